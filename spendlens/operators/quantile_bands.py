"""Exact quantile bands (deciles), per group, by distributed multi-rank selection.

Band rule (0-based order statistics x_(k) of the n non-null values of a group):

    e_i = x_(floor((n - 1) * i / q)),  i = 0..q
    band(x) = 1 + #{ i in 1..q-1 : x > e_i }

This is the linear-interpolated, right-closed cut (lowest value included)
evaluated on integer positions: no value lies strictly between two adjacent
order statistics, so comparing with the lower one decides, with no float
interpolation.  Duplicate edges raise, like the analysed workload, or merge.

``quantile_edges`` finds the order statistics of all groups; edges are rows,
and no value of the data is collected.  A *part* is a group, or an interval of one that
holds a wanted rank.  Parts of at most ``leaf_rows`` values are aggregated to
(value, count) and ranked by running counts.  A larger part is cut: a mergeable
sketch gives it up to ``splits`` split values, a row's cell is its place among
them (the values equal to a split are a cell of their own, so a value repeated by a
third of all rows is settled by its count), running counts of the cells say
which wanted ranks a cell covers, and the cells that cover any are the next
parts.  A round keeps about (q + 1) / ``splits`` of the rows, so a few rounds
reach any size, and every cell is smaller than its part, so it always ends.
Which ranks a value covers is arithmetic on its running count; no list of
targets is joined.  A job asks for the largest part; a round's split values and
cell counts (at most 2 * ``splits`` a part) are written and read back, so that
a round adds two joins with files to the rows' plan instead of copies of it, and
every reader cuts at the same values (a sketch taken twice may differ).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators.attach import attach
from spendlens.session import kept, reused

LEAF_ROWS = 250_000
SPLITS = 64
_KEY = ["_g", "_part"]


class Edges(list):
    """Lower order statistics e_0..e_q (what the band rule compares with); ``interpolated``: the exact cut points;
    ``again``: cut i equals cut i - 1."""

    def __init__(self, lower, interpolated, again):
        super().__init__(lower)
        self.interpolated, self.again = interpolated, again


def _covered(lo: Column, hi: Column, last: Column, q: int, up: int) -> tuple[Column, Column]:
    """The first and last i of 0..q whose position (n - 1) * i / q, rounded down (``up`` 0) or up (1), is a rank of [lo, hi).

    ``last`` is n - 1; everything is integer arithmetic.
    """
    def floor_div(a: Column) -> Column:  # a / last for last > 0, rounded down
        return F.floor((a - F.pmod(a, last)) / last).cast("long")

    if up:  # ceil(p) >= lo  <=>  p > lo - 1, and ceil(p) < hi  <=>  p <= hi - 1
        first, final = floor_div((lo - 1) * q) + 1, floor_div((hi - 1) * q)
    else:  # floor(p) >= lo  <=>  p >= lo, and floor(p) < hi  <=>  p < hi
        first, final = -floor_div(-lo * q), -floor_div(-hi * q) - 1
    one = last == 0  # a single value: all positions are 0
    hit = (lo <= 0) & (hi > 0)
    return (F.when(one, F.when(hit, 0).otherwise(1)).otherwise(F.greatest(first, F.lit(0))),
            F.when(one, F.when(hit, q).otherwise(0)).otherwise(F.least(final, F.lit(q))))


def _hits(ranked: DataFrame, q: int) -> DataFrame:
    """``(_g, i, n, lower, upper)`` of the wanted ranks that values ``_v`` with ranks [_lo, _hi) cover."""
    none, value, covered = F.lit(None).cast("double"), F.col("_v"), []
    for up, (lower, upper) in enumerate([(value, none), (none, value)]):
        first, final = (x.cast("int") for x in _covered(F.col("_lo"), F.col("_hi"), F.col("_n") - 1, q, up))
        places = F.when(first <= final, F.sequence(first, final)).otherwise(F.array().cast("array<int>"))
        covered.append(F.transform(places, lambda i: F.struct(i.alias("i"), lower.alias("lower"), upper.alias("upper"))))  # noqa: B023
    return ranked.select("_g", F.col("_n").alias("n"), F.explode(F.concat(*covered)).alias("r")).select("_g", "r.i", "n", "r.lower", "r.upper")


def _running(counted: DataFrame, order: str) -> DataFrame:
    """Ranks [_lo, _hi) in the group, from counts ``c`` in the order of ``order`` within the part."""
    within = Window.partitionBy(*_KEY).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_hi", F.sum("c").over(within) + F.col("_before")).withColumn("_lo", F.col("_hi") - F.col("c"))


def quantile_edges(df: DataFrame, col: str, q: int = 10, by: str | None = None, leaf_rows: int = LEAF_ROWS, splits: int = SPLITS) -> DataFrame:
    """``(group, i, n, lower, upper)``: for each group and i of 0..q the order statistics around position (n - 1) * i / q.

    ``lower`` is e_i.  The group column has ``by``'s name (``group`` for the whole
    frame); null is a group like any other; null and NaN values are none, and a
    group without values has no edges; infinities are values.
    """
    group = F.col(by) if by else F.lit(0)
    v = F.col(col).cast("double")
    rows = df.select(group.alias("_g"), F.lit("").alias("_part"), v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    parts = reused(rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_size")).withColumns({"_n": F.col("_size"), "_before": F.lit(0).cast("long")}))
    found, leaves = [], []
    count = F.count(F.lit(1)).alias("c")
    while (parts.agg(F.max("_size")).first()[0] or 0) > leaf_rows:
        parts = parts if found else kept(parts, "groups")
        inside = attach(rows, parts, _KEY, spread="_v", sizes="_size")
        leaves.append(inside.where(F.col("_size") <= leaf_rows).groupBy(*_KEY, "_n", "_before", "_size", "_v").agg(count))
        rows, parts, settled = _cut(inside.where(F.col("_size") > leaf_rows), q, splits)
        found.append(settled)
    leaves.append(attach(rows.groupBy(*_KEY, "_v").agg(count), parts, _KEY))  # at most leaf_rows of a key
    values = leaves[0]
    for leaf in leaves[1:]:
        values = values.unionByName(leaf)
    edges = _hits(_running(values, "_v"), q)
    for settled in found:
        edges = edges.unionByName(settled)
    edges = edges.groupBy("_g", "i", "n").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    return edges.withColumnRenamed("_g", by or "group")


def _cut(inside: DataFrame, q: int, splits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: the rows and the parts that go on, and the edges settled by repeated values."""
    grid = [k / splits for k in range(1, splits)]
    sketch = inside.groupBy(*_KEY).agg(F.max("_size").alias("_rows"), F.percentile_approx("_v", grid, 100 * splits).alias("_at"))
    sketch = kept(sketch.withColumn("_at", F.array_sort(F.array_distinct("_at"))), "splits")
    cell = F.size(F.filter("_at", lambda s: s < F.col("_v"))) * 2 + F.array_contains("_at", F.col("_v")).cast("int")
    celled = attach(inside, sketch, _KEY, spread="_v", sizes="_rows").withColumn("_cell", cell)
    counted = celled.groupBy(*_KEY, "_n", "_before", "_cell").agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("_v"))
    ranked = kept(_running(counted, "_cell"), "cells")
    last = F.col("_n") - 1
    wanted = [first <= final for first, final in (_covered(F.col("_lo"), F.col("_hi"), last, q, up) for up in (0, 1))]
    settled = F.col("_cell") % 2 == 1
    part = F.concat_ws(".", "_part", F.col("_cell").cast("string"))
    open_cells = ranked.where(~settled & (wanted[0] | wanted[1]))
    parts = open_cells.select("_g", part.alias("_part"), F.col("c").alias("_size"), "_n", F.col("_lo").alias("_before"))
    going = celled.where(F.col("_cell") % 2 == 0).select("_g", part.alias("_part"), "_v")
    return going, parts, _hits(ranked.where(settled), q)


def _edge_lists(edges: DataFrame, group: str) -> DataFrame:
    """``(group, lower, upper)``: the edges of a group as arrays (q + 1 long)."""
    each = F.sort_array(F.collect_list(F.struct("i", "lower", "upper")))
    return edges.groupBy(group).agg(each.alias("_e")).select(group, F.col("_e.lower").alias("lower"), F.col("_e.upper").alias("upper"))


def interior_edges(edges: DataFrame, group: str = "group", on_duplicates: str = "raise") -> DataFrame:
    """``(group, interior)``: the edges that the band rule compares with, after the duplicate policy.

    Duplicates are judged on the interpolated cut points (two equal lower order
    statistics need not give equal ones): cut i + 1 equals cut i when the upper
    statistic of i + 1 is the lower one of i.  ``raise`` fails the job, ``merge``
    drops the repeated cut, as a quantile cut that drops duplicate bins does.
    """
    if on_duplicates not in ("raise", "merge"):
        raise ValueError(f"unknown on_duplicates {on_duplicates!r}")
    lists = _edge_lists(edges, group)
    inner = F.expr("transform(sequence(1, size(lower) - 2), k -> struct(lower[k] AS e, upper[k] = lower[k - 1] AS again))")
    again = F.expr("exists(sequence(1, size(lower) - 1), k -> upper[k] = lower[k - 1])")
    if on_duplicates == "merge":
        kept = F.filter(inner, lambda x: ~x["again"])
    else:
        shown = F.concat(F.lit("Bin edges must be unique: "), F.array_join(F.transform("lower", lambda x: x.cast("string")), ", "))
        kept = F.when(again, F.raise_error(shown).cast("array<struct<e:double,again:boolean>>")).otherwise(inner)
    return lists.select(group, F.transform(kept, lambda x: x["e"]).alias("interior"))


def with_group_band(df: DataFrame, col: str, by: str, edges: DataFrame, out: str = "band", on_duplicates: str = "raise") -> DataFrame:
    """Add ``out``: the band of ``col`` among the edges of the row's group (null without a value or edges)."""
    value = F.col(col).cast("double")
    joined = attach(df, interior_edges(edges, by, on_duplicates).withColumnRenamed("interior", "_interior"), [by], spread=col, how="left")
    band = F.size(F.filter("_interior", lambda e: e < value)) + 1
    return joined.withColumn(out, F.when(value.isNotNull() & F.col("_interior").isNotNull(), band)).drop("_interior")


def band_bounds(edges: DataFrame, by: str) -> DataFrame:
    """``(by, band, lo, hi)``: the lower order statistics around each band."""
    lists = _edge_lists(edges, by)
    return lists.select(by, F.posexplode(F.expr("transform(sequence(1, size(lower) - 1), k -> struct(lower[k - 1] AS lo, lower[k] AS hi))")).alias("k", "r")) \
        .select(by, (F.col("k") + 1).alias("band"), "r.lo", "r.hi")


def _decimal_text(x: Column, precision: int) -> Column:
    """A rounded double in plain notation, at least one digit after the point."""
    text = F.regexp_replace(F.regexp_replace(x.cast(f"decimal(38,{precision})").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(x.isin(float("inf"), float("-inf")), F.lower(F.substring(x.cast("string"), 1, 4))).otherwise(text)


def band_intervals(edges: DataFrame, by: str, precision: int = 3) -> DataFrame:
    """``(by, band, lo, hi, label)`` of every band: the interpolated cut points ``(lo, hi]`` at ``precision`` decimals,
    the lowest nudged down so that it lies inside."""
    q = F.max("i").over(Window.partitionBy(by))  # q + 1 rows a group
    part = F.pmod((F.col("n") - 1) * F.col("i"), F.col("q")) / F.col("q")
    cut = F.col("lower") + F.when(F.col("upper") == F.col("lower"), 0.0).otherwise((F.col("upper") - F.col("lower")) * part)
    cuts = edges.withColumn("q", q).select(by, "i", F.round(cut, precision).alias("cut"))
    cuts = cuts.withColumn("cut", F.when(F.col("i") == 0, F.round(F.col("cut") - 10.0 ** -precision, precision)).otherwise(F.col("cut")))
    before = F.lag("cut").over(Window.partitionBy(by).orderBy("i"))
    bands = cuts.withColumn("lo", before).where("i > 0").select(by, F.col("i").alias("band"), "lo", F.col("cut").alias("hi"))
    label = F.concat(F.lit("("), _decimal_text(F.col("lo"), precision), F.lit(", "), _decimal_text(F.col("hi"), precision), F.lit("]"))
    return bands.withColumn("label", label)


def exact_quantile_edges(df: DataFrame, col: str, q: int = 10, by: str | None = None, **options) -> dict:
    """The same as {group: Edges([e_0, ..., e_q])}, for a caller with few groups: (q + 1) rows a group are collected."""
    rows = quantile_edges(df, col, q, by, **options).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[by] if by else None, {})[r.i] = r
    out = {}
    for g, found in groups.items():
        lower, upper = ([getattr(found[i], side) for i in range(q + 1)] for side in ("lower", "upper"))
        again = [i > 0 and upper[i] == lower[i - 1] for i in range(q + 1)]
        out[g] = Edges(lower, [_interpolated(found[i], q) for i in range(q + 1)], again)
    return out if by else {None: out.get(None, Edges([], [], []))}


def _interpolated(row, q: int):
    infinite = [x for x in (row.lower, row.upper) if abs(x) == float("inf")]
    if infinite:
        return infinite[0]
    return Fraction(row.lower) + Fraction((row.n - 1) * row.i % q, q) * (Fraction(row.upper) - Fraction(row.lower))


def check_edges(edges: list, on_duplicates: str = "raise") -> list:
    """Interior edges of one group used by the band rule, after the duplicate policy (see ``interior_edges``)."""
    if not edges:
        return []
    again = getattr(edges, "again", None) or [i > 0 and e == edges[i - 1] for i, e in enumerate(edges)]
    if on_duplicates not in ("raise", "merge"):
        raise ValueError(f"unknown on_duplicates {on_duplicates!r}")
    if any(again) and on_duplicates == "raise":
        raise ValueError(f"Bin edges must be unique: {list(edges)}")
    return [e for e, same in list(zip(edges, again, strict=True))[1:-1] if not same]


def band_expr(x: Column, interior: list) -> Column:
    """1 + number of interior edges strictly below x (null for null x)."""
    if not interior:
        return F.when(x.isNotNull(), F.lit(1))
    out = F.lit(1)
    for e in interior:
        out = out + (x > F.lit(float(e))).cast("int")
    return out


def with_value_band(df: DataFrame, col: str, out: str = "value_band", q: int = 10,
                    on_duplicates: str = "raise", **options) -> DataFrame:
    """Add ``out`` = decile band of ``col`` over the whole frame (its q + 1 edges are literals of the plan)."""
    edges = exact_quantile_edges(df, col, q, **options)[None]
    return df.withColumn(out, band_expr(F.col(col), check_edges(edges, on_duplicates)))
