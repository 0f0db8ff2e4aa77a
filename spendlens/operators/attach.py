"""Join a table of group values back to the rows of the groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 256  # keys that may get salts; another one has less than a 256th of the rows
TRACKED = 4096  # counters of the sketch
LEAST_ROWS = 100_000  # rows of a key that one task takes without salts


def heavy_hitter_salts(rows: DataFrame, keys: Sequence[str], least_rows: int = LEAST_ROWS) -> Column:
    """``map<hash of the key, number of salts>`` of the keys with more rows than a task should take.

    A scalar subquery: a mergeable top-k sketch over the rows' keys, run with the
    query that uses it.  A task's due is its part of the rows (by
    ``spark.sql.shuffle.partitions``), ``least_rows`` at least.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = rows.select(F.xxhash64(*keys).alias("h"))
    sketch = hashed.agg(F.expr(f"approx_top_k(h, {HEAVY_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    due = F.greatest(F.col("n") / tasks, F.lit(float(least_rows)))
    heavy = F.filter("top", lambda t: t["count"] > due)
    entries = F.transform(heavy, lambda t: F.struct(t["item"], F.ceil(t["count"] / due).cast("int")))
    return sketch.select(F.map_from_entries(entries).alias("salts")).scalar()


def known_salts(table: DataFrame, keys: Sequence[str], sizes: str, least_rows: int = LEAST_ROWS) -> Column:
    """The same from a table with the rows of each key: fewer keys than tasks have more than a task's due."""
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = table.select(F.xxhash64(*keys).alias("h"), F.col(sizes).alias("n"))
    due = F.greatest(sized.agg(F.sum("n") / tasks).scalar(), F.lit(float(least_rows)))
    heavy = sized.groupBy("h").agg(F.ceil(F.sum("n") / due).cast("int").alias("n")).where("n > 1")
    return heavy.agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("salts")).scalar()


def attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: str | None = None,
           how: str = "inner", least_rows: int = LEAST_ROWS, sizes: str | None = None) -> DataFrame:
    """Equi-join where null matches null; ``table`` has one row per key.

    The planner chooses the strategy from the sizes it sees at run time.  Where
    that is a shuffle, a group with a third of all rows must not meet in one
    task: with ``spread`` (a column that differs within a group) a sketch of the
    rows finds the heavy keys, their rows are dealt to as many salts as the
    key's size asks for, and the table has a copy for each; all other keys have
    one place and one copy.  A wrong estimate costs balance, not a result.
    ``sizes`` names a column of the table with the rows of each key: then these
    decide, and the rows are not read for a sketch.
    """
    names = {k: f"_t_{k}" for k in keys}
    right = table.select(*[F.col(k).alias(v) for k, v in names.items()],
                         *[c for c in table.columns if c not in keys])
    left = rows
    on = [left[k].eqNullSafe(right[v]) for k, v in names.items()]
    if spread is not None:
        salts = known_salts(table, keys, sizes, least_rows) if sizes else heavy_hitter_salts(rows, keys, least_rows)
        of = lambda cols: F.coalesce(F.element_at(salts, F.xxhash64(*cols)), F.lit(1))
        left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), of(keys)).cast("int"))
        right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), of(names.values()) - 1)))
        on = [left[k].eqNullSafe(right[v]) for k, v in names.items()] + [left["_salt"] == right["_copy"]]
    return left.join(right, on, how).drop(*names.values(), "_salt", "_copy")


def attach_totals(rows: DataFrame, totals: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``attach`` by the groups ``by``; without any, the one row of ``totals`` comes as a scalar subquery instead of a
    join without a condition."""
    if by:
        return attach(rows, totals, by, how=how)
    one = totals.select(F.struct(*totals.columns).alias("one")).scalar()
    return rows.withColumn("_one", one).select(*rows.columns, "_one.*")
