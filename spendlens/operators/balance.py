"""Exact-size, seeded, stratified down-sampling that balances categories.

Quotas (stratum s, category c, N_c rows of the category):
    share_c(s) = count_c(s) / N_c
    least(s)   = least share_c(s) of the two reference categories
    quota_c(s) = min(count_c(s), floor(N_c * least(s)))
Other categories are only capped, so they may stay unbalanced.
``quota='double'`` does this in floating point, where ``floor(49 * (1/49))`` is 0;
``quota='exact'`` in integers (decimal(38,0) products).

Sample: of each (stratum, category) the ``quota`` rows with the smallest
``md5('<seed>:<id>')`` (ties by id).  The order depends on seed and id only,
never on partitioning, so it can be checked against SQL.

Plan: the rows are read twice.  The first reading counts them by (group, first
bits of the hash); group counts, quotas and how many rows each bucket still has
to give (all, some, none) come from these counts, which are kept.  The second
reading joins the rows with that by (group, bucket) and numbers each bucket's rows by
hash: both need the same partitioning, so it is one shuffle, and a bucket is
1 / 2**hash_bits of a group, so one with a third of all rows is spread over as many
tasks.  Nothing is collected, no job runs while building.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.operators.attach import attach, attach_totals
from spendlens.session import reused

CATEGORIES = ("Detractor", "Passive", "Promoter")
REF_PAIR = ("Detractor", "Promoter")
HASH_BITS = 12


def sample_key(seed, id_col: str) -> Column:
    """md5 of '<seed>:<id>' as lowercase hex (identical in Spark and DuckDB)."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(s.cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def _hash_bucket(h: Column, bits: int) -> Column:
    """The first ``bits`` (up to 32) bits of a hex hash."""
    return F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), 32 - bits)


def _shares(counts: DataFrame, strata: Sequence[str], category: str, categories: Sequence[str], ref_pair, by: Sequence[str]) -> DataFrame:
    """Wide counts, totals and shares per (by, stratum) from ``(by, strata, category, n)``."""
    keys = [*by, *strata]
    wide = counts.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col(category) == F.lit(c), F.col("n"))), F.lit(0)).cast("long").alias(f"n_{c}") for c in categories])
    totals = wide.groupBy(*by).agg(*[F.sum(f"n_{c}").cast("long").alias(f"total_{c}") for c in categories])
    out = attach_totals(wide, totals, by)
    out = out.withColumns({f"share_{c}": F.when(F.col(f"total_{c}") > 0, F.col(f"n_{c}") / F.col(f"total_{c}")).otherwise(F.lit(0.0))
                           for c in categories})
    a, b = ref_pair
    return out.withColumn("least_share", F.least(f"share_{a}", f"share_{b}"))


def stratum_counts(df: DataFrame, strata: Sequence[str], category: str = "category", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, *strata, category).agg(F.count(F.lit(1)).alias("n"))


def stratum_shares(df: DataFrame, strata: Sequence[str], category: str = "category", categories: Sequence[str] = CATEGORIES,
                   ref_pair=REF_PAIR, by: Sequence[str] = ()) -> DataFrame:
    """Counts, totals, column shares, the least share of the reference pair and
    its part of all least shares (a diagnostic that no quota uses)."""
    sh = _shares(stratum_counts(df, strata, category, by), strata, category, categories, ref_pair, by)
    total = sh.groupBy(*by).agg(F.sum("least_share").alias("_sum"))
    out = attach_totals(sh, total, by)
    out = out.withColumn("least_share_norm", F.when(F.col("_sum") > 0, F.col("least_share") / F.col("_sum")))
    return out.select(*by, *strata, *[f"{p}_{c}" for p in ("n", "total", "share") for c in categories], "least_share", "least_share_norm")


def _quotas(counts: DataFrame, strata: Sequence[str], category: str, categories: Sequence[str], ref_pair, by: Sequence[str], quota: str) -> DataFrame:
    sh = _shares(counts, strata, category, categories, ref_pair, by)
    a, b = ref_pair
    each = []
    for c in categories:
        if quota == "double":
            q = F.floor(F.col(f"total_{c}").cast("double") * F.col("least_share"))
        elif quota == "exact":
            big = lambda x: f"CAST({x} AS DECIMAL(19, 0))"
            q = F.expr(
                f"CASE WHEN total_{a} = 0 OR total_{b} = 0 THEN 0 "
                f"WHEN {big(f'n_{a}')} * {big(f'total_{b}')} <= {big(f'n_{b}')} * {big(f'total_{a}')} "
                f"THEN ({big(f'total_{c}')} * {big(f'n_{a}')}) div {big(f'total_{a}')} "
                f"ELSE ({big(f'total_{c}')} * {big(f'n_{b}')}) div {big(f'total_{b}')} END")
        else:
            raise ValueError(f"unknown quota mode {quota!r}")
        capped = F.least(F.col(f"n_{c}"), F.coalesce(q.cast("long"), F.lit(0).cast("long")))
        each.append(F.struct(F.lit(c).alias(category), F.col(f"n_{c}").alias("available"), capped.alias("quota")))
    return sh.select(*by, *strata, F.explode(F.array(*each)).alias("q")).select(*by, *strata, "q.*")


def balance_quota(df: DataFrame, strata: Sequence[str], category: str = "category", categories: Sequence[str] = CATEGORIES,
                  ref_pair=REF_PAIR, by: Sequence[str] = (), quota: str = "double") -> DataFrame:
    """One row per (by, stratum, category) with its quota and available count."""
    return _quotas(stratum_counts(df, strata, category, by), strata, category, categories, ref_pair, by, quota)


def mark_sample(df: DataFrame, strata: Sequence[str], category: str = "category", ref_pair=REF_PAIR, id_col: str = "party_id", seed=0,
                categories: Sequence[str] = CATEGORIES, by: Sequence[str] = (), quota: str = "double",
                hash_bits: int = HASH_BITS, mark: str = "sampled") -> DataFrame:
    """``df`` with a boolean column: the row is in the balanced sample.

    ``by`` balances each group (e.g. cohort) on its own; ``seed`` may be a column
    (one seed per group).  Rows of a category that is not in ``categories`` are in
    no sample (``balance_diagnostics`` reports them).
    """
    group = [*by, *strata, category]
    h = sample_key(seed, id_col)
    hashed = df.withColumns({"_h": h, "_b": _hash_bucket(h, hash_bits)})
    buckets = reused(hashed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("c")))
    counts = buckets.groupBy(*group).agg(F.sum("c").alias("n"))
    quotas = _quotas(counts, strata, category, categories, ref_pair, by, quota).where("quota > 0").select(*group, "quota")
    before = F.sum("c").over(Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # at most 2**hash_bits rows a group
    place = F.struct(*group, "_b")  # nulls inside it are equal, as in the grouping
    give = attach(buckets, quotas, group).withColumn("_give", F.col("quota") - F.coalesce(before, F.lit(0)))
    give = give.where("_give > 0").select(place.alias("_place"), "_give")
    placed = hashed.select(*df.columns, "_h", place.alias("_place")).join(give, "_place", "left")
    nth = F.row_number().over(Window.partitionBy("_place").orderBy("_h", id_col))
    return placed.select(*df.columns, F.coalesce(nth <= F.col("_give"), F.lit(False)).alias(mark))


def balance(df: DataFrame, strata: Sequence[str], **options) -> DataFrame:
    """The balanced sample of ``df`` (same columns); options as for ``mark_sample``."""
    return mark_sample(df, strata, **options, mark="_sampled").where("_sampled").drop("_sampled")


def balance_diagnostics(marked: DataFrame, category: str = "category", by: Sequence[str] = (), mark: str = "sampled") -> DataFrame:
    """Per (by, category), unknown categories included: rows available, rows sampled, sampled share in percent."""
    n = F.count(F.lit(1)).cast("long")
    out = marked.groupBy(*by, category).agg(n.alias("available"), F.count(F.when(F.col(mark), 1)).cast("long").alias("sampled"))
    return out.withColumn("sampled_pct", F.lit(100.0) * F.col("sampled") / F.col("available"))
