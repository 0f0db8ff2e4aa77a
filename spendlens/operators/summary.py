"""Grouped summaries in long numeric form (the "table one" of the analysis).

Continuous variables: per group and overall, rows, non-null n, missing, mean
and sample SD (nulls skipped, ddof = 1), and ratios of sums.  Categorical
variables: per group and overall, count per level and percent within the group.

Each is one aggregate over the data (partial aggregation map-side); the reshape
to long form, overall rows of levels and percent denominators work on the
aggregated rows.  Totals are told from a real null key by ``grouping()``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.numeric import safe_ratio_pct
from spendlens.operators.attach import attach_totals

OVERALL = "Overall"


def ratio_of(mode: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return mode if callable(mode) else lambda num, den: safe_ratio_pct(num, den, mode)


def group_measures(df: DataFrame, columns: Sequence[str], by: str, keys: Sequence[str] = (),
                   ratios: Sequence[tuple[str, str, str]] = (), share_mode="epsilon", extra: Sequence[Column] = ()) -> DataFrame:
    """The one aggregate: (keys, by) and (keys) with ``n_rows``, per column ``n_``, ``mean_``, ``sd_``, per ratio its value.

    A mean of decimals is one double division of exact totals.  ``_overall`` is
    1 in the rows over all groups.
    """
    types = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).cast("long").alias("n_rows")]
    for c in columns:
        total = F.sum(c).cast("double") if types[c].startswith("decimal") else F.sum(F.col(c).cast("double"))
        aggs += [F.count(c).cast("long").alias(f"n_{c}"), F.when(F.count(c) > 0, total / F.count(c)).alias(f"mean_{c}"),
                 F.stddev_samp(F.col(c).cast("double")).alias(f"sd_{c}")]
    ratio = ratio_of(share_mode)
    for num, den, out in ratios:
        aggs += [F.coalesce(F.sum(num), F.lit(0)).cast("double").alias(f"_num_{out}"), F.coalesce(F.sum(den), F.lit(0)).cast("double").alias(f"_den_{out}")]
    agg = df.groupingSets([[*keys, by], [*keys]], *keys, by).agg(*aggs, *extra, F.grouping(by).alias("_overall"))
    return agg.withColumns({out: ratio(F.col(f"_num_{out}"), F.col(f"_den_{out}")) for _, _, out in ratios}) if ratios else agg


def summarize_continuous(df: DataFrame, columns: Sequence[str], by: str = "category", keys: Sequence[str] = (),
                         ratios: Sequence[tuple[str, str, str]] = (), share_mode="epsilon", overall: str = OVERALL,
                         overall_ratio: str = "true") -> DataFrame:
    """Long rows (keys..., variable, group, n_rows, n, n_missing, mean, sd).

    A ratio (numerator, denominator, name) is a constant of its group: mean is
    the ratio, SD 0.  Its overall row is the ratio of all rows (no SD), or with
    ``overall_ratio='mean'`` mean and SD of the groups' constants over the rows of
    the groups (rows with a null group left out).
    """
    if overall_ratio not in ("true", "mean"):
        raise ValueError(f"unknown overall_ratio {overall_ratio!r}")
    agg = group_measures(df, columns, by, keys, ratios, share_mode)
    if ratios and overall_ratio == "mean":
        named = agg.where((F.col("_overall") == 0) & F.col(by).isNotNull())
        total = F.sum("n_rows")
        sums = [x for _, _, out in ratios for x in ((F.sum(F.col("n_rows") * F.col(out)) / total).alias(f"_mean_{out}"),
                                                    (F.sum(F.col("n_rows") * F.col(out) * F.col(out)) / total).alias(f"_square_{out}"))]
        agg = attach_totals(agg, named.groupBy(*keys).agg(total.alias("_total"), *sums), keys, how="left")
        for _, _, out in ratios:
            variance = F.greatest(F.lit(0.0), F.col(f"_square_{out}") - F.pow(f"_mean_{out}", F.lit(2))) * F.col("_total") / (F.col("_total") - 1)
            agg = agg.withColumn(f"_sd_{out}", F.when(F.col("_total") > 1, F.sqrt(variance)))
    return continuous_rows(agg, columns, by, keys, ratios, overall, overall_ratio)


def continuous_rows(agg: DataFrame, columns: Sequence[str], by: str = "category", keys: Sequence[str] = (),
                    ratios: Sequence[tuple[str, str, str]] = (), overall: str = OVERALL, overall_ratio: str = "true") -> DataFrame:
    """The long rows of measures by (keys, by) and (keys)."""
    is_overall = F.col("_overall") == 1
    label = F.when(is_overall, F.lit(overall)).otherwise(F.col(by).cast("string"))
    rows = [F.struct(F.lit(c).alias("variable"), F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("mean"), F.col(f"sd_{c}").alias("sd"))
            for c in columns]
    for _, _, out in ratios:
        mean, sd = F.col(out), F.when(~is_overall & (F.col("n_rows") > 1), F.lit(0.0))
        if overall_ratio == "mean":
            mean, sd = F.when(is_overall, F.col(f"_mean_{out}")).otherwise(mean), F.when(is_overall, F.col(f"_sd_{out}")).otherwise(sd)
        rows.append(F.struct(F.lit(out).alias("variable"), F.col("n_rows").alias("n"), mean.alias("mean"), sd.alias("sd")))
    return (agg.select(*keys, label.alias("group"), "n_rows", F.explode(F.array(*rows)).alias("r"))
            .select(*keys, "r.variable", "group", "n_rows", "r.n", (F.col("n_rows") - F.col("r.n")).alias("n_missing"), "r.mean", "r.sd"))


def level_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows by combination of levels (``n_rows``): what categorical summaries are made from."""
    return df.groupBy(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).agg(F.count(F.lit(1)).alias("n_rows"))


def summarize_levels(counts: DataFrame, columns: Sequence[str], by: str, keys: Sequence[str] = (), overall: str = OVERALL,
                     include_null: bool = False) -> DataFrame:
    """Long rows (keys..., variable, level, group, n, pct) of ``level_counts``.

    pct = 100 * n / (non-null rows of the variable in the group); with
    ``include_null`` null levels count in the denominator and get a percent.
    Without it the null level is reported with n only: the missing count.
    """
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("level")) for c in columns])
    long = counts.select(*keys, by, "n_rows", F.explode(each).alias("r")).select(*keys, by, "n_rows", "r.variable", "r.level")
    sets = [[*keys, "variable", "level", by], [*keys, "variable", "level"]]
    agg = long.groupingSets(sets, *keys, "variable", "level", by).agg(F.sum("n_rows").cast("long").alias("n"), F.grouping(by).alias("g"))
    agg = agg.select(*keys, "variable", "level", F.when(F.col("g") == 1, F.lit(overall)).otherwise(F.col(by).cast("string")).alias("group"), "n")
    counted = F.col("n") if include_null else F.when(F.col("level").isNotNull(), F.col("n"))
    den = F.sum(counted).over(Window.partitionBy(*keys, "variable", "group"))  # a row per level
    pct = F.when(counted.isNotNull() & (den > 0), F.lit(100.0) * F.col("n") / den)
    return agg.withColumn("pct", pct.cast("double"))


def summarize_categorical(df: DataFrame, columns: Sequence[str], by: str = "category", keys: Sequence[str] = (),
                          overall: str = OVERALL, include_null: bool = False) -> DataFrame:
    return summarize_levels(level_counts(df, columns, [*keys, by]), columns, by, keys, overall, include_null)
