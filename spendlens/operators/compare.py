"""Comparison of groups from moments and level counts, without another look at the rows.

``welch``: Welch's F over the groups' means (unequal variances), with its degrees
of freedom; ``chi_square``: Pearson's statistic of level against group;
``standardised_differences``: (mean a - mean b) / sqrt((var a + var b) / 2).  All
work on the few rows of ``summary.group_measures`` (or ``cube.cube_measures``) and of
``summary.level_counts``.  Groups with less than two values or without spread have
no weight in Welch's F: with one of them the statistic is null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _moments(agg: DataFrame, columns: Sequence[str], by: str, keys: Sequence[str]) -> DataFrame:
    """Long rows (keys..., variable, by, n, mean, var) of the groups."""
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("mean"),
                              (F.col(f"sd_{c}") * F.col(f"sd_{c}")).alias("var")) for c in columns])
    return agg.where((F.col("_overall") == 0) & F.col(by).isNotNull()).select(*keys, by, F.explode(each).alias("r")).select(*keys, by, "r.*")


def welch(agg: DataFrame, columns: Sequence[str], by: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., variable, statistic, df1, df2)."""
    group = F.struct(by, "n", "mean", (F.col("n") / F.nullif(F.col("var"), F.lit(0.0))).alias("w"))
    rows = _moments(agg, columns, by, keys).groupBy(*keys, "variable").agg(F.sort_array(F.collect_list(group)).alias("g"))  # a struct per group
    total = lambda of: F.aggregate("g", F.lit(0.0), lambda a, x: a + of(x))
    k = F.size("g")
    rows = rows.withColumn("sum_w", total(lambda x: x["w"]))
    rows = rows.withColumn("centre", total(lambda x: x["w"] * x["mean"]) / F.col("sum_w"))
    between = total(lambda x: x["w"] * (x["mean"] - F.col("centre")) * (x["mean"] - F.col("centre"))) / F.nullif(k - 1, F.lit(0))
    part = total(lambda x: (1 - x["w"] / F.col("sum_w")) * (1 - x["w"] / F.col("sum_w")) / F.nullif(x["n"] - 1, F.lit(0)))
    rows = rows.withColumns({"between": between, "part": part, "k2": F.nullif((k * k - 1).cast("double"), F.lit(0.0))})
    statistic = F.col("between") / (1 + 2 * (k - 2) * F.col("part") / F.col("k2"))
    known = k > 1
    return rows.select(*keys, "variable", F.when(known, statistic).alias("statistic"), (k - 1).cast("long").alias("df1"),
                       F.when(known & statistic.isNotNull(), F.col("k2") / F.nullif(3 * F.col("part"), F.lit(0.0))).alias("df2"))


def chi_square(counts: DataFrame, columns: Sequence[str], by: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., variable, statistic, df1, df2) of ``level_counts``; null levels and groups are left out, df2 is null."""
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in columns])
    cells = (counts.where(F.col(by).isNotNull()).select(*keys, by, "n_rows", F.explode(each).alias("r")).where("r.level IS NOT NULL")
             .groupBy(*keys, "r.variable", "r.level", by).agg(F.sum("n_rows").alias("n")))
    place = [*keys, "variable"]
    of = lambda *more: F.sum("n").over(Window.partitionBy(*place, *more))  # noqa: E731 - a row per level and group
    cells = cells.withColumns({"row": of("level"), "col": of(by), "all": of()})
    share = F.col("n").cast("double") * F.col("n") / (F.col("row").cast("double") * F.col("col"))
    out = cells.groupBy(*place).agg(F.sum(share).alias("share"), F.max("all").alias("all"), F.countDistinct("level").alias("levels"), F.countDistinct(by).alias("groups"))
    df = ((F.col("levels") - 1) * (F.col("groups") - 1)).alias("df1")
    return out.select(*place, F.greatest(F.col("all") * (F.col("share") - 1), F.lit(0.0)).alias("statistic"), df, F.lit(None).cast("double").alias("df2"))


def standardised_differences(agg: DataFrame, columns: Sequence[str], pair: tuple[str, str], by: str = "category", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., variable, difference) between two groups; null where one has no spread to measure or both have none."""
    rows = _moments(agg, columns, by, keys)
    pick = lambda name, c: F.max(F.when(F.col(by) == name, F.col(c)))
    a, b = pair
    spread: Column = F.sqrt((pick(a, "var") + pick(b, "var")) / 2)
    return rows.groupBy(*keys, "variable").agg(((pick(a, "mean") - pick(b, "mean")) / F.nullif(spread, F.lit(0.0))).alias("difference"))
