"""Roll-up cube: mergeable sufficient statistics, stored once, from which any slice along its dimensions is reported.

A cell (one value of every dimension) holds its rows, and per measure the
non-null count, the exact sum and the exact sum of squares (decimals), so cells
add up: the statistics of a union are the sums of the cells'.  Levels of
categorical variables are dimensions, so their counts are sums of rows.  The
size depends on days x stages x categories x levels, not on people.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.operators.summary import ratio_of


def build_cube(df: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """``(dimensions..., n_rows, n_m, sum_m, square_m for each measure m)``; one aggregate, nulls are dimension values."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        aggs += [F.count(m).alias(f"n_{m}"), F.sum(m).alias(f"sum_{m}"), F.sum(F.col(m) * F.col(m)).alias(f"square_{m}")]
    return df.groupBy(*dimensions).agg(*aggs)


def merge_cubes(a: DataFrame, b: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """The cube of two sets of rows, from their cubes."""
    return a.unionByName(b).groupBy(*dimensions).agg(*[F.sum(c).alias(c) for c in a.columns if c not in dimensions])


def cube_measures(cube: DataFrame, measures: Sequence[str], by: str, keys: Sequence[str] = (), ratios: Sequence[tuple[str, str, str]] = (),
                  share_mode="epsilon", extra: Sequence[Column] = ()) -> DataFrame:
    """What ``summary.group_measures`` gives for the people, from the cells: (keys, by) and (keys)."""
    aggs = [F.sum("n_rows").cast("long").alias("n_rows")]
    for m in measures:
        aggs += [F.sum(f"n_{m}").cast("long").alias(f"n_{m}"), F.sum(f"sum_{m}").alias(f"_sum_{m}"), F.sum(f"square_{m}").alias(f"_square_{m}")]
    out = cube.groupingSets([[*keys, by], [*keys]], *keys, by).agg(*aggs, *extra, F.grouping(by).alias("_overall"))
    for m in measures:
        n, total = F.col(f"n_{m}"), F.col(f"_sum_{m}").cast("double")
        spread = F.greatest(F.lit(0.0), F.col(f"_square_{m}").cast("double") - total * (total / n))
        out = out.withColumns({f"mean_{m}": F.when(n > 0, total / n), f"sd_{m}": F.when(n > 1, F.sqrt(spread / (n - 1)))})
    ratio = ratio_of(share_mode)
    zero = lambda c: F.coalesce(F.col(f"_sum_{c}"), F.lit(0)).cast("double")
    out = out.withColumns({name: ratio(zero(num), zero(den)) for num, den, name in ratios}) if ratios else out
    return out.drop(*[f"{p}_{m}" for m in measures for p in ("_sum", "_square")])


def cube_levels(cube: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """What ``summary.level_counts`` gives for the people, from the cells."""
    return cube.groupBy(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).agg(F.sum("n_rows").alias("n_rows"))
