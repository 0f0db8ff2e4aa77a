"""Ratio of sums per group (share of spend), attached back to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.numeric import safe_ratio_pct
from spendlens.operators.attach import attach


def group_share(df: DataFrame, specs: Sequence[tuple[str, str, str]], by: Sequence[str],
                mode: str = "epsilon") -> DataFrame:
    """``100 * sum(num) / guarded(sum(den))`` per group, one row per group.

    ``specs``: (numerator column, denominator column, output column).
    Sums of all-null columns count as 0, so a group without any value gets
    share 0 instead of null.  Null group keys are dropped.
    """
    aggs, outs = [], []
    for num, den, out in specs:
        aggs += [F.coalesce(F.sum(num), F.lit(0)).alias(f"_n_{out}"),
                 F.coalesce(F.sum(den), F.lit(0)).alias(f"_d_{out}")]
        outs.append(safe_ratio_pct(F.col(f"_n_{out}"), F.col(f"_d_{out}"), mode).alias(out))
    keyed = df
    for k in by:
        keyed = keyed.where(F.col(k).isNotNull())
    return keyed.groupBy(*by).agg(*aggs).select(*by, *outs)


def with_group_share(df: DataFrame, specs: Sequence[tuple[str, str, str]], by: Sequence[str],
                     mode: str = "epsilon", spread: str | None = None) -> DataFrame:
    """Attach the group shares to each row (rows with a null key are dropped).

    Reports do not need this: a share is a measure of the report's own
    aggregate.  It is for shares of another set of rows than the report's.
    """
    rows = df.drop(*[out for _, _, out in specs])
    return attach(rows, group_share(df, specs, by, mode), list(by), spread)
