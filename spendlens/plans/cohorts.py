"""Cohort grid: {6 m, 3 m, 1 m, one stage} x {raw, balanced} in one plan.

Instead of eight separate reports (eight scans, eight balancings), each base
row is tagged with the cohorts it belongs to and exploded once; balancing and
summaries are then grouped by cohort, so every step is one aggregate over all
cohorts together.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.numeric import safe_ratio_pct
from spendlens.operators.balance import mark_sample

# The balancing strata of the analysed workload
REF_STRATA = ["value_band", "stage", "age_band", "intent", "tenure"]
RAW, BALANCED = "raw", "balanced"


@dataclass(frozen=True)
class Cohort:
    name: str
    seed: int
    start: dt.date | None = None
    end: dt.date | None = None
    stage: str | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        if self.start is not None:
            c = c & (F.col("survey_dt") >= F.lit(self.start.isoformat()).cast("date"))
        if self.end is not None:
            c = c & (F.col("survey_dt") <= F.lit(self.end.isoformat()).cast("date"))
        if self.stage is not None:
            c = c & (F.col("stage") == F.lit(self.stage))
        return c


def explode_cohorts(df: DataFrame, cohorts: Sequence[Cohort]) -> DataFrame:
    """One row per (cohort, member row) with columns cohort and seed (narrow, no shuffle)."""
    tags = F.array(*[F.when(c.condition(), F.struct(F.lit(c.name).alias("cohort"),
                                                     F.lit(c.seed).alias("seed")))
                     for c in cohorts])
    return (df.withColumn("_c", F.explode(F.array_compact(tags)))
            .select("_c.cohort", "_c.seed", *df.columns))


def cohort_frames(base: DataFrame, cohorts: Sequence[Cohort], strata: Sequence[str] = REF_STRATA, quota: str = "double") -> DataFrame:
    """Raw and balanced members of every cohort, tagged by ``variant``.

    A member is one row; it is doubled (narrow) where it is in the sample.
    """
    marked = mark_sample(explode_cohorts(base, cohorts), strata, by=["cohort"], seed=F.col("seed"), quota=quota, mark="_in")
    variants = F.array_compact(F.array(F.lit(RAW), F.when(F.col("_in"), F.lit(BALANCED))))
    return marked.withColumn("variant", F.explode(variants)).drop("_in")


def balanced_cohorts(base: DataFrame, cohorts: Sequence[Cohort], strata: Sequence[str] = REF_STRATA, quota: str = "double") -> DataFrame:
    """The balanced members of every cohort."""
    marked = mark_sample(explode_cohorts(base, cohorts), strata, by=["cohort"], seed=F.col("seed"), quota=quota, mark="_in")
    return marked.where("_in").drop("_in")


def variant_share(num: Column, den: Column) -> Column:
    """Shares of raw cohorts are signed, those of balanced ones clamped."""
    return F.when(F.col("variant") == BALANCED, safe_ratio_pct(num, den, "clamp")).otherwise(safe_ratio_pct(num, den, "epsilon"))
