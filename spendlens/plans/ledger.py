"""Row counts of a population pull, measured in the job that pulls it.

``observed_pull`` returns the population with observed metrics in its plan and a
``PullLedger``; whatever action runs on the population first fills the ledger,
with no further reading.  Steps: rows in the window, with a person, people
(latest survey each), people with a row in each relation, with a category, and
those that the base drops for a missing first year or customer value.

Metrics are counters that tasks report: a task that Spark runs a second time
after a lost executor may report twice, so a ledger describes a run and no
result depends on it; ``consistent`` tells a ledger whose steps do not add up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.recodes import Labels
from spendlens.plans.population import KEY, PARTS, _date, build_population

SCHEMA = "step_no int, step string, n_rows long"


def _n(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


@dataclass(frozen=True)
class PullLedger:
    window: Observation
    people: Observation

    def counts(self) -> dict[str, int]:
        """The steps in order; waits for an action on the population that has read all of it."""
        return {**self.window.get, **self.people.get}

    def consistent(self) -> bool:
        n = self.counts()
        parts = all(n[k] <= n["people"] for k in n if k.startswith("in_") and k != "in_window")
        return n["people"] <= n["with_person"] <= n["in_window"] and parts and (
            n["with_category"] == n["without_first_year"] + n["without_customer_value"] + n["base"])

    def frame(self, spark: SparkSession) -> DataFrame:
        """``(step_no, step, n_rows)``: a dozen rows."""
        return spark.createDataFrame([(i, step, n) for i, (step, n) in enumerate(self.counts().items())], SCHEMA)


def observed_pull(tables: Mapping[str, DataFrame], start, end, labels: Labels, columns: Sequence[str] | None = None, **options) -> tuple[DataFrame, PullLedger]:
    """``build_population`` with a ledger; the columns that the steps ask about are pulled too and dropped again."""
    window, people = Observation("pull_window"), Observation("pull_people")
    survey = tables["survey"].where(F.col("survey_dt").between(_date(start), _date(end))).observe(
        window, F.count(F.lit(1)).alias("in_window"), _n(F.col(KEY).isNotNull(), "with_person"))
    asked = ["category", "own_rev_y1", "own_rev_y2", "cust_value", "total_revenue_y2", "age_band"]
    pulled = None if columns is None else [*dict.fromkeys([*columns, *asked])]
    df = build_population({**tables, "survey": survey}, start, end, labels, pulled, flags=True, **options)
    known, first, value = F.col("category").isNotNull(), F.col("own_rev_y1").isNotNull(), F.col("cust_value").isNotNull()
    df = df.observe(people, F.count(F.lit(1)).alias("people"), *[_n(F.col(f"in_{r}"), f"in_{r}") for r in PARTS], _n(known, "with_category"),
                    _n(known & ~first, "without_first_year"), _n(known & first & ~value, "without_customer_value"), _n(known & first & value, "base"))
    flags = [f"in_{r}" for r in PARTS]
    return df.drop(*flags) if columns is None else df.select(KEY, *[c for c in columns if c != KEY]), PullLedger(window, people)
