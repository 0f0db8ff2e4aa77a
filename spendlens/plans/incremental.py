"""The latest survey per person as a stored state that batches of surveys move on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.operators.latest import latest_per_key, merge_latest
from spendlens.plans.population import KEY, _date
from spendlens.sources.versions import Version, VersionedTable


def _order() -> list[Column]:
    return [F.col("survey_dt").desc(), F.col("survey_id").desc()]


class LatestSurveys:
    """Latest survey per person of a date window, kept in a versioned table.

    A batch reads the stored state and itself, never earlier surveys; the new
    state becomes current when its manifest is there, so a batch that dies can be
    run again.  The window is inclusive and fixed for a state; surveys outside it, or
    without a date or person, are passed over.
    """

    def __init__(self, table: VersionedTable, start, end):
        self.table, self._within = table, F.col("survey_dt").between(_date(start), _date(end))

    def advance(self, batch: DataFrame, name: str = "") -> Version:
        new = batch.where(self._within)
        state = merge_latest(self.table.read(), new, KEY, _order()) if self.table.numbers() else latest_per_key(new, KEY, _order())
        return self.table.write(state, notes={"batch": name})

    def advance_all(self, batches: Iterable[tuple[str, DataFrame]]) -> DataFrame:
        for name, batch in batches:
            self.advance(batch, name)
        return self.state()

    def advance_stream(self, surveys: DataFrame, checkpoint: str):
        """Run what a streaming source of surveys has as micro-batches (each one ``advance``); returns the query."""
        return (surveys.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                .foreachBatch(lambda batch, n: self.advance(batch, f"stream-{n}")).start())

    def state(self) -> DataFrame:
        return self.table.read()
