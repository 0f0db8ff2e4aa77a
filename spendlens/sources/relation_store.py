"""Relations written for the joins they meet: bucketed by person, surveys partitioned by month too.

All six tables are bucketed and sorted by ``party_id`` into the same number of
buckets, with one row per person in the five that are joined.  The scan then
has the partitioning that the deduplication and every join ask for: a pull
from the store plans no exchange, whatever its size, and a bucket of one table
meets only that bucket of the others.  Surveys also lie in a folder per month;
a window reads those it touches.  Use as many buckets as the largest relation needs
for a bucket to fit a task (a person with a third of the surveys is one
bucket; their surveys are cut to the latest while scanning it).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.sources.relations import SCHEMAS, one_per_key

KEY = "party_id"
MONTH = "survey_month"
BUCKET_ROWS = 1_000_000


def buckets_for(tables: Mapping[str, DataFrame], rows: int = BUCKET_ROWS) -> int:
    """Buckets of at most about ``rows`` surveys (the largest relation), one for each core at least.

    Surveys are a file per bucket and month, and a file costs a fifth of a second
    however few rows it has, so their number follows the data.
    """
    survey = tables["survey"]
    return max(survey.sparkSession.sparkContext.defaultParallelism, -(-survey.count() // rows))


def write_store(tables: Mapping[str, DataFrame], prefix: str, buckets: int, on_duplicates: str = "first") -> None:
    """Write the relations as tables ``<prefix>_<relation>`` of the session's catalog (they must not exist)."""
    for name in SCHEMAS:
        df = tables[name]
        if name == "survey":
            df = df.withColumn(MONTH, F.date_format("survey_dt", "yyyy-MM"))
        else:
            df = one_per_key(df, KEY, on_duplicates, name)
        writer = df.repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY).mode("error")
        (writer.partitionBy(MONTH) if name == "survey" else writer).saveAsTable(f"{prefix}_{name}")


def drop_store(spark: SparkSession, prefix: str) -> None:
    for name in SCHEMAS:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


class RelationStore(Mapping):
    """The written relations by name; with a window, surveys of its months only.  Rows are unique: pull with ``on_duplicates='trust'``."""

    def __init__(self, spark: SparkSession, prefix: str, start: dt.date | None = None, end: dt.date | None = None):
        self._spark, self._prefix, self._start, self._end = spark, prefix, start, end

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        df = self._spark.table(f"{self._prefix}_{name}")
        if name != "survey":
            return df
        if self._start is not None:
            df = df.where(F.col(MONTH) >= self._start.strftime("%Y-%m"))
        if self._end is not None:
            df = df.where(F.col(MONTH) <= self._end.strftime("%Y-%m"))
        return df.drop(MONTH)
