"""Latest row per key (top-1 per group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: str, order: list[Column],
                   keep_null_key: bool = False) -> DataFrame:
    """Keep the first row per ``key`` under ``order`` (row_number = 1).

    Catalyst plans this as a WindowGroupLimit: a partial top-1 runs before
    the shuffle, so a key with millions of rows ships one row per map task.
    Null keys are dropped unless ``keep_null_key`` (then they form one group).
    """
    if not keep_null_key:
        df = df.where(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def merge_latest(stored: DataFrame, new: DataFrame, key: str, order: list[Column], keep_null_key: bool = False) -> DataFrame:
    """The next stored latest rows from the stored ones and a batch, whatever the order of arrival.

    The first row by ``order`` of a union is the first of the parts' firsts, so
    the rows that earlier batches brought need not be read again, a late row
    loses against what is stored, and a batch merged twice changes nothing.
    The batch is cut to its own firsts before it meets the stored rows.
    """
    own = latest_per_key(new, key, order, keep_null_key)
    return latest_per_key(stored.unionByName(own), key, order, keep_null_key)
