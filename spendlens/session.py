"""Session defaults."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "spendlens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster, pass nothing: master and partition counts come from the
    deployment.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**conf, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: persisted frames by application, and whether other queries of the session read them too
_HELD: dict[str, list[tuple[DataFrame, bool]]] = {}


def reused(df: DataFrame, shared: bool = False) -> DataFrame:
    """Mark a narrow frame that several steps of a query read, or (``shared``) several queries.

    Nothing runs here: the first reader fills the blocks, and a block lost with
    its executor is computed again from the sources.  ``release`` frees them.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.setdefault(df.sparkSession.sparkContext.applicationId, []).append((df, shared))
    return df


def release(spark: SparkSession, shared: bool = False) -> int:
    """Free what the queries run so far have persisted (the shared frames only on request); returns how many frames.

    Queries built before stay right: what they need again is computed again.
    """
    held = _HELD.pop(spark.sparkContext.applicationId, [])
    kept = [] if shared else [(df, True) for df, of_session in held if of_session]
    plans = [df for df, _ in kept]
    for df, of_session in held:
        if (shared or not of_session) and not any(df.sameSemantics(k) for k in plans):
            df.unpersist()
    if kept:
        _HELD[spark.sparkContext.applicationId] = kept
    return len(held) - len(kept)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a small frame as Parquet in the shared folder and return what reads it (a job; nulls are allowed in all columns).

    For a step's result that many later plans contain: they show a file instead
    of the plan that made it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/core/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reused_or_kept(df: DataFrame, name: str, most_rows: int) -> DataFrame:
    """``reused``, or ``kept`` if the frame has more than ``most_rows`` rows (a job counts them).

    Every reader's plan holds the whole plan of a persisted frame, and the
    driver keeps the text of each; a written frame is one file scan in them,
    and takes no memory of the executors.
    """
    held = reused(df)
    if held.count() <= most_rows:
        return held
    written = kept(held, name)
    held.unpersist()
    return written


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``; one is set only with a local master and none named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spendlens-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")
