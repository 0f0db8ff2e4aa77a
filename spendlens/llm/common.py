"""Helpers shared by the operators: reading tables, cutting lineage, safe column names."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"  # the six separators of words: \x20 and \x09-\x0D


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir``; a scratch one only in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spendlens-llm-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """What the session needs for rows that are whole documents: this package on the workers, Arrow batches small in rows and bytes.

    Call it once before the operators where the package is not installed on the
    workers; the registered queries and the pipeline's stages do.
    """
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    ship_package(spark)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context (they may not have it installed)."""
    import zipfile

    import spendlens

    sc = spark.sparkContext
    if getattr(sc, "_spendlens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(spendlens.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-code-"), "spendlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._spendlens_shipped = True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the files, it does not repeat
    the work above) and fixes values that depend on the partitioning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what this application has written; frames that read it can no longer be used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def crc_remainder(key: Column, modulus: int) -> Column:
    """``crc32(key as text) mod modulus``; null for a null key."""
    return F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(modulus))


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) have their bit in a bitmap (uint8, a power of two long) of ``bitmap_of``."""
    bits = np.uint64(len(bitmap) * 8 - 1)
    at = hashes & bits
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of ``2**bits`` bits (at least 2**15) of a column ``h``, put together on the executors in blocks of 4 KB."""
    at = F.col("h").bitwiseAND((1 << bits) - 1) + 1  # Spark's bitmap positions count from 1
    blocks = hashes.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = bytearray(1 << bits - 3)
    for r in blocks.toLocalIterator():
        out[(r.block - 1) * 4096:r.block * 4096] = r.bits
    return bytes(out)
