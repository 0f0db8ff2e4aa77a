"""Versioned tables: every write is a new folder, and a manifest put last makes it the current one.

Layout under a path::

    data/<run id>/...            the files of one write
    manifest/<number>.json       version <number>: its folder, schema, rows, who wrote it

A reader takes the manifest with the highest number, so a writer that dies
half-way leaves the former version readable and its files unnamed.  A manifest
is written whole under a name of its own and then renamed to its number; a
rename onto an existing name fails, so of two writers one gets the number and
the other takes the next.  Folders are never overwritten; ``vacuum`` deletes
those that no kept version names.  All paths go through Hadoop's file systems,
so any store that Spark can write will do (on one whose rename is no single
step, give each table one writer at a time).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    schema: str
    format: str
    n_rows: int
    notes: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read_text(self, name: str) -> str:
        stream = self._fs.open(self._hadoop(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        """The versions there are, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.removesuffix(".json").isdigit())

    def version(self, number: int | None = None) -> Version:
        number = number if number is not None else max(self.numbers(), default=None)
        if number is None:
            raise LookupError(f"{self.path} has no version")
        return Version(**json.loads(self._read_text(f"manifest/{number:012d}.json")))

    def read(self, number: int | None = None) -> DataFrame:
        """A version, by default the current one; its frame stays right whatever is written later (until ``vacuum``)."""
        v = self.version(number)
        return self._spark.read.schema(T.StructType.fromJson(json.loads(v.schema))).format(v.format).load(f"{self.path}/{v.folder}")

    def stage(self, df: DataFrame, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
        """Write the files of a version that no manifest names yet; returns their folder."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.format(fmt).mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{self.path}/{folder}")
        return folder

    def commit(self, folder: str, schema: T.StructType, fmt: str = "parquet", notes: dict | None = None) -> Version:
        """Make staged files the current version."""
        n_rows = self._spark.read.schema(schema).format(fmt).load(f"{self.path}/{folder}").count()
        while True:
            number = max(self.numbers(), default=0) + 1
            v = Version(number, folder, schema.json(), fmt, n_rows, notes or {})
            own = self._hadoop(f"{self.path}/manifest/.{uuid.uuid4().hex}")
            stream = self._fs.create(own, False)
            try:
                stream.write(json.dumps(asdict(v)).encode("utf-8"))
            finally:
                stream.close()
            final = self._hadoop(f"{self.path}/manifest/{number:012d}.json")
            if not self._fs.exists(final) and self._fs.rename(own, final):
                return v
            self._fs.delete(own, False)  # another writer took the number

    def write(self, df: DataFrame, fmt: str = "parquet", partition_by: list[str] | None = None, notes: dict | None = None) -> Version:
        return self.commit(self.stage(df, fmt, partition_by), df.schema, fmt, notes)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the last ``keep`` versions and every folder that none of them names; returns the folders.

        Only where no writer is at work: staged files look like those of a dead one.
        """
        numbers = self.numbers()
        for n in numbers[:-keep] if keep else numbers:
            self._fs.delete(self._hadoop(f"{self.path}/manifest/{n:012d}.json"), False)
        named = {self.version(n).folder for n in self.numbers()}
        gone = [f"data/{n}" for n in self._names("data") if f"data/{n}" not in named]
        for folder in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)
        return gone
