"""Logs of records as JSON lines that rotate by size, and streams that follow them.

A log is a folder of generations.  Appending adds files to the last one until it has reached its
size; then the next begins, and generations beyond those to keep are deleted.  A follower lists
new files of all generations; what was deleted before it was read is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class RotatingLog:
    """Records below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, max_bytes: int = 8 << 20, keep: int = 2):
        self.spark, self.root, self.max_bytes, self.keep = spark, root.rstrip("/"), max_bytes, keep
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        place = self.path(self.root)
        found = self.store.listStatus(place) if self.store.exists(place) else []
        return sorted(int(s.getPath().getName().removeprefix("gen-")) for s in found if s.getPath().getName().startswith("gen-"))

    def _folder(self, generation: int) -> str:
        return f"{self.root}/gen-{generation:08}"

    def append(self, records: DataFrame, tag: str | None = None) -> int:
        """Writes records to the log and gives their generation; a tag that is appended again replaces what it wrote."""
        there = self.generations()
        for g in there:
            if tag is not None and self.store.exists(self.path(f"{self._folder(g)}/part-of-{tag}")):
                records.write.mode("overwrite").json(f"{self._folder(g)}/part-of-{tag}")
                return g
        last = there[-1] if there else 1
        if there and self.store.getContentSummary(self.path(self._folder(last))).getLength() >= self.max_bytes:
            last += 1
        records.write.mode("overwrite").json(f"{self._folder(last)}/part-of-{tag or uuid.uuid4().hex}")
        for g in there:
            if g <= last - self.keep:
                self.store.delete(self.path(self._folder(g)), True)
        return last

    def read(self, schema: StructType) -> DataFrame:
        """All records that are kept; lines that are no records of the schema are left out."""
        raw = self.spark.read.schema(StructType([*schema.fields]).add("_bad", "string")).option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true")
        return raw.json(self.root).filter("_bad is null").drop("_bad")

    def follow(self, schema: StructType, max_files: int = 1_000) -> DataFrame:
        """A stream of the records as they come, over rotations."""
        return self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("maxFilesPerTrigger", max_files).json(self.root)


def summary(log: DataFrame, kind: str, session: str, duration: str, failed: Column) -> DataFrame:
    """(kind, calls, sessions, failures, total, longest) of each kind of entry."""
    return log.groupBy(kind).agg(F.count("*").alias("calls"), F.countDistinct(session).alias("sessions"), F.count_if(failed).alias("failures"), F.sum(duration).alias("total"), F.max(duration).alias("longest"))
