"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def remember(path: str) -> str:
    """Notes a folder of intermediate files, so that `scratch` can delete it."""
    _made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, at the end, the intermediate files of all queries that were run inside; their results must be consumed by then."""
    first = len(_made)
    try:
        yield _made
    finally:
        for path in _made[first:]:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        del _made[first:]


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a local one if driver and executors are one process (tests), else an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanlens-")
    return remember(f"{base}/spanlens-{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written once and read back: what uses it several times doesn't compute it again."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
