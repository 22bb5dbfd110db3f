"""What the operators of this subpackage share: tables, shared folders, row keys, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.sources.store import remember


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where that is unset and driver and
    executors are one process (tests); on a cluster without the setting an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanlens-")
        sc.setCheckpointDir(found)
    return found


ROWS_A_FILE = 200_000


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends and lost executors cost nothing.

    rows: about how many there are at most, if that is known; narrow tables then go to few files.
    """
    path = remember(f"{shared_dir(df.sparkSession)}/spanlens-{label}-{uuid.uuid4().hex}")
    if rows is not None:
        df = df.coalesce(2 + rows // ROWS_A_FILE)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes the files of tables from `materialise` that nothing reads any more."""
    for df in stored:
        path = getattr(df, "stored_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Ranges of `key` over all cores if the files were cut into fewer parts than there are cores."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartitionByRange(n, key)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added to all of them until no column has one (in any case)."""
    taken, more = {c.lower() for c in columns}, ""
    while any(w.lower() + more in taken for w in wanted):
        more += "_"
    return [w + more for w in wanted]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(pid: int, n: int) -> int:
    """A key of row n that task pid reads; the same if the task runs again."""
    return (pid << 36) + n


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_chars: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each stay within a bound (a longer text comes alone)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
        at, n = 0, 0
        for i, size in enumerate(sizes):
            if i > at and n + size > max_chars:
                yield batch.slice(at, i - at)
                at, n = i, 0
            n += size
        if at < len(sizes):
            yield batch.slice(at)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch function, giving its memory back to the system when a task ends: idle workers live on beside the JVM."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id): the smallest id reachable over links (a, b); ids without links are left out of the result.

    Large-star and small-star rounds: each node hands its neighbours to the smallest of them, until
    nothing changes.  Every round is two hash joins with pre-aggregated minima, written to the shared
    folder in place of the round before; hot stars are joins that can be split.  `nodes` only types the ids.
    """
    id_type = nodes.schema["id"].dataType
    edges = links.select(F.greatest("a", "b").cast(id_type).alias("hi"), F.least("a", "b").cast(id_type).alias("lo")).filter("hi <> lo").distinct()
    last = before = None
    for _ in range(rounds):
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if not n or (n, mark) == last:
            break
        last = (n, mark)
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = materialise(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges", rows=2 * n)
        if before is not None:
            discard(before)
        before = edges
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component_id"))
