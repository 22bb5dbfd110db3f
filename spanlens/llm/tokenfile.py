"""Token ids in Parquet files: list columns, chosen encodings, row groups and page indexes.

Documents are dealt into ranges of their id, sorted inside each, encoded whole and written by
Spark's own Parquet writer (any store that Spark can write, with its commit protocol).  Input files
whose parts hold ascending ids in ranges of their own are read as they are, without a shuffle.  Ids are
a dictionary-coded list column; id, length and start columns are delta-coded without a
dictionary, so metadata reads touch a few kilobytes and page indexes find a document's page.
`shard` is the number of the range, so (shard, local_start) orders all ids; the offsets of the
shards come from one sum per shard.

Defined results: null or empty text is the end id alone; null ids come first; repeated rows are
documents of their own (rows of one id lie together, in the order of their text); an empty
table gives an empty file set.  Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.bpe import encoder
from spanlens.llm.common import freed, shared_dir, table, text_blocks
from spanlens.sources.store import remember

END_ID = 0
KNOWN_UNITS, BLOCK_CHARS = 300_000, 8_000_000  # of a worker: parts of texts whose ids it remembers, characters at a time
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 128 << 10, 512


def ordered_parts(docs: DataFrame, key: str) -> dict[int, int] | None:
    """The place of each part of a plain file scan, if its ids ascend within and over the parts; else None.

    Only ids are read, and a row for each part comes back.  What a scan's parts are follows from its files alone.
    """
    plan = docs.select(key)._jdf.queryExecution().executedPlan().toString()
    if plan.count("FileScan") != 1 or "Exchange" in plan:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        ascending = True
        for batch in batches:
            ids = batch.column(0)
            if batch.num_rows:
                found = ids.to_numpy(zero_copy_only=False)
                ascending = ascending and not ids.null_count and bool((np.diff(found) > 0).all()) and (last is None or found[0] > last)
                if not ascending:
                    break
                first, last = int(found[0]) if first is None else first, int(found[-1])
        named = {"pid": [TaskContext.get().partitionId()], "first": [first], "last": [last], "ascending": [ascending]}
        yield pa.RecordBatch.from_pydict(named, pa.schema([("pid", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("ascending", pa.bool_())]))

    parts = docs.select(F.col(key).cast("long").alias(key)).mapInArrow(run, "pid int, first long, last long, ascending boolean").collect()
    full = sorted((p for p in parts if p.first is not None), key=lambda p: p.first)
    if not all(p.ascending for p in parts) or any(a.last >= b.first for a, b in zip(full, full[1:], strict=False)):
        return None
    return {p.pid: n for n, p in enumerate(full)}


def write_tokens(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = END_ID,
    shards: int | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
    codec: str = "zstd",
) -> None:
    """Writes (key, shard, local_start, n_tokens, tokens), in ascending order of the key over the files."""
    # As many ranges as the input has splits, so that files stay of one size as it grows.
    n = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.select(key, text).rdd.getNumPartitions())
    source, places = docs.select(F.col(key).cast("long").alias(key), text), None if shards else ordered_parts(docs, key)
    if places is None:
        source = source.repartitionByRange(n, key).sortWithinPartitions(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pid, before = encoder(tokenizer, KNOWN_UNITS), TaskContext.get().partitionId(), 0
        pid = pid if places is None else places.get(pid, pid)
        for batch in text_blocks(batches, text, BLOCK_CHARS):
            for first, ids, bounds in enc.blocks(batch.column(1).to_pylist()):
                m = len(bounds) - 1
                ends = bounds[1:] + np.arange(1, m + 1)
                out = np.empty(len(ids) + m, np.int32)
                last = ends - 1
                body = np.ones(len(out), bool)
                body[last] = False
                out[body] = ids
                out[last] = end_id
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                sizes = np.diff(offsets).astype(np.int64)
                starts = before + offsets[:-1].astype(np.int64)
                before += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, m), pa.array(np.full(m, pid)), pa.array(starts), pa.array(sizes), pa.ListArray.from_arrays(offsets, out)],
                    names=[key, "shard", "local_start", "n_tokens", "tokens"],
                )

    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "v2", "parquet.dictionary.page.size": 1 << 20}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in (key, "local_start", "n_tokens")}
    done = source.mapInArrow(freed(run), f"`{key}` long, shard long, local_start long, n_tokens long, tokens array<int>")
    done.write.options(compression=codec, **{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", columns: tuple[str, ...] = ("tokens",)) -> DataFrame:
    """(key, start, n_tokens, ...): start counts the ids of all documents before; only the columns named are read."""
    stored = spark.read.parquet(path)
    ends = stored.groupBy("shard").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    # One row for each file written.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # As many rows as files were written: at most the number of ranges.
    return stored.join(F.broadcast(base), "shard").select(key, (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def checksums(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of stored ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return tokens.select(key, "start", "n_tokens", "tokens").mapInArrow(freed(run), f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = remember(f"{shared_dir(spark)}/spanlens-tokens-{uuid.uuid4().hex}")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return checksums(read_tokens(spark, path))
