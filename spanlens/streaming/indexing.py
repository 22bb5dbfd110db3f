"""Incremental indexing: each micro-batch of files puts, replaces or deletes their postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators import index as I
from spanlens.sources.versions import ChunkStore
from spanlens.streaming.common import table_stream, work_folder


def current(rows: DataFrame, id: str) -> DataFrame:
    """(id, term, tf) of the last batch of each file; a file whose last batch deleted it has none."""
    last = rows.groupBy(id).agg(F.max("batch").alias("batch"))
    return rows.join(last, [id, "batch"]).filter("term IS NOT NULL").select(id, "term", "tf")


def term_df(rows: DataFrame, id: str) -> DataFrame:
    return current(rows, id).groupBy("term").agg(F.count("*").alias("df"))


def put_batch(batch: DataFrame, n: int, out: str, id: str, text: str, deleted: str | None = None) -> None:
    """Writes what a batch makes of its files under the batch's number, so one that runs again overwrites itself.

    Of a file that comes more than once in a batch the greatest text counts; a file without terms, or a
    deleted one, leaves a row with no term.
    """
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    files = batch.select(id, F.when(~gone, F.col(text)).alias("_text")).groupBy(id).agg(F.max("_text").alias("_text"))
    posted = I.postings(files, id, "_text")
    rows = files.select(id).join(posted, id, "left").select(id, "term", "tf")
    rows.write.mode("overwrite").parquet(f"{out}/batch={n}")


def index_stream(spark: SparkSession, path: str, id: str, text: str = "text", deleted: str | None = None) -> DataFrame:
    """(term, df) over all files that are there now, indexed batch by batch; a later batch replaces a file's postings."""
    out, state = work_folder(spark, "postings"), work_folder(spark, "postings-state")
    stream = table_stream(spark, path).writeStream.foreachBatch(lambda batch, n: put_batch(batch, n, out, id, text, deleted))
    stream.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return term_df(spark.read.parquet(out), id)


def store_stream(spark: SparkSession, chunks: DataFrame, store: ChunkStore, checkpoint: str, deleted: str | None = None, max_files: int = 1) -> None:
    """Puts each micro-batch of a stream of chunks into a store: one segment a batch, compacted now and then; a batch that runs again is known by its tag.

    deleted: a column that is true where a row only says that its file is gone.
    """

    def put(batch: DataFrame, n: int) -> None:
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        there = batch.filter(~gone)
        store.put(there.drop(deleted) if deleted else there, batch.filter(gone).select("path").distinct(), tag=f"{checkpoint}#{n}")

    chunks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
