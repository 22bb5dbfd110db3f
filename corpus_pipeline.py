"""Filters `documents` in stages and packs what is left into training windows.

Each stage takes (spark, docs, sf_dir): docs is what the stage before kept, written as Parquet
and read again.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm import decontam, linededup, minhash, packing, toxicity
from spanlens.llm.common import discard, free_names, materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from `labels` and drops documents whose score is at the threshold or above."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (name,) = free_names(docs.columns, "_toxicity")
    return toxicity.annotate(docs, model, out=name).filter(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of each source out of the texts; n_chars follows."""
    lines, dropped = free_names(docs.columns, "_lines", "_dropped")
    cut = linededup.drop_boilerplate(docs, lines_out=lines, dropped_out=dropped)
    changed = F.col(dropped) > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return minhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row with an item of `benchmark`."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, place and window.

    Workers that the stages before have left their marks on get less to keep.
    """
    return packing.pack(docs, known_units=150_000, block_chars=3_000_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash", drop_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

# Learned scores, hashed signatures and dynamic programming have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
