"""Sharding by weighted rendezvous hashing.

Each record key draws one number per shard; the record goes to the shard with the best draw
(-ln(u) / weight is least).  A shard's draw depends on the key and that shard alone, so one
more shard takes rows only into itself, and a change of one weight moves rows only to or from
that shard.  All of it is JVM expressions; only narrow rows (no texts) are shuffled to number
the slots.

Nulls: a null key hashes like any other value; a null text has no bytes.  Repeated rows go to
one shard and get slots of their own.  An empty table gives no rows.  Only the columns named
are read, so others may clash with nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.common import table

SHARDS = 40
ROWS_A_BIN = 20_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard (0-based) that wins the key."""
    top = float(1 << 53)

    def draw(i: int, w: float) -> Column:
        # xxhash64's upper 53 bits as a number in (0, 1); smaller cost wins, ties go to the lower shard.
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(i)), 11).cast("double") + 0.5) / F.lit(top)
        return F.struct((-F.ln(u) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))

    return F.least(*(draw(i, w) for i, w in enumerate(weights)))["shard"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str], rows_a_bin: int = ROWS_A_BIN) -> DataFrame:
    """Adds `slot`, a gapless number from 0 within each shard.

    A shard is dealt into bins by a hash of the ordering columns, so that no task sorts a whole
    shard; a bin's first slot is the sum of the counts of the bins before it.  There is one row
    for each shard and bin in that sum, and the number of bins follows the row count.
    """
    n = df.count()
    bins = max(1, n // rows_a_bin)
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    sizes = binned.groupBy(shard, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(shard, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(shard, "_bin").orderBy(*order)
    numbered = binned.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(first, [shard, "_bin"]).withColumn("slot", F.col("_first") + F.col("_at")).drop("_bin", "_first", "_at")


def assign(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, grown: float = 1.0) -> DataFrame:
    """Each record's key, size, checksum, shard, slot and its shard once a shard of weight `grown` is added."""
    text = F.col("text")
    sized = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = sized.select(
        "*",
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), [*weights, grown]).cast("int").alias("grown_shard"),
    )
    return with_slots(placed, "shard", [key, "size", "text_crc32"])


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
