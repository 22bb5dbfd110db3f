"""What a training set and a held-out set have in common: commits, files, tasks and hashes that are in both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions import text as T
from spanlens.sources.store import stored

LEAST_BYTES = 512


def shared(train: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Values of a column that both sets have, each once; nulls are no value.  Root commits and hashes are found so."""
    return train.select(key).dropna().intersect(held_out.select(key).dropna())


def shared_blobs(train: DataFrame, held_out: DataFrame, digest: str, size: str, least: int = LEAST_BYTES) -> DataFrame:
    """Digests of files of `least` bytes or more that both sets hold; smaller ones are alike by chance."""
    big = F.col(size) >= least
    return shared(train.filter(big), held_out.filter(big), digest)


def equal_tasks(train: DataFrame, held_out: DataFrame, task: Column, ids: tuple[str, str]) -> DataFrame:
    """(ids) of tasks of the two sets whose words are the same once case, blanks and punctuation are gone."""
    a = train.select(F.col(ids[0]), T.normalise_task(task).alias("_t")).filter("_t <> ''")
    b = held_out.select(F.col(ids[1]), T.normalise_task(task).alias("_t"))
    return a.join(b, "_t").select(*ids)


BROADCAST_WORDS = 200_000


def sharing_rarest(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, item_text: str) -> DataFrame:
    """(doc, item): pairs in which the document holds the inner word of the item that the fewest documents hold.

    A document that contains an item's text holds its inner words whole (the first and last may be cut off inside longer
    ones), so no pair is lost.  Only words that items ask for are counted and joined, and common ones meet nobody.
    """
    inner = F.expr(f"slice(split({item_text}, ' '), 2, greatest(size(split({item_text}, ' ')) - 2, 1))")
    asked = items.select(item, F.explode(F.array_distinct(inner)).alias("_w"))
    known = asked.select("_w").distinct()
    few = known.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    words = docs.select(doc, F.explode(F.array_distinct(F.split(text, " "))).alias("_w")).join(F.broadcast(known) if few else known, "_w", "left_semi")
    words = stored(words, "words")
    counts = words.groupBy("_w").agg(F.count("*").alias("_df"))
    rarest = asked.join(counts, "_w", "left").groupBy(item).agg(F.min_by("_w", F.struct(F.coalesce("_df", F.lit(0)), "_w")).alias("_w"))
    return words.join(rarest, "_w").select(doc, item)
