"""Session state as batch plans: topic, working set, what was sent or read, epochs, caches.

Streaming versions of the stateful ones are in `spanlens.streaming`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.operators.shape import budget_append

WORKING_SET, SENT, SESSIONS, AGAIN = 40, 200, 256, 8
WHOLE = 2**31 - 1  # the last line of a file that was read whole


def topics(prompts: DataFrame, session: str, turn: str, text: str, follow_up: Column) -> DataFrame:
    """Adds `topic`: the last prompt so far that stands on its own; a session's first prompt always does."""
    w = Window.partitionBy(session).orderBy(turn)
    first = F.row_number().over(w) == 1
    return prompts.withColumn("topic", F.last(F.when(first | ~follow_up, F.col(text)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def effective_queries(prompts: DataFrame, session: str, turn: str, text: str, follow_up: Column, names: Column) -> DataFrame:
    """Adds `query`: what is searched for a prompt: itself, or, if it leans on the topic, the topic and the names that the prompt adds."""
    first = F.row_number().over(Window.partitionBy(session).orderBy(turn)) == 1
    marked = topics(prompts, session, turn, text, follow_up).withColumn("_own", first | ~follow_up)
    with_names = F.when(names == "", F.col("topic")).otherwise(F.concat("topic", F.lit("\n"), names))
    return marked.withColumn("query", F.when(F.col("_own"), F.col(text)).otherwise(with_names)).drop("_own")


def sent_now(events: DataFrame, session: str, order: str, reset: Column, sent: Column, key: list[str], most: int = SENT) -> DataFrame:
    """What was sent since a session's last reset: each key once, by its first time; the newest `most`."""
    now = epochs(events, session, [order], reset).filter("current").filter(sent)
    once = now.groupBy(session, *key).agg(F.min(order).alias(order))
    nth = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order), *key))
    return once.withColumn("age", nth - 1).filter(F.col("age") < most)


def shown_again(events: DataFrame, session: str, order: str, compacted: Column, shown: Column, span: list[str], score: str, tokens: str, budget: int, most: int = AGAIN) -> DataFrame:
    """(session, order, place, span, score): the best spans so far after each compaction, as far as they fit two thirds of the budget.

    A span counts with its best score before the compaction; one that doesn't fit is passed over, later ones may fit.
    """
    at = events.filter(compacted).select(session, F.col(order).alias("_at"))
    before = events.filter(shown).join(at, session).filter(F.col(order) < F.col("_at"))
    best = before.groupBy(session, "_at", *span).agg(F.max(score).alias(score), F.max(tokens).alias("_tokens"))
    place = F.row_number().over(Window.partitionBy(session, "_at").orderBy(F.desc(score), *span)) - 1
    top = best.withColumn("place", place).filter(F.col("place") < most)
    lists = top.groupBy(session, F.col("_at").alias(order)).agg(F.array_sort(F.collect_list(F.struct("place", *span, score, "_tokens"))).alias("_xs"))
    fits = budget_append(F.transform("_xs", lambda x: x["_tokens"].cast("int")), budget * 2 // 3)
    kept = lists.withColumn("_xs", F.filter(F.arrays_zip("_xs", fits.alias("_fits")), lambda x: x["_fits"]))
    return kept.select(session, order, F.explode(F.transform("_xs", lambda x: x["_xs"])).alias("x")).select(session, order, "x.place", *(f"x.{c}" for c in span), f"x.{score}")


def working_set(results: DataFrame, session: str, span: list[str], score: str, most: int = WORKING_SET) -> DataFrame:
    """The best score of each span a session was shown; the best `most` spans."""
    best = results.groupBy(session, *span).agg(F.max(score).alias(score))
    order = Window.partitionBy(session).orderBy(F.desc(score), *span)
    return best.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < most)


def epochs(events: DataFrame, session: str, order: list[str], reset: Column) -> DataFrame:
    """Adds `epoch` (resets so far, the row itself included) and whether it is the session's last."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("epoch", F.sum(reset.cast("long")).over(w))
    return found.withColumn("current", F.col("epoch") == F.max("epoch").over(Window.partitionBy(session)))


def newest(events: DataFrame, session: str, key: list[str], order: str, most: int = SENT) -> DataFrame:
    """Each key of a session once, the `most` last seen."""
    last = events.groupBy(session, *key).agg(F.max(order).alias(order))
    w = Window.partitionBy(session).orderBy(F.desc(order), *key)
    return last.withColumn("age", F.row_number().over(w) - 1).filter(F.col("age") < most)


def alive(entries: DataFrame, now: Column, stored: str = "stored", ttl: str = "ttl") -> DataFrame:
    """Cache entries that have not run out; a ttl of 0 never does."""
    return entries.filter((F.col(ttl) == 0) | (F.col(stored) + F.col(ttl) > now))


def budget_prefix(items: DataFrame, group: str, order: list[str], cost: str, budget: float, batch: int = 8) -> DataFrame:
    """Whole batches, in order, whose running cost stays within the budget."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    numbered = items.withColumn("batch", F.floor(n / batch))
    sums = numbered.groupBy(group, "batch").agg(F.sum(cost).alias("_c"))
    running = F.sum("_c").over(Window.partitionBy(group).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    kept = sums.withColumn("_r", F.round(running, 6)).filter(F.col("_r") <= budget).select(group, "batch")
    return numbered.join(kept, [group, "batch"])


def read_counts(reads: DataFrame, session: str, order: list[str], *key: str) -> DataFrame:
    """Adds `reads`: how often the session has read (the key) so far, this time included."""
    w = Window.partitionBy(session, *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return reads.withColumn("reads", F.count("*").over(w))


def last_entries(log: DataFrame, session: str, order: list[str], n: int, prefix: str = "") -> DataFrame:
    """The last n entries of each session whose id begins with the prefix, numbered from the newest."""
    kept = log.filter(F.startswith(F.col(session).cast("string"), F.lit(prefix))) if prefix else log
    return kept.withColumn("k", F.row_number().over(Window.partitionBy(session).orderBy(*map(F.desc, order)))).filter(F.col("k") <= n)


def capture(prompts: DataFrame, candidates: DataFrame, query: str, text: str = "text", id: str = "chunk_id", most: int = 4_000) -> DataFrame:
    """A record for each prompt: its text up to a bound, its length, and its candidates in order with their chances, without their code."""
    item = F.struct("rank", F.col(id), "p")
    listed = candidates.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x[id].alias(id), x["rank"].alias("rank"), x["p"].alias("p"))).alias("candidates"))
    return prompts.select(query, F.substring(text, 1, most).alias("prompt"), F.length(text).cast("long").alias("chars")).join(listed, query, "left")


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records as JSON lines; every append adds files, so that what was written stays."""
    records.write.mode(mode).json(path)
