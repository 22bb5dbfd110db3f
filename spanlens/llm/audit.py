"""How filters interact: what each removes, and what it would have removed anyway, in every order.

Method.  A document's outcome depends on its mask alone: which of the filters it fails.  So the
documents of a part (a language, say) come down to one row of counts by mask, and what is asked
of them is a matrix product: rows of counts, stacked for all parts and labels, times integer
matrices with a column for each order and step (32 by 600 for five filters), which hold 1 where
a mask is kept, removed, redundant or failed alone at that step.  Shapley sums are the removed
matrix added up over all orders.

A filter `exact copy` (E) is true of rows whose text some row with a smaller key has.  It is
settled without joining texts: rows are counted by (text's SHA-256, part, labels, key), the
least key of a text is a minimum over these counts, and rows above it fail.

Scale.  Texts are read once; counting is on the JVM, and rows of (key, hash, part, mask) are all
that is shuffled.  Counts are partial sums before they are shuffled, so a text, a part or a key
that holds a third of all rows is a row a task; null keys are dealt by their hashes.  At
most parts x 32 rows are left for the product, which tasks make for a bounded number of parts at
a time.  Nothing comes to the driver.

Defined results: a null text is the empty text (it fails A, passes B to D, and equals other empty
texts); a null part is the empty string; rows of equal text and key are no copies of each other;
a null key is neither smaller nor larger than any, and has no labels; of repeated labels the
greatest counts, null labels count as 0; an empty table has no parts and gives no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import freed, table

BLANKS = " \t\n\x0b\f\r"
FILTERS = "ABCDE"
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
COLUMNS = (*OUTCOMES, "good_lost", "toxic_lost", "shapley")


def failures(text: Column) -> list[Column]:
    """Conditions A to D on a text that is not null: short, repetitive, shouting, symbols."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang", conditions=failures) -> DataFrame:
    """(key, part, hash, mask): bit i of the mask is set if condition i holds; hash tells texts apart."""
    body = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("body")))]
    return body.select("key", "part", F.unhex(F.sha2("body", 256)).alias("hash"), sum(bits[1:], bits[0]).cast("int").alias("mask"))


def histograms(marked: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic", copies: int = 4) -> DataFrame:
    """(part, mask, n, good, toxic): documents by mask, with the bit `copies` set for copies of a text under a smaller key."""
    known = labels.select(F.col(key).cast("long").alias("deal"), F.col(good).alias("g"), F.col(toxic).alias("t")).dropna(subset=["deal"])
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = known.groupBy("deal").agg(is_one("g"), is_one("t")).withColumn("has", F.lit(True))
    rows = marked.groupBy("key", "part", "hash", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("has", F.col("key").isNotNull()).withColumn("deal", F.coalesce("key", F.xxhash64("hash", "part")))
    labelled = rows.join(known, ["deal", "has"], "left").na.fill(0, ["g", "t"])
    # All rows of a text have one mask; the rows under its least key are no copies.
    texts = labelled.groupBy("hash", "part", "mask", "g", "t").agg(
        F.min("key").alias("least"), F.sum("n").alias("n"), F.min_by("n", "key").alias("n_least"), F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    whole = texts.groupBy("hash").agg(F.collect_list(F.struct("part", "mask", "g", "t", "least", "n", "n_least", "n_null")).alias("rows"), F.min("least").alias("least"))
    each = whole.select("least", F.explode("rows").alias("r"))
    first = F.when(F.col("r.least") == F.col("least"), F.col("r.n_least")).otherwise(0) + F.col("r.n_null")
    split = F.array(F.struct(F.col("r.mask").alias("mask"), first.alias("n")), F.struct(F.col("r.mask").bitwiseOR(F.lit(1 << copies)).alias("mask"), (F.col("r.n") - first).alias("n")))
    out = each.select("r.part", "r.g", "r.t", F.explode(split).alias("s")).filter("s.n > 0")
    return out.groupBy("part", F.col("s.mask").alias("mask")).agg(F.sum("s.n").alias("n"), F.sum(F.col("s.n") * F.col("g")).alias("good"), F.sum(F.col("s.n") * F.col("t")).alias("toxic"))


def incidence(filters: Sequence[str]) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each column, and for each outcome the integer matrix with a row for each mask."""
    orders = list(itertools.permutations(range(len(filters))))
    columns = [("".join(filters[f] for f in order), step + 1) for order in orders for step in range(len(filters))]
    own = np.array([1 << order[step] for order in orders for step in range(len(filters))])
    before = np.array([sum(1 << f for f in order[:step]) for order in orders for step in range(len(filters))])
    mask = np.arange(1 << len(filters))[:, None]
    fails, earlier = (mask & own) > 0, (mask & before) > 0
    found = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": mask == own}
    found = {k: v.astype(np.int64) for k, v in found.items()}
    found["shapley"] = np.stack([found["removed"][:, own == bit].sum(1) for bit in own], 1)
    return columns, found


def outcomes(counts: DataFrame, filters: Sequence[str] = FILTERS, parts_at_once: int = 64) -> DataFrame:
    """A row for each part, order and step, from histograms."""
    columns, matrices = incidence(filters)
    stacked = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("rows"))
    width = 1 << len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, parts_at_once):
                some = batch.slice(at, parts_at_once)
                stack = np.zeros((3, some.num_rows, width), np.int64)
                for i, rows in enumerate(some.column(1).to_pylist()):
                    for r in rows:
                        stack[:, i, r["mask"]] += (r["n"], r["good"], r["toxic"])
                n, good, toxic = stack
                made = {k: n @ matrices[k] for k in (*OUTCOMES, "shapley")} | {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
                names = [pa.array(np.repeat(some.column(0).to_numpy(zero_copy_only=False), len(columns)), pa.string())]
                names += [pa.array([c[0] for c in columns] * some.num_rows), pa.array([c[1] for c in columns] * some.num_rows, pa.int32())]
                yield pa.RecordBatch.from_arrays([*names, *(pa.array(made[c].ravel(), pa.int64()) for c in COLUMNS)], names=["part", "filter_order", "step", *COLUMNS])

    return stacked.mapInArrow(freed(run), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = masks(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return outcomes(histograms(marked, table(spark, sf_dir, "labels")))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), l AS (
  SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY 1
), marked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask
  FROM w LEFT JOIN l USING (doc_id)
), h AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY 1, 2
), f(i) AS (
  SELECT unnest([0, 1, 2, 3, 4])
), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', (x + 1)::INT, 1)), '') AS filter_order, step::INT AS step, o[step] AS own, (1 << o[step]::INT) AS bit,
    coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x::INT)), 0)::INT AS before
  FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)
), out AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, steps GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM out
"""
