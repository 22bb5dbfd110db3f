"""Candidates for a batch of queries: term choice, BM25, lookups by name, fusion, caps, blends and gates.

Everything is keyed by the query id, so a batch of prompts is one plan.  Ties follow one total
order: score descending, then id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from spanlens.functions import paths
from spanlens.functions import text as T
from spanlens.operators.index import BROADCAST_TERMS, Index, met
from spanlens.sources.store import stored

K1, B = 1.2, 0.75
RRF_K = 60
MAX_TERMS, DF_BUDGET = 24, 20_000_000


def prepare_terms(asked: DataFrame, query: str, terms: str, cap: int | None = 256) -> DataFrame:
    """(query, term, pos): distinct usable terms by first place; past the cap (None: no cap) the longest stay."""
    seen = asked.select(query, F.posexplode(terms).alias("pos", "term")).filter(F.col("term").rlike(r"^[a-z0-9_]{2,64}\z"))
    first = seen.groupBy(query, "term").agg(F.min("pos").cast("long").alias("pos"))
    if cap is None:
        return first
    by_length = Window.partitionBy(query).orderBy(F.desc(F.length("term")), "pos")
    return first.withColumn("_r", F.row_number().over(by_length)).filter(F.col("_r") <= cap).drop("_r")


def select_terms(prepared: DataFrame, term_df: DataFrame, query: str, max_terms: int = MAX_TERMS, budget: int = DF_BUDGET) -> DataFrame:
    """The rarest terms whose squared document frequencies fit a budget; the first that doesn't fit ends the list."""
    rarest = Window.partitionBy(query).orderBy("df", "pos").rowsBetween(Window.unboundedPreceding, 0)
    known = prepared.join(term_df, "term").filter("df > 0")
    ranked = known.withColumn("running", F.sum(F.col("df") * F.col("df")).over(rarest)).withColumn("nth", F.row_number().over(rarest))
    return ranked.filter((F.col("running") <= budget) & (F.col("nth") <= max_terms)).select(query, "term", "pos", "df")


def bm25(selected: DataFrame, index: Index, query: str, id: str, limit: int | None = 48, per_term: int | None = None) -> DataFrame:
    """(query, id, score, rank): the sum of the terms' Okapi scores; the best `limit` of each query (None: all).

    per_term: only each term's best so many chunks count, as where a store returns its top for each term; none by default.
    """
    hits = met(selected, index).crossJoin(F.broadcast(index.corpus))  # one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if per_term:
        best_of = Window.partitionBy(query, "term").orderBy(F.desc(F.round(gain, 12)), id)
        hits = hits.withColumn("_t", F.row_number().over(best_of)).filter(F.col("_t") <= per_term)
    scored = hits.groupBy(query, id).agg(F.round(F.sum(idf * gain), 6).alias("score"))
    best = Window.partitionBy(query).orderBy(F.desc("score"), id)
    ranked = scored.withColumn("rank", F.row_number().over(best) - 1)
    return ranked if limit is None else ranked.filter(F.col("rank") < limit)


CELLS = 4_000_000  # scores of chunks by queries that a task holds at once


def whole(prepared: DataFrame, index: Index, query: str, id: str, limit: int | None = None) -> DataFrame:
    """(query, id, score, rank) as of `bm25`, by all terms of each query however frequent; all chunks that hold one, or the best `limit`.

    Where the index has a row for each chunk and what is asked is few, chunks are scored where they are read: a task adds up
    its chunks' scores for all queries, and of the best `limit` it passes on its own best alone.  Nothing else is shuffled.
    """
    known = stored(prepared.join(index.term_df, "term").filter("df > 0").select(query, "term", "df"), "chosen")
    best = Window.partitionBy(query).orderBy(F.desc("score"), id)
    if index.rows is None or known.count() > BROADCAST_TERMS:
        scored = bm25(known, index, query, id, limit=None)
        return scored if limit is None else scored.filter(F.col("rank") < limit)
    figures = index.corpus.first()
    asked = known.toArrow()
    queries = pc.unique(asked[query].combine_chunks())
    terms = pc.unique(asked["term"].combine_chunks())
    of, term = (np.asarray(pc.index_in(asked[c].combine_chunks(), value_set=v)) for c, v in ((query, queries), ("term", terms)))
    df = np.asarray(asked["df"].combine_chunks(), np.float64)
    n, avgdl = figures.n, figures.avgdl
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    order = np.argsort(term, kind="stable")
    given = prepared.sparkSession.sparkContext.broadcast((queries, terms, of[order], idf[order], np.searchsorted(term[order], np.arange(len(terms) + 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, terms, of, idf, start = given.value
        step = max(1, CELLS // max(1, len(queries)))

        def made(ids: pa.Array, doc: np.ndarray, q: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([queries.take(pa.array(q)), ids.take(pa.array(doc)), pa.array(score)], [query, id, "score"])

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids, dl, lists = batch.slice(at, step).columns
                flat = lists.flatten()
                code = np.asarray(pc.fill_null(pc.index_in(flat.field("term"), value_set=terms), -1))
                doc = np.repeat(np.arange(len(ids)), np.asarray(pc.fill_null(lists.value_lengths(), 0)))
                tf = np.asarray(flat.field("tf"), np.float64)
                kept = np.flatnonzero(code >= 0)
                kept = kept[np.argsort(code[kept], kind="stable")]
                code, doc, tf = code[kept], doc[kept], tf[kept]
                gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * np.asarray(dl, np.float64)[doc] / avgdl))
                scores = np.zeros((len(ids), len(queries)))
                cuts = np.flatnonzero(np.diff(code, prepend=-1, append=-1))
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    a, b = start[code[i]], start[code[i] + 1]
                    scores[np.ix_(doc[i:j], of[a:b])] += gain[i:j, None] * idf[a:b]
                if limit is not None and limit < len(ids):
                    # All that may still be among the best once scores are rounded.
                    least = np.partition(scores, len(ids) - limit, axis=0)[len(ids) - limit]
                    scores[scores < least - 2e-6] = 0
                d, q = np.nonzero(scores)
                yield made(ids, d, q, scores[d, q])

    schema = StructType([prepared.schema[query], index.rows.schema[id], StructField("score", DoubleType())])
    scored = index.rows.select(id, "dl", "terms").mapInArrow(run, schema).withColumn("score", F.round("score", 6))
    ranked = scored.withColumn("rank", F.row_number().over(best) - 1)
    return ranked if limit is None else ranked.filter(F.col("rank") < limit)


def by_names(inverted: DataFrame, asked: DataFrame, query: str, id: str, first_name: bool = True, limit: int | None = 48) -> DataFrame:
    """Chunks by how many of the asked names they hold: (query, id, matched, first, rank); limit None: all.

    asked: (query, ident, pos).  Definitions tie-break by the first asked name, references don't.
    """
    found = asked.join(inverted, "ident").groupBy(query, id).agg(F.countDistinct("ident").alias("matched"), F.min("pos").alias("first"))
    order = [F.desc("matched"), *(["first"] if first_name else []), id]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)) - 1)
    return ranked if limit is None else ranked.filter(F.col("rank") < limit)


def resolve_paths(files: DataFrame, mentions: DataFrame, query: str, path: str = "path", mention: str = "mention") -> DataFrame:
    """(query, path): the files that a query's mentions mean, met by base name."""
    said = mentions.select(query, F.col(mention).alias("_m")).distinct().withColumn("_base", F.element_at(F.split("_m", "/"), -1))
    named = files.select(path).distinct().withColumn("_base", F.element_at(F.split(path, "/"), -1))
    return named.join(said, "_base").filter(paths.mentions(F.col(path), F.col("_m"))).select(query, path).distinct()


def path_signal(files: DataFrame, mentions: DataFrame, index: Index, query: str, id: str, limit: int = 48, per_term: int | None = None) -> DataFrame:
    """(query, id, score, rank): a second search whose terms are those of the paths that a query mentions.

    The index holds each chunk's path in its text, so that chunks of the files meant, and of their neighbours, come first.
    """
    resolved = resolve_paths(files, mentions, query)
    asked = resolved.select(query, F.explode(T.terms(F.col("path"))).alias("term")).distinct()
    return bm25(asked.join(index.term_df, "term"), index, query, id, limit, per_term)


def rrf(lists: list[DataFrame], query: str, id: str, k: int = RRF_K) -> DataFrame:
    """(query, id, fused, rank) of ranked lists (query, id, rank from 0): the sum of 1 / (k + rank)."""
    tagged = [x.select(query, id, F.col("rank").cast("long").alias("rank"), F.lit(n).alias("list_no")) for n, x in enumerate(lists)]
    every = tagged[0]
    for x in tagged[1:]:
        every = every.unionByName(x)
    fused = every.groupBy(query, id).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("fused"), F.min(F.struct("list_no", "rank")).alias("_first"))
    order = Window.partitionBy(query).orderBy(F.desc("fused"), "_first")
    return fused.withColumn("rank", F.row_number().over(order) - 1).drop("_first")


def cap_per_file(candidates: DataFrame, query: str, path: str, cap: int = 3, k: int | None = 24) -> DataFrame:
    """The first `cap` of each file keep their order, the others fill up behind them, k in all (None: all)."""
    in_file = Window.partitionBy(query, path).orderBy("rank")
    order = Window.partitionBy(query).orderBy(F.col("_n") > cap, "rank")
    placed = candidates.withColumn("_n", F.row_number().over(in_file)).withColumn("place", F.row_number().over(order) - 1).drop("_n")
    return placed if k is None else placed.filter(F.col("place") < k)


def demote_prose(candidates: DataFrame, query: str, prose: str = "is_prose", fused: str = "fused") -> DataFrame:
    """Prose halves its score and moves behind code, each in its old order."""
    order = Window.partitionBy(query).orderBy(prose, "rank")
    return candidates.withColumn("place", F.row_number().over(order) - 1).withColumn(fused, F.when(F.col(prose), F.col(fused) * 0.5).otherwise(F.col(fused)))


def blend(candidates: DataFrame, query: str, p: str = "p", weight: float = 0.5) -> DataFrame:
    """Scored candidates mix the model's chance with (1 - rank / n), n the scored ones of the query; others get 0."""
    n = F.count(p).over(Window.partitionBy(query))
    return candidates.withColumn("blend", F.when(F.col(p).isNull(), 0.0).otherwise((1 - weight) * (1 - F.col("rank") / n) + weight * F.col(p)))


def gate(blended: DataFrame, query: str, p: str = "p", threshold: float = 0.5, min_keep: int = 3) -> DataFrame:
    """Scored by blend, then the rest in lexical order; those below the threshold go, but min_keep stay."""
    order = Window.partitionBy(query).orderBy(F.col(p).isNull(), F.desc("blend"), "rank")
    passing = F.sum((F.coalesce(p, F.lit(0.0)) >= threshold).cast("int")).over(Window.partitionBy(query))
    placed = blended.withColumn("place", F.row_number().over(order) - 1).withColumn("_pass", passing)
    kept = F.when(F.col("_pass") >= min_keep, F.coalesce(p, F.lit(0.0)) >= threshold).otherwise(F.col("place") < min_keep)
    return placed.filter(kept).drop("_pass")


def with_scores(candidates: DataFrame, scores: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Candidates with the model's chance where there is one; null: not scored."""
    return candidates.join(scores.select(*keys, p), keys, "left")
