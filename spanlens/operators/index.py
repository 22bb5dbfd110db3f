"""Term, definition and reference indexes of chunks as plain DataFrames.

A chunk is any row with an id and a text.  Postings hold each term of a chunk with its count
capped; lengths, document frequencies and corpus figures are aggregates of the postings, so a
changed chunk changes only its own rows and the differences (`df_delta`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from spanlens.sources.store import stored

MAX_TF = 2


@dataclass(frozen=True)
class Index:
    """(id, term, tf, dl), (id, dl), (term, df) and (n, avgdl); where chunks are rows of their own, (id, dl, terms) too."""

    postings: DataFrame
    doc_len: DataFrame
    term_df: DataFrame
    corpus: DataFrame
    rows: DataFrame | None = None


# A-Z, a-z, digits and underscores stay, all other bytes part words.
_RUNS = bytes(b if b == 95 or bytes([b]).isalnum() else 32 for b in range(256))
_PARTS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
KEPT, PIECE = 500_000, 2_000_000  # words whose terms a task remembers, bytes of texts that are counted at once


def terms_of(run: bytes) -> tuple[str, ...]:
    """`T.word_terms` of one run of letters, digits and underscores; none if it is no word."""
    if run[:1].isdigit():
        return ()
    word = run.decode()
    low = word.lower()
    if run.isalpha() and (run.islower() or run[1:].islower() or run.isupper()):  # one part
        return (low,) if len(low) > 1 else ()
    parts = _PARTS.findall(word)
    return (*(p.lower() for p in parts if len(p) > 1), *([low] if len(parts) > 1 else []))


def counted(chunks: DataFrame, id: str = "chunk_id", text: Column | str = "text", max_tf: int = MAX_TF, asked: list[str] | None = None, by_row: bool = False) -> DataFrame:
    """(id, dl, terms): a row for each chunk that has terms, with its length and its terms (all, or the asked ones alone) with their counts.

    Only whole texts are shuffled, so that rows with one id count as one chunk.  by_row: each row is a chunk of its own,
    counted where it is read; nothing is shuffled.
    """
    spark, body = chunks.sparkSession, F.col(text) if isinstance(text, str) else text
    wanted = None if asked is None else spark.sparkContext.broadcast(frozenset(asked))
    kind = chunks.select(id).schema[0].dataType
    schema = StructType([StructField(id, kind), StructField("dl", LongType()), StructField("terms", ArrayType(StructType([StructField("term", StringType()), StructField("tf", LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[str, ...]] = {}  # terms of words of several parts
        some = None if wanted is None else pa.array(wanted.value, pa.string())

        def piece(ids: pa.Array, doc: np.ndarray, texts: list[bytes]) -> pa.RecordBatch | None:
            # Words, then terms, are numbers; what a document holds of them is counted by sorting pairs of numbers.
            line = np.frombuffer(b" ".join([b"", *texts, b""]).translate(_RUNS), np.uint8)
            keep = line != 32
            begin = np.flatnonzero(keep[1:] & ~keep[:-1]) + 1
            room = np.cumsum([1, *(len(t) + 1 for t in texts)])  # where texts begin
            of_word = doc[np.searchsorted(room, begin, "right") - 1]
            letters, at = line[keep], np.zeros(len(begin) + 1, np.int32)
            at[1:] = np.cumsum(np.flatnonzero(keep[:-1] & ~keep[1:]) + 1 - begin)
            coded = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
            words, code = coded.dictionary, np.asarray(coded.indices, np.int64)
            one = pc.match_substring_regex(words, "^([A-Za-z][a-z]+|[A-Z][A-Z]+)$").to_numpy(zero_copy_only=False)  # words of one part
            others = words.filter(pa.array(~one)).cast(pa.binary()).to_pylist()
            if len(known) > KEPT:
                known.clear()
            several = [terms_of(w) if found is None else found for w, found in zip(others, map(known.get, others), strict=True)]
            known.update(zip(others, several, strict=True))
            each = np.ones(len(words), np.int64)
            each[~one] = np.fromiter(map(len, several), np.int64, len(several))
            if not each.sum():
                return None
            named = pa.concat_arrays([pc.ascii_lower(words.filter(pa.array(one))), pa.array(chain.from_iterable(several), pa.string())]).dictionary_encode()
            terms, number = named.dictionary, np.asarray(named.indices, np.int64)
            # Numbers of each word's terms, one word after another.
            start, flat, single = np.cumsum(each) - each, np.empty(each.sum(), np.int64), int(one.sum())
            flat[start[one]] = number[:single]
            flat[np.repeat(~one, each)] = number[single:]
            n = each[code]
            place = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.repeat(of_word, n) * len(terms) + flat[place]
            key.sort()
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tf = np.diff(np.append(begin, len(key)))
            of, term = np.divmod(key[begin], len(terms))
            if max_tf:
                tf = np.minimum(tf, max_tf)
            length = np.bincount(of, tf, len(ids)).astype(np.int64)
            held = np.flatnonzero(length)
            if some is not None:
                kept = pc.is_in(terms, value_set=some).to_numpy(zero_copy_only=False)[term]
                of, term, tf = of[kept], term[kept], tf[kept]
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids))[held])])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([terms.take(pa.array(term)), pa.array(tf.astype(np.int64))], ["term", "tf"]))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(held)), pa.array(length[held]), lists], [id, "dl", "terms"])

        for batch in batches:
            ids, lists = batch.columns
            texts, rows = lists.flatten().cast(pa.binary()), batch.num_rows
            of = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            chars = np.bincount(of, pc.binary_length(texts).to_numpy(zero_copy_only=False), rows)
            cuts = np.flatnonzero(np.diff(np.cumsum(chars) // PIECE)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), rows], strict=True):
                a, b = np.searchsorted(of, [i, j])
                made = piece(ids.slice(i, j - i), of[a:b] - i, texts.slice(a, b - a).to_pylist())
                if made is not None:
                    yield made

    rows = chunks.select(id, body.alias("_t"))
    whole = rows.select(id, F.array_compact(F.array("_t")).alias("_t")) if by_row else rows.groupBy(id).agg(F.collect_list("_t").alias("_t"))
    return whole.mapInArrow(run, schema)


def postings(chunks: DataFrame, id: str = "chunk_id", text: Column | str = "text", max_tf: int = MAX_TF) -> DataFrame:
    """(id, term, tf): how often a term occurs in a chunk, at most max_tf times (0: no cap)."""
    return counted(chunks, id, text, max_tf).select(id, F.inline("terms"))


def build(chunks: DataFrame, id: str = "chunk_id", text: Column | str = "text", max_tf: int = MAX_TF) -> Index:
    """The index of chunks as lazy plans; `written` keeps it."""
    return of_postings(counted(chunks, id, text, max_tf).select(id, F.inline("terms"), "dl"), id)


BROADCAST_TERMS = 500_000


def written_for(chunks: DataFrame, terms: DataFrame, id: str = "chunk_id", text: Column | str = "text", max_tf: int = MAX_TF, label: str = "asked") -> Index:
    """The index of a batch of queries, written once: postings of the asked terms (a table with the column `term`) alone.

    Lengths and corpus figures are those of all terms.  Each chunk is one row with its length and its asked terms, so
    what is written and read again follows the queries and the number of chunks.  Texts are counted where they are read;
    only those whose id comes again are brought together and counted as one chunk.
    """
    asked = terms.select("term").distinct()
    some = [r.term for r in asked.limit(BROADCAST_TERMS + 1).collect()]
    if len(some) <= BROADCAST_TERMS:
        rows = stored(counted(chunks, id, text, max_tf, some, by_row=True), label)
        again = stored(rows.groupBy(id).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(id).alias("_id")), "again")
        if not again.isEmpty():
            same = F.col(id).eqNullSafe(F.col("_id"))
            rows = stored(rows.join(again, same, "left_anti").unionByName(counted(chunks.join(again, same, "left_semi"), id, text, max_tf, some)), label)
        kept = rows.withColumnRenamed("terms", "_terms")
    else:
        marked = build(chunks, id, text, max_tf).postings.join(asked.withColumn("_asked", F.lit(True)), "term", "left")
        kept = stored(marked.groupBy(id).agg(F.sum("tf").alias("dl"), F.collect_list(F.when(F.col("_asked"), F.struct("term", "tf"))).alias("_terms")), label)
    posted = kept.select(id, F.inline("_terms"), "dl")
    return Index(posted, kept.select(id, "dl"), posted.groupBy("term").agg(F.count("*").alias("df")), kept.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), kept.withColumnRenamed("_terms", "terms"))


def met(asked: DataFrame, index: Index) -> DataFrame:
    """Postings of the terms of `asked` (term, ...) with its columns.

    What is asked is written once and, if it is few, goes to all postings; postings are never broadcast, however small their files are.
    """
    asked = stored(asked, "chosen")
    few = asked.count() <= BROADCAST_TERMS
    return index.postings.join(F.broadcast(asked), "term") if few else asked.join(index.postings.hint("merge"), "term")


def written(index: Index, id: str = "chunk_id", label: str = "index") -> Index:
    """The index with its postings written once: texts are read and cut into terms a single time, whatever is asked."""
    return of_postings(stored(index.postings, label), id)


def save(index: Index, path: str, files: int | None = None) -> None:
    """Writes the postings, sorted by term within files that each hold a range of terms, so that a lookup reads few of them."""
    ranged = index.postings.repartitionByRange(files, "term") if files else index.postings.repartitionByRange("term")
    ranged.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, id: str = "chunk_id") -> Index:
    return of_postings(spark.read.parquet(path), id)


def of_postings(posted: DataFrame, id: str) -> Index:
    lengths = posted.groupBy(id).agg(F.first("dl").alias("dl"))
    return Index(posted, lengths, posted.groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def df_delta(old: DataFrame, new: DataFrame, id: str = "chunk_id") -> DataFrame:
    """(term, delta) of document frequencies between two sets of postings; chunks that did not change cancel."""
    signed = old.select("term", F.lit(-1).alias("d")).unionByName(new.select("term", F.lit(1).alias("d")))
    return signed.groupBy("term").agg(F.sum("d").alias("delta")).filter("delta <> 0")


def text_delta(chunks: DataFrame, old: Column | str, new: Column | str, id: str = "chunk_id") -> DataFrame:
    """`df_delta` of the postings of two texts of each chunk, before and after.

    All texts are compared; only those of ids that changed are cut into terms, and terms that an id keeps cancel before
    anything is said of them.  Rows with one id count as one chunk, as in `postings`.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    moved = ~a.eqNullSafe(b)
    texts = F.struct(a.alias("a"), F.when(moved, b).alias("b"), moved.alias("moved"))
    whole = chunks.select(id, texts.alias("_t")).groupBy(id).agg(F.collect_list("_t").alias("_t")).filter(F.exists("_t", lambda t: t["moved"]))
    sides = whole.select(F.transform("_t", lambda t: t["a"]).alias("a"), F.transform("_t", lambda t: F.when(t["moved"], t["b"]).otherwise(t["a"])).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[str, ...]] = {}
        delta: Counter[str] = Counter()

        def words(texts: list[str | None]) -> set[bytes]:
            return {w for t in texts if t for w in t.encode().translate(_RUNS).split()}

        def terms(words: set[bytes]) -> set[str]:
            found: set[str] = set()
            for w in words:
                of_word = known.get(w)
                if of_word is None:
                    if len(known) >= KEPT:
                        known.clear()
                    of_word = known[w] = terms_of(w)
                found.update(of_word)
            return found

        def said() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(delta), pa.string()), pa.array(list(delta.values()), pa.int64())], ["term", "delta"])
            delta.clear()
            return made

        for batch in batches:
            for before, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gone, come = words(before), words(after)
                both = gone & come
                gone, come = terms(gone - both), terms(come - both)
                if gone or come:
                    stay = terms(both)  # a term may lie in words of both kinds
                    delta.update(come - gone - stay)
                    delta.subtract(gone - come - stay)
                if len(delta) >= KEPT:
                    yield said()
        yield said()

    return sides.mapInArrow(run, "term string, delta long").groupBy("term").agg(F.sum("delta").alias("delta")).filter("delta <> 0")


def inverted(chunks: DataFrame, names: str, id: str = "chunk_id") -> DataFrame:
    """(ident, id) of an array column of names."""
    return chunks.select(F.explode(F.array_distinct(names)).alias("ident"), id)


def compare_snapshots(indexed: DataFrame, live: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(path, status) of a re-index: new, changed, unchanged or deleted, by content hashes."""
    a, b = indexed.select(F.col(path), F.col(digest).alias("_old")), live.select(F.col(path), F.col(digest).alias("_new"))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, path, "full").select(path, status.alias("status"))


def replace_files(chunks: DataFrame, put: DataFrame, gone: DataFrame, path: str = "path") -> DataFrame:
    """The chunk table after files were put (all their chunks replaced) or deleted."""
    touched = put.select(path).unionByName(gone.select(path)).distinct()
    return chunks.join(touched, path, "left_anti").unionByName(put)


def freshness(indexed: DataFrame, live: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """(path, state) of what is indexed: current, stale (its file changed) or missing."""
    now = live.select(F.col(path), F.col(digest).alias("_new"))
    state = F.when(F.col("_new").isNull(), "missing").when(F.col("_new") == F.col(digest), "current").otherwise("stale")
    return indexed.select(path, digest).join(now, path, "left").select(path, state.alias("state"))


def removed(indexed: DataFrame, live: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are indexed and no longer there."""
    return indexed.select(path).distinct().join(live.select(path), path, "left_anti")


def list_files(chunks: DataFrame, path: str = "path") -> DataFrame:
    return chunks.select(path).distinct()


def get_chunks(asked: DataFrame, chunks: DataFrame, id: str = "chunk_id") -> DataFrame:
    """The asked chunks that exist, with what was asked of them (its place, its query).

    What is asked is written once and, if it is few, goes to the chunks, so that their texts are not shuffled.
    """
    asked = stored(asked, "chosen")
    return (F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked).join(chunks, id)
