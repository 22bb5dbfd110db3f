"""MinHash near-dedup: one permutation, optimal densification, bands, star-shaped candidates.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased.  A document's set is its distinct k-word
shingles (with fewer words, the whole sequence as one), as 64-bit hashes.  One permutation
splits the hash range into 128 bins and keeps the least of each; an empty bin borrows from a
bin drawn for it, over and over, until one is full.  25 bands of 5 bins give buckets: sets with
a Jaccard similarity of 0.85 share a bucket with a chance of 1 - 4e-7, at 0.8 1 - 5e-5.

Equal sets become one node first, so copies never meet in a bucket.  Each bucket is a star: its
centre is the member whose buckets hold the most other members, the likeliest to be what the
rest were copied from, and candidates are (centre, member), at most one pair for each member
and band.  The pairs are confirmed on the full sets; components follow by large-star and
small-star rounds.

What a star may miss is found exactly.  Members of buckets that still hold more than one
component are joined by prefix: with shingles ordered from rare to frequent, two sets as alike
as asked share one among their first few, and its places bound what they can have in common.
A text of such a bucket that is alike to none has its own rare shingles there and meets nobody;
pairs within a component, and a shingle's pairs within its largest component, are never made.
So all links between components are found that join sets sharing a bucket.

Scale: texts leave the scan only for documents that share a bucket with another set; nothing is
collected to the driver; hot sets, buckets and shingles are counted before any shuffle and
joined in ways that can be split.  Tables that nothing reads any more are deleted on the way.

Defined results: no words: no shingles, linked with nothing, its own component; null ids stay
null and link with nothing; rows of one id are each judged by their own text; an empty table
gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.llm.common import components, discard, freed, materialise, spread, table, text_blocks
from spanlens.llm.words import blank_words, grams, hashes, mix

BINS, BANDS, ROWS = 128, 25, 5
_EDGES = (np.arange(BINS, dtype=np.uint64) << np.uint64(57)).astype(np.uint64)
# Which bin an empty bin asks on each attempt: the universal hash of optimal densification.
_ASK = (mix((np.arange(1, 65, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(BINS, dtype=np.uint64)[None, :]) >> np.uint64(57)).astype(np.int64)
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    h = hashes(blank_words(text))
    return np.unique(grams(h, min(k, len(h)))) if len(h) else h


def signature(sets: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    at = np.searchsorted(sets, _EDGES)
    ends = np.concatenate([at[1:], [len(sets)]])
    full = ends > at
    sig = sets[np.minimum(at, len(sets) - 1)]
    if not full.all():
        src = np.arange(BINS)
        empty = np.flatnonzero(~full)
        for ask in _ASK:
            src[empty] = ask[empty]
            empty = empty[~full[src[empty]]]
            if not len(empty):
                break
        src[empty] = int(np.flatnonzero(full)[0])
        sig = sig[src]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    key = _BAND.copy()
    for i in range(ROWS):
        key = mix(key ^ rows[:, i])
    return key.view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            size, mark, bands = [], [], []
            for body in batch.column(1).to_pylist():
                s = shingles(body, k)
                size.append(len(s))
                mark.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "mark", "bands"]
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches):
            sets = [shingles(body, k).tobytes() for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["mark", "hashes"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each set as a list."""
    for batch in text_blocks(batches, "hashes"):
        sets = [np.frombuffer(s, np.int64) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["mark", "tokens"])


def _confirm(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a, a = None, None
        for batch in batches:
            ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, left, right) in enumerate(zip(ids_a, batch.column(2), batch.column(3), strict=True)):
                if x != last_a:
                    last_a, a = x, np.frombuffer(left.as_py(), np.uint64)
                b = np.frombuffer(right.as_py(), np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if 100 * both >= per_cent * (len(a) + len(b) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([ids_a[i] for i in keep], pa.binary()), pa.array([ids_b[i] for i in keep], pa.binary())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough, stored."""
    with_a = pairs.join(sets.select(F.col("mark").alias("a"), F.col("hashes").alias("ha")), "a")
    with_b = with_a.join(sets.select(F.col("mark").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")
    return materialise(with_b.mapInArrow(freed(_confirm(per_cent)), "a binary, b binary"), "links")


def star_pairs(members: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's centre, if their sizes allow it."""
    known = members.groupBy("mark").agg(F.sum(F.col("c") - 1).alias("met"))
    centre = members.join(known, "mark").groupBy("bucket").agg(F.max(F.struct("met", "mark", "n")).alias("m")).select("bucket", F.col("m.mark").alias("cm"), F.col("m.n").alias("cn"))
    met = members.join(centre, "bucket").filter("mark <> cm").filter(f"100 * least(n, cn) >= {per_cent} * greatest(n, cn)")
    return met.select(F.least("mark", "cm").alias("a"), F.greatest("mark", "cm").alias("b")).distinct()


def prefix_pairs(parts: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """(a, b) of different `comp` that may be alike enough: an exact join on the rarest shingles of (mark, n, comp)."""
    tokens = sets.join(parts, "mark", "left_semi").mapInArrow(freed(_tokens), "mark binary, tokens array<long>").select("mark", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).filter("f > 1")
    by_mark = Window.partitionBy("mark")
    ranked = tokens.join(often, "token").select("mark", "token", F.row_number().over(by_mark.orderBy("f", "token")).alias("r"), F.count("*").over(by_mark).alias("known"))
    # A shingle that no other set holds comes before all of these, and finds nothing.
    placed = ranked.join(parts, "mark").withColumn("at", F.col("n") - F.col("known") + F.col("r") - 1)
    rows = materialise(placed.filter(f"at <= n - ({per_cent} * n + 99) div 100").select("token", "mark", "n", "comp", "at"), "prefixes")
    main = rows.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k"))
    split = rows.join(main.filter("k > 1").select("token", F.col("m.comp").alias("main")), "token")
    x, y = split.filter("comp <> main").alias("x"), split.alias("y")
    # The smaller set meets with its first few shingles only, the larger with some more.
    least = f"({per_cent} * (x.n + y.n) + {99 + per_cent}) div {100 + per_cent}"  # what the two must have in common
    fits = (
        "x.token = y.token AND x.comp <> y.comp AND (y.comp = y.main OR x.mark < y.mark)"
        f" AND 100 * least(x.n, y.n) >= {per_cent} * greatest(x.n, y.n)"
        f" AND least(x.n - x.at, y.n - y.at) >= {least}"
    )
    return x.join(y, F.expr(fits)).select(F.least("x.mark", "y.mark").alias("a"), F.greatest("x.mark", "y.mark").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, per_cent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id): sets with 100 * |A and B| >= per_cent * |A or B| are linked."""
    source = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id")
    sketch = materialise(source.mapInArrow(freed(_sketch(k)), "id long, n long, mark binary, bands array<long>"), "sketch")
    # One node for each set, with the least id of its rows.
    nodes = sketch.filter("mark IS NOT NULL AND id IS NOT NULL").groupBy("mark").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    banded = nodes.select("mark", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1")
    members = materialise(banded.join(sizes, "bucket"), "members")
    near = members.select("mark").distinct().join(nodes.select("mark", "rep"), "mark").select(F.col("rep").alias("id")).distinct()
    sets = materialise(source.join(near, "id", "left_semi").mapInArrow(freed(_sets(k)), "mark binary, hashes binary").dropDuplicates(["mark"]), "sets")

    links = confirmed(star_pairs(members, per_cent), sets, per_cent)
    comp = components(nodes.select(F.col("mark").alias("id")), links)
    # Buckets that are not one component yet, by their members.
    named = members.select("bucket", "mark", "n").join(comp.select(F.col("id").alias("mark"), "component_id"), "mark", "left")
    named = named.select("bucket", "mark", "n", F.coalesce("component_id", "mark").alias("comp"))
    open_buckets = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    parts = materialise(named.join(open_buckets, "bucket", "left_semi").select("mark", "n", "comp").distinct(), "parts")
    more = confirmed(prefix_pairs(parts, sets, per_cent), sets, per_cent)
    discard(members, parts, sets)
    if not more.isEmpty():
        comp = components(nodes.select(F.col("mark").alias("id")), comp.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more))

    within = comp.unionByName(comp.select(F.col("component_id").alias("id"), "component_id").distinct()).select(F.col("id").alias("mark"), "component_id")
    roots = within.join(nodes.select("mark", "rep"), "mark").groupBy("component_id").agg(F.min("rep").alias("root"))
    names = nodes.select("mark", "rep").join(within.join(roots, "component_id").select("mark", "root"), "mark", "left").select("mark", F.coalesce("root", "rep").alias("root"))
    out = sketch.select("id", "n", "mark").join(names, "mark", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows, with all their columns, that stand for their group: those of the least id.

    Of rows with one id and one text a single one stays; rows with null ids link with nothing and stay.
    """
    found = materialise(near_duplicates(docs, key, text, k, per_cent), "groups")
    others = found.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(others, key, "left_anti")
    repeated = materialise(found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "repeated")
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key, text]))
    return kept.select(docs.columns)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, per_cent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
