"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations.

Each of `tables` tables turns a vector by `rotations` pseudo-random rotations (three rounds of
random signs and a fast Hadamard transform); in each the axis of the largest coordinate and its
sign are one digit of the bucket.  A vector lives in one bucket of a table and also visits, for
each rotation, the bucket with the second-best digit there.  Pairs of a resident and any other
member of a bucket are candidates; their cosine in double precision decides.  With the
defaults, vectors of cosine 0.9 meet with a chance of 0.9997 (measured on random vectors of 64
numbers), nearer ones more surely.

Equal vectors are one class with a weight, so copies are never compared.  Buckets beyond
`block` members are cut into blocks, and pairs of blocks are compared apart, each a group of
bounded size.  A link is counted only in the first table and bucket that finds it, so no list of
pairs is ever shuffled: a group gives back counts and a spanning star for each of its
components.  Component ids come from large-star and small-star rounds over those.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers link with
nothing and are components of their own; vectors of different lengths don't link; null ids stay
null; repeated rows are copies; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import components, freed, materialise, spread, table
from spanlens.llm.words import mix

TABLES, ROTATIONS, BLOCK, THRESHOLD, SEED = 12, 2, 1024, 0.9, 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows (their length is a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def buckets(x: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """(vectors, tables, 1 + rotations): each table's own bucket first, then those visited."""
    n, dim = x.shape
    d = 1 << max(0, dim - 1).bit_length()
    wide = np.zeros((n, d))
    wide[:, :dim] = x
    rng = np.random.default_rng([seed, dim])
    out = np.empty((n, tables, 1 + rotations), np.uint64)
    at = np.arange(n)
    for t in range(tables):
        best, second = [], []
        for _ in range(rotations):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            z = np.concatenate([y, -y], axis=1)
            one = np.argmax(z, axis=1)
            z[at, one] = -np.inf
            best.append(one.astype(np.uint64))
            second.append(np.argmax(z, axis=1).astype(np.uint64))
        for visit in range(1 + rotations):
            key = np.full(n, (dim << 20) + t + 1, np.uint64)
            for r in range(rotations):
                key = mix(key * np.uint64(2 * d + 1) + (second[r] if visit == r + 1 else best[r]))
            out[:, t, visit] = key
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: directions stay as they are, to the last bit, and no square over- or underflows."""
    top = np.abs(x).max(axis=-1, keepdims=True)
    return np.ldexp(x, -np.frexp(top)[1])


def _floats(kind: str) -> str:
    return "<f4" if "float" in kind else "<f8"


def _sketch(key: str, kind: str, tables: int, rotations: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows = batch.column(1).to_pylist()
                vectors: list[bytes | None] = [None] * len(rows)
                codes: list = [None] * len(rows)
                by_dim: dict[int, list[int]] = {}
                for i, v in enumerate(rows):
                    if v and None not in v:
                        a = np.array(v, "<f8")
                        if np.isfinite(a).all() and a.any():
                            vectors[i] = np.array(v, _floats(kind)).tobytes()
                            by_dim.setdefault(len(v), []).append(i)
                for _, index in by_dim.items():
                    found = buckets(scaled(np.array([rows[i] for i in index], "<f8")), tables, rotations, seed).reshape(len(index), -1).view(np.int64)
                    for i, c in zip(index, found, strict=True):
                        codes[i] = c
                digests = [xxhash.xxh3_128_intdigest(v) if v is not None else None for v in vectors]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([None if x is None else (x >> 64) - (1 << 63) for x in digests], pa.int64()),
                        pa.array([None if x is None else (x & ((1 << 64) - 1)) - (1 << 63) for x in digests], pa.int64()),
                        pa.array(vectors, pa.binary()),
                        pa.array(codes, pa.list_(pa.int64())),
                    ],
                    names=[key, "h1", "h2", "vector", "codes"],
                )

    return run


class _Groups:
    """Compares the members of a group and gathers counts and stars."""

    def __init__(self, kind: str, threshold: float, tables: int, rotations: int, seed: int):
        self.kind, self.threshold, self.args = kind, threshold, (tables, rotations, seed)
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.stars: list[tuple[np.ndarray, np.ndarray]] = []

    def compare(self, ids, weights, homes, blocks, vectors, bucket: int, lo: int, hi: int) -> None:
        x = scaled(np.stack([np.frombuffer(v, _floats(self.kind)) for v in vectors]).astype("<f8"))
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = unit @ unit.T >= self.threshold
        near &= homes[:, None] | homes[None, :]
        if lo != hi:
            near &= blocks[:, None] != blocks[None, :]
        np.fill_diagonal(near, False)
        if not near.any():
            return
        some = np.flatnonzero(near.any(axis=1))
        near = near[np.ix_(some, some)]
        label = np.arange(len(some))
        while True:  # least member within reach
            new = np.minimum(label, np.where(near, label[None, :], len(label)).min(axis=1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        member = label != np.arange(len(label))
        self.stars.append((ids[some][member], ids[some][label[member]]))
        a, b = np.nonzero(np.triu(near, 1))
        mine = self._first(buckets(x[some], *self.args), a, b, bucket)
        a, b = a[mine], b[mine]
        w = weights[some]
        self.ids.append(ids[some])
        self.counts.append(np.bincount(a, w[b], len(some)) + np.bincount(b, w[a], len(some)))

    @staticmethod
    def _first(codes: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
        """Which of the pairs no earlier table, and no lower bucket of the same table, finds."""
        mine = np.zeros(len(a), bool)
        here = np.uint64(bucket & ((1 << 64) - 1))
        for at in range(0, len(a), 20_000):
            x, y = codes[a[at : at + 20_000]], codes[b[at : at + 20_000]]
            at_x = (y == x[:, :, :1]).any(axis=2)  # y is at home in or visits x's own bucket
            at_y = (x == y[:, :, :1]).any(axis=2)
            first = np.argmax(at_x | at_y, axis=1)
            i = np.arange(len(first))
            top = np.uint64((1 << 64) - 1)
            low = np.minimum(np.where(at_x[i, first], x[i, first, 0], top), np.where(at_y[i, first], y[i, first, 0], top))
            mine[at : at + 20_000] = low == here
        return mine

    def batch(self) -> pa.RecordBatch:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        n = np.concatenate(self.counts).astype(np.int64) if self.counts else np.zeros(0, np.int64)
        star = [np.concatenate([s[i] for s in self.stars]) if self.stars else np.zeros(0, np.int64) for i in (0, 1)]
        self.ids, self.counts, self.stars = [], [], []
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids, star[0]])), pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(star[1])]), pa.concat_arrays([pa.array(n), pa.nulls(len(star[0]), pa.int64())])],
            names=["a", "b", "n"],
        )


def _compare(kind: str, threshold: float, tables: int, rotations: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(kind, threshold, tables, rotations, seed)
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table) -> None:
            bucket, lo, hi, blocks, ids, w = (rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "id", "w"))
            homes = np.asarray(rows.column("home").to_pylist(), bool)
            vectors = rows.column("vector").to_pylist()
            change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            edges = [0, *change.tolist(), len(ids)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if e - s > 1:
                    groups.compare(ids[s:e], w[s:e], homes[s:e], blocks[s:e], vectors[s:e], int(bucket[s]), int(lo[s]), int(hi[s]))

        def key(b: pa.RecordBatch, i: int) -> tuple:
            return tuple(b.column(b.schema.get_field_index(c))[i].as_py() for c in ("bucket", "lo", "hi"))

        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come sorted by group: what ends a batch may go on in the next.
            last, n = key(batch, batch.num_rows - 1), batch.num_rows
            low, high = 0, n - 1
            while low < high:  # first row of the last group
                mid = (low + high) // 2
                if key(batch, mid) == last:
                    high = mid
                else:
                    low = mid + 1
            if low or (held and key(held[-1], held[-1].num_rows - 1) != last):
                work(pa.Table.from_batches([*held, batch.slice(0, low)]))
                held = []
                yield groups.batch()
            held.append(batch.slice(low))
        if held:
            work(pa.Table.from_batches(held))
            yield groups.batch()

    return run


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, rotations: int = ROTATIONS, block: int = BLOCK, seed: int = SEED
) -> DataFrame:
    """(key, n_links, component_id) of every row."""
    kind = df.schema[vector].dataType.simpleString()
    source = spread(df.select(F.col(key).cast("long").alias(key), vector), key)
    sketch = materialise(source.mapInArrow(freed(_sketch(key, kind, tables, rotations, seed)), f"`{key}` long, h1 long, h2 long, vector binary, codes array<long>"), "vectors")
    classes = materialise(sketch.filter(F.col("h1").isNotNull() & F.col(key).isNotNull()).groupBy("h1", "h2").agg(F.min(key).alias("id"), F.count("*").alias("w")), "classes", rows=sketch.count())
    members = sketch.withColumnRenamed(key, "id").join(classes, ["h1", "h2", "id"]).dropDuplicates(["id", "h1", "h2"]).select("id", "w", "vector", "codes")
    members = materialise(members, "members")
    visits = members.select("id", F.posexplode("codes").alias("at", "bucket")).select("id", "bucket", (F.col("at") % (1 + rotations) == 0).alias("home"))
    # A vector may visit the bucket it lives in through another table's digits only; once is enough.
    visits = visits.groupBy("id", "bucket").agg(F.max("home").alias("home"))
    sizes = visits.groupBy("bucket").agg(F.count("*").alias("c"), F.max("home").alias("lived")).filter("c > 1 and lived").select("bucket", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    placed = visits.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    grouped = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "id", "bucket", "home", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    full = grouped.join(members.select("id", "w", "vector"), "id").select("bucket", "lo", "hi", "block", "id", "w", "home", "vector")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = full.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    found = materialise(dealt.mapInArrow(freed(_compare(kind, threshold, tables, rotations, seed)), "a long, b long, n long"), "vector-links")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = components(members.select("id"), found.filter("b is not null").select("a", "b"))
    named = classes.join(counts, "id", "left").join(comps, "id", "left")
    named = named.select("h1", "h2", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return sketch.select(key, "h1", "h2").join(named, ["h1", "h2"], "left").select(
        key, F.when(F.col(key).isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)).alias("component_id")
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
