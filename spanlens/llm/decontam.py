"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  The
least k-gram hash of each window of w k-grams is a fingerprint of a document; benchmark items
get fingerprints in the same way.  Any shared span of w + k - 1 words holds a shared
fingerprint, so joining the two finds every span of that length; a hit is then extended: each
window of `span` words around a shared fingerprint is looked up among the items' windows and
compared word by word, and windows that touch become one span.  Items shorter than `span` are
one window of their own length, looked up everywhere.  The work is linear in the text, whatever
repeats in it or in the items.

Scale: documents are read once per block of benchmark items and never shuffled; a block holds
at most `block_chars` characters of items, so what is sent to the workers has a fixed bound and
a larger benchmark only means more blocks, whose hits are merged per document.  An item longer
than a block is cut into overlapping parts (`span` - 1 words shared) that keep its id.

Defined results: null or wordless text has no words, no hits; null item ids or texts are
skipped; repeated rows are judged alike, each on its own; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import freed, spread, table, text_blocks
from spanlens.llm.words import alnum_hashes, grams, mix

SPAN, GRAM = 10, 5
BLOCK_CHARS = 16_000_000


class Windows:
    """The windows of n words of a set of items: sorted hashes, where each can be read, and which items hold it.

    Windows that the same items hold share a group, so a passage of many items names them once.
    """

    def __init__(self, words: np.ndarray, parts: list[tuple[int, int, int]], n: int):
        """parts: (item, begin, end) of each text in `words`."""
        self.n = n
        marks, offsets, owners = [], [], []
        for item, begin, end in parts:
            mark, at = np.unique(grams(words[begin:end], n), return_index=True)
            marks.append(mark)
            offsets.append(at + begin)
            owners.append(np.full(len(mark), item))
        mark, at, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (marks, offsets, owners))
        order = np.lexsort((owner, mark))
        mark, at, owner = mark[order], at[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]])) if len(mark) else np.zeros(0, np.int64)
        self.mark, self.at = mark[first], at[first]
        ends = np.concatenate([first[1:], [len(mark)]]).astype(np.int64)
        if len(first):
            key = mix(np.add.reduceat(mix(owner.astype(np.uint64) + np.uint64(1)), first) + (ends - first).astype(np.uint64))
            _, some, self.group = np.unique(key, return_index=True, return_inverse=True)
        else:
            some, self.group = first, first
        self.owners = [owner[first[k] : ends[k]] for k in some]

    def find(self, words: np.ndarray, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts in h where a window lies, word for word, and the groups met."""
        if not len(starts) or not len(self.mark):
            return starts[:0], starts[:0]
        w = np.full(len(starts), np.uint64(self.n), np.uint64)
        for i in range(self.n):
            w = mix(w + h[starts + i])
        k = np.minimum(np.searchsorted(self.mark, w), len(self.mark) - 1)
        hit = np.flatnonzero(self.mark[k] == w)
        for i in range(self.n):
            hit = hit[words[self.at[k[hit]] + i] == h[starts[hit] + i]]
        return starts[hit], np.unique(self.group[k[hit]])


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[str, np.ndarray]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram, self.window = span, gram, span - gram + 1
        self.ids = [i for i, _ in items]
        self.words = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
        marks, parts, at = [np.zeros(0, np.uint64)], {}, 0
        for n, (_, h) in enumerate(items):
            if len(h):
                parts.setdefault(min(span, len(h)), []).append((n, at, at + len(h)))
            if len(h) >= span:
                g = grams(h, gram)
                marks.append(g[winnow(g, self.window)])
            at += len(h)
        self.mark = np.unique(np.concatenate(marks))
        self.tables = [Windows(self.words, rows, n) for n, rows in sorted(parts.items())]

    def places(self, h: np.ndarray, n: int) -> np.ndarray:
        """Where a window of n words may begin: around shared fingerprints, or anywhere for items too short to have any."""
        if len(h) < n:
            return np.zeros(0, np.int64)
        if n < self.span:
            return np.arange(len(h) - n + 1)
        g = grams(h, self.gram)
        at = winnow(g, self.window)
        k = np.minimum(np.searchsorted(self.mark, g[at]), len(self.mark) - 1)
        hit = at[self.mark[k] == g[at]]
        starts = np.unique(hit[:, None] - np.arange(self.window)[None, :])
        return starts[(starts >= 0) & (starts <= len(h) - n)]

    def hits(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end) of words that are hit, and the ids of the items with a window in the text."""
        found: set[str] = set()
        edge = None
        for table in self.tables:
            starts, groups = table.find(self.words, h, self.places(h, table.n))
            if len(starts):
                edge = np.zeros(len(h) + 1, np.int64) if edge is None else edge
                edge[starts] += 1
                edge[starts + table.n] -= 1
                for g in groups.tolist():
                    found.update(self.ids[i] for i in table.owners[g].tolist())
        if edge is None:
            return [], found
        inside = np.concatenate([[False], np.cumsum(edge) > 0]).astype(np.int8)
        turns = np.flatnonzero(np.diff(inside))
        return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)), found


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Positions of each window's least hash (its first, if there are more), without repeats."""
    n = len(g) - window + 1
    if n <= 0:
        return np.array([int(np.argmin(g))]) if len(g) else np.zeros(0, int)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    at = np.argmin(views, axis=1) + np.arange(n)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", span: int = SPAN, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The benchmark in blocks of bounded size, item by item through the driver."""
    block: list[tuple[str, np.ndarray]] = []
    room = block_chars
    rows = benchmark.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), text)
    for name, body in rows.toLocalIterator(prefetchPartitions=False):
        h = alnum_hashes(body)
        step = max(span, block_chars // 8)
        for at in range(0, max(1, len(h)), step):
            part = h[at : at + step + span - 1]
            if at and len(part) < span:
                break
            if block and room < 8 * len(part):
                yield block
                block, room = [], block_chars
            block.append((name, part))
            room -= 8 * len(part)
    yield block


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: its key, n_words, spans of hit words and the items with windows in it.

    Blocks follow one another as narrow passes; each adds its hits to those before it.
    """
    sc = docs.sparkSession.sparkContext
    found = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key")
    key_type = found.schema["key"].dataType.simpleString()
    blocks = list(item_blocks_broadcast(sc, benchmark, span, block_chars))
    hit_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    for nth, shared in enumerate(blocks):
        last = nth == len(blocks) - 1

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, first=nth == 0, last=last) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, span, gram)
            for batch in text_blocks(batches, "text"):
                before = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True) if not first else (([], []) for _ in range(batch.num_rows))
                words, spans, names = [], [], []
                for body, (old, seen) in zip(batch.column(1).to_pylist(), before, strict=True):
                    h = alnum_hashes(body)
                    hit, new = items.hits(h)
                    words.append(len(h))
                    spans.append([{"s": s, "e": e} for s, e in (merged([*hit, *((x["s"], x["e"]) for x in old)]) if old else hit)])
                    names.append(sorted({*seen, *new}))
                columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(spans, hit_type), pa.array(names, pa.list_(pa.string()))]
                titles = ["key", "n_words", "spans", "items"]
                if not last:
                    columns.insert(1, batch.column(1))
                    titles.insert(1, "text")
                yield pa.RecordBatch.from_arrays(columns, names=titles)

        body = "" if last else "text string, "
        found = found.mapInArrow(freed(judge), f"key {key_type}, {body}n_words long, spans array<struct<s:int,e:int>>, items array<string>")
    return found.withColumnRenamed("key", key)


def item_blocks_broadcast(sc, benchmark: DataFrame, span: int, block_chars: int):
    for block in item_blocks(benchmark, span=span, block_chars=block_chars):
        yield sc.broadcast(block)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", span: int = SPAN, gram: int = GRAM, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, with all their columns, that share no window with any item: one narrow pass for each block."""
    sc = docs.sparkSession.sparkContext
    for block in item_blocks(benchmark, span=span, block_chars=block_chars):
        shared = sc.broadcast(block)

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value, span, gram)
            for batch in text_blocks(batches, text):
                bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
                yield batch.filter(pa.array([not items.hits(alnum_hashes(body))[0] for body in bodies], pa.bool_()))

        docs = docs.mapInArrow(freed(judge), docs.schema)
    return docs


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (a, x) -> a + (x.e - x.s))")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
