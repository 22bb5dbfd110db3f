"""Packing token ids into windows by dynamic programming, in document order.

The ids of the documents of a partition, in the order of the rows, form one stream.  Cuts may
fall after a document (free) or after a sentence (`sentence_penalty` tokens).  Sentences longer
than `long` tokens, which could leave a window half empty, may be truncated at multiples of
`stride` tokens (`hard_penalty`).  A window from cut i to cut j
holds at most `size` ids and costs its padding plus the penalty of cut j:

    best(j) = size - c(j) + penalty(j) + min over c(j) - size <= c(i) < c(j) of best(i) + c(i)

The minimum slides with j, so a monotone queue gives each transition in constant time.  The
last window of a stream, if cutting it into powers of two (which need no padding) costs less
than its padding, is cut so.  Streams are worked off in runs of about `run_ids` ids whose last
window is carried over, so memory does not grow with the partition.

Defined results: null or empty text is the end id alone; a document longer than a window
spreads over several in order; repeated rows are documents of their own; no rows, no windows.
Only the columns named are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.bpe import encoder
from spanlens.llm.common import freed, row_key, spread, table, text_blocks

SIZE, END_ID = 2048, 1
_ENDS: dict[str, np.ndarray] = {}  # of this worker process, by tokenizer
SENTENCE_PENALTY, HARD_PENALTY, STRIDE, LONG = 2.0, 8.0, 24, 256


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id whether its token ends a sentence or a line."""
    ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    for token, i in tokenizer.get_vocab().items():
        core = token.rstrip("\"')]”’»")
        ends[i] = core[-1:] in (".", "!", "?", "Ċ")
    return ends


def cuts(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, sentence_penalty: float, hard_penalty: float, stride: int, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and the penalty of each; the last is the end of the stream."""
    at = np.flatnonzero(ends[ids]) + 1
    inside = np.union1d(at, doc_ends)
    gap = np.diff(np.concatenate([[0], inside]))
    hard = [np.arange(inside[i] - gap[i] + stride, inside[i], stride) for i in np.flatnonzero(gap > long)]
    every = np.union1d(inside, np.concatenate(hard)) if hard else inside
    cost = np.full(len(every), hard_penalty)
    cost[np.searchsorted(every, inside)] = sentence_penalty
    cost[np.searchsorted(every, doc_ends)] = 0.0
    return every, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Ends of the windows of least padding and penalties, by a monotone queue over the cuts."""
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, -1)])  # best(i) + c(i), c(i), i; least first
    back = []
    for j, (c, p) in enumerate(zip(at.tolist(), cost.tolist(), strict=True)):
        while queue[0][1] < c - size:
            queue.popleft()
        least, _, i = queue[0]
        back.append(i)
        value = least + size + p  # best(j) + c(j)
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, c, j))
    out, j = [], len(at) - 1
    while j >= 0:
        out.append(int(at[j]))
        j = back[j]
    return out[::-1]


def tail_cuts(length: int, size: int, hard_penalty: float) -> list[int]:
    """Lengths of the windows that take the end of a stream."""
    bits = [1 << b for b in range(size.bit_length(), -1, -1) if length >> b & 1]
    return bits if (len(bits) - 1) * hard_penalty < size - length else [length]


class Packer:
    """Takes documents one after another and gives back the pieces of finished windows."""

    def __init__(self, ends: np.ndarray, size: int, sentence_penalty: float, hard_penalty: float, stride: int, long: int = LONG):
        self.ends, self.size, self.penalties = ends, size, (sentence_penalty, hard_penalty, min(stride, size), min(long, size))
        self.hard_penalty = hard_penalty
        self.docs: list[tuple[object, np.ndarray, int]] = []  # (key, ids still to pack, ids before these)
        self.held = 0

    def add(self, key: object, ids: np.ndarray) -> None:
        self.docs.append((key, ids, 0))
        self.held += len(ids)

    def windows(self, last: bool) -> Iterator[list[tuple[object, np.ndarray, int, int]]]:
        """Pieces (key, ids, start, ids of the document) of each window; the last is held back unless `last`."""
        if not self.held:
            return
        ids = np.concatenate([d[1] for d in self.docs])
        doc_ends = np.cumsum([len(d[1]) for d in self.docs])
        at, cost = cuts(ids, doc_ends, self.ends, *self.penalties)
        edges = best_cuts(at, cost, self.size)
        if last:
            before = edges[-2] if len(edges) > 1 else 0
            tail = np.cumsum(tail_cuts(edges[-1] - before, self.size, self.hard_penalty)) + before
            edges = edges[:-1] + [int(x) for x in tail]
        else:
            edges = edges[:-1]
        n, used, begin = 0, 0, 0
        for edge in edges:
            pieces = []
            while begin < edge:
                key, body, start = self.docs[n]
                take = min(len(body) - used, edge - begin)
                pieces.append((key, body[used : used + take], start + used, start + len(body)))
                used, begin = used + take, begin + take
                if used == len(body):
                    n, used = n + 1, 0
            yield pieces
        if n < len(self.docs) and used:
            key, body, start = self.docs[n]
            self.docs[n] = (key, body[used:], start + used)
        self.docs = self.docs[n:]
        self.held = sum(len(d[1]) for d in self.docs)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SIZE,
    end_id: int = END_ID,
    tokenizer: str = "byte_bpe_50k.json",
    sentence_penalty: float = SENTENCE_PENALTY,
    hard_penalty: float = HARD_PENALTY,
    stride: int = STRIDE,
    long: int = LONG,
    run_ids: int = 500_000,
    with_ids: bool = True,
    known_units: int = 500_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    known_units and block_chars bound a worker's memory: parts of texts whose ids are kept, and characters
    encoded at once.
    """
    source = spread(docs.select(key, text), key)
    key_type = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pid = encoder(tokenizer, known_units), TaskContext.get().partitionId()
        if tokenizer not in _ENDS:
            _ENDS[tokenizer] = sentence_ends(enc.tokenizer)
        packer = Packer(_ENDS[tokenizer], size, sentence_penalty, hard_penalty, stride, long)
        n = 0
        arrow_key = None

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal n
            cols: list[list] = [[] for _ in range(8)]
            for pieces in packer.windows(last):
                offset = 0
                for k, ids, start, total in pieces:
                    for c, v in zip(cols, (k, start, len(ids), zlib.crc32(ids.tobytes()), total, row_key(pid, n), offset, ids if with_ids else None), strict=True):
                        c.append(v)
                    offset += len(ids)
                n += 1
            out = [pa.array(cols[0], arrow_key), *(pa.array(c, pa.int64()) for c in cols[1:7])]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array([x.astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(out, names=names)

        end = np.array([end_id], "<u4")
        for batch in text_blocks(batches, text, 2 * block_chars):
            arrow_key = batch.column(0).type
            keys = batch.column(0).to_pylist()
            for first, ids, bounds in enc.blocks(batch.column(1).to_pylist(), block_chars):
                for i in range(len(bounds) - 1):
                    packer.add(keys[first + i], np.concatenate([ids[bounds[i] : bounds[i + 1]], end]))
                    if packer.held >= run_ids:
                        yield flush(False)
        if arrow_key is not None:
            yield flush(True)

    schema = f"`{key}` {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return source.mapInArrow(freed(run), schema + ", ids array<int>" * with_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: ids, sequences and padded places (sequences of a power of two have none)."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.expr("n & (n - 1)") == 0, 0).otherwise(size - F.col("n"))
    return lengths.agg(F.sum("n").alias("ids"), F.count("*").alias("sequences"), F.sum(pad).alias("padding"))
