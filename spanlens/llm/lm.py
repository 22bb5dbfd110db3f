"""Language-model scores of whole texts: word counts, repeated passages, and causal self-attention in numpy.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, then one end.

Coding.  Every text is split and encoded once, into the shared folder: subword ids, two bytes each.
All that follows reads the ids; a word is the bytes of its ids.  Contexts are made again from the
ids wherever they are needed: their hashes would take 24 bytes for each word.

Base.  Words of the training texts are counted over all of them (summed in each task before any
shuffle).  The most frequent ones (at most `max_head`, long ones by a hash) go to the workers;
what a document holds of the others is joined to the counts.  As every frequent word is in the
first part, that join has no hot keys.

Memory.  Four words in a row are a context; every one (or one in `contexts`, by hash, where a
caller asks for fewer) is
remembered with the word that follows it most often in the training texts, if it did so twice or
more.  After such a context that word's chance is a(context) + (1 - a(context)) times the
model's, and every other word's 1 - a(context) times the model's, with a = `trust` * (n - 1) /
(how often the context occurred): the chances add up to one.  What is remembered grows with the
corpus.  Each task counts its contexts with the words after them, sorts them by hash and sends
them as packed bytes, a row for each of many ranges of hashes; what comes of a range settles its
contexts, and only those that are remembered are written.  The contexts of scored texts are sent
in the same way, with the chances of the words after them, and meet what is remembered of their
range in the same join as the words.

Model.  A word's chance is `mix` times its share among the frequent words plus 1 - `mix` times
its chance as subwords: a blank and its letters as ids of a public byte-level vocabulary, given
that a word begins and ends there.  P(id) = P(class of the id | context) * P(id | class): the
`head` commonest ids are classes of their own, the rest fall into classes by the ids beside them
in all counted words.  P(id | class) comes from all training words.  P(class | context) is a
softmax of bigram log-odds of the last id plus one layer of causal self-attention with a bias
for each distance.  A text is read in windows of 2 * `span` ids that overlap by half; only the
second half of a window (the first of a text: both) is scored, so each id is scored once, with
at least `span` ids before it where the text has them.  Windows of many texts go through masked
attention together.

Fitting.  Every training text is read whole.  All its ids give the bigrams, the shares by the last
class and the attention windows; neighbours inside words, for the classes, come from the counts of
all words.  Tables are summed over tasks.  Attention is fitted by Adam: the texts are dealt into
`rounds` parts by a hash of their keys, and in round r each task takes its texts of part r, with
windows laid out as in scoring, so each id (and each text's end) is the goal once and as many ids
lie before it as when it is scored.  Weights begin in common and are averaged by the tasks' windows
after each round: what reaches the driver is one set of weights.

Defined results: null or empty text is the end alone; no training texts: counts are zero and
the model knows only its uniform part; repeated rows are scored alike, each on its own; null
keys are training rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.bpe import public_file
from spanlens.llm.common import freed, materialise, row_key, spread, table, text_blocks
from spanlens.llm.toxicity import held_out
from spanlens.llm.words import grams

VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_HEAD, ROUNDS = 150_000, 4
HEAD, TAIL, ROWS, SPAN, MIX = 48, 16, 2_048, 16, 0.3
CONTEXT, CONTEXTS, TRUST = 4, 1, 0.9
PIECE = 2_000  # weights in a row when they are averaged
KEPT = 800_000  # words whose ids a worker remembers
_SUBWORDS: dict[str, Subwords] = {}
# A-Z to a-z; every ASCII blank to a space.
_FLAT = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Subwords(dict):
    """Ids of " word" as the bytes of `kind`, kept while there is room."""

    def __init__(self, name: str):
        super().__init__()
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_file(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.size = self.end + 1
        self.starts = np.zeros(self.size, bool)  # ids that begin a word; the end does too
        self.starts[[i for b, i in ranks.items() if b[:1] == b" "] + [self.end]] = True
        self.kind = id_kind(self.size)
        self.letters = [self.encoding.decode_single_token_bytes(i) for i in range(self.end)]
        self.hashed: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Hashes of words, given as the bytes of their ids, without the blank before them."""
        found = list(map(self.hashed.get, words))
        if None in found:
            if len(self.hashed) > KEPT:
                self.hashed.clear()
            for i, known in enumerate(found):
                if known is None:
                    ids = np.frombuffer(words[i], self.kind).tolist()
                    found[i] = xxhash.xxh64_intdigest(b"".join([self.letters[x] for x in ids])[1:])
                    if len(words[i]) <= 40:
                        self.hashed[words[i]] = found[i]
        return np.array(found, np.uint64)

    def of(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, given with a blank before it; what is not kept is encoded in one go."""
        found = [self.get(w) for w in words]
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            if len(self) + len(new) > KEPT:
                self.clear()
            for i, ids in zip(new, self.encoded([words[i] for i in new]), strict=True):
                found[i] = ids
                if len(words[i]) <= 40:
                    self[words[i]] = ids
        return found

    def encoded(self, words: list[bytes]) -> list[bytes]:
        line = b"".join(words).decode("utf-8", "replace")
        if len(line.split()) != len(words):  # blanks beyond ASCII within words: an id could reach over a word's end
            return [np.array(self.encoding.encode_ordinary(w.decode("utf-8", "replace")), self.kind).tobytes() for w in words]
        ids = self.encoding.encode_to_numpy(line, disallowed_special=()).astype(self.kind)
        at = (np.flatnonzero(self.starts[ids]) * ids.itemsize).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip(at, [*at[1:], len(data)], strict=True)]


def id_kind(size: int) -> np.dtype:
    """How ids are kept: words of unequal ids have unequal bytes, an even number of them."""
    return np.dtype("<u2" if size < 2**16 else "<u4")


def subwords(name: str = VOCABULARY) -> Subwords:
    if name not in _SUBWORDS:
        _SUBWORDS[name] = Subwords(name)
    return _SUBWORDS[name]


@dataclass
class Attention:
    """The fitted model: tables by input row, class of each id and its share of the class."""

    row: np.ndarray  # input row of each id
    klass: np.ndarray  # class of each id
    share: np.ndarray  # ln P(id | class, class of the last id), by the last id's class and the id's input row
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    rest: np.ndarray
    out: np.ndarray
    bigram: np.ndarray
    bias: np.ndarray  # by distance 0 .. 2 * span - 1
    begins: np.ndarray  # by class of the last id and class of the next: the share of ids that begin a word
    own: np.ndarray  # class of each input row
    alone: np.ndarray  # ln P(id | input row): 0 for ids with a row of their own
    span: int

    def mask(self) -> np.ndarray:
        """Biases of (place in the half, place in the window), minus infinity for what lies ahead."""
        far = (np.arange(self.span)[:, None] + self.span) - np.arange(2 * self.span)[None, :]
        return np.where(far >= 0, self.bias[np.clip(far, 0, len(self.bias) - 1)], -1e9).astype(np.float32)

    def logs(self, rows: np.ndarray, target: np.ndarray, follows: np.ndarray, block: int = 96) -> tuple[np.ndarray, np.ndarray]:
        """ln P(class of the next id) and ln P(the next id begins a word), for halves of windows (halves, span)."""
        mask, span, depth, hidden, c = self.mask(), self.span, self.query.shape[1], self.out.shape[0], self.out.shape[1]
        out, begins = np.empty(rows.shape, np.float32), np.empty(rows.shape, np.float32)
        # One table of all that is looked up by row; the ones add up the weights.
        table = np.concatenate([self.query, self.rest, self.key, self.value, np.ones((len(self.value), 1), np.float32)], axis=1, dtype=np.float32)
        wide, m = table.shape[1], min(block, len(rows))
        t0, s0, a0 = np.empty(((m + 1) * span, wide), np.float32), np.empty((m, span, 2 * span), np.float32), np.empty((m, span, hidden + 1), np.float32)
        z0, g0, line, ones = np.empty((m * span, c), np.float32), np.empty((m * span, c), np.float32), np.arange(m * span), np.ones(c, np.float32)
        # Where no exponent can come near float32's end, the largest needn't be taken off; chances are the same.
        reach = np.sqrt((self.query**2).sum(axis=1).max() * (self.key**2).sum(axis=1).max()) + np.abs(self.bias).max()
        calm_s, calm_z = reach < 60, np.abs(self.out).sum(axis=0).max() + np.abs(self.bigram).max() < 60
        for at in range(0, len(rows), block):
            now = rows[at : at + block]
            n = len(now)
            t, s, a, z, g = t0[: (n + 1) * span], s0[:n], a0[:n], z0[: n * span], g0[: n * span]
            np.take(table, now.reshape(-1), axis=0, out=t[span:], mode="clip")
            np.take(table, rows[at - 1] if at else now[0], axis=0, out=t[:span], mode="clip")
            mine = t[span:].reshape(n, span, wide)
            # Windows overlap by half, so they are views of the same places.
            window = np.lib.stride_tricks.as_strided(t, (n, 2 * span, wide), (span * t.strides[0], *t.strides), writeable=False)[:, :, depth + hidden :]
            np.matmul(mine[:, :, :depth], window[:, :, :depth].transpose(0, 2, 1), out=s)
            s += mask
            s[~follows[at : at + n], :, :span] = -1e9
            if not calm_s:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            np.matmul(s, window[:, :, depth:], out=a)
            h = a[:, :, :hidden] / a[:, :, hidden:]
            h += mine[:, :, depth : depth + hidden]
            np.tanh(h, out=h)
            np.matmul(h, self.out, out=z.reshape(n, span, c))  # half by half: one product of all would round by a half's place
            np.take(self.bigram, now.reshape(-1), axis=0, out=g, mode="clip")
            z += g
            if not calm_z:
                z -= z.max(axis=1, keepdims=True)
            hit = z[line[: n * span], target[at : at + n].reshape(-1)]
            np.exp(z, out=z)
            every = np.log(z @ ones)
            np.take(self.begins, self.own[now.reshape(-1)], axis=0, out=g, mode="clip")
            out[at : at + n] = (hit - every).reshape(now.shape)
            begins[at : at + n] = (np.log(np.einsum("ij,ij->i", z, g)) - every).reshape(now.shape)
        return out, begins

    def score(self, ids: np.ndarray, each: np.ndarray, words: np.ndarray, share: np.ndarray, mix: float, end: int, end_share: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 P of each text, and ln P of each word.

        ids: of all words of all texts; each: ids of a word; words: words of a text; share: each word's chance
        among the frequent words.
        """
        span = self.span
        of_word = np.concatenate([[0], np.cumsum(each)])
        word_at = np.concatenate([[0], np.cumsum(words)])
        bounds = of_word[word_at]
        n = np.diff(bounds)
        halves = (n + 1 + span - 1) // span
        first = np.concatenate([[0], np.cumsum(halves)])
        begin = first[:-1] * span
        places = np.repeat(begin - bounds[:-1], n) + np.arange(len(ids))
        context = np.full(first[-1] * span, end, np.int64)  # the end stands before a text too
        goal = np.full(first[-1] * span, end, np.int64)
        goal[places] = ids
        context[places + 1] = ids  # a text has room for one place more than it has ids
        last = begin + n
        follows = np.ones(first[-1], bool)
        follows[first[:-1]] = False
        logs, begins = self.logs(self.row[context].reshape(-1, span), self.klass[goal].reshape(-1, span), follows)
        logs, begins = logs.reshape(-1).astype(np.float64), begins.reshape(-1).astype(np.float64)
        logs += self.share[self.klass[context], self.row[goal]] + self.alone[goal]
        # A word: its ids, given that a word begins, and that another begins (or the text ends) after it.
        start = places[of_word[:-1]] if len(each) else np.zeros(0, np.int64)
        sub = np.add.reduceat(logs[places], of_word[:-1]) - begins[start] + begins[start + each] if len(each) else np.zeros(0)
        word_log = np.log(mix * share + (1 - mix) * np.exp(np.maximum(sub, -690)))
        word_log = np.where(sub < -690, np.where(share > 0, word_log, math.log(1 - mix) + sub), word_log)
        ends = np.log(mix * end_share + (1 - mix) * np.exp(logs[last] - begins[last]))
        text = np.repeat(np.arange(len(words)), words)
        return (np.bincount(text, word_log, len(words)) + ends) / math.log(10), word_log


def classes(counts: np.ndarray, beside: tuple[np.ndarray, np.ndarray, np.ndarray], head: int, tail: int) -> np.ndarray:
    """Class of each id: its own for the commonest, else that of the ids with like neighbours.

    beside: (id, slot, n): how often an id stands beside the head's ids, by slots 0 .. 2 * head + 1.
    """
    order = np.argsort(-counts, kind="stable")
    klass = np.full(len(counts), head + tail - 1)
    klass[order[:head]] = np.arange(head)
    profile = np.zeros((len(counts), 2 * (head + 1)), np.float32)
    np.add.at(profile, (beside[0], beside[1]), beside[2])
    rest = order[head:]
    rest = rest[profile[rest].sum(axis=1) >= 3]
    if len(rest) > tail:
        x = np.sqrt(profile[rest] / profile[rest].sum(axis=1, keepdims=True))
        centres = x[np.linspace(0, len(rest) - 1, tail - 1).astype(int)]
        for _ in range(12):
            near = np.argmax(x @ centres.T, axis=1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].mean(axis=0)
                    centres[c] /= np.linalg.norm(centres[c]) + 1e-9
        klass[rest] = head + near
    return klass


def shares(counts: np.ndarray, seen: np.ndarray, klass: np.ndarray, row: np.ndarray, trust: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """ln P(input row | its class, class of the last id) and ln P(id | input row).

    The counts of all words give P(row | class); `seen`, rows by the last id's class, moves it.
    """
    c, v = seen.shape
    plus = counts + 0.1
    by_row = np.bincount(row, plus, v)
    of_row = np.zeros(v, np.int64)
    of_row[row] = klass
    prior = by_row / np.maximum(np.bincount(of_row, by_row, c)[of_row], 1e-12)
    totals = np.zeros((c, c))
    np.add.at(totals.T, of_row, seen.T)
    with np.errstate(divide="ignore"):
        table = np.log((seen + trust * prior) / (totals[:, of_row] + trust))
    return np.maximum(table, -60).astype(np.float32), np.log(plus / by_row[row])


def initial(v: int, c: int, span: int, wide: int = 16, depth: int = 8, hidden: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights before any fitting."""
    rng, f = np.random.default_rng(seed), np.float32
    return {
        "e": rng.normal(0, 0.3, (v, wide)).astype(f),
        "q": rng.normal(0, 0.2, (wide, depth)).astype(f),
        "k": rng.normal(0, 0.2, (wide, depth)).astype(f),
        "v": rng.normal(0, 0.2, (wide, hidden)).astype(f),
        "r": rng.normal(0, 0.2, (wide, hidden)).astype(f),
        "b": np.zeros(hidden, f),
        "o": np.zeros((hidden, c), f),
        "d": (-0.05 * np.arange(2 * span)).astype(f),
    }


def windows_of(runs: list[np.ndarray], span: int) -> np.ndarray:
    """Windows of 2 * span + 1 ids, `span` apart: each id of a run but the first is once among the last `span`; -1 where a run has none."""
    runs = [r for r in runs if len(r) > 1]
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    halves = (sizes + span - 2) // span
    first = np.concatenate([[0], np.cumsum(halves)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    room = halves * span + span + 1
    at = np.concatenate([[0], np.cumsum(room)])
    line = np.full(at[-1], -1, np.int32)
    if runs:
        line[np.repeat(at[:-1] + span - begin[:-1], sizes) + np.arange(begin[-1])] = np.concatenate(runs)
    start = np.repeat(at[:-1] - first[:-1] * span, halves) + np.arange(first[-1]) * span
    return line[start[:, None] + np.arange(2 * span + 1)]


def across(x: np.ndarray, y: np.ndarray, block: int = 256) -> np.ndarray:
    """x.T @ y for long narrow tables, block by block."""
    n = len(x) // block * block
    out = np.matmul(x[:n].reshape(-1, block, x.shape[1]).transpose(0, 2, 1), y[:n].reshape(-1, block, y.shape[1])).sum(axis=0)
    out += x[n:].T @ y[n:]
    return out


def train(p: dict[str, np.ndarray], data: np.ndarray, row: np.ndarray, klass: np.ndarray, bigram: np.ndarray, span: int, epochs: int = 1, rate: float = 1.5e-2, size: int = 128, seed: int = 7) -> dict[str, np.ndarray]:
    """The weights after Adam steps on all windows of `windows_of`."""
    rng, f = np.random.default_rng(seed), np.float32
    # Weights, slopes and their means are each one array, of which the named ones are parts.
    at = np.cumsum([0, *(x.size for x in p.values())])
    whole, slope, m, s, t = np.concatenate([x.ravel() for x in p.values()]), *(np.zeros(at[-1], f) for _ in range(4))
    p, g = ({k: y[i:j].reshape(x.shape) for (k, x), i, j in zip(p.items(), at[:-1], at[1:], strict=True)} for y in (whole, slope))
    wide, depth, hidden, c = p["e"].shape[1], p["q"].shape[1], len(p["b"]), p["o"].shape[1]
    far = (np.arange(span)[:, None] + span) - np.arange(2 * span)[None, :]
    ahead, near = far < 0, np.clip(far, 0, 2 * span - 1)
    step, scale, size = 0, f(1 / math.sqrt(depth)), max(1, min(size, len(data)))
    total = max(1, epochs * -(-len(data) // size))
    rows, goals, fresh = row.astype(np.int16 if len(p["e"]) < 2**15 else np.int32)[data[:, :-1]], klass.astype(np.int16)[data[:, span + 1 :]], data[:, 0] < 0
    goals[data[:, span + 1 :] < 0] = -1
    ones, each, far_odds, line = np.ones((max(c, size * span), 1), f), np.ones((2 * span, 1), f), np.abs(bigram).max(), np.arange(size * span)
    a0, z0, odds0 = np.empty((size, span, 2 * span), f), np.empty((size * span, c), f), np.empty((size * span, c), f)
    there0, gthere0, ghere0 = np.empty((size * 2 * span, depth + hidden), f), np.empty((size, 2 * span, depth + hidden), f), np.empty((size * span, depth + hidden), f)
    for _ in range(epochs):
        turn = rng.permutation(len(data))
        for at in range(0, len(turn), size):
            chosen = turn[at : at + size]
            n = len(chosen)
            a, z, odds_, there, gthere, ghere = a0[:n], z0[: n * span], odds0[: n * span], there0[: n * 2 * span], gthere0[:n], ghere0[: n * span]
            x, goal = rows[chosen], goals[chosen].reshape(-1)
            said = goal >= 0
            part = said.astype(f)[:, None] / f(max(1, said.sum()))  # what has no goal weighs nothing
            ex = np.take(p["e"], x, axis=0, mode="wrap")
            flat, en = ex.reshape(-1, wide), ex[:, span:].reshape(-1, wide)
            kv, qr = np.concatenate([p["k"], p["v"]], axis=1), np.concatenate([p["q"] * scale, p["r"]], axis=1)
            here = en @ qr
            there = np.matmul(flat, kv, out=there).reshape(n, 2 * span, -1)
            q, k, val = here[:, :depth].reshape(n, span, depth), there[:, :, :depth], there[:, :, depth:]
            np.matmul(q, k.transpose(0, 2, 1), out=a)
            # As in scoring, the largest is taken off only where an exponent could come near float32's end.
            calm = max(a.max(), -a.min()) + np.abs(p["d"]).max() < 60
            a += np.where(ahead, f(-1e9), p["d"][near])
            a[fresh[chosen], :, :span] = -1e9
            if not calm:
                a -= a.max(axis=2, keepdims=True)
            np.exp(a, out=a)
            weights = a.reshape(-1, 2 * span)
            weights *= 1 / (weights @ each)
            read = np.matmul(a, val).reshape(-1, hidden)
            h = read + here[:, depth:]
            h += p["b"]
            np.tanh(h, out=h)
            np.matmul(h, p["o"], out=z)
            z += np.take(bigram, x[:, span:].reshape(-1), axis=0, out=odds_, mode="wrap")
            if np.abs(p["o"]).sum(axis=0).max() + far_odds >= 60:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            # Slopes by class are part / sum * (z - sum where the goal is); the factor goes to the narrower side.
            sums = z @ ones[:c]
            z[line[: n * span], goal] -= sums[:, 0]
            part /= sums
            gh = z @ p["o"].T
            gh *= part
            gh *= 1 - h * h
            h *= part
            g["o"][:] = across(h, z)
            np.matmul(ones[: n * span].T, gh, out=g["b"][None])
            ghere[:, depth:] = gh
            gh3 = gh.reshape(n, span, hidden)
            gs = np.matmul(gh3, val.transpose(0, 2, 1))
            read *= gh
            gs -= (read @ ones[:hidden]).reshape(n, span, 1)
            gs *= a
            np.matmul(gs.transpose(0, 2, 1), q, out=gthere[:, :, :depth])
            np.matmul(a.transpose(0, 2, 1), gh3, out=gthere[:, :, depth:])
            np.matmul(gs, k, out=ghere.reshape(n, span, -1)[:, :, :depth])
            g["d"][:] = np.bincount(near.ravel(), np.where(ahead, 0, gs.sum(axis=0)).ravel(), 2 * span)
            all_there = gthere.reshape(-1, depth + hidden)
            gqr, gkv = across(en, ghere), across(flat, all_there)
            g["q"][:], g["r"][:], g["k"][:], g["v"][:] = gqr[:, :depth] * scale, gqr[:, depth:], gkv[:, :depth], gkv[:, depth:]
            gx = (all_there @ kv.T).reshape(n, 2 * span, wide)
            gx[:, span:] += (ghere @ qr.T).reshape(n, span, wide)
            seen = x.ravel()
            order = np.argsort(seen, kind="stable")
            seen = seen[order]
            begin = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            g["e"][:] = 0
            # Two numbers at a time: sums of complex numbers are sums of their parts.
            g["e"][seen[begin]] = np.add.reduceat(np.take(gx.reshape(-1, wide), order, axis=0, mode="wrap").view(np.complex64 if wide % 2 == 0 else f), begin, axis=0).view(f)
            step += 1
            lr = rate * min(1.0, step / 20) * max(0.05, 1 - step / total)
            np.subtract(slope, m, out=t)
            t *= f(0.1)
            m += t
            np.multiply(slope, slope, out=t)
            t -= s
            t *= f(0.01)
            s += t
            np.sqrt(s, out=t)
            t *= f(1 / math.sqrt(1 - 0.99**step))
            t += f(1e-8)
            np.divide(m, t, out=t)
            t *= f(lr / (1 - 0.9**step))
            whole -= t
    return {k: x.copy() for k, x in p.items()}


@dataclass
class Shape:
    """What is counted before attention is fitted: input rows and classes of ids, and how many of each."""

    row: np.ndarray
    klass: np.ndarray
    v: int
    c: int


def shape(counts: np.ndarray, beside, head: int, tail: int, own_rows: int) -> Shape:
    klass = classes(counts, beside, head, tail)
    order = np.argsort(-counts, kind="stable")
    row = own_rows + klass
    row[order[:own_rows]] = np.arange(min(own_rows, len(order)))
    return Shape(row, klass, own_rows + head + tail, head + tail)


def odds(pairs: np.ndarray) -> np.ndarray:
    """Bigram log-odds of the next class by the last id's row."""
    common = pairs.sum(axis=0) + 1.0
    common /= common.sum()
    return np.log((pairs + 20 * common) / (pairs.sum(axis=1, keepdims=True) + 20)).astype(np.float32)


def assemble(counts: np.ndarray, starts: np.ndarray, sh: Shape, bigram: np.ndarray, seen: np.ndarray, p: dict[str, np.ndarray], span: int) -> Attention:
    """Tables for scoring."""
    e, f, scale = p["e"], np.float32, np.float32(1 / math.sqrt(p["q"].shape[1]))
    share, alone = shares(counts, seen, sh.klass, sh.row)
    # What of each row begins a word, then of each class after a class of the last id, as `score` takes the chances of ids.
    own = np.zeros(sh.v, np.int64)
    own[sh.row] = sh.klass
    of_row = np.bincount(sh.row, np.exp(alone) * starts, sh.v)
    begins = np.zeros((sh.c, sh.c))
    np.add.at(begins.T, own, (np.exp(share) * of_row).T)
    begins = np.clip(begins, 1e-9, None).astype(f)
    return Attention(sh.row.astype(np.int32), sh.klass.astype(np.int32), share, e @ p["q"] * scale, e @ p["k"], e @ p["v"], e @ p["r"] + p["b"], p["o"], bigram, p["d"], begins, own, alone, span)


def bigrams(runs: list[np.ndarray], sh: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (row, next class) and (class, next row) in runs of ids."""
    pairs, seen = np.zeros(sh.v * sh.c, np.int64), np.zeros(sh.c * sh.v, np.int64)
    for run in runs:
        pairs += np.bincount(sh.row[run[:-1]] * sh.c + sh.klass[run[1:]], minlength=sh.v * sh.c)
        seen += np.bincount(sh.klass[run[:-1]] * sh.v + sh.row[run[1:]], minlength=sh.c * sh.v)
    return pairs.reshape(sh.v, sh.c), seen.reshape(sh.c, sh.v)


def text_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts, a blank before each, every word's place among them and how many words each text has."""
    flat, at = numbers(texts.fill_null("") if texts.null_count else texts, np.uint8)
    view, edges = memoryview(flat), at.tolist()
    line = b" ".join([b"", *(view[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))])  # a blank before each text
    flat = np.frombuffer(line.translate(_FLAT), np.uint8)
    keep = flat != 32
    begin = np.flatnonzero(keep[1:] & ~keep[:-1])  # the last blank before each word
    keep[begin] = True
    sizes = np.diff(np.searchsorted(begin, np.concatenate([at[:-1] + np.arange(len(texts)), [len(flat)]])))
    flat = flat[keep]
    coded = _sliced(pa.py_buffer(flat), np.concatenate([np.flatnonzero(flat == 32), [len(flat)]])).dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64), sizes


def chosen_contexts(hashes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of words after a chosen context, the contexts' hashes and the words'; hashes: of the distinct words."""
    if len(codes) <= CONTEXT:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none
    h = hashes[codes]
    before = grams(h[:-1], CONTEXT)  # of the words at i .. i + 3, for the word at i + 4
    place = np.arange(len(before)) + CONTEXT
    within = place - np.repeat(np.cumsum(sizes) - sizes, sizes)[place]
    chosen = (within >= CONTEXT) & (before % np.uint64(every) == 0)
    return place[chosen], before[chosen], h[place[chosen]]


def code(docs: DataFrame, key: str, text: str, vocabulary: str, contexts: int) -> DataFrame:
    """`encoded` texts with their contexts: (id, ids, place, before, after) of every row."""
    return with_contexts(encoded(docs, key, text, vocabulary), vocabulary, contexts)


def encoded(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """Texts split and encoded once, in the shared folder: (id, ids) of every row, ids the bytes of the subword ids of all words."""
    source = spread(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords(vocabulary)
        for batch in text_blocks(batches, "text", 4_000_000):
            words, codes, sizes = text_words(batch.column(1))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            ids = pa.array(enc.of(words), pa.binary()).take(pa.array(codes))
            yield pa.RecordBatch.from_arrays([batch.column(0), _sliced(ids.buffers()[2], np.frombuffer(ids.buffers()[1], np.int32)[bounds])], names=["id", "ids"])

    kind = source.schema["id"].dataType.simpleString()
    return materialise(source.mapInArrow(freed(run), f"id {kind}, ids binary"), "coded")


def with_contexts(coded: DataFrame, vocabulary: str, contexts: int) -> DataFrame:
    """`encoded` texts with the words that follow a chosen context, the contexts' hashes and the words', as the bytes of numbers.

    Nothing of it is written: it is made where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = subwords(vocabulary)
        for batch in text_blocks(batches, "ids", 4_000_000):
            coded = Coded.of(batch.column(1), enc)
            (words, codes), sizes = coded.words(), coded.sizes()
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            place, before, after = chosen_contexts(enc.hashes(words), codes, sizes, contexts)
            at = np.searchsorted(place, bounds)
            place = place - np.repeat(bounds[:-1], np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(_sliced(pa.py_buffer(x.astype("<u8").tobytes()), at * 8) for x in (place, before, after))],
                names=["id", "ids", "place", "before", "after"],
            )

    kind = coded.schema["id"].dataType.simpleString()
    return coded.select("id", "ids").mapInArrow(freed(run), f"id {kind}, ids binary, place binary, before binary, after binary")


def _sliced(data: pa.Buffer | None, bounds: np.ndarray) -> pa.Array:
    """Binary values of the bytes between bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), data or pa.py_buffer(b"")])


def numbers(column: pa.Array, kind: str | np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers whose bytes a binary column holds, one value after another, and where values begin and end."""
    kind, (_, offsets, data) = np.dtype(kind), column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return flat.view(kind), (at - at[0]) // kind.itemsize


@dataclass
class Coded:
    """Subword ids of texts, one text after another."""

    ids: np.ndarray
    bounds: np.ndarray  # where texts begin and end
    first: np.ndarray  # where words begin

    @classmethod
    def of(cls, column: pa.Array, enc: Subwords) -> Coded:
        ids, bounds = numbers(column, enc.kind)
        return cls(ids, bounds, np.flatnonzero(enc.starts[ids]))

    def words(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, each as the bytes of its ids, and every word's place among them."""
        n, size, edges = len(self.first), self.ids.itemsize, np.concatenate([self.first, [len(self.ids)]])
        each, lanes, data = np.diff(edges), 8 // size, self.ids.tobytes()
        # A number for each word: its few ids, none of them 0, or 0 and the place among the distinct longer words.
        plus = np.concatenate([self.ids.astype(np.uint64) + np.uint64(1), np.zeros(lanes, np.uint64)])
        number = plus[self.first]
        for j in range(1, lanes):
            number |= np.where(each > j, plus[self.first + j] << np.uint64(8 * size * j), np.uint64(0))
        long = np.flatnonzero(each > lanes)
        if len(long):
            found = _sliced(pa.py_buffer(data), edges * size).take(pa.array(long)).dictionary_encode()
            number[long] = (np.asarray(found.indices, np.uint64) + np.uint64(1)) << np.uint64(8 * size)
        coded = pa.array(number).dictionary_encode()
        codes, any_ = np.asarray(coded.indices, np.int64), np.zeros(len(coded.dictionary), np.int64)
        any_[codes] = np.arange(n)
        return [data[i:j] for i, j in zip((edges[any_] * size).tolist(), (edges[any_ + 1] * size).tolist(), strict=True)], codes

    def sizes(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(np.searchsorted(self.first, self.bounds))

    def line(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids with the end before, between and after texts, and where the ends are."""
        m = len(self.bounds) - 1
        out = np.full(len(self.ids) + m + 1, end, np.int64)
        out[np.arange(len(self.ids)) + np.repeat(np.arange(1, m + 1), np.diff(self.bounds))] = self.ids
        return out, self.bounds + np.arange(m + 1)


def word_key(word: bytes) -> bytes:
    """Short words as they are, long ones by a hash that no word can be: it has an odd number of bytes."""
    return word if len(word) <= 64 else b" " + xxhash.xxh3_128_digest(word)


def _packed(columns: list[np.ndarray]) -> pa.Array:
    """Binary values of a blank and the columns' bytes: an odd number of them, so they clash with no word."""
    return _binary([np.full((len(columns[0]), 1), 32, np.uint8), *map(_bytes, columns)])


def _bytes(column: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(column).view(np.uint8).reshape(len(column), 8)


def _binary(parts: list[np.ndarray]) -> pa.Array:
    data = np.concatenate(parts, axis=1)
    n = len(data)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * data.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


_IS_GRAM = "after IS NOT NULL"
WIDTHS = (7, 4, 4)  # bytes of a context (the upper ones of its hash), the word after it and their count, as they are sent
SCORED = (7, 4, 4, 4)  # bytes of a context, the word after it, its chance and the place of its text
RANGE = 1_000_000  # places of contexts that are settled together


def range_bits(ids: DataFrame, vocabulary: str) -> int:
    """The power of two of ranges that keep each within its bound, as a word has two ids or so."""
    size = ids.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // (2 * id_kind(subwords(vocabulary).size).itemsize)
    return min(16, math.ceil(math.log2(size // RANGE + 1)))


def by_range(columns: list[np.ndarray], bits: int, widths: tuple[int, ...]) -> tuple[list[int], list[bytes]]:
    """The ranges of contexts, which are in order, and what is sent of each."""
    of = (columns[0] >> np.uint64(56 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])[: None if len(of) else 1]
    return of[edges[:-1]].tolist(), [packed([c[i:j] for c in columns], widths) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def packed(columns: list[np.ndarray], widths: tuple[int, ...] = WIDTHS) -> bytes:
    """Numbers by columns and, within a column, by the place of the byte, so that what sorted numbers share lies together."""
    return b"".join(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for x, w in zip(columns, widths, strict=True))


def unpacked(data: bytes, widths: tuple[int, ...] = WIDTHS) -> list[np.ndarray]:
    n, at, out = len(data) // sum(widths), 0, []
    for w in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        out.append(x.view("<u8").reshape(-1))
        at += n * w
    return out


def tallied(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(context, after, n) with equal pairs summed, in order."""
    context, after, n = columns
    order = np.lexsort((after, context))
    context, after, n = context[order], after[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (after[1:] != after[:-1])])) if len(n) else order
    return [context[first], after[first], np.add.reduceat(n, first) if len(n) else n]


def context_counts(coded: DataFrame, ranges: int) -> DataFrame:
    """(key, c, n, after) of the contexts that a word followed twice or more: that word's hash, how often it did, and how often the context occurred.

    Of a word's hash the upper 4 bytes are taken, of a context's the upper 7.  coded: (before, after) of `with_contexts`.
    """
    bits = math.ceil(math.log2(max(1, ranges)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, "before", 8_000_000):
            before, after = (numbers(c, "<u8")[0] for c in batch.columns)
            if not len(before):
                continue
            columns = tallied([before >> np.uint64(8), after >> np.uint64(32), np.ones(len(before), np.uint64)])
            of, data = by_range(columns, bits, WIDTHS)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(data, pa.binary())], names=["of", "data"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                context, after, c = (np.concatenate(x) for x in zip(*map(unpacked, batch.column(0)[i].as_py()), strict=True))
                order = np.argsort(context, kind="stable")
                context, after, c = context[order], after[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                often = np.repeat(np.add.reduceat(c, first) > 1, np.diff(np.append(first, len(c))))
                context, after, c = tallied([context[often], after[often], c[often]])
                if not len(context):
                    continue
                first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                n, best = np.add.reduceat(c, first), np.maximum.reduceat(c << np.uint64(32) | after, first)
                c, after = best >> np.uint64(32), best & np.uint64(2**32 - 1)
                kept = c > 1
                yield pa.RecordBatch.from_arrays(
                    [_packed([context[first][kept] << np.uint64(8)]), pa.array(c[kept].astype(np.int64)), pa.array(n[kept].astype(np.int64)), _binary([_bytes(after[kept])[:, :4]])], names=["key", "c", "n", "after"]
                )

    grouped = coded.select("before", "after").mapInArrow(freed(send), "of long, data binary").groupBy("of").agg(F.collect_list("data").alias("data")).select("data")
    return grouped.mapInArrow(freed(settle), "key binary, c long, n long, after binary")


def key_counts(coded: DataFrame, vocabulary: str, ids: DataFrame | None = None) -> DataFrame:
    """(key, c, n, after) of coded texts: words with their counts alone, and the `context_counts`.

    ids: the same texts without contexts, if they are at hand.
    """
    ids = coded if ids is None else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = subwords(vocabulary), Counter()

        def said() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["key", "c"])

        for batch in text_blocks(batches, "ids", 4_000_000):
            words, codes = Coded.of(batch.column(0), enc).words()
            for w, n in zip(words, np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                seen[w] += n
            if len(seen) > 600_000:
                yield said()
                seen.clear()
        yield said()

    words = ids.select("ids").mapInArrow(freed(run), "key binary, c long").groupBy("key").agg(F.sum("c").alias("c"))
    blank = words.select("key", "c", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("after"))
    return blank.unionByName(context_counts(coded, 2 ** range_bits(ids, vocabulary)))


def remembered(keys: DataFrame, trust: float) -> DataFrame:
    """(key, trust, after) of contexts whose likeliest next word came twice or more."""
    return keys.filter(_IS_GRAM).select("key", (F.lit(trust) * (F.col("c") - 1) / F.col("n")).alias("trust"), "after")


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The words (by `word_key`) whose count is above the least level that leaves at most `most` of them."""
    level = F.floor(F.log2("c") * 8)
    levels = sorted(((r.l, r.n) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = None, 0
    for name, k in levels:
        if n + k > most:
            break
        least, n = name, n + k
    if least is None:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_key(w) for w in batch.column(0).to_pylist()], pa.binary()), batch.column(1)], names=["word", "c"])

    return {bytes(r.word): r.c for r in counts.filter(level >= least).mapInArrow(run, "word binary, c long").collect()}


def id_counts(counts: DataFrame, size: int, ends: int) -> np.ndarray:
    """How often each subword id occurs in all counted words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for ids, _, n in _counted(batches, size):
            seen += np.bincount(ids, n, size).astype(np.int64)
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[hit])], names=["id", "n"])

    out = np.zeros(size)
    for r in counts.mapInArrow(freed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    out[-1] = ends
    return out


def _counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of counted words, whether each begins its word, and its word's count."""
    for batch in batches:
        ids, bounds = numbers(batch.column(0), id_kind(size))
        first = np.zeros(len(ids), bool)
        first[bounds[:-1]] = True
        yield ids.astype(np.int64), first, np.repeat(batch.column(1).to_numpy(), np.diff(bounds))


def neighbours(counts: DataFrame, ids: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, slot, n): how often each id follows (slots 0 .. head) and precedes (head + 1 .. 2 * head + 1) the commonest ids inside words; a word's edge is a slot of its own."""
    rank = np.full(len(ids), head)
    rank[np.argsort(-ids, kind="stable")[:head]] = np.arange(head)
    shared, slots, size = counts.sparkSession.sparkContext.broadcast(rank), 2 * (head + 1), len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = shared.value, np.zeros(size * slots)
        for ids, first, n in _counted(batches, size):
            inner = np.flatnonzero(~first)
            np.add.at(seen, ids[inner] * slots + rank[ids[inner - 1]], n[inner].astype(float))
            np.add.at(seen, ids[inner - 1] * slots + head + 1 + rank[ids[inner]], n[inner].astype(float))
        hit = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(seen[hit].astype(np.int64))], names=["cell", "n"])

    found = counts.mapInArrow(freed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell = found.column("cell").to_numpy()
    return cell // slots, cell % slots, found.column("n").to_numpy()


def _lines(batches: Iterator[pa.RecordBatch], enc: Subwords) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`Coded.line` of all texts of a table whose only column is the ids, in blocks."""
    for batch in text_blocks(batches, "ids", 4_000_000):
        yield Coded.of(batch.column(0), enc).line(enc.end)


def text_bigrams(coded: DataFrame, vocabulary: str, sh: Shape) -> tuple[np.ndarray, np.ndarray]:
    """`bigrams` of all coded texts, each between two ends, summed over tasks."""
    shared = coded.sparkSession.sparkContext.broadcast(sh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = shared.value
        total = np.zeros(2 * sh.v * sh.c, np.int64)
        for line, _ in _lines(batches, subwords(vocabulary)):
            pairs, seen = bigrams([line], sh)
            total += np.concatenate([pairs.ravel(), seen.ravel()])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["cell", "n"])

    found = coded.select("ids").mapInArrow(freed(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    whole = np.zeros(2 * sh.v * sh.c)
    whole[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return whole[: sh.v * sh.c].reshape(sh.v, sh.c), whole[sh.v * sh.c :].reshape(sh.c, sh.v)


def fit_attention(coded: DataFrame, vocabulary: str, sh: Shape, bigram: np.ndarray, span: int, rounds: int) -> dict[str, np.ndarray]:
    """Weights fitted in every task and averaged by the tasks' windows after each round; each text is in one round."""
    sc = coded.sparkSession.sparkContext
    p = initial(sh.v, sh.c, span)
    names, sizes = list(p), [x.size for x in p.values()]
    fixed = sc.broadcast((sh, bigram))
    for turn in range(rounds):
        now = sc.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], now=now, turn=turn) -> Iterator[pa.RecordBatch]:
            sh, bigram = fixed.value
            weights, n = now.value, 0
            for line, at in _lines(batches, subwords(vocabulary)):
                data = windows_of([line[a : b + 1] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], span)
                weights = train(weights, data, sh.row, sh.klass, bigram, span, rate=1.5e-2 / (1 + turn), seed=turn)
                n += len(data)
            if n:
                flat = np.concatenate([weights[k].ravel() for k in names]).astype(np.float64) * n
                pieces = [flat[at : at + PIECE] for at in range(0, len(flat), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces, pa.list_(pa.float64()))], names=["piece", "n", "x"])

        mine = coded.filter(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn).select("ids")
        rows = mine.mapInArrow(freed(run), "piece int, n long, x array<double>").select("piece", "n", F.posexplode("x").alias("at", "x"))
        found = rows.groupBy("piece", "at").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
        if not found.num_rows:
            continue  # a part without texts
        flat = np.zeros(sum(sizes))
        flat[found.column("piece").to_numpy() * PIECE + found.column("at").to_numpy()] = found.column("x").to_numpy()
        parts = np.split(flat.astype(np.float32), np.cumsum(sizes)[:-1])
        p = {k: x.reshape(p[k].shape) for k, x in zip(names, parts, strict=True)}
    return p


@dataclass
class Fitted:
    model: Attention
    head: dict[bytes, int]
    n: int
    v: int
    ends: int
    vocabulary: str
    mix: float
    contexts: int


def fit(
    training: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, max_head: int = MAX_HEAD, contexts: int = CONTEXTS, trust: float = TRUST, rounds: int = ROUNDS, share: float = MIX
) -> tuple[Fitted, DataFrame]:
    """The model of a table of training texts, and what is looked up for it: (key, c, trust, after) of words and contexts."""
    return fit_coded(encoded(training, key, text, vocabulary), vocabulary, max_head, contexts, trust, rounds, share)


def fit_coded(
    coded: DataFrame, vocabulary: str = VOCABULARY, max_head: int = MAX_HEAD, contexts: int = CONTEXTS, trust: float = TRUST, rounds: int = ROUNDS, share: float = MIX
) -> tuple[Fitted, DataFrame]:
    """`fit` on `encoded` rows."""
    keys = materialise(key_counts(with_contexts(coded, vocabulary, contexts), vocabulary, coded), "words")
    counts = keys.filter(f"NOT ({_IS_GRAM})").select(F.col("key").alias("word"), "c")
    ends = coded.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ids = id_counts(counts, subwords(vocabulary).size, ends)
    sh = shape(ids, neighbours(counts, ids, HEAD), HEAD, TAIL, ROWS)
    pairs, seen = text_bigrams(coded, vocabulary, sh)
    bigram = odds(pairs)
    weights = fit_attention(coded, vocabulary, sh, bigram, SPAN, rounds)
    model = assemble(ids, subwords(vocabulary).starts, sh, bigram, seen, weights, SPAN)
    memory = remembered(keys, trust).select("key", F.lit(None).cast("long").alias("c"), "trust", "after")
    known = counts.select(F.col("word").alias("key"), "c", F.lit(None).cast("double").alias("trust"), F.lit(None).cast("binary").alias("after"))
    return Fitted(model, frequent(counts, max_head), n + ends, v + (ends > 0), ends, vocabulary, share, contexts), known.unionByName(memory)


RANGE_KEY = " %06d"  # an odd number of bytes, unlike words, and fewer than rows' own keys have


def range_key(of: int) -> bytes:
    return (RANGE_KEY % of).encode()


def score(docs: DataFrame, fitted: Fitted, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every row."""
    return score_coded(encoded(docs, key, text, fitted.vocabulary), fitted, known, key)


def score_coded(coded: DataFrame, fitted: Fitted, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """`score` of `encoded` rows."""
    key_type = coded.schema["id"].dataType.simpleString()
    shared = coded.sparkSession.sparkContext.broadcast(fitted)
    norm, bits = fitted.n + fitted.v + 1, range_bits(coded, fitted.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        f, pid, n = shared.value, TaskContext.get().partitionId(), 0
        enc, count = subwords(f.vocabulary), f.head.get
        end_log = math.log10((f.ends + 1) / norm)
        total = max(1, f.ends + sum(f.head.values()))
        for batch in text_blocks(batches, "ids", 2_000_000):
            coded, m = Coded.of(batch.column(1), enc), batch.num_rows
            (words, codes), sizes = coded.words(), coded.sizes()
            doc = np.repeat(np.arange(m), sizes)
            # The frequent words' part of the base, and the others' counts in each document.
            found_c = np.array([count(w if len(w) <= 64 else word_key(w), 0) for w in words] or [1], np.int64)
            logs = np.where(found_c > 0, np.log10((found_c + 1) / norm), 0.0)
            base = np.bincount(doc, logs[codes], m) + end_log
            met = np.bincount(doc, found_c[codes] > 0, m).astype(np.int64) + (f.ends > 0)
            rare = found_c[codes] == 0
            pair, tf = np.unique(doc[rare] * len(words) + codes[rare], return_counts=True) if rare.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            each = np.diff(np.concatenate([coded.first, [len(coded.ids)]]))
            scores, word_logs = f.model.score(coded.ids.astype(np.int64), each, sizes, found_c[codes] / total, f.mix, enc.end, f.ends / total)
            place, before, after = chosen_contexts(enc.hashes(words), codes, sizes, f.contexts)
            rows = np.array([row_key(pid, n + i) for i in range(m)], np.int64)
            n += m
            order = np.argsort(before, kind="stable")
            chance = word_logs[place].astype(np.float32).view(np.uint32).astype(np.uint64)
            of, data = by_range([x[order] for x in (before >> np.uint64(8), after >> np.uint64(32), chance, doc[place].astype(np.uint64))], bits, SCORED)
            k, j = len(pair), len(of)
            blank = lambda kind: pa.nulls(k + j, kind)
            # Each row's own key is one that no word and no context has, by its length.
            own = pa.concat_arrays([_binary([np.full((m, 3), 32, np.uint8), _bytes(rows)]), pa.array([words[i] for i in (pair % max(1, len(words))).tolist()], pa.binary())])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([rows, rows[pair // max(1, len(words))], np.full(j, rows[0] if m else 0)])),
                    pa.concat_arrays([batch.column(0), blank(batch.column(0).type)]),
                    pa.concat_arrays([pa.array(sizes + 1), blank(pa.int64())]),
                    pa.concat_arrays([pa.array(met), blank(pa.int64())]),
                    pa.concat_arrays([pa.array(base), blank(pa.float64())]),
                    pa.concat_arrays([pa.array(scores), blank(pa.float64())]),
                    pa.concat_arrays([own, pa.array([range_key(x) for x in of], pa.binary())]),
                    pa.array(np.concatenate([np.zeros(m, np.int64), tf, np.zeros(j, np.int64)])),
                    pa.concat_arrays([pa.nulls(m + k, pa.binary()), pa.array(data, pa.binary())]),
                ],
                names=["row", "id", "n_tokens", "known", "base", "score", "key", "tf", "data"],
            )

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, c, memory = batch.columns
            items, of = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            plain, data = items.field("data").is_null(), items.field("data")
            columns = [items.field(x).filter(plain) for x in ("row", "id", "n_tokens", "known", "base", "score", "tf")]
            yield pa.RecordBatch.from_arrays([*columns, c.take(pa.array(of)).filter(plain), pa.array(np.zeros(len(columns[0])))], names=names)
            rows, at = items.field("row"), None
            for i in np.flatnonzero(~np.asarray(plain)).tolist():
                if of[i] != at:
                    at, held = of[i], memory[int(of[i])].values
                    if held is not None:
                        keys, trust, after = (held.field(x) for x in ("key", "trust", "after"))
                        keys = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 9)[:, 1:].copy().view("<u8").reshape(-1) >> np.uint64(8)
                        order = np.argsort(keys)
                        keys, trust, after = keys[order], trust.to_numpy()[order], np.frombuffer(b"".join(after.to_pylist()), "<u4")[order]
                if held is None:
                    continue
                context, said, chance, doc = unpacked(data[i].as_py(), SCORED)
                found = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                hit = np.flatnonzero(keys[found] == context)
                if not len(hit):
                    continue
                found, ln_p = found[hit], chance[hit].astype(np.uint32).view(np.float32).astype(np.float64)
                a, right = trust[found], after[found] == said[hit]
                # What memory adds to the model's chance of a word after a context it knows.
                gain = np.where(right, np.log10(a + (1 - a) * np.exp(ln_p)) - ln_p / math.log(10), np.log10(1 - a))
                text, place = np.unique(doc[hit].astype(np.int64), return_inverse=True)
                k = len(text)
                blank = [pa.nulls(k, f.type) for f in columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(text + rows[i].as_py()), *blank, pa.nulls(k, pa.int64()), pa.array(np.bincount(place, gain, k))], names=names)

    fields = f"row long, id {key_type}, n_tokens long, known long, base double, score double"
    names = ["row", "id", "n_tokens", "known", "base", "score", "tf", "c", "gain"]
    found = coded.select("id", "ids").mapInArrow(freed(run), f"{fields}, key binary, tf long, data binary")
    listed = found.groupBy("key").agg(F.collect_list(F.struct("row", "id", "n_tokens", "known", "base", "score", "tf", "data")).alias("items"))
    # What is remembered goes by the upper bits of the contexts' hashes, whose bytes begin with the lowest.
    upper = F.shiftright(F.conv(F.hex(F.concat(F.expr("substr(key, 9, 1)"), F.expr("substr(key, 8, 1)"))), 16, 10).cast("int"), 16 - bits)
    memory = known.filter("trust IS NOT NULL").groupBy(upper.alias("of")).agg(F.collect_list(F.struct("key", "trust", "after")).alias("memory"))
    ranged = memory.select(F.encode(F.format_string(RANGE_KEY, "of"), "utf-8").alias("key"), F.lit(None).cast("long").alias("c"), "memory")
    words = known.filter("trust IS NULL").select("key", "c", F.lit(None).cast(ranged.schema["memory"].dataType).alias("memory"))
    joined = listed.join(words.unionByName(ranged), "key", "left").select("items", "c", "memory")
    every = joined.mapInArrow(freed(met), f"{fields}, tf long, c long, gain double")
    rare_log = F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(norm)))
    return (
        every.groupBy("row")
        .agg(
            F.max("id").alias(key),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.coalesce("known", F.lit(0)) + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
            F.sum(F.coalesce("base", F.lit(0.0)) + F.when(F.col("tf") > 0, F.col("tf") * rare_log).otherwise(0.0)).alias("base_score"),
            (F.max("score") + F.sum("gain")).alias("score"),
        )
        .drop("row")
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encoded(table(spark, sf_dir, "documents"), "doc_id", "text", VOCABULARY)
    fitted, known = fit_coded(coded.filter(~held_out("id", 7, 2)))
    scored = score_coded(coded, fitted, known)
    return scored.select(
        "doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.n).cast("long").alias("train_tokens"), "base_score", "score"
    )
