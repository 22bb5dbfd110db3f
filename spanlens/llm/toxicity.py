"""Toxicity of texts behind obfuscation: a noisy channel is undone first, then words are scored.

Restoring.  A token of letters only, give or take punctuation at its ends, stays as it is, and a
number says nothing.  Any other token with letters or with symbols that stand for letters, and
any run of three or more single characters, becomes a lattice: a
digit or symbol may stand for letters (leetspeak), a separator or blank may be dropped or split
words (spacing), a character said three times or more is one or two (repetition).  Viterbi
decoding under an interpolated character trigram model, with a cost for each change, picks the
restored words.

Scoring.  A document is the set of its restored words and their beginnings of 4, 5 and 6
letters.  The features whose presence differs between toxic and other labelled documents (by
likelihood ratio) go into a logistic regression fitted in numpy; how large the ratio must be and
how strong the ridge is, is chosen by cross-validation within the documents learned from.

Bounds.  The classifier is fitted on at most `max_docs` labelled documents (those least by a
hash of their key), and what they hold bounds its features.  The character model counts the
trigrams of all documents; those of less than one in a million (`rare`) are left to smoothing, so
at most a million reach the driver and the workers.  Texts are never shuffled.

Defined results: null and empty texts get the score of no features; without labels of both
kinds the score is the smoothed share of toxic labels (0.1 if there are none); repeated labels
of a document count as their maximum; null labels and labels without a document are left out;
of several texts under one key the least is learned from.
Other columns pass through `annotate`, whose score column has a name of the caller's choice.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import discard, freed, materialise, spread, table, text_blocks

MAX_DOCS, RARE = 20_000, 1e-6
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

# Letters that a digit or symbol may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = frozenset(".-_*~'`^,:;/\\=#%&·•")
EDGE = ".,;:!?\"'()[]{}<>«»“”‘’…¿¡-–—_*~`"

# Least likelihood ratios of a feature and ridges that cross-validation chooses from.
EVIDENCE, RIDGES = (4.0, 8.0), (0.1, 0.5)

LEET_COST, DROP_COST, SPLIT_COST, TWICE_COST, LITERAL_COST = 0.7, 0.4, 1.5, 0.5, 1.0
_SINGLES = re.compile(r"(?:^|(?<=\s))\S(?:\s+\S){2,}(?=\s|$)")
_SYMBOLS = frozenset(c for c in LEET if not c.isdigit())
_AMOUNT = re.compile(r"[$€£+]?[\d.,:/%+-]*[$€£+]?")
_THRICE = re.compile(r"(.)\1\1")


@dataclass
class CharModel:
    """Interpolated trigrams over lower-case words between spaces."""

    tri: dict[str, int]
    cache: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.bi, self.ctx3, self.uni, self.ctx2 = Counter(), Counter(), Counter(), Counter()
        for g, n in self.tri.items():
            self.ctx3[g[:2]] += n
            self.bi[g[1:]] += n
            self.ctx2[g[1]] += n
            self.uni[g[2]] += n
        self.all = max(1, sum(self.uni.values()))
        self.letters = max(1, len(self.uni))

    def __getstate__(self):
        return {"tri": self.tri}

    def __setstate__(self, state):
        self.__init__(state["tri"])

    def log(self, gram: str) -> float:
        """ln P(third character | first two)."""
        found = self.cache.get(gram)
        if found is None:
            p3 = self.tri.get(gram, 0) / max(1, self.ctx3.get(gram[:2], 0))
            p2 = self.bi.get(gram[1:], 0) / max(1, self.ctx2.get(gram[1], 0))
            p1 = self.uni.get(gram[2], 0) / self.all
            found = math.log(0.70 * p3 + 0.20 * p2 + 0.08 * p1 + 0.02 / (self.letters + 1))
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[gram] = found
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters the strings it may stand for, with costs."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        n, i = j - i, j
        inner = 0 < i - n and i < len(token)
        reads: list[tuple[str, float]] = []
        if c.isspace():
            reads += [("", 0.0), (" ", SPLIT_COST)]
        elif c.isalpha():
            reads += [(c * n, 0.0)] if n <= 2 else [(c, 0.0), (c * 2, TWICE_COST)]
        else:
            for x in LEET.get(c, ""):
                reads += [(x * n, LEET_COST * n)] if n <= 2 else [(x, LEET_COST), (x * 2, LEET_COST + TWICE_COST)]
            if c in SEPARATORS or not inner:
                reads.append(("", DROP_COST))
            if c in SEPARATORS:
                reads.append((" ", SPLIT_COST))
            if not reads or c.isdigit():
                reads.append((c * min(n, 2), LITERAL_COST))
        out.append(reads)
    return out


def restore(token: str, model: CharModel) -> list[str]:
    """The likeliest words behind a token, by Viterbi over the last two characters."""
    # Of each state: the cost, and what was read last with what led there.
    states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    for reads in lattice(token):
        following: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, said) in states.items():
            for word, extra in reads:
                total, two = cost + extra, last
                for c in word:
                    if c == " " and two[1] == " ":
                        continue
                    total -= model.log(two + c)
                    two = two[1] + c
                if two not in following or total < following[two][0]:
                    following[two] = (total, (said, word) if word else said)
        states = following
    _, two = min((cost - (model.log(two + " ") if two[1] != " " else 0.0), two) for two, (cost, _) in states.items())
    parts, said = [], states[two][1]
    while said is not None:
        said, word = said
        parts.append(word)
    return "".join(reversed(parts)).split()


def untailed(core: str) -> str:
    """Without the marks at its end, each said three times or more, with marks of edges behind them.

    Runs of equal characters are met from the end, each once.
    """
    end = cut = len(core)
    while end:
        c, start = core[end - 1], end
        while start and core[start - 1] == c:
            start -= 1
        if end - start >= 3 and not (c.isalnum() or c == "_" or c.isspace()):
            cut = start
        elif c not in EDGE:
            break
        end = start
    return core[:cut]


def plain(token: str) -> str | None:
    """The token without its edges if nothing is hidden in it; None if it needs decoding; empty if it says nothing."""
    core = token.strip(EDGE)
    if not core.isalpha():
        core = untailed(core).strip(EDGE)
    if core.isalpha():
        return None if _THRICE.search(core) else core
    if any(c.isalpha() for c in core):
        return None
    return "" if _SYMBOLS.isdisjoint(core) or _AMOUNT.fullmatch(core) else None


class Restorer(dict):
    """Restored words of each token, kept while there is room."""

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def words(self, token: str) -> tuple[str, ...]:
        core = plain(token)
        return (core,) if core else () if core == "" else tuple(restore(token, self.model))

    def __missing__(self, token: str):
        found = self.value(token)
        if len(token) <= 80:
            if len(self) >= 200_000:
                self.clear()
            self[token] = found
        return found

    value = words

    def of(self, text: str | None) -> set:
        """What all tokens of a text give, each once."""
        if not text:
            return set()
        low = text.lower()
        tokens = set(low.split())
        tokens.update(_SINGLES.findall(low))
        return set(chain.from_iterable(map(self.__getitem__, tokens)))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Scorer(Restorer):
    """Feature numbers of each token."""

    def __init__(self, model: CharModel, numbers: dict[str, int]):
        super().__init__(model)
        self.numbers = numbers

    def value(self, token: str) -> tuple[int, ...]:
        get = self.numbers.get
        return tuple({n for w in self.words(token) for f in features(w) if (n := get(f)) is not None})


@dataclass
class Model:
    chars: CharModel
    numbers: dict[str, int]
    weights: np.ndarray
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self.chars, self.numbers)

    def score(self, found: set[int]) -> float:
        z = self.bias + float(self.weights[sorted(found)].sum()) if found else self.bias
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))


def logistic(rows: list[list[int]], y: np.ndarray, n: int, ridge: float = 0.1, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2 logistic regression on sets of features, by accelerated gradient steps."""
    col = np.fromiter(chain.from_iterable(rows), np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    prior = (y.sum() + 1) / (len(y) + 10)
    w, b = np.zeros(n), math.log(prior / (1 - prior))
    degree = np.sqrt(np.bincount(row, minlength=len(rows)) + 1.0)
    curve = np.bincount(col, degree[row], n) / 4 * degree.mean() + ridge  # a diagonal bound of the curvature
    curve_b = max(1.0, (degree**2).sum() / 4)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], len(rows)) + vb, -50, 50)))
        g = np.bincount(col, (p - y)[row], n) + ridge * v
        w2, b2 = v - g / curve, vb - (p - y).sum() / curve_b
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def chosen(rows: list[list[int]], y: np.ndarray, ratios: np.ndarray) -> tuple[float, float]:
    """Evidence and ridge of the least loss on documents held back in turn, by halves of those learned from."""
    fold = np.arange(len(y)) % 2
    best = (math.inf, EVIDENCE[0], RIDGES[0])
    for evidence in EVIDENCE:
        left = np.cumsum(ratios > evidence) - 1
        kept = [[int(left[f]) for f in r if ratios[f] > evidence] for r in rows]
        for ridge in RIDGES:
            loss = 0.0
            for part in (0, 1):
                w, b = logistic([r for r, f in zip(kept, fold, strict=True) if f != part], y[fold != part], int(left[-1]) + 1, ridge, 100)
                z = np.array([w[r].sum() + b for r, f in zip(kept, fold, strict=True) if f == part])
                loss += float(np.logaddexp(0, np.where(y[fold == part] > 0, -z, z)).sum())
            if loss < best[0] - 1e-9:
                best = (loss, evidence, ridge)
    return best[1], best[2]


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of the plain words of texts, summed while there is room."""
    seen: Counter = Counter()

    def said() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["gram", "n"])

    for batch in text_blocks(batches, "_t"):
        words: Counter = Counter()
        for body in batch.column(0).to_pylist():
            if body:
                words.update(body.lower().split())
        for token, n in words.items():
            word = plain(token)
            if word:
                padded = f"  {word} "
                for i in range(len(padded) - 2):
                    seen[padded[i : i + 3]] += n
        if len(seen) > 500_000:
            yield said()
            seen.clear()
    yield said()


def characters(texts: DataFrame, rare: float = RARE) -> CharModel:
    """The character model of all texts (a table with the column `_t`)."""
    counted = materialise(texts.mapInArrow(freed(_trigrams), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    least = rare * (counted.agg(F.sum("n")).first()[0] or 0)
    model = CharModel({r.gram: r.n for r in counted.filter(F.col("n") >= least).collect()})
    discard(counted)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS, rare: float = RARE) -> Model:
    """Learns from the labelled documents whose `usable` (an expression on the key) is true."""
    known = labels.select(F.col(key).cast("long").alias("_k"), F.col(label).cast("double").alias("_y")).dropna()
    if usable is not None:
        known = known.filter(usable)
    asked = known.groupBy("_k").agg((F.max("_y") > 0).cast("long").alias("_y")).orderBy(F.xxhash64("_k"), "_k").limit(max_docs)
    texts = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_t"))
    stored = materialise(texts.join(F.broadcast(asked), "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t")).select("_k", "_t", "_y"), "labelled")
    sample = stored.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "_k")
    chars = characters(texts.select("_t"), rare)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        for batch in text_blocks(batches, "_t"):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for body, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[y].update({f for w in restorer.of(body) for f in features(w)})
            names = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([seen[0][f] for f in names], pa.int64()), pa.array([seen[1][f] for f in names], pa.int64())], names=["f", "no", "yes"]
            )

    totals = {r._y: r.n for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    no, yes = totals.get(0, 0), totals.get(1, 0)
    if not no or not yes:
        share = 0.1 if not no + yes else (yes + 0.1) / (no + yes + 1)
        return Model(chars, {}, np.zeros(0), math.log(share / (1 - share)))
    p = (yes) / (no + yes)
    seen = sample.mapInArrow(freed(evidence), "f string, no long, yes long").groupBy("f").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).filter("no + yes >= 3")
    # Likelihood ratio of "the feature comes with toxic documents at a rate of its own" against the common rate.
    n = F.col("no") + F.col("yes")
    gain = F.when(F.col("yes") > 0, F.col("yes") * F.log(F.col("yes") / (n * p))).otherwise(0.0) + F.when(F.col("no") > 0, F.col("no") * F.log(F.col("no") / (n * (1 - p)))).otherwise(0.0)
    best = seen.select("f", gain.alias("g")).filter(F.col("g") > min(EVIDENCE)).orderBy(F.desc("g"), "f").collect()
    numbers = {r.f: i for i, r in enumerate(best)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chars, numbers)
        for batch in text_blocks(batches, "_t"):
            found = [sorted(scorer.of(body)) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["_k", "x", "_y"])

    rows = sorted(sample.mapInArrow(freed(vectors), "_k long, x array<int>, _y long").collect())
    discard(stored)
    xs, y = [r.x for r in rows], np.array([r._y for r in rows], float)
    if not numbers:
        return Model(chars, {}, *logistic(xs, y, 0))
    least, ridge = chosen(xs, y, np.array([r.g for r in best]))
    kept = sum(r.g > least for r in best)  # numbers go by falling ratio
    weights, bias = logistic([[f for f in x if f < kept] for x in xs], y, kept, ridge)
    return Model(chars, {f: i for f, i in numbers.items() if i < kept}, weights, bias)


def annotate(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """The rows with the column `out`: the score of their whole text."""
    if out in docs.columns:
        raise ValueError(f"documents have a column {out} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = m.scorer()
        for batch in text_blocks(batches, text):
            at = batch.schema.get_field_index(text)
            scores = [m.score(scorer.of(body)) for body in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(freed(run), f"{fields}, `{out}` double")


def held_out(key: str, parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out("_k"))
    scored = annotate(docs, model, out="score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
