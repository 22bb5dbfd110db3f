"""URL filter: rules, and gradient-boosted trees on lexical features for the rest.

A rule `host/path` fits a host and all its subdomains if the URL's path starts with the rule's
path; the longest rule wins.  URLs that a rule fits are the labelled ones.  The trees learn from
them alone, at most `max_rows` distinct ones (least by hash), and judge every URL without a
rule.  Every feature and every tree is a SQL expression; only that bounded sample of numbers
reaches the driver, where the trees are grown in numpy.  Suffix statistics (pages of each last
host label, and their mean length) count all rows; labels are no part of them, and they are said
in powers of ten and steps of eight characters, so that they don't name a suffix, which rules
pick whole.  Suffixes are broadcast to the pages if they are few, by a count; else pages and
suffixes meet in a join that can be split.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and
is judged by its features (zeros for null); repeated rows are judged alike; without labels of
both kinds the verdict is the only one, `allow` if there are none; an empty table gives
no rows.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import ascii_lower, materialise, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_ROWS = 20_000
MAX_SUFFIXES, MAX_SUFFIX_BYTES = 200_000, 8 << 20  # of what is broadcast
FEATURES = ("length", "host_length", "path_length", "depth", "dots", "hyphens", "digit_ratio", "entropy", "parameters", "secure", "fragment", "host_digits", "suffix_pages", "suffix_length")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """The features that need the URL alone."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.coalesce(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit(""))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "dots": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
        "hyphens": (n - F.length(F.replace(u, F.lit("-"), F.lit("")))).cast("double"),
        "digit_ratio": F.when(n > 0, _count(u, "[0-9]") / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "secure": ascii_lower(u).startswith("https:").cast("double"),
        "fragment": F.contains(u, F.lit("#")).cast("double"),
        "host_digits": _count(host, "[0-9]").cast("double"),
    }


@dataclass(frozen=True)
class Trees:
    """Regression trees of one log-odds: each a list of (feature, threshold, left, right) or a leaf value."""

    base: float
    trees: tuple

    def column(self, columns: dict[str, Column]) -> Column:
        names = list(FEATURES)

        def node(t) -> Column:
            if not isinstance(t, tuple):
                return F.lit(float(t))
            f, cut, left, right = t
            return F.when(columns[names[f]] <= F.lit(cut), node(left)).otherwise(node(right))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + node(t)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Trees:
    """Logistic gradient boosting with histograms of at most `bins` quantile bins a feature."""
    if not len(y):
        return Trees(-10.0, ())
    p0 = ((w * y).sum() + 1e-3) / (w.sum() + 2e-3)
    base = float(np.log(p0 / (1 - p0)))
    if y.min() == y.max():
        return Trees(base, ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, trees = np.full(len(y), base), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = coded[rows, f]
                gl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(nl < least) | (len(rows) - nl < least)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, k))
        if best[1] is None:
            value = -rate * gs / (hs + ridge)
            margin[rows] += value
            return float(value)
        f, k = best[1]
        left = coded[rows, f] <= k
        return (f, float(edges[f][k]), split(rows[left], g, h, level + 1), split(rows[~left], g, h, level + 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        trees.append(split(np.arange(len(y)), w * (p - y), w * p * (1 - p), 0))
    return Trees(base, tuple(trees))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, max_rows: int = MAX_ROWS) -> DataFrame:
    """(key, host, path, rule, verdict, score): score is the trees' chance of `block`, for all rows."""
    parts = pages.select(F.col(key), F.col(url).alias("_url")).select("*", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    known = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_suffix", F.substring_index("host", ".", -1))
    suffixes = known.groupBy("_suffix").agg(
        F.floor(F.log10(F.count("*").cast("double"))).cast("double").alias("suffix_pages"),
        F.coalesce(F.floor(F.avg(F.length("_url")) / 8).cast("double"), F.lit(0.0)).alias("suffix_length"),
    )
    suffixes = materialise(suffixes, "suffixes")
    size = suffixes.agg(F.count("*").alias("n"), F.sum(F.octet_length("_suffix")).alias("bytes")).first()
    suffixes = F.broadcast(suffixes) if size.n <= MAX_SUFFIXES and (size.bytes or 0) <= MAX_SUFFIX_BYTES else suffixes
    lex = lexical(F.col("_url"), F.col("host"), F.col("path"))
    names = ("_url", "host", "path", "_suffix")
    # A URL's labels agree: the rule follows from the URL.
    distinct = known.filter(F.col("_rule").isNotNull()).select(*names, (F.col("_rule.verdict") == "block").cast("double").alias("_y")).groupBy(*names, "_y").agg(F.lit(1))
    chosen = distinct.orderBy(F.xxhash64("_url"), "_url").limit(max_rows).join(suffixes, "_suffix", "left")
    found = chosen.select("_y", *(lex[f].alias(f) if f in lex else F.col(f) for f in FEATURES)).collect()
    data = np.array([tuple(r) for r in found], dtype=float).reshape(len(found), 1 + len(FEATURES))
    data = data[np.lexsort(data.T[::-1])]  # the order rows arrive in doesn't matter
    trees = grow(data[:, 1:], data[:, 0], np.ones(len(data)))
    scored = known.join(suffixes, "_suffix", "left")
    named = scored.select(key, "host", "path", "_rule", *(lex[f].alias(f"_{f}") if f in lex else F.col(f).alias(f"_{f}") for f in FEATURES))
    score = trees.column({f: F.col(f"_{f}") for f in FEATURES})
    return named.withColumn("score", score).select(
        key,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
