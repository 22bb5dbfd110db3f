"""Globs and regular expressions as data: translated on the driver where they are constants, analysed in Arrow batches where they are columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def braces(glob: str) -> list[str]:
    """A glob with {a,b} groups, nested ones too, as the plain globs it stands for, in order.

    A stack holds, for each open group, the finished options and the texts of the one being read; a brace
    that never closes is an ordinary character.
    """
    closed = [False] * len(glob)
    waiting: list[int] = []
    for i, c in enumerate(glob):
        if c == "{":
            waiting.append(i)
        elif c == "}" and waiting:
            closed[waiting.pop()] = closed[i] = True
    stack: list[tuple[list[str], list[str]]] = []
    texts, options = [""], []
    for i, c in enumerate(glob):
        if c == "{" and closed[i]:
            stack.append((texts, options))
            texts, options = [""], []
        elif c == "}" and closed[i]:
            group = options + texts
            texts, options = stack.pop()
            texts = [before + part for before in texts for part in group]
        elif c == "," and stack:
            options, texts = options + texts, [""]
        else:
            texts = [t + c for t in texts]
    return texts


def glob_body(plain: str) -> str:
    """The regular expression of a glob without braces: `**/` is any folders, `*` and `?` stay within a folder."""
    text, i = "", 0
    while i < len(plain):
        if plain.startswith("**/", i):
            text, i = text + "(.*/)?", i + 3
        elif plain.startswith("**", i):
            text, i = text + ".*", i + 2
        else:
            text += {"*": "[^/]*", "?": "[^/]"}.get(plain[i], re.escape(plain[i]))
            i += 1
    return text


def glob_regex(glob: str) -> str:
    """A regular expression (both engines' dialects) that paths of a glob match as a whole; a glob without a slash fits at any depth."""
    return f"^({'|'.join(glob_body(plain if '/' in plain else '**/' + plain) for plain in braces(glob))})$"


def in_globs(path: Column, globs: list[str]) -> Column:
    """Whether a path fits one of the globs and none of the negated (!) ones."""
    wanted = [g for g in globs if not g.startswith("!")]
    banned = [g[1:] for g in globs if g.startswith("!")]
    fits = path.rlike("|".join(map(glob_regex, wanted))) if wanted else F.lit(True)
    return fits & ~path.rlike("|".join(map(glob_regex, banned))) if banned else fits


def alternatives(pattern: str) -> list[str]:
    """The parts of a regular expression between its outermost bars."""
    out, depth, inside, last, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[last:i])
            last = i + 1
        i += 1
    return [*out, pattern[last:]]


def identifier_of(pattern: str) -> str | None:
    """The one name a pattern looks for, if it is a name between boundaries and definition words."""
    bare = re.sub(r"\\[bBAZ]|^\^|\$$|\\s[*+]?|\\\(.*$", " ", pattern)
    bare = re.sub(r"\b(fn|func|def|class|struct|enum|trait|impl|type|const|let|pub|function)\b", " ", bare).strip()
    return bare if re.fullmatch(r"[A-Za-z_$][\w$]*", bare) else None


_DEFINING = re.compile(r"\b(fn|func|def|class|struct|enum|trait|impl|type|const|let|function|interface)\b")


def literals_of(pattern: str) -> list[str]:
    """Literal pieces of a pattern that look like paths or dashed names: three characters or more with a letter and a dash or slash."""
    pieces = re.split(r"\\[A-Za-z]|[\\^$|()\[\]{}*+?\s\"'`,;:=<>!&#%~]+", pattern)
    return [p for p in pieces if re.fullmatch(r"[\w$.@/-]{3,}", p) and re.search("[-/]", p) and re.search("[A-Za-z]", p)]


def analyse(rows: DataFrame, pattern: str) -> DataFrame:
    """Adds names, defining, named and literals of a column of regular expressions.

    defining: it asks for a definition; named: every alternative is one name.  Each distinct pattern is analysed
    once, in Arrow batches, and joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [[identifier_of(a) for a in alternatives(t)] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[n for n in f if n] for f in found], pa.list_(pa.string())),
                    pa.array([bool(_DEFINING.search(t)) for t in texts], pa.bool_()),
                    pa.array([all(f) for f in found], pa.bool_()),
                    pa.array([literals_of(t) for t in texts], pa.list_(pa.string())),
                ],
                names=["_p", "names", "defining", "named", "literals"],
            )

    distinct = rows.select(F.col(pattern).alias("_p")).dropna().distinct()
    known = distinct.mapInArrow(run, "_p string, names array<string>, defining boolean, named boolean, literals array<string>")
    return rows.join(known, F.col(pattern) == F.col("_p"), "left").drop("_p")
