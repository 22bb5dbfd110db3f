"""Exact lookups: which queries are names, and the lines where a name occurs."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from spanlens.functions import paths
from spanlens.functions import text as T
from spanlens.operators.chunk import line_array, lines
from spanlens.sources.store import stored

# Words that frame a lookup without naming anything.
FRAMING = ("where", "is", "find", "the", "used", "defined", "show", "of", "in")
MAX_NAMES, MAX_CHARS = 8, 128


def query_names(query: Column) -> Column:
    """Candidate names of a query: its parts without framing words."""
    return F.filter(F.split(F.trim(query), r"[\s|,]+"), lambda w: (w != "") & ~F.lower(w).isin(*FRAMING))


def is_lookup(query: Column) -> Column:
    """Whether a query names code to be found as written: one name, a list, or names that can only be code."""
    names = query_names(query)
    code = lambda n: F.contains(n, F.lit("_")) | (n.rlike("^.+[A-Z]") & n.rlike("[a-z]"))
    few = F.size(names).between(1, MAX_NAMES) & (F.length(query) <= MAX_CHARS)
    shaped = F.forall(names, lambda n: n.rlike(r"^[A-Za-z_$][A-Za-z0-9_$/-]*\z"))
    return few & shaped & ((F.size(names) == 1) | F.contains(query, F.lit("|")) | F.forall(names, code))


def name_lines(files: DataFrame, id: str, name: str, text: str = "text") -> DataFrame:
    """(id, line, body, in_file): lines that hold a name; files without it are left out before lines are cut."""
    rows = lines(files.filter(F.contains(text, F.lit(name))), id, text).filter(T.has_name(F.col("body"), name))
    return rows.select(id, "line", "body", F.count("*").over(Window.partitionBy(id)).alias("in_file"))


# Tables of at most so many names are broadcast.
BROADCAST_NAMES = 100_000


# Kinds of keys, by what they look like; no key of one kind looks like one of another.
KEY_KINDS = {"small": "^[a-z0-9]+$", "capitals": "^[A-Z]+$", "dashed": "[-/]$", "rare": r"^([_$]|[^\x00-\x7F])$"}


def _suffixes(found: Column, tail: int = 0) -> Column:
    """The ends of each string: at most three characters before `tail` more."""
    cut = lambda x: F.transform(F.sequence(F.lit(0 if tail else 1), F.length(x) - tail), lambda n: F.right(x, n + tail))
    return F.flatten(F.transform(found, cut))


def line_keys(body: Column, kinds: frozenset[str] = frozenset(KEY_KINDS)) -> Column:
    """What a line offers to names: runs of small letters and digits, ends of runs of capitals, ends before - and /, and rarer characters.

    A name whose `name_key` is not among them is not in the line: within a name's boundaries its runs of small letters
    and digits are whole runs of the line.
    """
    all_ = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    found = {
        "small": all_("[a-z0-9]+"),
        "capitals": _suffixes(all_("[A-Z]{1,3}(?![A-Za-z0-9])")),
        "dashed": _suffixes(all_("[A-Za-z0-9]{0,3}[-/]"), 1),
        "rare": all_(r"[_$]|[^\x00-\x7F]"),
    }
    asked = [keys for kind, keys in found.items() if kind in kinds]
    return F.array().cast("array<string>") if not asked else asked[0] if len(asked) == 1 else F.concat(*asked)


def name_key(name: Column) -> Column:
    """The one key by which a name meets lines; null for what has no letter, digit, underscore, dollar sign, dash or slash."""
    all_ = lambda pattern: F.regexp_extract_all(name, F.lit(pattern), F.lit(0))
    longest = lambda xs: F.array_max(F.transform(xs, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    plain = F.contains(name, F.lit("-")) | F.contains(name, F.lit("/"))
    return F.coalesce(
        F.when(plain, longest(all_("[A-Za-z0-9]{0,3}[-/]"))),
        longest(all_("[a-z0-9]+")),
        F.right(F.try_element_at(all_("[A-Z]+"), F.lit(-1)), F.lit(3)),
        F.try_element_at(all_(r"[_$]|[^\x00-\x7F]"), F.lit(1)),
    )


def lines_of_names(texts: DataFrame, names: DataFrame, id: str, query: str = "query", name: str = "name", text: str = "text") -> DataFrame:
    """(query, id, line, body, names): lines of all texts that hold a name of a query, in one pass for a whole table of names.

    names: (query, name).  Lines meet names by key (`line_keys`, `name_key`; only kinds of keys that names have), boundaries are checked after.  Few names
    go to the lines, so that nothing is shuffled (each id is one row of texts); of many, lines and names meet in a join that can be split.
    """
    asked = _asked(names, query, name)
    if asked.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        return _held(texts.select(id, text), asked, query, text).select(query, id, "line", "body", "names")
    wanted = asked.select("_name", "_pattern", "_key").distinct()
    kinds = wanted.agg(*(F.count_if(F.col("_key").rlike(pattern)).alias(kind) for kind, pattern in KEY_KINDS.items())).first()
    offered = line_keys(F.col("body"), frozenset(kind for kind in KEY_KINDS if kinds[kind]))
    each = lines(texts, id, text).select(id, "line", "body").withColumn("_key", F.explode(F.array_distinct(offered)))
    met = each.join(wanted, "_key").filter(F.contains("body", F.col("_name")))
    held = met.filter(F.coalesce(F.rlike("body", F.col("_pattern")), F.lit(True))).select(id, "line", "body", "_name")
    return held.join(asked.select(query, "_name"), "_name").groupBy(query, id, "line").agg(F.first("body").alias("body"), F.array_sort(F.collect_set("_name")).alias("names"))


def _asked(names: DataFrame, query: str, name: str) -> DataFrame:
    """(query, _name, _pattern, _key): each name of each query that can be looked for."""
    pairs = names.select(query, F.col(name).alias("_name")).filter("_name <> ''").distinct()
    return pairs.select(query, "_name", T.name_pattern(F.col("_name")).alias("_pattern"), name_key(F.col("_name")).alias("_key")).filter("_key is not null")


# `line_keys` as plain patterns: what is found, and how long the ends are of which each is a key (0: all of it).
_OFFERS = {"small": ("[a-z0-9]+", 0), "capitals": ("[A-Z]{1,3}(?![A-Za-z0-9])", 1), "dashed": ("[A-Za-z0-9]{0,3}[-/]", 1), "rare": (r"[_$]|[^\x00-\x7F]", 0)}
ROWS = 20_000  # rows in an Arrow batch


def _held(texts: DataFrame, asked: DataFrame, query: str, text: str) -> DataFrame:
    """Rows of texts, without the text, with (query, line, body, names, first) of each line that holds a name of a query; first: the names that no line of the text before holds."""
    by_key, owners = defaultdict(dict), defaultdict(list)
    for q, n, pattern, key in asked.collect():
        by_key[key][n] = pattern
        owners[n].append(q)
    offers = [_OFFERS[kind] for kind, pattern in KEY_KINDS.items() if any(re.search(pattern, key) for key in by_key)]
    shared = texts.sparkSession.sparkContext.broadcast((dict(by_key), dict(owners), offers))
    kept = [c for c in texts.columns if c != text]
    said = [asked.schema[query], StructField("line", IntegerType()), StructField("body", StringType()), *(StructField(c, ArrayType(StringType())) for c in ("names", "first"))]
    schema = StructType([*texts.select(kept).schema, *said])
    kinds = [to_arrow_type(f.dataType) for f in said]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key, owners, offers = shared.value
        offers = [(re.compile(pattern), ends) for pattern, ends in offers]
        patterns = {n: pattern and re.compile(pattern) for found in by_key.values() for n, pattern in found.items()}

        def holds(body: str) -> Iterator[str]:
            keys = set()
            for pattern, ends in offers:
                found = set(pattern.findall(body))
                keys |= {x[i:] for x in found for i in range(len(x))} if ends else found
            for key in keys & by_key.keys():
                for n in by_key[key]:
                    if n in body and (patterns[n] is None or patterns[n].search(body)):
                        yield n

        for batch in batches:
            rows, columns = [], ([], [], [], [], [])

            def piece(batch=batch, rows=rows, columns=columns) -> pa.RecordBatch:
                taken = batch.select(range(len(kept))).take(pa.array(rows, pa.int64()))
                made = pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=schema.names)
                for x in (rows, *columns):
                    x.clear()
                return made

            for row, bodies in enumerate(batch.column(len(kept)).to_pylist()):
                before: set[str] = set()
                for line, body in enumerate(bodies or (), 1):
                    by_query = defaultdict(list)
                    found = sorted(holds(body))
                    for n in found:
                        for q in owners[n]:
                            by_query[q].append(n)
                    for q, ns in by_query.items():
                        rows.append(row)
                        for x, value in zip(columns, (q, line, body, ns, [n for n in ns if n not in before]), strict=True):
                            x.append(value)
                    before.update(found)
                    if len(rows) >= ROWS:
                        yield piece()
            if rows:
                yield piece()

    bodies = F.transform(line_array(F.col(text)), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return texts.select(*kept, bodies.alias("_lines")).mapInArrow(run, schema)


def reports(chunks: DataFrame, names: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    """(query, path, symbol, line, body, names, is_definition) of all lines of chunks that hold a name of a query.

    chunks: (chunk_id, path, start_line, symbol, defines, text), which share no lines: a line belongs to the symbol of
    its chunk, the innermost one.  The first line of a chunk that holds a name which the chunk defines is its definition.
    """
    asked = _asked(names, query, name)
    if asked.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        held = _held(chunks.select("path", "start_line", "symbol", "defines", "text"), asked, query, "text")
        own = F.coalesce(F.arrays_overlap("first", "defines"), F.lit(False))
        return held.select(query, "path", "symbol", (F.col("start_line") + F.col("line") - 1).alias("line"), "body", "names", own.alias("is_definition"))
    # Read twice below.
    found = stored(lines_of_names(chunks.select("chunk_id", "text"), names, "chunk_id", query, name), "held")
    rows = found.join(chunks.select("chunk_id", "path", "start_line", "symbol", "defines"), "chunk_id")
    said = rows.select(query, "chunk_id", "line", F.explode("names").alias("_n"), F.array_contains("defines", F.col("_n")).alias("_own"))
    first = said.groupBy(query, "chunk_id", "_n").agg(F.min("line").alias("line"), F.bool_or("_own").alias("_own")).filter("_own")
    marked = first.select(query, "chunk_id", "line").distinct().withColumn("_def", F.lit(True))
    rows = rows.join(marked, [query, "chunk_id", "line"], "left")
    return rows.select(query, "path", "symbol", (F.col("start_line") + F.col("line") - 1).alias("line"), "body", "names", F.coalesce("_def", F.lit(False)).alias("is_definition"))


def report(chunks: DataFrame, name: str, per_file: int = 40, chars: int = 6_000) -> DataFrame:
    """(path, symbol, line, body, is_definition, in_file, listed) of the lines of chunks that hold a name.

    chunks: (chunk_id, path, start_line, symbol, defines, text).  A line belongs to its chunk's symbol; the first
    line of a chunk that defines the name is its definition.  Of each file the first `per_file` lines within `chars`
    characters are listed, definitions first; lines of documentation are only counted.
    """
    found = name_lines(chunks.select("chunk_id", "text"), "chunk_id", name).drop("in_file")
    rows = found.join(chunks.select("chunk_id", "path", "start_line", "symbol", "defines"), "chunk_id")
    first = F.min("line").over(Window.partitionBy("chunk_id"))
    rows = rows.withColumn("is_definition", F.array_contains("defines", name) & (F.col("line") == first)).withColumn("line", F.col("start_line") + F.col("line") - 1)
    order = Window.partitionBy("path").orderBy(F.desc("is_definition"), "line")
    before = F.coalesce(F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    listed = (F.row_number().over(order) <= per_file) & (before <= chars) & ~paths.is_prose(F.col("path"))
    return rows.select("path", "symbol", "line", "body", "is_definition", F.count("*").over(Window.partitionBy("path")).alias("in_file"), listed.alias("listed"))


def summary(found: DataFrame) -> DataFrame:
    """One row: files and lines that hold the name, those in documentation, and whether every line of code is listed."""
    prose = paths.is_prose(F.col("path"))
    return found.agg(
        F.countDistinct("path").alias("files"),
        F.count("*").alias("lines"),
        F.count_if(prose).alias("documentation"),
        F.count_if("is_definition").alias("definitions"),
        F.coalesce(F.bool_and(F.col("listed") | prose), F.lit(True)).alias("complete"),
    )
