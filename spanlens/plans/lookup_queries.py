"""Lookups of many names at once and what they say: documents are files of six-line chunks, benchmark items name two of their words each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators import answer, expand, lookup
from spanlens.plans.base import query, read
from spanlens.sources.store import stored

_WORD = "[A-Za-z]{4,}"
_PATH = "concat(CASE WHEN doc_id % 4 = 0 THEN 'tests/' ELSE '' END, source, '/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.rs' END)"

_FOUND = f"""w AS (SELECT item_id, list_slice(regexp_extract_all(text, '{_WORD}'), 1, 2) AS names FROM benchmark), names AS (SELECT DISTINCT item_id, unnest(names) AS name FROM w),
l AS (SELECT doc_id, {_PATH} AS path, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT *, (line - 1) // 6 AS k FROM l), c AS (SELECT doc_id, k, regexp_extract(string_agg(body, chr(10) ORDER BY line), '{_WORD}') AS defines FROM k GROUP BY 1, 2),
m AS (SELECT item_id, name, doc_id, path, line, k, body, min(line) OVER (PARTITION BY item_id, name, doc_id, k) AS first FROM k JOIN names ON contains(body, name)
 AND regexp_matches(body, concat(CASE WHEN regexp_matches(name, '^[A-Z]') THEN '(^|[^$])' ELSE '(^|[^A-Za-z0-9$])' END, name, CASE WHEN regexp_matches(name, '[A-Z]$') THEN '([^A-Za-z0-9$]|$)' ELSE '([^a-z0-9$]|$)' END))),
found AS (SELECT item_id, path, CASE WHEN k % 4 = 0 THEN '' ELSE concat('fn part', k // 2) END AS symbol, line::INTEGER AS line, body, list_sort(list(name)) AS names, bool_or(name = defines AND line = first) AS is_definition
 FROM m JOIN c USING (doc_id, k) GROUP BY item_id, path, k, line, body)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, path, start_line, symbol, defines, text): six lines each; a chunk defines its first word of four letters."""
    docs = read(spark, sf, "documents").select(F.expr("concat(CASE WHEN doc_id % 4 = 0 THEN 'tests/' ELSE '' END, source, '/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.rs' END)").alias("path"), F.split("text", "\n").alias("ls"))
    starts = F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 6))
    rows = docs.select("path", F.explode(F.transform(starts, lambda k: F.struct(k.alias("k"), F.array_join(F.slice("ls", (k * 6 + 1).cast("int"), 6), "\n").alias("text")))).alias("c"))
    k, text = F.col("c.k"), F.col("c.text")
    symbol = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("fn part"), F.floor(k / 2).cast("string")))
    return rows.select(F.concat_ws("#", "path", k.cast("string")).alias("chunk_id"), "path", (k * 6 + 1).alias("start_line"), symbol.alias("symbol"), F.array(F.regexp_extract(text, f"({_WORD})", 1)).alias("defines"), text.alias("text"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.slice(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), 1, 2).alias("names"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    names = _asked(spark, sf).select("item_id", F.explode("names").alias("name"))
    return lookup.reports(_chunks(spark, sf), names, "item_id").withColumn("line", F.col("line").cast("int"))


@query(f"WITH {_FOUND} SELECT item_id, path, symbol, line, names, is_definition FROM found")
def lookup_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every line that holds a name of any item, in one pass over the documents."""
    return _found(spark, sf).select("item_id", "path", "symbol", "line", "names", "is_definition")


def _within(label: str, source: str, room: str) -> str:
    """SELECT (item_id, said) of items (item_id, place, item, n_all, room) within a room."""
    return f"""(SELECT item_id, concat('{label}', coalesce(string_agg(item, ', ' ORDER BY k) FILTER (WHERE cut IS NULL OR k < cut), ''), CASE WHEN any_value(cut) IS NULL THEN '.' ELSE concat(CASE WHEN any_value(cut) > 0 THEN ', ' ELSE '' END, 'and ', any_value(n_all) - any_value(cut), ' more files.') END, chr(10)) AS said
 FROM (SELECT *, min(CASE WHEN {len(label)} + before + strlen(item) + 6 + strlen(concat('and ', n_all - k, ' more files.')) > {room} THEN k END) OVER (PARTITION BY item_id) AS cut
  FROM (SELECT *, row_number() OVER o - 1 AS k, coalesce(sum(strlen(item) + 2) OVER (PARTITION BY item_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2, 0) AS before FROM {source} WINDOW o AS (PARTITION BY item_id ORDER BY place))) GROUP BY item_id)"""


_BUDGET = answer.MOST - answer.SUMMARY - answer.TAIL

# The documents of this table that are prose all end in .md, tests lie in a folder of that name.
_ANSWER = f"""{_FOUND}, f0 AS (SELECT item_id, path, count(*) AS n, path LIKE '%.md' AS prose, path LIKE 'tests/%' AS test FROM found GROUP BY 1, 2),
t AS (SELECT item_id, count(*) AS files, sum(n)::BIGINT AS lines, count(*) FILTER (WHERE test) AS tests, coalesce(sum(n) FILTER (WHERE NOT prose), 0)::BIGINT AS code_lines, count(*) FILTER (WHERE prose) AS docs FROM f0 GROUP BY 1),
f AS (SELECT f0.*, t.* EXCLUDE (item_id), row_number() OVER (PARTITION BY item_id, prose ORDER BY n DESC, path) AS place, NOT prose OR docs = files AS listed FROM f0 JOIN t USING (item_id)),
u AS (SELECT g.*, f.place, row_number() OVER i AS nth, CASE WHEN symbol = lag(symbol) OVER i THEN 0 ELSE 1 END AS fresh, substr(trim(body, ' '), 1, 100) AS text FROM found g JOIN f USING (item_id, path) WHERE listed WINDOW i AS (PARTITION BY item_id, path ORDER BY line)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, path ORDER BY line) AS grp FROM u),
x AS (SELECT *, replace(symbol, 'fn ', '') AS short, count(*) OVER g AS size, row_number() OVER (PARTITION BY item_id, path, grp ORDER BY line) AS kk, first_value(text) OVER (PARTITION BY item_id, path, grp ORDER BY line) AS head FROM v WINDOW g AS (PARTITION BY item_id, path, grp)),
y AS (SELECT *, short = '' AS flat, short <> '' AND contains(head, short) AS opens FROM x),
said AS (SELECT item_id, path, place, nth, concat(CASE WHEN NOT flat AND size > 1 AND NOT opens AND kk = 1 THEN concat(' ‹', short, '›', chr(10)) ELSE '' END, CASE WHEN flat OR size = 1 OR (opens AND kk = 1) THEN ' ' ELSE '  ' END, line, ': ', text,
  CASE WHEN is_definition THEN ' [def]' ELSE '' END, CASE WHEN NOT flat AND size = 1 AND NOT opens THEN concat(' ‹', short, '›') ELSE '' END, chr(10)) AS said FROM y WHERE nth <= {answer.FILE_LINES}
 UNION ALL SELECT item_id, path, place, 0, concat(path, CASE WHEN test THEN ' (test)' ELSE '' END, chr(10)) FROM f WHERE listed),
b AS (SELECT * FROM (SELECT *, sum(strlen(said)) OVER (PARTITION BY item_id ORDER BY place, nth ROWS UNBOUNDED PRECEDING) AS used FROM said) WHERE used <= {_BUDGET}),
body AS (SELECT item_id, string_agg(said, '' ORDER BY place, nth) AS body, count(*) FILTER (WHERE nth > 0) AS shown FROM b GROUP BY 1), s AS (SELECT item_id, path, count(*) AS shown FROM b WHERE nth > 0 GROUP BY 1, 2),
h0 AS (SELECT f.*, coalesce(s.shown, 0) AS shown FROM f LEFT JOIN s USING (item_id, path) WHERE listed), h AS (SELECT item_id, place, CASE WHEN shown = 0 THEN concat(path, ' (', n, ')') ELSE concat(path, ' (', shown, ' of ', n, ' shown)') END AS item, count(*) OVER (PARTITION BY item_id) AS n_all FROM h0 WHERE shown < n),
hidden AS {_within('Not shown: ', 'h', str(answer.TAIL))},
d AS (SELECT f.item_id, place, concat(path, ' (', n, ')') AS item, docs AS n_all, {answer.TAIL} - coalesce(strlen(hidden.said), 0) AS room FROM f LEFT JOIN hidden USING (item_id) WHERE NOT listed),
counted AS {_within('Docs: ', 'd', 'room')},
r AS (SELECT w.item_id, concat('`', array_to_string(w.names, '|'), '`') AS nm, t.* EXCLUDE (item_id), coalesce(body.shown, 0) AS shown, body.body, hidden.said AS hid, counted.said AS doc, (SELECT count(*) FROM documents) AS files_read, coalesce(docs > 0 AND docs < files, false) AS with_docs
 FROM w LEFT JOIN t USING (item_id) LEFT JOIN body USING (item_id) LEFT JOIN hidden USING (item_id) LEFT JOIN counted USING (item_id))
SELECT item_id, CASE WHEN files IS NULL THEN concat('No match for ', nm, ' in the ', files_read, ' files read.', chr(10)) ELSE concat(nm, ': ', lines, ' lines in ', files, ' files', CASE tests WHEN 0 THEN '' WHEN 1 THEN ' (1 test)' ELSE concat(' (', tests, ' tests)') END, ' of ', files_read, ' files read',
 CASE WHEN shown = CASE WHEN with_docs THEN code_lines ELSE lines END THEN CASE WHEN with_docs THEN concat('; complete, docs counted.', chr(10)) ELSE concat('; complete.', chr(10)) END ELSE concat('; first ', shown, ' shown, the rest counted below.', chr(10)) END, coalesce(body, ''), coalesce(hid, ''), coalesce(doc, '')) END AS answer,
 shown, coalesce(shown = CASE WHEN with_docs THEN code_lines ELSE lines END, true) AS complete FROM r"""


@query(f"WITH {_ANSWER}")
def lookup_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What each item's lookup says, within 6,000 bytes."""
    found = stored(_found(spark, sf).withColumn("text", F.substring(F.trim("body"), 1, 100)).drop("names", "body"), "found")
    return answer.render(found, _asked(spark, sf), read(spark, sf, "documents").count(), "item_id")


_ITEM = "{'nth': nth, 'kind': kind, 'ord': ord, 'path': path, 'line': line, 'text': text, 'ident': ident, 'nd': nd, 'nu': nu}"


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, {_PATH} AS path, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT *, (line - 1) // 6 AS k FROM l), c AS (SELECT concat(path, '#', k) AS chunk_id, path, (k * 6 + 1)::INTEGER AS start_line, string_agg(body, chr(10) ORDER BY line) AS text FROM k GROUP BY path, k),
e AS (SELECT chunk_id, regexp_extract_all(text, '{_WORD}') AS ws FROM c), rf AS (SELECT DISTINCT unnest(ws[2:]) AS ident, chunk_id FROM e), df AS (SELECT ws[1] AS ident, chunk_id FROM e WHERE len(ws) > 0),
a0 AS (SELECT item_id, regexp_extract_all(text, '{_WORD}') AS ws FROM benchmark), a1 AS (SELECT item_id, unnest(ws) AS ident, generate_subscripts(ws, 1) AS pl FROM a0), a2 AS (SELECT item_id, ident, min(pl) AS pl FROM a1 GROUP BY 1, 2),
names AS (SELECT * FROM (SELECT item_id, ident, (row_number() OVER (PARTITION BY item_id ORDER BY pl) - 1)::INTEGER AS nth FROM a2) WHERE nth < 6), q AS (SELECT DISTINCT ident FROM names),
b AS (SELECT ident, chunk_id, 0 AS kind, row_number() OVER (PARTITION BY ident ORDER BY chunk_id) AS ord FROM df SEMI JOIN q USING (ident) QUALIFY ord <= 4 UNION ALL SELECT ident, chunk_id, 1, row_number() OVER (PARTITION BY ident ORDER BY chunk_id) AS ord FROM rf SEMI JOIN q USING (ident) QUALIFY ord <= 8),
n AS (SELECT ident, count(*) FILTER (WHERE kind = 0) AS nd, count(*) FILTER (WHERE kind = 1) AS nu FROM b GROUP BY 1 HAVING count(*) FILTER (WHERE kind = 0) <= 3),
h AS (SELECT b.*, nd, nu, path, start_line, string_split(text, chr(10)) AS ls, list_position(list_transform(string_split(text, chr(10)), lambda x: regexp_matches(x, concat('(^|[^A-Za-z0-9_])', ident, '([^A-Za-z0-9_]|$)'))), true) AS pl FROM b JOIN n USING (ident) JOIN c USING (chunk_id)),
i AS (SELECT item_id, nth, ident, kind, ord, nd, nu, path, CASE WHEN pl > 0 THEN (start_line + pl - 1)::INTEGER END AS line, CASE WHEN pl > 0 THEN substr(trim(ls[pl], ' '), 1, 120) END AS text FROM names JOIN h USING (ident)),
x AS (SELECT item_id, list({_ITEM} ORDER BY nth, kind, ord) AS xs FROM i GROUP BY 1),
w(item_id, k, outs, shown, listed, xs) AS (SELECT item_id, 0, xs[1:0], []::INTEGER[], 0, xs FROM x UNION ALL
 SELECT item_id, k + 1, CASE WHEN goes AND fresh THEN list_append(outs, xs[k + 1]) ELSE outs END, CASE WHEN goes THEN list_append(shown, xs[k + 1].nth) ELSE shown END, had + (goes AND fresh)::INTEGER, xs
 FROM (SELECT *, had < 4 AND len(outs) < 10 AND xs[k + 1].line IS NOT NULL AS goes, len(list_filter(outs, lambda y: y.path = xs[k + 1].path AND y.line = xs[k + 1].line)) = 0 AS fresh
  FROM (SELECT *, CASE WHEN k > 0 AND xs[k].nth = xs[k + 1].nth THEN listed ELSE 0 END AS had FROM w WHERE k < len(xs)))),
o AS (SELECT item_id, shown, unnest(outs) AS y, generate_subscripts(outs, 1) - 1 AS place FROM w WHERE k = len(xs))
SELECT item_id, place::INTEGER AS place, y.path AS path, y.line AS line, y.text AS text, concat(CASE WHEN y.kind = 0 THEN 'definition of `' ELSE 'use of `' END, y.ident, '`',
 CASE WHEN y.kind = 0 AND y.nu < 8 AND len(list_filter(shown, lambda s: s = y.nth)) = y.nd + y.nu THEN ' (all indexed uses shown)' ELSE '' END) AS relation FROM o""")
def usage_list(spark: SparkSession, sf: str) -> DataFrame:
    """Where the names of each item are defined and used, as far as the list goes."""
    words = F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))
    chunks = stored(_chunks(spark, sf).withColumn("ws", words), "chunks")
    asked = read(spark, sf, "benchmark").select("item_id", F.posexplode(F.array_distinct(words)).alias("nth", "ident"))
    defs = chunks.filter(F.size("ws") > 0).select(F.element_at("ws", 1).alias("ident"), "chunk_id")
    refs = chunks.select(F.explode(F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0)))).alias("ident"), "chunk_id")
    return expand.usage_list(asked, defs, refs, chunks, "item_id")
