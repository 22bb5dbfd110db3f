"""Words, terms, signals, paths and chunks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions import paths as P
from spanlens.functions import text as T
from spanlens.functions import vocab
from spanlens.operators import chunk as C
from spanlens.operators import index as I
from spanlens.plans import duck as D
from spanlens.plans.base import query, read
from spanlens.sources import tables as S

SMALL = C.ChunkConfig(2, 8, 5)


@query(f"SELECT doc_id, {D.words('text')} AS words FROM documents")
def words(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, {D.terms('text')} AS terms FROM documents")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.terms(F.col("text")).alias("terms"))


@query(f"WITH {D.POSTINGS} SELECT term, df FROM term_df")
def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return I.build(read(spark, sf, "documents"), "doc_id").term_df


@query(f"WITH {D.POSTINGS} SELECT doc_id, term, tf FROM postings")
def postings_capped(spark: SparkSession, sf: str) -> DataFrame:
    return I.postings(read(spark, sf, "documents"), "doc_id")


@query(f"SELECT item_id, {D.content_terms('text')} AS terms, len(list_distinct({D.content_terms('text')}))::BIGINT AS n FROM benchmark")
def content_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = T.content_terms(F.col("text"))
    return read(spark, sf, "benchmark").select("item_id", found.alias("terms"), F.size(F.array_distinct(found)).cast("long").alias("n"))


# No prompt of the driver's tables names code, so names and paths are put in front of them.
_PROMPT = "concat('Fix parse_config in src/', item_id, '/HashMap.rs, ', 'HttpServer::new() and load() of “', text, '”')"
_TOKENS = f"""list_filter(list_transform(string_split_regex({_PROMPT}, '\\s+'), lambda t: regexp_replace(regexp_replace(t, '^[^A-Za-z0-9_/.:()]+', ''), '[^A-Za-z0-9_/.:()]+$', '')), lambda t: t <> '')"""


@query(f"""
WITH t AS (SELECT item_id, unnest({_TOKENS}) AS tok FROM benchmark),
c AS (SELECT item_id, tok, regexp_replace(tok, '[,;).]+$', '') AS p, regexp_replace(tok, '[,;.]+$', '') AS core FROM t),
k AS (SELECT *, list_contains({D.in_list(vocab.PATH_EXTENSIONS)}, regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AND regexp_matches(string_split(p, '/')[-1], '^.+\\.[^.]*$') AS is_path FROM c),
i AS (SELECT item_id, core, unnest(string_split(core, '::')) AS part FROM k WHERE NOT is_path),
j AS (SELECT item_id, regexp_replace(part, '\\(\\)$', '') AS name FROM i WHERE regexp_matches(part, '^[A-Za-z_][A-Za-z0-9_]*\\(\\)$')
      OR (contains(core, '::') AND regexp_matches(part, '^[A-Za-z_][A-Za-z0-9_]*$'))
      OR (regexp_matches(part, '^[A-Za-z_][A-Za-z0-9_]*$') AND (contains(part, '_') OR (regexp_matches(part, '^.+[A-Z]') AND regexp_matches(part, '[a-z]')))))
SELECT b.item_id, coalesce(list_sort(list_distinct((SELECT list(name) FROM j WHERE j.item_id = b.item_id))), []) AS identifiers,
       coalesce(list_sort(list_distinct((SELECT list(p) FROM k WHERE is_path AND k.item_id = b.item_id))), []) AS paths FROM benchmark b""")
def prompt_signals(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.expr(_PROMPT)
    return read(spark, sf, "benchmark").select("item_id", T.explicit_identifiers(prompt).alias("identifiers"), T.path_mentions(prompt).alias("paths"))


# Prompts that lean on what came before, some of which name code: every third one names the same function and path.
FOLLOWING = """concat(CASE WHEN conv_id % 5 = 0 AND turn > 0 THEN 'and now' ELSE text END, CASE (conv_id + turn) % 3 WHEN 1 THEN ' it in parse_config of src/walk.rs' WHEN 2 THEN ' it' ELSE '' END)"""
FOLLOWS = f"""(len(list_distinct({D.content_terms(FOLLOWING)})) < 4 OR ((conv_id + turn) % 3 <> 1 AND list_has_any(list_transform({D.words(FOLLOWING)}, lambda w: lower(w)), {D.in_list(vocab.BACK_REFERENCES)})))"""


@query(f"SELECT conv_id, turn, {FOLLOWS} AS follow_up FROM conversations WHERE role = 'user'")
def follow_up(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.is_follow_up(F.expr(FOLLOWING)).alias("follow_up"))


_ASK = "concat(CASE turn % 4 WHEN 0 THEN 'Where is it used? ' WHEN 1 THEN 'Which tests? ' WHEN 2 THEN 'Find the call sites. ' ELSE '' END, text)"


@query(f"""
WITH w AS (SELECT conv_id, turn, {D.lower_words(_ASK)} AS w FROM conversations WHERE role = 'user'),
b AS (SELECT *, list_zip(w, w[2:]) AS pairs FROM w)
SELECT conv_id, turn, list_has_any(w, {D.in_list(vocab.TEST_WORDS)}) AS tests,
       list_has_any(w, {D.in_list(vocab.CALLER_WORDS)})
       OR len(list_filter(pairs, lambda p: (p[1] = 'call' AND p[2] IN ('site', 'sites')) OR (p[1] IN ('used', 'referenced') AND p[2] = 'by'))) > 0
       OR (list_contains(w, 'where') AND list_has_any(w, ['used', 'referenced'])) AS callers
FROM b""")
def follow_up_intent(spark: SparkSession, sf: str) -> DataFrame:
    ask = F.expr(_ASK)
    return read(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", T.asks_for_tests(ask).alias("tests"), T.asks_for_callers(ask).alias("callers"))


_DOC_ASK = "concat(CASE turn % 3 WHEN 0 THEN 'Update the README. ' WHEN 1 THEN 'documentations ' ELSE 'See ci/workflow ' END, text)"


@query(f"SELECT conv_id, turn, list_has_any({D.lower_words(_DOC_ASK)}, {D.in_list(vocab.NON_CODE_INTENT)}) AS non_code FROM conversations")
def non_code_intent(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", T.asks_for_non_code(F.expr(_DOC_ASK)).alias("non_code"))


@query(f"""SELECT conv_id, turn, octet_length(encode(trim(text, ' '))) < 3 OR starts_with(trim(text, ' '), '/') OR starts_with(trim(text, ' '), '#')
       OR len({D.terms("trim(text, ' ')")}) < 2 AS skipped FROM conversations""")
def skip_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", T.skip_prompt(F.col("text")).alias("skipped"))


_WRAPPED = "concat('Be efficient: answer with paths. ', replace(text, chr(10), ' '), chr(10), 'FILES: a comma-separated list')"
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({_WRAPPED}, '([.!?])(\\s|$)', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(f"""
WITH s AS (SELECT item_id, {_WRAPPED} AS prompt, array_to_string(list_filter({_SENTENCES}, lambda s: NOT (starts_with(lower(s), 'files:')
  OR {" OR ".join(f"contains(lower(s), '{m}')" for m in vocab.OUTPUT_FORMAT_MARKERS)})), ' ') AS kept FROM benchmark)
SELECT item_id, CASE WHEN len({D.content_terms('kept')}) = 0 THEN prompt ELSE kept END AS focus FROM s""")
def task_focus(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", T.task_focus(F.expr(_WRAPPED.replace("chr(10)", "'\\n'"))).alias("focus"))


_LINES = "CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END"


@query(f"""
WITH l AS (SELECT doc_id, unnest({_LINES}) AS body, generate_subscripts({_LINES}, 1) AS line FROM documents)
SELECT doc_id, line::INTEGER AS line, body, trim(body, ' ') = '' AS blank,
       coalesce(sum((trim(body, ' ') <> '')::INTEGER) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS nonblank_before
FROM l""")
def lines_index(spark: SparkSession, sf: str) -> DataFrame:
    return C.lines(read(spark, sf, "documents"), "doc_id")


@query(f"""
WITH d AS (SELECT doc_id, {_LINES} AS l FROM documents), s AS (
  SELECT doc_id, l, unnest(list_filter(range(0, greatest(len(l), 1), 6), lambda s: s = 0 OR s - 6 + 8 < len(l))) AS s FROM d WHERE len(l) > 0)
SELECT doc_id, (s + 1)::INTEGER AS start_line, least(s + 8, len(l))::INTEGER AS end_line FROM s
WHERE len(list_filter(l[s + 1:s + 8], lambda x: trim(x, ' ') <> '')) > 0""")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.sliding(read(spark, sf, "documents"), "doc_id", size=8, stride=6)


CHUNKS_SQL = f"""
lines AS (SELECT doc_id, {_LINES} AS l FROM documents),
flags AS (SELECT doc_id, len(l) AS n, list_transform(l, lambda x: trim(x, ' ') = '') AS b FROM lines WHERE len(l) > 0),
chain(doc_id, k, s, e, n, b) AS (
  SELECT doc_id, 0, s, list_max(list_filter(range(s, CASE WHEN s + 4 >= n - 1 THEN n ELSE coalesce(list_max(list_filter(range(s + 2, s + 6), lambda q: q < n AND b[q + 1])), s + 5) END), lambda q: NOT b[q + 1])), n, b
  FROM (SELECT doc_id, n, b, list_min(list_filter(range(0, n), lambda q: NOT b[q + 1])) AS s FROM flags) WHERE s IS NOT NULL
  UNION ALL
  SELECT doc_id, k + 1, s2, list_max(list_filter(range(s2, CASE WHEN s2 + 4 >= n - 1 THEN n ELSE coalesce(list_max(list_filter(range(s2 + 2, s2 + 6), lambda q: q < n AND b[q + 1])), s2 + 5) END), lambda q: NOT b[q + 1])), n, b
  FROM (SELECT doc_id, k, n, b, list_min(list_filter(range(e + 1, n), lambda q: NOT b[q + 1])) AS s2 FROM chain) WHERE s2 IS NOT NULL
),
found AS (SELECT doc_id, list({{'s': s, 'e': e}} ORDER BY k) AS f FROM chain GROUP BY doc_id),
fold(doc_id, k, pend, out, f) AS (
  SELECT doc_id, 0, -1::BIGINT, []::STRUCT(s BIGINT, e BIGINT)[], f FROM found
  UNION ALL
  SELECT doc_id, k + 1,
    CASE WHEN NOT whole AND NOT back AND ahead THEN st ELSE -1 END,
    CASE WHEN whole THEN list_append(out, {{'s': st, 'e': en}}) WHEN back THEN list_append(out[:-2], {{'s': out[-1].s, 'e': en}}) WHEN ahead THEN out ELSE list_append(out, {{'s': st, 'e': en}}) END, f
  FROM (SELECT *, en - st + 1 >= 2 AS whole, len(out) > 0 AND en - out[-1].s + 1 <= 8 AS back, k + 1 < len(f) AND f[k + 2].e - st + 1 <= 8 AS ahead
        FROM (SELECT *, CASE WHEN pend >= 0 THEN pend ELSE f[k + 1].s END AS st, f[k + 1].e AS en FROM fold WHERE k < len(f)))
),
chunks AS (SELECT doc_id, (w.s + 1)::INTEGER AS start_line, (w.e + 1)::INTEGER AS end_line FROM (SELECT doc_id, unnest(out) AS w FROM fold WHERE k = len(f)))"""


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, start_line, end_line FROM chunks")
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_text(read(spark, sf, "documents"), "doc_id", cfg=SMALL).drop("chunk")


_MARKED = "regexp_replace(text, '\\n([^\\n]{1,12})\\n', concat(chr(10), '## ', chr(92), '1', chr(10)), 'g')"


@query(f"""
WITH d AS (SELECT doc_id, {_MARKED} AS text FROM documents), l AS (SELECT doc_id, unnest({_LINES}) AS body, generate_subscripts({_LINES}, 1) AS line FROM d),
h AS (SELECT doc_id, line, CASE WHEN regexp_matches(trim(body, ' '), '^#{{1,6}} ') THEN trim(regexp_replace(trim(body, ' '), '^#{{1,6}} ', ''), ' ') END AS h FROM l)
SELECT doc_id, line::INTEGER AS line, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM h""")
def heading_ffill(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.regexp_replace("text", "\\n([^\\n]{1,12})\\n", "\n## $1\n")
    docs = read(spark, sf, "documents").select("doc_id", marked.alias("text"))
    return C.headings(C.lines(docs, "doc_id"), "doc_id").select("doc_id", "line", "heading")


# Page paths end in .html or a number; names are put around them so that every rule has rows.
_PATH = """CASE page_id % 7 WHEN 0 THEN regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) WHEN 1 THEN concat('src/', page_id, '/main_test.py') WHEN 2 THEN concat('node_modules/', page_id, '.js')
 WHEN 3 THEN concat('docs/README') WHEN 4 THEN concat('a/', page_id, '.min.js') WHEN 5 THEN concat('tests/x', page_id, '.rs') ELSE concat(page_id, '/Cargo.lock') END"""
_NAME = "lower(string_split(path, '/')[-1])"
_EXT = "string_split(lower(string_split(path, '/')[-1]), '.')[-1]"
_BY_EXT = " ".join(f"WHEN {_EXT} IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in reversed(vocab.EXTENSIONS.items()))
_BY_NAME = " ".join(f"WHEN {_NAME} IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in vocab.BARE_NAMES.items())


def _page_paths(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.expr(_PATH).alias("path"))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), c AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM p)
SELECT page_id, path, CASE WHEN len(parts) = 0 OR list_has_any(parts[:-2], {D.in_list(vocab.SKIP_DIRS)}) OR {_NAME} IN ({', '.join(repr(f) for f in vocab.SKIP_FILES)}) OR {_NAME} LIKE '%.lock'
  OR {_NAME} = '.env' OR {_NAME} LIKE '.env.%' OR {_NAME} LIKE '%.env' OR contains({_NAME}, '.min.') OR {_NAME} LIKE '%.map' OR {_NAME} LIKE '%.bundle.js' THEN NULL
  ELSE coalesce(CASE WHEN regexp_matches({_NAME}, '^.+\\.') THEN CASE {_BY_EXT} END END, CASE {_BY_NAME} END) END AS lang FROM c""")
def path_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _page_paths(spark, sf).withColumn("lang", P.language(F.col("path")))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, list_has_any(list_transform(string_split(path, '/')[:-2], lambda d: lower(d)), {D.in_list(vocab.TEST_DIRS)})
  OR regexp_matches(string_split(path, '/')[-1], '^tests\\.[a-z]+$|^test_.*\\.py$|({"|".join(e.replace(".", chr(92) + ".") for e in vocab.TEST_STEM_ENDS)})\\.[a-z]+$') AS is_test FROM p""")
def test_path(spark: SparkSession, sf: str) -> DataFrame:
    return _page_paths(spark, sf).select("page_id", P.is_test(F.col("path")).alias("is_test"))


@query(f"""
WITH p AS (SELECT page_id, concat({_PATH}, CASE page_id % 5 WHEN 0 THEN '/tests/a.rs' WHEN 1 THEN '/test_b.py' WHEN 2 THEN '/c.spec.ts' WHEN 3 THEN '/Spec' ELSE '' END) AS path FROM pages)
SELECT page_id, regexp_matches(path, '(^|/)(tests?|__tests__)/') OR starts_with(string_split(path, '/')[-1], 'test_') OR regexp_matches(string_split(path, '/')[-1], '(_test|\\.test|\\.spec)\\.[a-z]+$') AS by_task,
  regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)(/|$)|(^|/)test_[^/]*$|_test\\.\\w+$|\\.(test|spec)\\.\\w+$|(^|/)tests?\\.rs$') AS by_lookup FROM p""")
def test_path_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """The two other definitions of a test path, for tasks and for lookups."""
    more = F.expr("CASE page_id % 5 WHEN 0 THEN '/tests/a.rs' WHEN 1 THEN '/test_b.py' WHEN 2 THEN '/c.spec.ts' WHEN 3 THEN '/Spec' ELSE '' END")
    path = F.concat(F.col("path"), more)
    return _page_paths(spark, sf).select("page_id", P.is_test_task(path).alias("by_task"), P.is_test_lookup(path).alias("by_lookup"))


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
SELECT page_id, CASE WHEN contains({_NAME}, '.') THEN {_EXT} IN ({', '.join(repr(e) for e in vocab.PROSE_EXTENSIONS)}) ELSE {_NAME} IN ({', '.join(repr(e) for e in vocab.PROSE_NAMES)}) END AS is_prose FROM p""")
def prose_path(spark: SparkSession, sf: str) -> DataFrame:
    return _page_paths(spark, sf).select("page_id", P.is_prose(F.col("path")).alias("is_prose"))


@query("""
WITH s AS (SELECT * FROM (VALUES ('src1'), ('src1/en'), ('src2/fr/25.md')) v(scope))
SELECT scope, doc_id FROM documents, s WHERE concat(source, '/', lang, '/', doc_id, '.md') = scope OR starts_with(concat(source, '/', lang, '/', doc_id, '.md'), concat(scope, '/'))""")
def in_scope(spark: SparkSession, sf: str) -> DataFrame:
    scopes = spark.createDataFrame([("src1",), ("src1/en",), ("src2/fr/25.md",)], "scope string")
    return S.files(spark, sf).join(F.broadcast(scopes), P.in_scope(F.col("path"), F.col("scope"))).select("scope", "doc_id")  # three rows


@query("""
WITH m AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN concat(item_id, '.md') WHEN 1 THEN concat('en/', item_id, '.md') ELSE concat('src2/en/', item_id, '.md') END AS mention FROM benchmark),
f AS (SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.md') AS path FROM documents)
SELECT item_id, doc_id FROM m, f WHERE path = mention OR ends_with(path, concat('/', mention)) OR (NOT contains(mention, '/') AND string_split(path, '/')[-1] = mention)""")
def path_suffix_join(spark: SparkSession, sf: str) -> DataFrame:
    mention = F.expr("CASE item_id % 3 WHEN 0 THEN concat(item_id, '.md') WHEN 1 THEN concat('en/', item_id, '.md') ELSE concat('src2/en/', item_id, '.md') END")
    asked = read(spark, sf, "benchmark").select("item_id", mention.alias("mention"), F.element_at(F.split(mention, "/"), -1).alias("base"))
    files = S.files(spark, sf).withColumn("base", F.element_at(F.split("path", "/"), -1))
    # All kinds of mention agree in the base name: an equi-join first, the rest as a filter.
    return files.join(asked, "base").filter(P.mentions(F.col("path"), F.col("mention"))).select("item_id", "doc_id")


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("""
SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: octet_length(encode(x)))) > 2000
  OR (octet_length(encode(text)) > 4000 AND octet_length(encode(text)) // greatest(len(string_split(text, chr(10))) - ends_with(text, chr(10))::INTEGER, 1) > 300) AS minified FROM documents""")
def looks_minified(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.looks_minified(F.col("text"), 2000, 4000, 300).alias("minified"))


@query("""
SELECT page_id, CASE WHEN octet_length(encode(html)) > 6000 THEN 'too large' WHEN contains(html, '$$$') THEN 'binary'
  WHEN list_max(list_transform(string_split(html, chr(10)), lambda x: octet_length(encode(x)))) > 5000 THEN 'minified' END AS error FROM pages""")
def doc_guard(spark: SparkSession, sf: str) -> DataFrame:
    from spanlens.sources.files import guard

    return read(spark, sf, "pages").select("page_id", guard(F.col("html").cast("binary"), max_bytes=6_000, marker="$$$").alias("error"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT item_id, list_transform(list_zip({D.lower_words('text')}, {D.lower_words('text')}[2:]), lambda p: p[1] || ' ' || p[2])[:-2] AS pairs FROM benchmark")
def bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", F.transform(T.bigrams(T.lower_words(F.col("text"))), lambda p: F.concat_ws(" ", p["a"], p["b"])).alias("pairs"))


@query("SELECT doc_id, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS fold FROM documents")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.hash_split(F.col("doc_id")).alias("fold"))


_SUBJECT = "concat(CASE item_id % 3 WHEN 0 THEN 'fix(core): ' WHEN 1 THEN 'feat!: ' ELSE '' END, regexp_extract(text, '^[^.\\n]*', 0), ' (#', item_id, ')')"


@query(f"SELECT item_id, trim(regexp_replace(trim(regexp_replace(trim({_SUBJECT}, ' '), '^[a-z]+(\\([^)]*\\))?!?: *', ''), ' '), ' *\\(#[0-9]+\\)$', ''), ' ') AS subject FROM benchmark")
def clean_subject(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", T.clean_subject(F.expr(_SUBJECT.replace("\\n", "\\\\n"))).alias("subject"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_''`@\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS task FROM benchmark")
def normalise_task(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select("item_id", T.normalise_task(F.col("text")).alias("task"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id, line::INTEGER AS line, body FROM l WHERE contains(body, 'th') AND regexp_matches(body, '(^|[^A-Za-z0-9$])th([^a-z0-9$]|$)')""")
def has_name(spark: SparkSession, sf: str) -> DataFrame:
    return C.lines(read(spark, sf, "documents"), "doc_id").filter(T.has_name(F.col("body"), "th")).select("doc_id", "line", "body")


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])and([^A-Za-z0-9_]|$)') AS found FROM documents")
def contains_word(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.contains_word(F.col("text"), "and").alias("found"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
s AS (SELECT *, CASE WHEN length(body) <= 100 THEN 0 ELSE least(greatest(instr(body, 'the') - 41, 0), greatest(length(body) - 100, 0)) END AS st FROM l WHERE contains(body, 'the'))
SELECT doc_id, line::INTEGER AS line, concat(CASE WHEN st > 0 THEN '…' ELSE '' END, substr(body, st + 1, 100), CASE WHEN st + 100 < length(body) THEN '…' ELSE '' END) AS excerpt FROM s""")
def match_excerpt(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.lines(read(spark, sf, "documents"), "doc_id").filter(F.contains("body", F.lit("the")))
    return rows.select("doc_id", "line", T.match_excerpt(F.col("body"), F.lit("the")).alias("excerpt"))


_SYMBOL = "concat(source, ' > ', lang, ' > pub fn ', replace(substr(text, 1, 60), chr(10), ' '))"


@query(f"""
WITH s AS (SELECT doc_id, regexp_replace(string_split({_SYMBOL}, ' > ')[-1], '^((pub|async|export|default|static|public|private|fn|def|class|struct|enum|trait|impl|function|interface|type) )+', '') AS b FROM documents)
SELECT doc_id, trim(CASE WHEN length(b) > 40 THEN regexp_replace(substr(b, 1, 40), ' [^ ]*$', '') ELSE b END, ' ') AS symbol FROM s""")
def short_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.short_symbol(F.expr(_SYMBOL.replace("chr(10)", "'\\n'"))).alias("symbol"))


@query("""WITH s AS (SELECT doc_id, concat('file: ', source, '/', lang, '/', doc_id, '.md (lines 1-', len(string_split(text, chr(10))), ')', chr(10), text) AS state FROM documents),
t AS (SELECT doc_id, state, list_filter(string_split_regex(state, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM s)
SELECT doc_id, CASE WHEN len(ws) <= 256 THEN state ELSE regexp_extract(state, '^(?:[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]+){256}') END AS state FROM t""")
def render_state(spark: SparkSession, sf: str) -> DataFrame:
    state = F.concat(F.lit("file: "), F.col("path"), F.lit(" (lines 1-"), F.size(F.split("text", "\n")).cast("string"), F.lit(")\n"), F.col("text"))
    # The window is the scorer's, 256 tokens with the header; a token is a run of no blanks. A state within it stays as it is.
    window = F.regexp_extract(state, r"^(?:\s*+\S++){0,256}+(?:\s*+\z)?", 0)
    return S.files(spark, sf).select("doc_id", window.alias("state"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE NOT json_valid(CASE event_id % 5 WHEN 0 THEN substr(props, 2) ELSE props END)) AS bad FROM events GROUP BY 1")
def bad_json_count(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").withColumn("line", F.expr("CASE event_id % 5 WHEN 0 THEN substr(props, 2) ELSE props END"))
    bad = F.from_json("line", "k bigint, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch_us(ts) // 1000000 AS epoch FROM events")
def utc_format(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.expr("cast(ts as timestamp)").cast("long").alias("epoch"))


@query("SELECT user_id, event_type AS tool, count(*) AS calls FROM events GROUP BY 1, 2")
def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    per_day = read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    maps = per_day.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("calls"))
    return maps.select("user_id", F.explode("calls").alias("tool", "n")).groupBy("user_id", "tool").agg(F.sum("n").alias("calls"))

