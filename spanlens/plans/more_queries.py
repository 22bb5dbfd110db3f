"""Sources, patterns, reports and the remaining analytics."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions import patterns
from spanlens.functions import text as T
from spanlens.operators import ast_chunk, chunk, evalx, folds, leakage, retrieve, session, shape, transcript
from spanlens.operators import index as I
from spanlens.operators.score import LexicalScorer
from spanlens.plans import duck as D
from spanlens.plans.base import query, read
from spanlens.plans.retrieval_queries import _GOLD, _RETRIEVAL, _bm25, _gold, _index
from spanlens.plans.text_queries import CHUNKS_SQL, SMALL
from spanlens.sources import commits
from spanlens.sources import files as source_files_of
from spanlens.sources import tables as S


@query(f"""WITH {_GOLD}, g AS (SELECT item_id, count(*) AS golds FROM gold GROUP BY 1)
SELECT item_id, golds, regexp_extract(text, '^[^.]*', 0) AS subject FROM benchmark JOIN g USING (item_id) WHERE golds BETWEEN 1 AND 4 AND length(regexp_extract(text, '^[^.]*', 0)) >= 25""")
def make_tasks(spark: SparkSession, sf: str) -> DataFrame:
    golds = _gold(spark, sf).groupBy("item_id").agg(F.count("*").alias("golds")).filter("golds between 1 and 4")
    named = read(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", "^[^.]*", 0).alias("subject")).filter(F.length("subject") >= 25)
    return named.join(golds, "item_id").select("item_id", "golds", "subject")


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, start_line, end_line FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE concat(source, '/', lang) = 'src1/en')")
def chunks_of_file(spark: SparkSession, sf: str) -> DataFrame:
    files = S.files(spark, sf).filter(F.col("path").startswith("src1/en/"))
    return chunk.chunk_text(files, "doc_id", cfg=SMALL).select("doc_id", "start_line", "end_line")


_GLOBS = ["src1*/{en,fr}/**", "!**/1*.md"]


@query(f"""WITH f AS (SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.md') AS path FROM documents)
SELECT doc_id FROM f WHERE regexp_matches(path, '^src1[^/]*/(en|fr)/') AND NOT regexp_matches(path, '(^|/)1[^/]*\\.md$')""")
def glob_scope(spark: SparkSession, sf: str) -> DataFrame:
    return S.files(spark, sf).filter(patterns.in_globs(F.col("path"), _GLOBS)).select("doc_id")


_PATTERN = "CASE item_id % 4 WHEN 0 THEN concat('fn\\\\s+load_', item_id, '|struct Walker') WHEN 1 THEN concat('\\\\bname', item_id, '\\\\b') WHEN 2 THEN '(a|b)c|foo.*bar' ELSE 'class Foo\\\\(' END"


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN [concat('load_', item_id), 'Walker'] WHEN 1 THEN [concat('name', item_id)] WHEN 2 THEN []::VARCHAR[] ELSE ['Foo'] END AS names FROM benchmark""")
def pattern_idents(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "benchmark").select("item_id", F.expr(_PATTERN).alias("pattern"))
    return patterns.analyse(rows, "pattern").select("item_id", "names")


_SHAPED = "CASE item_id % 5 WHEN 0 THEN 'fn\\\\s+walk|struct Tree' WHEN 1 THEN 'walk' WHEN 2 THEN 'src/walk.rs: .*' WHEN 3 THEN 'a|b.*c' ELSE '--dry-run\\\\b' END"


@query("""SELECT item_id, item_id % 5 = 0 AS defining, item_id % 5 IN (0, 1) AS named, CASE item_id % 5 WHEN 2 THEN ['src/walk.rs'] WHEN 4 THEN ['--dry-run'] ELSE []::VARCHAR[] END AS literals FROM benchmark""")
def pattern_shapes(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "benchmark").select("item_id", F.expr(_SHAPED).alias("pattern"))
    return patterns.analyse(rows, "pattern").select("item_id", "defining", "named", "literals")


@query("""WITH l AS (SELECT l_orderkey AS f, l_linenumber AS n, min(l_suppkey % 5) AS indent FROM lineitem GROUP BY 1, 2), t AS (SELECT f, max(n) AS n FROM l GROUP BY 1)
SELECT a.f, a.n AS line, a.indent FROM l a JOIN t ON a.f = t.f AND a.n < t.n WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.f = a.f AND b.n > a.n AND b.indent <= a.indent)""")
def indent_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("line")).agg(F.min(F.col("l_suppkey") % 5).alias("indent"))
    return shape.indent_ancestors(rows, "f")


_DIFF = "concat('--- a/f', item_id, '.rs', '\\n', '+++ b/f', item_id, '.rs', '\\n', '@@ -', item_id + 3, ',', item_id % 3, ' +', item_id + 4, ',2 @@', '\\n', '+x', '\\n', '@@ -90 +91,0 @@')"


@query("""SELECT concat('f', item_id, '.rs') AS path, unnest(list_sort(list_distinct(list_concat(CASE item_id % 3 WHEN 0 THEN [item_id + 3, item_id + 4] ELSE range(item_id + 3, item_id + 3 + item_id % 3) END, [90]))))::BIGINT AS line FROM benchmark""")
def diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    return commits.changed_lines(read(spark, sf, "benchmark").select(F.expr(_DIFF).alias("d")), "d")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    n = F.expr("cast(floor(o_totalprice / 1000) as bigint)")
    return read(spark, sf, "orders").select(F.col("o_custkey").alias("task"), n.alias("size"), F.expr("cast(floor(o_totalprice * 7 / 1000) as bigint) % 97").alias("gain"), (F.col("o_orderkey") % 5).alias("uses"), F.col("o_orderkey").alias("at"))


_HEURISTIC_ORDER = {"shortest": "size, place", "longest": "-size, place", "best": "-gain, size, place", "densest": "-gain / greatest(size, 1)::DOUBLE, place", "most_used": "-uses, size, place", "in_order": "place"}
_FILLED = ", ".join(
    f"w_{h}(task, k, taken, used, gain, us) AS (SELECT task, 0, 0, 0::BIGINT, 0::BIGINT, list({{'s': size, 'g': gain}} ORDER BY {order}) FROM units GROUP BY 1 UNION ALL SELECT task, k + 1, taken + CASE WHEN used + us[k + 1].s <= 900 THEN 1 ELSE 0 END,"
    f" used + CASE WHEN used + us[k + 1].s <= 900 THEN us[k + 1].s ELSE 0 END, gain + CASE WHEN used + us[k + 1].s <= 900 THEN us[k + 1].g ELSE 0 END, us FROM w_{h} WHERE k < len(us))"
    for h, order in _HEURISTIC_ORDER.items()
)


@query(f"""WITH RECURSIVE units AS (SELECT o_custkey AS task, floor(o_totalprice / 1000)::BIGINT AS size, floor(o_totalprice * 7 / 1000)::BIGINT % 97 AS gain, o_orderkey % 5 AS uses, o_orderkey AS place FROM orders), {_FILLED}
{" UNION ALL ".join(f"SELECT '{h}' AS heuristic, task, taken, used, gain FROM w_{h} WHERE k = len(us)" for h in _HEURISTIC_ORDER)}""")
def heuristic_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Six ways to fill a budget with a task's units."""
    units = _units(spark, sf)
    found = [folds.heuristic_fill(units, "task", 900, h).select(F.lit(h).alias("heuristic"), "task", "taken", "used", "gain") for h in folds.HEURISTICS]
    return functools.reduce(DataFrame.unionByName, found)


@query("""WITH r AS (SELECT l_orderkey AS task, list_sort(list(DISTINCT concat('n', l_suppkey % 20))) AS needed FROM lineitem GROUP BY 1), n AS (SELECT task, unnest(needed) AS name FROM r)
SELECT CASE WHEN substr(name, 2)::INTEGER >= 15 THEN 'unknown' WHEN substr(name, 2)::INTEGER * 100 > 1000 THEN 'too_big' ELSE 'not_picked' END AS why, count(*) AS n FROM n WHERE substr(name, 2)::INTEGER >= 3 GROUP BY 1""")
def miss_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("n"), (F.col("l_suppkey") % 20).cast("string"))
    needed = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("needed"))
    names = lambda n: F.array(*(F.lit(f"n{i}") for i in range(n)))
    sizes = F.map_from_arrays(names(20), F.array(*(F.lit(100 * i) for i in range(20))))
    missed = needed.select(F.explode(folds.misses(F.col("needed"), names(3), names(15), sizes, 1000)).alias("m"))
    return missed.groupBy("m.why").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS session, count(DISTINCT l_suppkey) AS files, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS inlined FROM lineitem GROUP BY l_orderkey")
def read_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "session")
    return transcript.read_coverage(rows, "session", "l_suppkey", "l_quantity", F.col("l_returnflag") == "R").select("session", "files", F.round("inlined", 6).alias("inlined"))


@query("""WITH a AS (SELECT o_orderstatus AS arm, count(*) AS n FROM orders GROUP BY 1) SELECT concat('| arm | n |', chr(10), '|-|-|', chr(10), string_agg(concat('| ', arm, ' | ', n, ' |'), chr(10) ORDER BY arm)) AS report FROM a""")
def report_md(spark: SparkSession, sf: str) -> DataFrame:
    arms = read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("arm")).agg(F.count("*").alias("n"))
    line = F.format_string("| %s | %d |", "arm", "n")
    return arms.agg(F.concat(F.lit("| arm | n |\n|-|-|\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("report"))


@query(f"""{_RETRIEVAL}, c AS (SELECT r.item_id, r.doc_id, score, list_distinct(string_split(lower(b.text), ' ')) AS a, string_split(lower(d.text), ' ') AS h FROM ranked r JOIN benchmark b USING (item_id) JOIN documents d ON d.doc_id = r.doc_id WHERE rank < 12)
SELECT item_id, doc_id, round(1 / (1 + exp(-(-2 + 0.1 * score + 4 * len(list_filter(a, lambda x: list_contains(h, x)))::DOUBLE / len(a)))), 6) AS p FROM c""")
def score_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = I.get_chunks(_bm25(spark, sf, 12).select("item_id", "doc_id", "score"), read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    found = found.join(read(spark, sf, "benchmark").withColumnRenamed("text", "prompt"), "item_id")
    return LexicalScorer().score(found, "prompt", "text").select("item_id", "doc_id", F.round("p", 6).alias("p"))


# Whole documents as source files: each line of the text a comment in the body of a function or method.
_CODE = {
    "python": ("py", "# ", "import os\n\n\ndef f@(x):\n", "    return load(x)\n\n\nclass C@(Base):\n    def run(self):\n        return f@(self)\n"),
    "rust": ("rs", "// ", "use std::fmt;\n\nfn f@(x: Load) {\n", "    load(x);\n}\n\nimpl C@ {\n    fn run(&self) {\n        f@(self)\n    }\n}\n"),
    "typescript": ("ts", "// ", "import { load } from './load';\n\nfunction f@(x) {\n", "    return load(x);\n}\n\nclass C@ extends Base {\n  run() {\n    return f@(this);\n  }\n}\n"),
    "go": ("go", "// ", "package a\n\nfunc f@(x int) int {\n", "\treturn load(x)\n}\n\ntype C@ struct {\n\tn int\n}\n"),
}


def _commented(mark: str, line: Column) -> Column:
    return F.concat(F.lit("    " + mark), line)


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, lang, text): documents made into source files of four languages."""
    number, lang = F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, _CODE)), (F.col("doc_id") % len(_CODE) + 1).cast("int"))
    text = path = F.lit(None).cast("string")
    for name, (ext, mark, head, tail) in _CODE.items():
        said = F.array_join(F.transform(F.split("text", "\n"), functools.partial(_commented, mark)), "\n")
        whole = F.concat(F.replace(F.lit(head), F.lit("@"), number), said, F.lit("\n"), F.replace(F.lit(tail), F.lit("@"), number))
        text, path = F.when(lang == name, whole).otherwise(text), F.when(lang == name, F.concat(F.lit("f"), number, F.lit("." + ext))).otherwise(path)
    return read(spark, sf, "documents").select(path.alias("path"), lang.alias("lang"), text.alias("text"))


@query()
def ast_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as source files, chunked by their syntax."""
    return ast_chunk.chunk_files(source_files(spark, sf), chunk.ChunkConfig(4, 20, 20))


@query("SELECT conv_id, turn, text AS shown FROM conversations")
def transcript_turns(spark: SparkSession, sf: str) -> DataFrame:
    """A transcript as JSON lines, parsed again with an explicit schema."""
    lines = read(spark, sf, "conversations").select(F.to_json(F.struct(F.col("conv_id").alias("session"), "turn", F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"))).alias("line"))
    parsed = lines.select(F.from_json("line", "session bigint, turn bigint, message struct<role:string,content:array<struct<type:string,text:string>>>").alias("e"))
    text = parsed.select(F.col("e.session").alias("conv_id"), F.col("e.turn").alias("turn"), F.explode("e.message.content").alias("c"))
    return text.select("conv_id", "turn", F.col("c.text").alias("shown"))


@query("SELECT item_id, item_id % 4 < 2 AS names_code FROM benchmark")
def names_code(spark: SparkSession, sf: str) -> DataFrame:
    prompt = F.expr("CASE item_id % 4 WHEN 0 THEN 'look at parse_config please' WHEN 1 THEN 'what is wrong in src/walk.rs' WHEN 2 THEN 'what is wrong here' ELSE '' END")
    return read(spark, sf, "benchmark").select("item_id", T.names_code(prompt).alias("names_code"))


_COMMIT = "CASE item_id % 4 WHEN 0 THEN 'fix(core): stop the walk (#12)' WHEN 1 THEN 'feat!: add a walk' WHEN 2 THEN 'chore(1.2): bump.' ELSE 'Walk faster' END"
_BODY = "CASE item_id % 3 WHEN 0 THEN concat('# head', chr(10), chr(10), ' The walk ', chr(10), 'stopped.', chr(10), chr(10), 'Closes #3') WHEN 1 THEN concat('- list', chr(10), 'It was slow.', chr(10), 'Signed-off-by: x') ELSE NULL END"


@query(f"""WITH c AS (SELECT item_id, {_COMMIT} AS s, {_BODY} AS b FROM benchmark)
SELECT item_id, item_id % 4 = 0 OR item_id % 3 = 0 AS is_fix, concat(CASE item_id % 4 WHEN 0 THEN 'core: stop the walk' WHEN 1 THEN 'add a walk' WHEN 2 THEN 'bump' ELSE 'Walk faster' END, CASE item_id % 3 WHEN 0 THEN '. The walk stopped.' WHEN 1 THEN '. It was slow.' ELSE '' END) AS task FROM c""")
def commit_task(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "benchmark").select("item_id", F.expr(_COMMIT).alias("s"), F.expr(_BODY).alias("b"))
    return rows.select("item_id", T.is_fix(F.col("s"), F.col("b")).alias("is_fix"), T.commit_task(F.col("s"), F.col("b")).alias("task"))


@query("""WITH RECURSIVE u AS (SELECT o_custkey AS task, list(floor(o_totalprice / 1000)::BIGINT ORDER BY o_orderkey) AS ns FROM orders GROUP BY 1),
w(task, cap, budget, k, used, taken, ns) AS (SELECT task, cap, budget, 0, 0::BIGINT, 0, ns FROM u, (SELECT unnest([2, 4, 8]) AS cap), (SELECT unnest([300, 900]) AS budget) UNION ALL
 SELECT task, cap, budget, k + 1, CASE WHEN used + ns[k + 1] <= budget AND taken < cap THEN used + ns[k + 1] ELSE used END, taken + CASE WHEN used + ns[k + 1] <= budget AND taken < cap THEN 1 ELSE 0 END, ns FROM w WHERE k < len(ns))
SELECT task, cap, budget, used, taken FROM w WHERE k = len(ns)""")
def completeness_grid(spark: SparkSession, sf: str) -> DataFrame:
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("at", "size"))), lambda x: x["size"])
    return folds.fill_grid(_units(spark, sf).groupBy("task").agg(sizes.alias("ns")), "task", "ns", [2, 4, 8], [300, 900])


@query("""WITH RECURSIVE seq AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'ok' WHEN 'error' THEN 'fail' ELSE 'ask' END AS kind, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(user_id, k, state, fails, at_t, opened, refused) AS (SELECT DISTINCT user_id, 0::BIGINT, 'closed', 0, 0::BIGINT, 0, 0 FROM seq UNION ALL
 SELECT user_id, k, CASE WHEN kind = 'ask' AND o THEN 'half-open' WHEN kind = 'ok' THEN 'closed' WHEN trips THEN 'open' ELSE state END, CASE WHEN kind = 'ok' OR trips THEN 0 WHEN kind = 'fail' THEN fails + 1 ELSE fails END,
  CASE WHEN kind = 'ask' AND o THEN t WHEN trips THEN t + 100000 ELSE at_t END, opened + trips::INTEGER, refused + (kind = 'ask' AND state <> 'closed' AND NOT o)::INTEGER
 FROM (SELECT w.user_id, s.k, s.kind, s.t, w.state, w.fails, w.at_t, w.opened, w.refused, (w.state = 'open' AND s.t >= w.at_t) OR (w.state = 'half-open' AND s.t - w.at_t >= 100000) AS o, s.kind = 'fail' AND NOT (w.state = 'closed' AND w.fails + 1 < 2) AS trips
  FROM w JOIN seq s ON s.user_id = w.user_id AND s.k = w.k + 1)),
l AS (SELECT user_id, max(k) AS k FROM seq GROUP BY 1) SELECT user_id, opened, refused, state FROM w JOIN l USING (user_id, k)""")
def breaker_calls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "error", "fail").otherwise("ask")
    item = F.struct("ts", "event_id", kind.alias("kind"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    ordered = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return ordered.select("user_id", folds.breaker_calls(F.col("xs"), 2, 100_000).alias("b")).select("user_id", "b.*")


@query(f"""{_RETRIEVAL}, c AS (SELECT item_id, list({{'doc_id': doc_id, 'rank': rank, 'p': CASE WHEN rank < 3 THEN round(score / (score + 10), 6) END}} ORDER BY rank) AS cs FROM ranked WHERE rank < 5 GROUP BY 1)
SELECT item_id, substr(text, 1, 4000) AS prompt, length(text) AS chars, list_transform(cs, lambda x: x.doc_id) AS ids, list_transform(cs, lambda x: x.p) AS ps FROM benchmark LEFT JOIN c USING (item_id)""")
def capture_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = _bm25(spark, sf, 5).select("item_id", "doc_id", "rank", "score")
    scores = found.filter("rank < 3").select("item_id", "doc_id", F.round(F.col("score") / (F.col("score") + 10), 6).alias("p"))
    records = session.capture(read(spark, sf, "benchmark"), retrieve.with_scores(found.drop("score"), scores, ["item_id", "doc_id"]), "item_id", id="doc_id")
    return records.select("item_id", "prompt", "chars", F.transform("candidates", lambda x: x["doc_id"]).alias("ids"), F.transform("candidates", lambda x: x["p"]).alias("ps"))


@query("""WITH t AS (SELECT *, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), d AS (SELECT *, md5(text) AS h FROM documents WHERE doc_id % 2 = 1),
n AS (SELECT doc_id, doc_id % 2 AS side, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_''`@\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM documents)
SELECT 'commit' AS kind, count(*) AS n FROM (SELECT source FROM t INTERSECT SELECT source FROM d) UNION ALL
SELECT 'blob', count(*) FROM (SELECT h FROM t WHERE n_chars >= 512 INTERSECT SELECT h FROM d WHERE n_chars >= 512) UNION ALL
SELECT 'task', count(*) FROM n a JOIN n b ON a.t = b.t AND a.side = 0 AND b.side = 1 WHERE a.t <> '' UNION ALL
SELECT 'sha', count(*) FROM (SELECT substr(h, 1, 10) AS s FROM t INTERSECT SELECT substr(h, 1, 10) FROM d)""")
def leakage_joins(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").withColumn("h", F.md5("text")).withColumn("s", F.substring("h", 1, 10)).withColumns({"a": F.col("doc_id"), "b": F.col("doc_id")})
    train, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    kinds = {"commit": leakage.shared(train, held, "source"), "blob": leakage.shared_blobs(train, held, "h", "n_chars"), "task": leakage.equal_tasks(train, held, F.col("text"), ("a", "b")), "sha": leakage.shared(train, held, "s")}
    return functools.reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds.items()])


@query("""WITH RECURSIVE seq AS (SELECT user_id, event_type = 'error' AS skipped, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(user_id, k, mean, warm) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::DOUBLE, false FROM seq UNION ALL
 SELECT w.user_id, s.k, CASE WHEN s.skipped THEN w.mean * 0.75 WHEN w.warm THEN coalesce(w.mean * 0.75 + s.v * 0.25, s.v) ELSE w.mean END, w.warm OR NOT s.skipped FROM w JOIN seq s ON s.user_id = w.user_id AND s.k = w.k + 1),
l AS (SELECT user_id, max(k) AS k FROM seq GROUP BY 1) SELECT user_id, round(mean, 6) AS speed FROM w JOIN l USING (user_id, k)""")
def ema_speed(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct("ts", "event_id", F.col("value").alias("v"), (F.col("event_type") == "error").alias("skipped"))
    ordered = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    return ordered.select("user_id", F.round(folds.speed(F.col("xs")), 6).alias("speed"))


@query("""WITH RECURSIVE seq AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS k FROM events),
w(user_id, k, batch, n, longest, padded) AS (SELECT user_id, 1::BIGINT, 1, 1, v, 0.0::DOUBLE FROM seq WHERE k = 1 UNION ALL
 SELECT user_id, k, batch + new::INTEGER, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN v ELSE longest END, padded + CASE WHEN new THEN 0 ELSE longest - v END
 FROM (SELECT w.user_id, s.k, s.v, w.batch, w.n, w.longest, w.padded, w.n >= 8 OR (w.n + 1) * w.longest > 90 AS new FROM w JOIN seq s ON s.user_id = w.user_id AND s.k = w.k + 1)),
l AS (SELECT user_id, max(k) AS k FROM seq GROUP BY 1) SELECT user_id, batch AS batches, round(padded, 4) AS padded FROM w JOIN l USING (user_id, k)""")
def plan_padded(spark: SparkSession, sf: str) -> DataFrame:
    sizes = read(spark, sf, "events").groupBy("user_id").agg(F.collect_list("value").alias("vs"))
    found = sizes.select("user_id", folds.padded_batches(F.col("vs"), 8, 90.0).alias("b"))
    return found.select("user_id", "b.batches", F.round("b.padded", 4).alias("padded"))


@query("""WITH RECURSIVE b AS (SELECT conv_id, list(text ORDER BY turn) AS ts FROM conversations GROUP BY 1),
w(conv_id, k, said, ts) AS (SELECT conv_id, 0, '', ts FROM b UNION ALL SELECT conv_id, k + 1, CASE WHEN strlen(concat(said, ts[k + 1], chr(10))) <= 2000 THEN concat(said, ts[k + 1], chr(10)) ELSE said END, ts FROM w WHERE k < len(ts))
SELECT conv_id, md5(said) AS digest, strlen(said) AS bytes FROM w WHERE k = len(ts)""")
def append_bytes(spark: SparkSession, sf: str) -> DataFrame:
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    said = read(spark, sf, "conversations").groupBy("conv_id").agg(blocks.alias("ts")).select("conv_id", shape.append_blocks(F.col("ts"), 2_000).alias("said"))
    return said.select("conv_id", F.md5("said").alias("digest"), F.octet_length("said").cast("long").alias("bytes"))


@query(f"""{_RETRIEVAL}, {_GOLD}, kept AS (SELECT g.* FROM gold g JOIN documents d USING (doc_id) WHERE n_chars <= 5000), hits AS (SELECT g.item_id, r.rank FROM kept g LEFT JOIN (SELECT * FROM ranked WHERE rank < 10) r ON r.item_id = g.item_id AND r.doc_id = g.doc_id),
per AS (SELECT item_id, count(rank) AS found, count(*) AS golds FROM hits GROUP BY 1) SELECT count(*) AS items, round(avg(found * 1.0 / golds), 6) AS r_at_10 FROM per""")
def findable_recall(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    gold = evalx.findable(_gold(spark, sf, index), read(spark, sf, "documents"), "doc_id", F.col("n_chars") <= 5000)
    return evalx.ranking_metrics(_bm25(spark, sf, 10, index), gold, "item_id", "doc_id").select("items", "r_at_10")


_BLOCK = "concat('@@', md5(concat('c', item_id)), chr(9), CASE item_id % 5 WHEN 0 THEN 'chore: ' WHEN 1 THEN 'fix(walk): ' WHEN 2 THEN 'short' ELSE '' END, CASE WHEN item_id % 5 = 2 THEN '' ELSE concat('keep the tree of walk ', item_id, ' in its order') END, ' (#', item_id, ')', chr(10), chr(10), 'src/a', item_id, '.rs', chr(10), CASE WHEN item_id % 3 = 0 THEN concat('src/b', item_id, '.rs', chr(10), 'tests/t.rs', chr(10), 'README.md', chr(10)) ELSE '' END, CASE WHEN item_id % 7 = 0 THEN concat('c1.go', chr(10), 'c2.go', chr(10), 'c3.go', chr(10), 'c4.go', chr(10)) ELSE '' END)"


@query("""SELECT substr(md5(concat('c', item_id)), 1, 10) AS id, concat('keep the tree of walk ', item_id, ' in its order') AS task,
 CASE WHEN item_id % 3 = 0 THEN [concat('src/a', item_id, '.rs'), concat('src/b', item_id, '.rs')] ELSE [concat('src/a', item_id, '.rs')] END AS gold FROM benchmark WHERE item_id % 5 NOT IN (0, 2) AND item_id % 7 <> 0""")
def log_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as commits of a few logs, parsed and made into tasks."""
    logs = read(spark, sf, "benchmark").groupBy(F.col("item_id") % 4).agg(F.array_join(F.collect_list(F.expr(_BLOCK)), "\n").alias("log"))
    return commits.tasks(commits.parse_log(logs))


_PATHS = "b AS (SELECT doc_id, concat_ws('/', source, lang, concat(doc_id, '.md')) AS path, concat(source, '/', lang, '/', doc_id, '.md ', text) AS text FROM documents)"


@query(f"""WITH {_PATHS}, {D.POSTINGS.replace("FROM documents", "FROM b")}, m AS (SELECT item_id, CASE item_id % 2 WHEN 0 THEN concat(item_id, '.md') ELSE concat('en/', item_id, '.md') END AS mention FROM benchmark),
r AS (SELECT item_id, path FROM m JOIN b ON path = mention OR ends_with(path, concat('/', mention))), t AS (SELECT DISTINCT item_id, unnest({D.terms('path')}) AS term FROM r), selected AS (SELECT item_id, term, df FROM t JOIN term_df USING (term)), {D.BM25}
SELECT item_id, doc_id, score FROM ranked WHERE rank < 10""")
def path_terms(spark: SparkSession, sf: str) -> DataFrame:
    """A second search: documents by the terms of the paths that a prompt mentions."""
    files = S.files(spark, sf)
    index = I.written(I.build(files, "doc_id", F.concat_ws(" ", "path", "text")), "doc_id")
    mention = F.expr("CASE item_id % 2 WHEN 0 THEN concat(item_id, '.md') ELSE concat('en/', item_id, '.md') END")
    said = read(spark, sf, "benchmark").select("item_id", mention.alias("mention"))
    return retrieve.path_signal(files, said, index, "item_id", "doc_id", 10).select("item_id", "doc_id", "score")


_RULE = """CASE item_id % 4 WHEN 0 THEN concat('*', item_id, '.md') WHEN 1 THEN concat('!*', item_id - 1, '.md') WHEN 2 THEN concat('src', item_id % 20, '/de/') ELSE concat('/', item_id, '*') END"""


@query("""WITH f AS (SELECT doc_id, source, lang, concat(doc_id, '.md') AS base FROM documents), d AS (SELECT DISTINCT concat('src', item_id % 20) AS source FROM benchmark WHERE item_id % 4 = 2),
m AS (SELECT doc_id, item_id % 4 = 1 AS back, CASE item_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END * 1000000 + item_id AS place FROM f JOIN benchmark ON CASE item_id % 4 WHEN 0 THEN ends_with(base, concat(item_id, '.md'))
 WHEN 1 THEN source = concat('src', item_id % 20) AND ends_with(base, concat(item_id - 1, '.md')) WHEN 3 THEN source = concat('src', item_id % 20) AND lang = 'en' AND starts_with(base, item_id::VARCHAR) ELSE false END)
SELECT DISTINCT doc_id FROM (SELECT doc_id FROM m GROUP BY 1 HAVING NOT arg_max(back, place) UNION ALL SELECT doc_id FROM f JOIN d USING (source) WHERE lang = 'de')""")
def ignored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files that ignore rules of several folders (one for each benchmark item) leave out."""
    folder = F.expr("CASE item_id % 4 WHEN 1 THEN concat('src', item_id % 20) WHEN 3 THEN concat('src', item_id % 20, '/en') ELSE '' END")
    rules = read(spark, sf, "benchmark").select(folder.alias("folder"), F.lit(1).alias("rank"), F.col("item_id").alias("n"), F.expr(_RULE).alias("line"))
    files = S.files(spark, sf).select("doc_id", "path")
    return files.join(source_files_of.ignored_paths(files, rules), "path").select("doc_id")


_COSTS = "{" + ", ".join(f"'n{i}': {40 + 37 * i % 90}" for i in range(20)) + "}"


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey AS task, l_orderkey, list_sort(list(DISTINCT concat('n', l_suppkey % 20))) AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), g AS (SELECT task, list(c) AS calls FROM o GROUP BY 1),
w(task, k, items, used, calls) AS (SELECT task, 0, []::VARCHAR[], 0::BIGINT, calls FROM g UNION ALL
 SELECT task, k + 1, CASE WHEN best IS NULL THEN items ELSE list_concat(items, best.items) END, CASE WHEN best IS NULL THEN used ELSE used + best.cost END, calls
 FROM (SELECT *, list_sort(list_transform(list_filter(cand, lambda x: used + x.cost <= 500), lambda x: {{'each': x.cost / len(list_filter(calls, lambda c: len(list_filter(c, lambda i: NOT list_contains(items, i) AND NOT list_contains(x.items, i))) = 0 AND len(list_filter(c, lambda i: NOT list_contains(items, i))) > 0))::DOUBLE, 'cost': x.cost, 'items': x.items}}))[1] AS best
  FROM (SELECT *, list_transform(list_filter(list_transform(calls, lambda c: list_filter(c, lambda i: NOT list_contains(items, i))), lambda x: len(x) > 0), lambda x: {{'cost': list_sum(list_transform(x, lambda i: MAP {_COSTS}[i]))::BIGINT, 'items': x}}) AS cand FROM w WHERE k < len(calls))))
SELECT task, list_sort(items) AS items, used, len(list_filter(calls, lambda c: len(list_filter(c, lambda i: NOT list_contains(items, i))) = 0))::INTEGER AS covered FROM w WHERE k = len(calls)""")
def greedy_picks(spark: SparkSession, sf: str) -> DataFrame:
    """What a greedy picker shows each customer, whose orders are calls that need the names of their suppliers."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("task"))
    name = F.concat(F.lit("n"), (F.col("l_suppkey") % 20).cast("string"))
    calls = read(spark, sf, "lineitem").join(orders, "l_orderkey").groupBy("task", "l_orderkey").agg(F.array_sort(F.collect_set(name)).alias("c"))
    costs = F.create_map(*(F.lit(x) for i in range(20) for x in (f"n{i}", 40 + 37 * i % 90)))
    found = calls.groupBy("task").agg(F.collect_list("c").alias("calls")).select("task", folds.greedy_picks(F.col("calls"), costs, 500).alias("g"))
    return found.select("task", F.array_sort("g.items").alias("items"), "g.used", "g.covered")


@query("""SELECT o_orderkey AS call, (o_totalprice / 1e6 / ((1 / 3.5::DOUBLE) * (3.75::DOUBLE + 0.3::DOUBLE * (o_orderkey % 4)) / 1e6)) AS chars, (o_totalprice * (1 / 3.5::DOUBLE) * (3.75::DOUBLE + 0.3::DOUBLE * (o_orderkey % 4)) / 1e6) AS price FROM orders""")
def break_even(spark: SparkSession, sf: str) -> DataFrame:
    """How much may be shown for each call saved, and what showing costs."""
    later = F.col("o_orderkey") % 4
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("call"), folds.break_even_chars(F.col("o_totalprice") / 1e6, later).alias("chars"), folds.injection_price(F.col("o_totalprice"), later).alias("price"))


@query(f"""WITH {D.POSTINGS}, {D.QUERY_TERMS}, hits AS (SELECT item_id, term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS gain FROM selected JOIN postings USING (term) JOIN doc_len USING (doc_id) CROSS JOIN corpus),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id, term ORDER BY round(gain, 12) DESC, doc_id) AS nth FROM hits), scored AS (SELECT item_id, doc_id, round(sum(idf * gain), 6) AS score FROM top WHERE nth <= 20 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored) SELECT item_id, doc_id, score, rank FROM ranked WHERE rank < 10""")
def bm25_per_term(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 where only the best twenty documents of each term count, as a store returns them."""
    index = _index(spark, sf)
    asked = read(spark, sf, "benchmark").select("item_id", T.content_terms(F.col("text")).alias("terms"))
    chosen = retrieve.select_terms(retrieve.prepare_terms(asked, "item_id", "terms"), index.term_df, "item_id")
    return retrieve.bm25(chosen, index, "item_id", "doc_id", 10, per_term=20).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
