"""Retrieval over the driver's tables: documents are files or chunks, benchmark items are prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions import text as T
from spanlens.operators import chunk as C
from spanlens.operators import expand as X
from spanlens.operators import index as I
from spanlens.operators import leakage
from spanlens.operators import retrieve as R
from spanlens.operators import shape as H
from spanlens.plans import duck as D
from spanlens.plans.base import query, read
from spanlens.plans.text_queries import CHUNKS_SQL, SMALL
from spanlens.sources import tables as S
from spanlens.sources.store import stored


def _index(spark: SparkSession, sf: str) -> I.Index:
    """Documents by the terms of the benchmark's items, which are all that any of these queries asks for."""
    asked = read(spark, sf, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("term"))
    return I.written_for(read(spark, sf, "documents"), asked, "doc_id")


def _prepared(spark: SparkSession, sf: str, cap: int | None = 256) -> DataFrame:
    asked = read(spark, sf, "benchmark").select("item_id", T.content_terms(F.col("text")).alias("terms"))
    return R.prepare_terms(asked, "item_id", "terms", cap)


def _bm25(spark: SparkSession, sf: str, limit: int = 48, index: I.Index | None = None) -> DataFrame:
    index = index or _index(spark, sf)
    return R.bm25(R.select_terms(_prepared(spark, sf), index.term_df, "item_id"), index, "item_id", "doc_id", limit)


def _whole(spark: SparkSession, sf: str, index: I.Index | None = None) -> DataFrame:
    """Every document that holds a term of an item, by all of the item's terms."""
    return R.whole(_prepared(spark, sf, None), index or _index(spark, sf), "item_id", "doc_id")


_RETRIEVAL = f"WITH {D.POSTINGS}, {D.QUERY_TERMS}, {D.BM25}"
_WHOLE = f"WITH {D.POSTINGS}, {D.ALL_TERMS}, {D.BM25}"
# Positions count from 0 in Spark's posexplode and from 1 in DuckDB's lists.


@query(f"WITH {D.POSTINGS}, {D.QUERY_TERMS} SELECT item_id, term, pos - 1 AS pos FROM prepared")
def prepare_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf)


@query(f"WITH {D.POSTINGS}, {D.QUERY_TERMS} SELECT item_id, term, pos - 1 AS pos, df FROM selected")
def select_terms(spark: SparkSession, sf: str) -> DataFrame:
    return R.select_terms(_prepared(spark, sf), _index(spark, sf).term_df, "item_id")


@query(f"{_RETRIEVAL} SELECT item_id, doc_id, score, rank FROM ranked WHERE rank < 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 10).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_LABELLED = """
quality AS (SELECT item_id, r.doc_id, row_number() OVER (PARTITION BY item_id ORDER BY quality DESC, toxic, r.doc_id) - 1 AS rank FROM ranked r JOIN labels USING (doc_id) WHERE rank < 48),
lists AS (SELECT item_id, doc_id, rank, 0 AS no FROM ranked WHERE rank < 48 UNION ALL SELECT item_id, doc_id, rank, 1 FROM quality),
fused AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS fused, min(no * 1000 + rank) AS f FROM lists GROUP BY 1, 2),
rrf AS (SELECT item_id, doc_id, fused, row_number() OVER (PARTITION BY item_id ORDER BY fused DESC, f) - 1 AS rank FROM fused)"""


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    lexical = stored(_bm25(spark, sf), "lexical")
    order = Window.partitionBy("item_id").orderBy(F.desc("quality"), "toxic", "doc_id")
    labelled = lexical.join(read(spark, sf, "labels"), "doc_id").withColumn("rank", F.row_number().over(order) - 1)
    return R.rrf([lexical, labelled], "item_id", "doc_id")


_ALL_LABELLED = _LABELLED.replace(" WHERE rank < 48", "").replace("no * 1000 + rank", "no * 1000000000000 + rank")


@query(f"{_WHOLE}, {_ALL_LABELLED} SELECT item_id, doc_id, fused, rank FROM rrf")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Both lists whole."""
    lexical = stored(_whole(spark, sf), "lexical")
    order = Window.partitionBy("item_id").orderBy(F.desc("quality"), "toxic", "doc_id")
    labelled = lexical.join(read(spark, sf, "labels"), "doc_id").withColumn("rank", F.row_number().over(order) - 1)
    return R.rrf([lexical, labelled], "item_id", "doc_id").select("item_id", "doc_id", "fused", F.col("rank").cast("long").alias("rank"))


@query(f"""{_RETRIEVAL}, {_LABELLED}, n AS (SELECT r.*, source, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS n FROM rrf r JOIN documents USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n > 3, rank) - 1 AS place FROM n) SELECT item_id, doc_id, source, place FROM p WHERE place < 24""")
def cap_per_file(spark: SparkSession, sf: str) -> DataFrame:
    found = _fused(spark, sf).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return R.cap_per_file(found, "item_id", "source").select("item_id", "doc_id", "source", F.col("place").cast("long").alias("place"))


@query(f"""{_RETRIEVAL}, {_LABELLED}, p AS (SELECT r.*, lang <> 'en' AS prose FROM rrf r JOIN documents USING (doc_id))
SELECT item_id, doc_id, CASE WHEN prose THEN fused * 0.5 ELSE fused END AS fused, rank, row_number() OVER (PARTITION BY item_id ORDER BY prose, rank) - 1 AS place FROM p""")
def demote_prose(spark: SparkSession, sf: str) -> DataFrame:
    found = _fused(spark, sf).join(read(spark, sf, "documents").select("doc_id", (F.col("lang") != "en").alias("is_prose")), "doc_id")
    moved = R.demote_prose(found, "item_id")
    return moved.select("item_id", "doc_id", "fused", F.col("rank").cast("long").alias("rank"), F.col("place").cast("long").alias("place"))


# A model's chance for the first sixteen candidates: a hash, so that both engines agree.
_P = "CASE WHEN rank < 16 THEN round((('0x' || substr(md5(concat(item_id, '-', doc_id)), 1, 6))::BIGINT % 1000) / 1000.0, 3) END"


def _with_p(df: DataFrame, first: int | None = 16) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat_ws("-", "item_id", "doc_id").cast("binary")), 1, 6), 16, 10).cast("long") % 1000
    p = F.round(h / 1000, 3)
    return df.withColumn("p", p if first is None else F.when(F.col("rank") < first, p))


_BLEND = f"""{_RETRIEVAL}, scored_p AS (SELECT item_id, doc_id, rank, {_P} AS p FROM ranked WHERE rank < 24),
blend AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE 0.5 * (1 - rank / count(p) OVER (PARTITION BY item_id)) + 0.5 * p END AS blend FROM scored_p)"""


@query(f"{_BLEND} SELECT item_id, doc_id, p, round(blend, 6) AS blend FROM blend")
def weighted_blend(spark: SparkSession, sf: str) -> DataFrame:
    found = R.blend(_with_p(_bm25(spark, sf, 24)), "item_id")
    return found.select("item_id", "doc_id", "p", F.round("blend", 6).alias("blend"))


_ALL_BLEND = _BLEND.replace(_RETRIEVAL, _WHOLE).replace(" WHERE rank < 24", "").replace("CASE WHEN rank < 16 THEN ", "").replace(" END AS p FROM", " AS p FROM")


@query(f"""{_ALL_BLEND}, placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY p IS NULL, round(blend, 9) DESC, rank) - 1 AS place,
 count(*) FILTER (WHERE coalesce(p, 0) >= 0.5) OVER (PARTITION BY item_id) AS passing FROM blend)
SELECT item_id, doc_id, place FROM placed WHERE CASE WHEN passing >= 3 THEN coalesce(p, 0) >= 0.5 ELSE place < 3 END""")
def rerank_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Every candidate has its chance."""
    blended = R.blend(_with_p(_whole(spark, sf), None), "item_id").withColumn("blend", F.round("blend", 9))
    return R.gate(blended, "item_id").select("item_id", "doc_id", F.col("place").cast("long").alias("place"))


@query(f"""{_RETRIEVAL}, f AS (SELECT item_id, doc_id, source, rank, row_number() OVER (PARTITION BY item_id, source ORDER BY rank) AS n FROM ranked JOIN documents USING (doc_id) WHERE rank < 24),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank) - 1 AS nth FROM f WHERE n = 1) SELECT item_id, doc_id, source, nth FROM g WHERE nth < 5""")
def distinct_files(spark: SparkSession, sf: str) -> DataFrame:
    found = _bm25(spark, sf, 24).join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return H.distinct_files(found, "item_id", "source", 5).select("item_id", "doc_id", "source", F.col("nth").cast("long").alias("nth"))


# Spans for shaping: a line item is a span of its supplier's "file".
_SPANS = """spans AS (SELECT l_suppkey // 5 AS query_id, concat('f', l_suppkey % 5) AS path, CAST(l_partkey % 60 AS INTEGER) AS "start",
 CAST(l_partkey % 60 + l_quantity AS INTEGER) AS "end", round(l_discount + l_tax, 2) AS score FROM lineitem)"""


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item: five suppliers are a query, each of them a file, so groups keep their size as the table grows."""
    return read(spark, sf, "lineitem").selectExpr("l_suppkey div 5 as query_id", "concat('f', l_suppkey % 5) as path", "cast(l_partkey % 60 as int) as start", "cast(l_partkey % 60 + l_quantity as int) as end", "round(l_discount + l_tax, 2) as score")


_MERGED = f"""{_SPANS}, seq AS (SELECT query_id, path, "start" AS s, "end" AS e, score, row_number() OVER (PARTITION BY query_id, path ORDER BY "start", "end", score) AS k FROM spans),
walk(query_id, path, k, s, e, score, grp) AS (
  SELECT query_id, path, k, s, e, score, 1 FROM seq WHERE k = 1
  UNION ALL
  SELECT q.query_id, q.path, q.k, CASE WHEN j THEN w.s ELSE q.s END, CASE WHEN j THEN greatest(w.e, q.e) ELSE q.e END, CASE WHEN j THEN greatest(w.score, q.score) ELSE q.score END, grp + CASE WHEN j THEN 0 ELSE 1 END
  FROM (SELECT w.*, q.k AS qk, (q.s - w.e - 1 <= 3 AND greatest(w.e, q.e) - w.s + 1 <= 50) AS j FROM walk w JOIN seq q ON q.query_id = w.query_id AND q.path = w.path AND q.k = w.k + 1) w
  JOIN seq q ON q.query_id = w.query_id AND q.path = w.path AND q.k = w.qk),
merged AS (SELECT query_id, path, s AS "start", e AS "end", score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path, grp ORDER BY k DESC) AS last FROM walk) WHERE last = 1)"""


@query(f'WITH RECURSIVE {_MERGED} SELECT query_id, path, "start", "end", score FROM merged')
def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    return H.merge_spans(_spans(spark, sf), "query_id")


_BUDGETED = """cut AS (SELECT *, coalesce(sum("end" - "start" + 1) OVER (PARTITION BY query_id ORDER BY score DESC, path, "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {}),
kept AS (SELECT query_id, path, "start", CAST(least("end", "start" + 100 - before - 1) AS INTEGER) AS "end", score FROM cut WHERE before < 100)"""


@query(f'WITH RECURSIVE {_MERGED}, {_BUDGETED.format("merged")} SELECT * FROM kept')
def line_budget(spark: SparkSession, sf: str) -> DataFrame:
    return H.line_budget(H.merge_spans(_spans(spark, sf), "query_id"), "query_id", budget=100)


@query(f"""WITH RECURSIVE {_MERGED}, top AS (SELECT query_id, path, "start", "end", score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, "start", "end") AS r FROM merged) WHERE r <= 10),
{_BUDGETED.format("top")} SELECT * FROM kept""")
def shape_spans(spark: SparkSession, sf: str) -> DataFrame:
    return H.shape_spans(_spans(spark, sf), "query_id", budget=100)


_RANKED_SPANS = """ranked AS (SELECT query_id, path, "start", "end", score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, "start", "end") - 1 AS rank FROM merged)"""
_SENT = """sent AS (SELECT query_id, path, CAST(min("start") AS INTEGER) AS "start", CAST(min("start") + 10 AS INTEGER) AS "end" FROM spans WHERE path IN ('f1', 'f3') GROUP BY 1, 2)"""


def _ranked_spans(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start", "end")
    return H.merge_spans(_spans(spark, sf), "query_id").withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    return _spans(spark, sf).filter("path in ('f1', 'f3')").groupBy("query_id", "path").agg(F.min("start").alias("start"), (F.min("start") + 10).alias("end"))


_OVERLAP = 'EXISTS (SELECT 1 FROM sent y WHERE y.query_id = x.query_id AND y.path = x.path AND x."start" <= y."end" AND y."start" <= x."end")'


@query(f'WITH RECURSIVE {_MERGED}, {_RANKED_SPANS}, {_SENT} SELECT query_id, path, "start", "end" FROM ranked x WHERE {_OVERLAP}')
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    return H.overlaps(_ranked_spans(spark, sf), _sent(spark, sf), ["query_id", "path"]).select("query_id", "path", "start", "end")


@query(f'WITH RECURSIVE {_MERGED}, {_RANKED_SPANS}, {_SENT} SELECT query_id, path, "start", "end" FROM ranked x WHERE NOT {_OVERLAP}')
def already_sent_anti(spark: SparkSession, sf: str) -> DataFrame:
    return H.overlaps(_ranked_spans(spark, sf), _sent(spark, sf), ["query_id", "path"], "left_anti").select("query_id", "path", "start", "end")


_SIZED = f"""{_RANKED_SPANS}, {_SENT}, m AS (SELECT *, {_OVERLAP} AS sent FROM ranked x),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, sent, path ORDER BY rank) AS n FROM m),
g AS (SELECT *, CASE WHEN NOT sent AND n = 1 THEN row_number() OVER (PARTITION BY query_id, sent, n ORDER BY rank) END AS nth FROM f),
b AS (SELECT *, CASE WHEN sent THEN 'already' WHEN nth <= @full THEN 'full' ELSE 'map' END AS bucket FROM g),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY rank) AS k, count(*) FILTER (WHERE bucket = 'full') OVER (PARTITION BY query_id) AS full_n FROM b),
sized AS (SELECT query_id, path, "start", "end", bucket FROM c WHERE bucket <> 'map' OR k <= @listed - full_n)"""


@query(f"""WITH RECURSIVE {_MERGED}, {_SIZED.replace('@full', '2').replace('@listed', '10')} SELECT * FROM sized""")
def size_context(spark: SparkSession, sf: str) -> DataFrame:
    return H.size_context(_ranked_spans(spark, sf), _sent(spark, sf), "query_id").select("query_id", "path", "start", "end", "bucket")


@query(f"""WITH RECURSIVE {_MERGED}, {_SIZED.replace('@full', "(query_id % 2)").replace('@listed', '6')},
rel AS (SELECT l_suppkey // 5 AS query_id, concat('f', l_suppkey % 7) AS path, (l_partkey % 200)::INTEGER AS "start", (l_partkey % 200 + 5)::INTEGER AS "end", l_orderkey * 10 + l_linenumber AS pos, l_returnflag = 'R' AS is_usage FROM lineitem),
free AS (SELECT * FROM rel x WHERE NOT is_usage AND NOT EXISTS (SELECT 1 FROM sized y WHERE y.query_id = x.query_id AND y.path = x.path AND x."start" <= y."end" AND y."start" <= x."end")),
once AS (SELECT query_id, path, "start", "end", min(pos) AS pos FROM free GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, path, "start", "end") AS k FROM once)
SELECT * FROM sized UNION ALL SELECT query_id, path, "start", "end", 'related' FROM r WHERE k <= 8 UNION ALL SELECT query_id, path, "start", "end", 'usage' FROM rel WHERE is_usage""")
def size_follow_up(spark: SparkSession, sf: str) -> DataFrame:
    """Follow-ups: smaller caps, none whole where they ask for tests, neighbours and usages beside the spans."""
    ranked = _ranked_spans(spark, sf)
    limits = ranked.select("query_id").distinct().withColumn("caps", H.smaller_caps(H.caps(), H.follow_up_caps(F.col("query_id") % 2 == 0)))
    related = read(spark, sf, "lineitem").selectExpr("l_suppkey div 5 as query_id", "concat('f', l_suppkey % 7) as path", "cast(l_partkey % 200 as int) as start", "cast(l_partkey % 200 + 5 as int) as end", "l_orderkey * 10 + l_linenumber as pos", "l_returnflag = 'R' as is_usage")
    return H.size_context(ranked, _sent(spark, sf), "query_id", limits=limits, related=related).select("query_id", "path", "start", "end", "bucket")


@query(f"""WITH RECURSIVE {_MERGED}, {_RANKED_SPANS} SELECT query_id, path, string_agg(concat("start", '-', "end"), '; ' ORDER BY rank) AS line, min(rank)::BIGINT AS first FROM ranked GROUP BY 1, 2""")
def ranked_locations(spark: SparkSession, sf: str) -> DataFrame:
    return H.ranked_locations(_ranked_spans(spark, sf), "query_id")


@query(f"""WITH RECURSIVE {_MERGED}, {_RANKED_SPANS}, b AS (SELECT query_id, list(("end" - "start" + 1)::BIGINT ORDER BY rank) AS n FROM ranked GROUP BY 1),
w(query_id, k, used, fits, n) AS (SELECT query_id, 0, 0::BIGINT, []::BOOLEAN[], n FROM b UNION ALL
 SELECT query_id, k + 1, CASE WHEN used + n[k + 1] <= 60 THEN used + n[k + 1] ELSE used END, list_append(fits, used + n[k + 1] <= 60), n FROM w WHERE k < len(n))
SELECT query_id, fits FROM w WHERE k = len(n)""")
def budget_append(spark: SparkSession, sf: str) -> DataFrame:
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("rank", (F.col("end") - F.col("start") + 1).alias("n")))), lambda x: x["n"])
    return _ranked_spans(spark, sf).groupBy("query_id").agg(sizes.alias("n")).select("query_id", H.budget_append(F.col("n"), 60).alias("fits"))


_RENDERED = f"""WITH RECURSIVE {CHUNKS_SQL}, r AS (SELECT doc_id, start_line, end_line, concat('### ', source, '/', lang, '/', doc_id, '.md:', start_line, '-', end_line, chr(10), '```md', chr(10),
 array_to_string((SELECT l FROM lines x WHERE x.doc_id = c.doc_id)[start_line:end_line], chr(10)), chr(10), '```') AS rendered FROM chunks c JOIN documents USING (doc_id))"""


def _rendered(spark: SparkSession, sf: str) -> DataFrame:
    files = S.files(spark, sf)
    chunks = C.chunk_text(files, "doc_id", cfg=SMALL).join(files.select("doc_id", "path"), "doc_id")
    return chunks.select("doc_id", "start_line", "end_line", "path", H.render_span(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk"), F.lit("md")).alias("rendered"))


@query(f"{_RENDERED} SELECT doc_id, start_line, end_line, rendered FROM r")
def render_span(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf).drop("path")


@query(f"WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.md') AS path, start_line AS \"start\", end_line AS \"end\" FROM chunks JOIN documents USING (doc_id)")
def parse_rendered(spark: SparkSession, sf: str) -> DataFrame:
    return _rendered(spark, sf).select("doc_id", F.inline(H.parse_rendered(F.col("rendered"))))


# Names of a document: it defines its first three words of six letters or more and refers to the rest.
_NAMES = f"""names AS (SELECT doc_id, list_distinct(w) AS u, w FROM (SELECT doc_id, list_filter({D.words('text')}, lambda x: length(x) >= 6) AS w FROM documents)),
ordered AS (SELECT doc_id, ident, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM (SELECT doc_id, x AS ident, list_position(w, x) AS pos FROM (SELECT doc_id, w, unnest(u) AS x FROM names))),
defs AS (SELECT ident, doc_id AS chunk_id, pos FROM ordered WHERE pos < 3),
refs AS (SELECT ident, doc_id AS chunk_id, pos - 3 AS pos FROM ordered WHERE pos >= 3 AND pos < 51)"""


def _names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = F.array_distinct(F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 6))
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.posexplode(found).alias("pos", "ident"))
    rows = stored(rows.withColumn("pos", F.col("pos").cast("long")).filter("pos < 51"), "names")
    return rows.filter("pos < 3").select("ident", "chunk_id", "pos"), rows.filter("pos >= 3 and pos < 51").select("ident", "chunk_id", (F.col("pos") - 3).alias("pos"))


_ASKED = f"""asked_n AS (SELECT item_id, x AS ident, list_position(w, x) - 1 AS pos FROM (SELECT item_id, w, unnest(list_distinct(w)) AS x FROM (SELECT item_id, list_filter({D.words('text')}, lambda x: length(x) >= 6) AS w FROM benchmark)))"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    found = F.filter(T.words(F.col("text")), lambda w: F.length(w) >= 6)
    rows = read(spark, sf, "benchmark").select("item_id", F.posexplode(found).alias("pos", "ident"))
    return rows.groupBy("item_id", "ident").agg(F.min("pos").cast("long").alias("pos"))


def _by_names_sql(names: str, order: str) -> str:
    return f"""WITH {_NAMES}, {_ASKED}, m AS (SELECT item_id, chunk_id, count(DISTINCT ident) AS matched, min(a.pos) AS first FROM asked_n a JOIN {names} USING (ident) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) - 1 AS rank FROM m) SELECT item_id, chunk_id, matched, rank FROM r WHERE rank < 48"""


@query(_by_names_sql("defs", "matched DESC, first, chunk_id"))
def chunks_defining(spark: SparkSession, sf: str) -> DataFrame:
    defs, _ = _names(spark, sf)
    return R.by_names(defs.drop("pos"), _asked(spark, sf), "item_id", "chunk_id").select("item_id", "chunk_id", "matched", F.col("rank").cast("long").alias("rank"))


@query(_by_names_sql("refs", "matched DESC, chunk_id"))
def chunks_referencing(spark: SparkSession, sf: str) -> DataFrame:
    _, refs = _names(spark, sf)
    return R.by_names(refs.drop("pos"), _asked(spark, sf), "item_id", "chunk_id", first_name=False).select("item_id", "chunk_id", "matched", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_NAMES}, {_ASKED}, c AS (SELECT ident, count(*) AS n FROM defs GROUP BY 1) SELECT item_id, ident, coalesce(n, 0) AS n FROM asked_n LEFT JOIN c USING (ident)")
def definition_counts(spark: SparkSession, sf: str) -> DataFrame:
    defs, _ = _names(spark, sf)
    counted = defs.groupBy("ident").agg(F.count("*").alias("n"))
    return _asked(spark, sf).join(counted, "ident", "left").select("item_id", "ident", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_NAMES} SELECT ident, chunk_id FROM refs")
def inverted_refs(spark: SparkSession, sf: str) -> DataFrame:
    _, refs = _names(spark, sf)
    chunks = refs.groupBy("chunk_id").agg(F.collect_list("ident").alias("names"))
    return I.inverted(chunks, "names")


_SEEDS = "seeds AS (SELECT item_id, doc_id AS chunk_id, rank FROM ranked WHERE rank < 3)"


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 3).select("item_id", F.col("doc_id").alias("chunk_id"), "rank")


_CALLEES = """own AS (SELECT DISTINCT item_id, ident FROM seeds JOIN defs USING (chunk_id)),
used AS (SELECT DISTINCT item_id, ident FROM (SELECT item_id, ident, row_number() OVER (PARTITION BY item_id, chunk_id ORDER BY pos) AS n FROM seeds JOIN refs USING (chunk_id) WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.item_id = seeds.item_id AND o.ident = refs.ident)) WHERE n <= 6),
clear AS (SELECT ident, chunk_id FROM (SELECT *, count(*) OVER (PARTITION BY ident) AS d FROM defs) WHERE d <= 3),
callees AS (SELECT item_id, ident, c.chunk_id FROM used JOIN clear c USING (ident) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.item_id = used.item_id AND s.chunk_id = c.chunk_id))"""
_CALLERS = """mine AS (SELECT DISTINCT item_id, ident FROM (SELECT item_id, ident, row_number() OVER (PARTITION BY item_id, chunk_id ORDER BY ident) AS n FROM seeds JOIN defs USING (chunk_id)) WHERE n <= 4),
few AS (SELECT ident, chunk_id FROM (SELECT ident, chunk_id, row_number() OVER (PARTITION BY ident ORDER BY chunk_id) AS n FROM refs) WHERE n <= 4),
callers AS (SELECT item_id, ident, f.chunk_id FROM mine JOIN few f USING (ident) WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.item_id = mine.item_id AND s.chunk_id = f.chunk_id))"""


@query(f"{_RETRIEVAL}, {_NAMES}, {_SEEDS}, {_CALLEES} SELECT item_id, ident, chunk_id FROM callees")
def callees(spark: SparkSession, sf: str) -> DataFrame:
    defs, refs = _names(spark, sf)
    return X.callees(_seeds(spark, sf), refs, defs.drop("pos"), "item_id")


@query(f"{_RETRIEVAL}, {_NAMES}, {_SEEDS}, {_CALLERS} SELECT item_id, ident, chunk_id FROM callers")
def callers(spark: SparkSession, sf: str) -> DataFrame:
    defs, refs = _names(spark, sf)
    return X.callers(_seeds(spark, sf), refs, defs.drop("pos"), "item_id")


_RELATED = f"""{_RETRIEVAL}, {_NAMES}, {_SEEDS}, {_CALLEES}, {_CALLERS},
sides AS (SELECT item_id, chunk_id, 0 AS side, row_number() OVER (PARTITION BY item_id ORDER BY ident, chunk_id) AS i FROM callees UNION ALL SELECT item_id, chunk_id, 1, row_number() OVER (PARTITION BY item_id ORDER BY ident, chunk_id) FROM callers),
items AS (SELECT item_id, list({{'chunk_id': chunk_id, 'path': source, 's': chunk_id // 40 * 40, 'e': chunk_id // 40 * 40 + 45}} ORDER BY i, side) AS f FROM sides JOIN documents ON doc_id = chunk_id GROUP BY 1)"""


@query(f"""{_RELATED.replace('WITH ', 'WITH RECURSIVE ', 1)},
w AS (SELECT item_id, 0 AS k, f[1:0] AS acc, f FROM items UNION ALL
 SELECT item_id, k + 1, CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda y: y.path = f[k + 1].path)) >= 2 OR len(list_filter(acc, lambda y: y.path = f[k + 1].path AND y.s <= f[k + 1].e AND f[k + 1].s <= y.e)) > 0 THEN acc ELSE list_append(acc, f[k + 1]) END, f FROM w WHERE k < len(f))
SELECT item_id, list_transform(acc, lambda y: y.chunk_id) AS related FROM w WHERE k = len(f)""")
def related_merge(spark: SparkSession, sf: str) -> DataFrame:
    defs, refs = _names(spark, sf)
    seeds, plain = stored(_seeds(spark, sf), "seeds"), defs.drop("pos")
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("ident", "chunk_id"))
    sides = X.callees(seeds, refs, plain, "item_id").select("item_id", "chunk_id", F.lit(0).alias("side"), nth.alias("i"))
    sides = sides.unionByName(X.callers(seeds, refs, plain, "item_id").select("item_id", "chunk_id", F.lit(1).alias("side"), nth.alias("i")))
    placed = sides.join(read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path")), "chunk_id")
    span = F.struct("chunk_id", "path", F.expr("chunk_id div 40 * 40").alias("start"), F.expr("chunk_id div 40 * 40 + 45").alias("end"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("i", "side", span.alias("x")))), lambda y: y["x"])
    return placed.groupBy("item_id").agg(items.alias("f")).select("item_id", F.transform(X.accept(F.col("f")), lambda y: y["chunk_id"]).alias("related"))


@query("""WITH m AS (SELECT item_id, CASE item_id % 2 WHEN 0 THEN concat(item_id, '.md') ELSE concat('en/', item_id, '.md') END AS mention FROM benchmark),
f AS (SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.md') AS path FROM documents)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY path) - 1 AS rank FROM m JOIN f ON path = mention OR ends_with(path, concat('/', mention))""")
def path_signal(spark: SparkSession, sf: str) -> DataFrame:
    mention = F.expr("CASE item_id % 2 WHEN 0 THEN concat(item_id, '.md') ELSE concat('en/', item_id, '.md') END")
    asked = read(spark, sf, "benchmark").select("item_id", mention.alias("m"), F.element_at(F.split(mention, "/"), -1).alias("base"))
    files = S.files(spark, sf).withColumn("base", F.element_at(F.split("path", "/"), -1))
    hits = files.join(asked, "base").filter((F.col("path") == F.col("m")) | F.endswith("path", F.concat(F.lit("/"), F.col("m"))))
    return hits.select("item_id", "doc_id", (F.row_number().over(Window.partitionBy("item_id").orderBy("path")) - 1).cast("long").alias("rank"))


_GOLD = "gold AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _gold(spark: SparkSession, sf: str, index: I.Index | None = None) -> DataFrame:
    """(item_id, doc_id) of documents that contain an item: pairs that share the item's rarest term, then the whole text.

    Items without a term that a document must hold (two words or fewer, or none of two letters) are held against every document.
    """
    items, docs = read(spark, sf, "benchmark").select("item_id", "text"), read(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    index = index or _index(spark, sf)
    # The first and last words of an item may be cut off inside a longer word of the document.
    inner = F.expr("slice(_w, 2, greatest(size(_w) - 2, 0))")
    texts = items.filter("text IS NOT NULL").select("text").distinct().withColumn("_w", T.words(F.col("text")))
    asked = stored(texts.select("text", F.array_distinct(F.flatten(F.transform(inner, lambda w: T.terms(w)))).alias("terms")), "inner")
    rarest = Window.partitionBy("text").orderBy("df", "term")
    known = asked.select("text", F.explode("terms").alias("term")).join(index.term_df, "term")
    chosen = known.withColumn("_n", F.row_number().over(rarest)).filter("_n = 1").select("text", "term")
    pairs = I.met(chosen, index).select("text", F.col("doc_id").alias("_id"))
    found = pairs.join(docs, F.col("doc_id").eqNullSafe(F.col("_id"))).filter(F.contains("body", F.col("text"))).select("text", "doc_id")
    bare = asked.filter(F.size("terms") == 0).select("text")
    if not bare.isEmpty():
        found = found.unionByName(docs.join(bare, F.contains("body", F.col("text"))).select("text", "doc_id"))
    return found.join(items, "text").select("item_id", "doc_id")


@query(f"WITH {_GOLD} SELECT item_id, doc_id FROM gold")
def gold_match(spark: SparkSession, sf: str) -> DataFrame:
    return _gold(spark, sf)


_METRICS = """hits AS (SELECT g.item_id, g.doc_id, r.rank FROM gold g LEFT JOIN ranked r ON r.item_id = g.item_id AND r.doc_id = g.doc_id),
per_item AS (SELECT item_id, count(*) FILTER (WHERE rank < 10) AS found, count(*) AS golds, min(rank) AS first FROM hits GROUP BY 1)
SELECT count(*) AS items, round(avg(found / 10.0), 6) AS p_at_10, round(avg(CASE WHEN found > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10,
 round(avg(coalesce(1.0 / (first + 1), 0.0)), 6) AS mrr, round(avg(found * 1.0 / golds), 6) AS r_at_10 FROM per_item"""


@query(f"{_WHOLE}, {_GOLD}, {_METRICS}")
def mrr_hit_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What is named after the first ten looks at those; the reciprocal rank is that of the whole list."""
    from spanlens.operators.evalx import ranking_metrics

    index = _index(spark, sf)
    return ranking_metrics(_whole(spark, sf, index), _gold(spark, sf, index), "item_id", "doc_id", whole=True)


_NORMAL = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9_''`@\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ')"


@query(f"""WITH d AS (SELECT doc_id, text AS body, {_NORMAL.format("text")} AS nb FROM documents), b AS (SELECT item_id, text, {_NORMAL.format("text")} AS nt FROM benchmark)
SELECT doc_id, item_id, body = text AS exact FROM d JOIN b ON contains(nb, nt)""")
def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("body"), T.normalise_task(F.col("text")).alias("nb"))
    items = read(spark, sf, "benchmark").select("item_id", "text", T.normalise_task(F.col("text")).alias("nt"))
    pairs = leakage.sharing_rarest(docs, items, "doc_id", "item_id", "nb", "nt")
    both = pairs.join(docs, "doc_id").join(items, "item_id").filter(F.contains("nb", F.col("nt")))
    return both.select("doc_id", "item_id", (F.col("body") == F.col("text")).alias("exact"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts to shaped spans: chunks, BM25 over them, a second list by names, fusion, the ten best merged spans within a budget of lines.

    Both lists, and what is fused and merged, are whole.
    """
    files = S.files(spark, sf)
    chunks = C.chunk_text(files, "doc_id", cfg=SMALL).join(files.select("doc_id", "path"), "doc_id")
    chunks = stored(chunks.withColumn("chunk_id", F.concat_ws(":", "doc_id", "start_line")), "chunks")
    index = I.written_for(chunks, read(spark, sf, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("term")), "chunk_id", "chunk")
    lexical = R.whole(_prepared(spark, sf, None), index, "item_id", "chunk_id")
    names = chunks.select("chunk_id", F.array_distinct(F.filter(T.words(F.col("chunk")), lambda w: F.length(w) >= 6)).alias("n"))
    named = R.by_names(I.inverted(names, "n"), _asked(spark, sf), "item_id", "chunk_id", limit=None)
    fused = R.rrf([lexical, named], "item_id", "chunk_id").join(chunks.select("chunk_id", "path", "start_line", "end_line"), "chunk_id")
    spans = fused.select("item_id", "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.col("fused").alias("score"))
    return H.shape_spans(spans, "item_id").select("item_id", "path", "start", "end", F.round("score", 6).alias("score"))


@query()
def retrieve_spans(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)
