"""Line ranges over the driver's tables: line items are what sessions (suppliers) read of files, and what they were shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.operators import ranges as R
from spanlens.plans.base import query, read

_NEAR = 10
# A line item of odd number is a read, one of even number something that was shown; both are lines lo to hi of a file.
_ITEM = """l_suppkey AS session, concat('f', l_partkey % 20) AS path, l_orderkey AS o, l_linenumber AS n, l_orderkey % 50 AS turn, (l_orderkey % 400 + 1)::INTEGER AS lo,
 (l_orderkey % 400 + l_quantity)::INTEGER AS hi, CASE l_returnflag WHEN 'R' THEN 'inlined' WHEN 'A' THEN 'mapped' ELSE 'related' END AS kind, (l_partkey % 10 + 1)::INTEGER AS rank,
 floor(l_extendedprice / 100)::BIGINT AS tokens, (l_orderkey % 7)::DOUBLE AS seconds"""
_SRC = f"""src AS (SELECT row_number() OVER () AS id, {_ITEM} FROM lineitem), r AS (SELECT * FROM src WHERE n % 2 = 1), s AS (SELECT * FROM src WHERE n % 2 = 0),
gold AS (SELECT DISTINCT l_suppkey AS session, concat('f', l_orderkey % 25) AS path FROM lineitem WHERE l_discount = 0.1)"""


def _source(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("session"),
        F.concat(F.lit("f"), F.col("l_partkey") % 20).alias("path"),
        F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("n"),
        (F.col("l_orderkey") % 50).alias("turn"),
        (F.col("l_orderkey") % 400 + 1).cast("int").alias("lo"),
        (F.col("l_orderkey") % 400 + F.col("l_quantity")).cast("int").alias("hi"),
        F.when(F.col("l_returnflag") == "R", "inlined").when(F.col("l_returnflag") == "A", "mapped").otherwise("related").alias("kind"),
        (F.col("l_partkey") % 10 + 1).cast("int").alias("rank"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("tokens"),
        (F.col("l_orderkey") % 7).cast("double").alias("seconds"),
    )


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf).filter("n % 2 = 1").drop("kind", "rank")


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf).filter("n % 2 = 0").select("session", "path", "kind", "lo", "hi", "rank", "tokens")


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").filter("l_discount = 0.1").select(F.col("l_suppkey").alias("session"), F.concat(F.lit("f"), F.col("l_orderkey") % 25).alias("path")).distinct()


@query(f"""WITH {_SRC}, a AS (SELECT DISTINCT session, path, unnest(range(lo, hi + 1)) AS line FROM r), b AS (SELECT DISTINCT session, path, unnest(range(lo, hi + 1)) AS line FROM s),
u AS (SELECT session, path, line, a.line IS NOT NULL AS x, b.line IS NOT NULL AS y FROM a FULL JOIN b USING (session, path, line)),
i AS (SELECT *, line - row_number() OVER (PARTITION BY session, path ORDER BY line) AS island FROM u)
SELECT session, path, count(*) FILTER (WHERE x)::INTEGER AS reads, count(*) FILTER (WHERE y)::INTEGER AS shown, count(*) FILTER (WHERE x AND y)::INTEGER AS both, count(*) FILTER (WHERE x AND NOT y)::INTEGER AS unseen,
 count(*)::INTEGER AS either, count(DISTINCT island)::INTEGER AS pieces FROM i GROUP BY 1, 2""")
def range_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Sets of what a session read of each file and was shown of it, and what their algebra says."""
    reads, shown = R.merged(_reads(spark, sf), ["session", "path"], out="r"), R.merged(_shown(spark, sf), ["session", "path"], out="s")
    both = reads.join(shown, ["session", "path"], "full").withColumn("r", F.coalesce("r", R.none())).withColumn("s", F.coalesce("s", R.none())).withColumn("u", R.union(F.col("r"), F.col("s")))
    r, s = F.col("r"), F.col("s")
    return both.select("session", "path", R.measure(r).alias("reads"), R.measure(s).alias("shown"), R.measure(R.intersect(r, s)).alias("both"), R.measure(R.subtract(r, s)).alias("unseen"), R.measure(F.col("u")).alias("either"), F.size("u").alias("pieces"))


_LINES = f"""{_SRC}, inl AS (SELECT DISTINCT session, path, unnest(range(lo, hi + 1)) AS line FROM s WHERE kind = 'inlined'), near AS (SELECT DISTINCT session, path, unnest(range(lo - {_NEAR}, hi + {_NEAR} + 1)) AS line FROM s WHERE kind = 'inlined'),
listed AS (SELECT DISTINCT session, path, unnest(range(lo, hi + 1)) AS line FROM s WHERE kind <> 'inlined'), files AS (SELECT DISTINCT session, path FROM s),
l AS (SELECT id, session, path, o, n, unnest(range(lo, hi + 1)) AS line FROM r),
c AS (SELECT id, session, path, o, n, line, CASE WHEN inl.line IS NOT NULL THEN 'redundant' WHEN near.line IS NOT NULL THEN 'expansion' WHEN listed.line IS NOT NULL THEN 'map_hit' WHEN files.path IS NOT NULL THEN 'map_file' WHEN gold.path IS NOT NULL THEN 'gold_miss' ELSE 'other' END AS class
 FROM l LEFT JOIN inl USING (session, path, line) LEFT JOIN near USING (session, path, line) LEFT JOIN listed USING (session, path, line) LEFT JOIN files USING (session, path) LEFT JOIN gold USING (session, path))"""


@query(f"""WITH {_LINES} SELECT session, path, o, n, {', '.join(f"count(*) FILTER (WHERE class = '{k}')::INTEGER AS {k}" for k in ('redundant', 'expansion', 'map_hit', 'map_file', 'gold_miss', 'other'))} FROM c GROUP BY id, session, path, o, n""")
def read_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of every read by what was known of them."""
    found = R.read_classes(_reads(spark, sf), _shown(spark, sf), _gold(spark, sf), near=_NEAR)
    return found.select("session", "path", "o", "n", "redundant", "expansion", "map_hit", "map_file", "gold_miss", "other")


_SAVED = """SELECT session, count(*) AS turns, round(sum(tok), 4) AS tokens_saved, count(*) FILTER (WHERE least >= 0.8) AS turns_saved, sum(CASE WHEN least >= 0.8 THEN sec ELSE 0 END) AS seconds_saved"""


@query(f"""WITH {_LINES}, f AS (SELECT id, count(*) FILTER (WHERE class IN ('redundant', 'expansion')) / count(*)::DOUBLE AS f FROM c GROUP BY 1),
t AS (SELECT session, turn, min(f) AS least, sum(tokens * f) AS tok, max(seconds) AS sec FROM r JOIN f USING (id) GROUP BY 1, 2) {_SAVED} FROM t GROUP BY 1""")
def turns_removed(spark: SparkSession, sf: str) -> DataFrame:
    """What sessions would save if nothing shown in full, or next to it, were read again."""
    found = R.read_classes(_reads(spark, sf), _shown(spark, sf), _gold(spark, sf), near=_NEAR)
    saved = R.removed(found, R.class_fraction(["redundant", "expansion"]), ["session"])
    return saved.withColumn("tokens_saved", F.round("tokens_saved", 4))


@query(f"""WITH {_SRC}, ks AS (SELECT unnest([3, 5, 8, 10]) AS k), done AS (SELECT DISTINCT session, path, lo, hi FROM s WHERE kind = 'inlined'),
x AS (SELECT s.*, k FROM s JOIN ks ON rank <= k WHERE kind = 'mapped' AND rank > 3 AND NOT EXISTS (SELECT 1 FROM done d WHERE d.session = s.session AND d.path = s.path AND d.lo = s.lo AND d.hi = s.hi)),
e AS (SELECT DISTINCT session, k, path, unnest(range(lo, hi + 1)) AS line FROM x), a AS (SELECT session, k, sum(tokens)::BIGINT AS added FROM x GROUP BY 1, 2),
l AS (SELECT id, session, path, k, unnest(range(lo, hi + 1)) AS line FROM r, ks), f AS (SELECT id, k, count(e.line) / count(*)::DOUBLE AS f FROM l LEFT JOIN e USING (session, k, path, line) GROUP BY 1, 2),
t AS (SELECT session, k, turn, min(f) AS least, sum(tokens * f) AS tok, max(seconds) AS sec FROM r JOIN f USING (id) GROUP BY 1, 2, 3),
g AS ({_SAVED}, k FROM t GROUP BY session, k)
SELECT session, k, turns, tokens_saved, turns_saved, seconds_saved, coalesce(added, 0) AS tokens_added, round(coalesce(added, 0) * (3.75 + 0.3 * (greatest(turns - turns_saved, 1) - 1)) / 1e6, 6) AS cost_added FROM g LEFT JOIN a USING (session, k)""")
def inline_more(spark: SparkSession, sf: str) -> DataFrame:
    """What sessions would save, and pay, if more of the listed spans were shown in full."""
    found = R.inline_more(_reads(spark, sf), _shown(spark, sf), [3, 5, 8, 10])
    return found.withColumn("tokens_saved", F.round("tokens_saved", 4)).withColumn("cost_added", F.round("cost_added", 6))


@query(f"""WITH {_SRC} SELECT session, path, coalesce(['inlined', 'mapped', 'related'][min(CASE kind WHEN 'inlined' THEN 1 WHEN 'mapped' THEN 2 WHEN 'related' THEN 3 END)], 'absent') AS covered FROM gold LEFT JOIN s USING (session, path) GROUP BY 1, 2""")
def gold_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How each file that mattered to a session was shown, if it was."""
    return R.gold_coverage(_gold(spark, sf), _shown(spark, sf))


# A lookup is an order: its items are hits, those returned are in files that the answer named, those open are cited; another answer holds every second item's lines.
_LOOKUPS = """h AS (SELECT l_orderkey AS lookup, concat('f', l_suppkey % 4) AS path, (l_partkey % 60)::INTEGER AS line, l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem),
named AS (SELECT DISTINCT lookup, path FROM h WHERE l_returnflag = 'R'), cited AS (SELECT DISTINCT lookup, line FROM h WHERE l_linestatus = 'O'),
g AS (SELECT DISTINCT lookup, path, unnest(range(line, (line + l_quantity)::INTEGER)) AS line FROM h WHERE l_linenumber % 2 = 0), gf AS (SELECT DISTINCT lookup, path FROM h WHERE l_linenumber % 2 = 0),
m AS (SELECT h.lookup, h.path, named.path IS NOT NULL AS nm, cited.line IS NOT NULL AS ci, (g.line IS NOT NULL)::INTEGER AS have FROM h LEFT JOIN named USING (lookup, path) LEFT JOIN cited ON cited.lookup = h.lookup AND cited.line = h.line LEFT JOIN g ON g.lookup = h.lookup AND g.path = h.path AND g.line = h.line),
o AS (SELECT lookup, bool_or(nm) AS any_named FROM m GROUP BY 1), us AS (SELECT m.*, any_named FROM m JOIN o USING (lookup) WHERE nm OR NOT any_named),
l AS (SELECT lookup, count(*) AS n_used, avg(have) AS line_cov, avg(have) FILTER (WHERE ci) AS cited_cov FROM us GROUP BY 1),
w AS (SELECT DISTINCT us.lookup, us.path, gf.path IS NOT NULL AS got FROM us LEFT JOIN gf ON gf.lookup = us.lookup AND gf.path = us.path), f AS (SELECT lookup, avg(got::INTEGER) AS file_cov FROM w GROUP BY 1),
cov AS (SELECT * FROM l JOIN f USING (lookup))"""


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    items = read(spark, sf, "lineitem").withColumns({"lookup": F.col("l_orderkey"), "path": F.concat(F.lit("f"), F.col("l_suppkey") % 4), "line": (F.col("l_partkey") % 60).cast("int")})
    got = items.filter("l_linenumber % 2 = 0").select("lookup", "path", F.col("line").alias("lo"), (F.col("line") + F.col("l_quantity") - 1).cast("int").alias("hi"))
    return R.lookup_coverage(items, items.filter("l_returnflag = 'R'"), items.filter("l_linestatus = 'O'"), got)


@query(f"WITH {_LOOKUPS} SELECT lookup, n_used, round(line_cov, 6) AS line_cov, round(cited_cov, 6) AS cited_cov, round(file_cov, 6) AS file_cov FROM cov")
def lookup_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """What another answer holds of the lines and files that were used of each lookup."""
    return _covered(spark, sf).select("lookup", "n_used", *(F.round(c, 6).alias(c) for c in ("line_cov", "cited_cov", "file_cov")))


@query(f"""WITH {_LOOKUPS} SELECT o_orderpriority AS intent, count(*) AS lookups, round(avg(line_cov), 6) AS line_cov, round(avg(cited_cov), 6) AS cited_cov, round(avg(file_cov), 6) AS file_cov,
 count(*) FILTER (WHERE coalesce(line_cov, 1) = 1 AND coalesce(file_cov, 1) = 1) AS "full" FROM cov JOIN orders ON o_orderkey = lookup GROUP BY 1""")
def lookup_coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    intents = read(spark, sf, "orders").select(F.col("o_orderkey").alias("lookup"), F.col("o_orderpriority").alias("intent"))
    found = R.coverage_report(_covered(spark, sf).join(intents, "lookup"), "intent")
    return found.select("intent", "lookups", *(F.round(c, 6).alias(c) for c in ("line_cov", "cited_cov", "file_cov")), "full")


@query(f"""WITH {_SRC}, k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY o, n) AS place FROM s WHERE kind = 'mapped' AND o % 25 = 0 OR kind <> 'mapped')
SELECT session, kind, path, lo, hi, CASE WHEN kind = 'mapped' THEN row_number() OVER (PARTITION BY session, kind ORDER BY place)::INTEGER END AS rank FROM k""")
def shown_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """What each session was shown, rendered as one block and parsed back to ranges."""
    rows = _source(spark, sf).filter("n % 2 = 0").filter("kind <> 'mapped' or o % 25 = 0")
    where = F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    said = {
        "inlined": F.concat(F.lit("### "), "path", F.lit(":"), where, F.lit(" — fn x\n```\n### not:1-2\n- a:1-2 — b\n```")),
        "mapped": F.concat(F.lit("7. "), "path", F.lit(" — "), where, F.lit(" name")),
        "related": F.concat(F.lit("- "), "path", F.lit(":"), where, F.lit(" name — calls it")),
    }
    body = lambda kind: F.array_join(F.transform(F.filter("xs", lambda x: x["kind"] == kind), lambda x: x[kind]), "\n")
    items = F.array_sort(F.collect_list(F.struct("o", "n", "kind", *(c.alias(k) for k, c in said.items()))))
    text = F.concat_ws("\n", F.lit("Intro"), body("inlined"), F.lit("Ranked locations:"), body("mapped"), F.lit("Related by references:"), body("related"))
    blocks = rows.groupBy("session").agg(items.alias("xs")).select("session", text.alias("text"))
    return blocks.select("session", F.inline(R.parse_shown(F.col("text"))))
