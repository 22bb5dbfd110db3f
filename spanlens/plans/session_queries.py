"""Session state over `conversations` (prompts) and `events` (tool calls and resets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions import text as T
from spanlens.functions import vocab
from spanlens.operators import session as S
from spanlens.plans import duck as D
from spanlens.plans.base import query, read
from spanlens.plans.text_queries import FOLLOWING, FOLLOWS


@query(f"""WITH f AS (SELECT conv_id, turn, text, len(list_distinct({D.content_terms('text')})) < 4 OR list_has_any(list_transform({D.words('text')}, lambda w: lower(w)), {D.in_list(vocab.BACK_REFERENCES)}) AS fu,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(last_value(CASE WHEN k = 1 OR NOT fu THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS topic FROM f""")
def session_topic(spark: SparkSession, sf: str) -> DataFrame:
    prompts = read(spark, sf, "conversations").filter("role = 'user'")
    return S.topics(prompts, "conv_id", "turn", "text", T.is_follow_up(F.col("text"))).select("conv_id", "turn", F.md5("topic").alias("topic"))


_RESULTS = "r AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS span, value FROM events WHERE event_type IN ('view', 'click'))"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").filter("event_type in ('view', 'click')").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("span"), "value", "ts", "event_id")


@query(f"WITH {_RESULTS}, b AS (SELECT user_id, span, max(value) AS value FROM r GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, span) - 1 AS place FROM b) SELECT user_id, span, value, place FROM p WHERE place < 40")
def working_set(spark: SparkSession, sf: str) -> DataFrame:
    return S.working_set(_results(spark, sf), "user_id", ["span"], "value").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_RESULTS}, b AS (SELECT user_id, span, max(value) AS value FROM r GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, span) - 1 AS place FROM b) SELECT user_id, list(span ORDER BY place) AS spans FROM p WHERE place < 5 GROUP BY 1")
def handoff_top5(spark: SparkSession, sf: str) -> DataFrame:
    top = S.working_set(_results(spark, sf), "user_id", ["span"], "value", 5)
    return top.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "span"))), lambda x: x["span"]).alias("spans"))


@query("SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reads FROM events WHERE event_type = 'view'")
def read_counts(spark: SparkSession, sf: str) -> DataFrame:
    views = read(spark, sf, "events").filter("event_type = 'view'")
    return S.read_counts(views, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "reads")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM events)
SELECT user_id, event_id, epoch, epoch = max(epoch) OVER (PARTITION BY user_id) AS current FROM e""")
def context_epoch(spark: SparkSession, sf: str) -> DataFrame:
    return S.epochs(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup").select("user_id", "event_id", "epoch", "current")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM events), c AS (SELECT *, epoch = max(epoch) OVER (PARTITION BY user_id) AS cur FROM e)
SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS span FROM c WHERE cur AND event_type IN ('view', 'purchase')""")
def already_set(spark: SparkSession, sf: str) -> DataFrame:
    marked = S.epochs(read(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return marked.filter("current and event_type in ('view', 'purchase')").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("span")).distinct()


@query("WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY last DESC) - 1 AS age FROM l) SELECT user_id, last FROM r WHERE age < 256")
def lru_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("last")).orderBy(F.desc("last")).limit(S.SESSIONS)


@query("WITH r AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS span, max(event_id) AS event_id FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, span) - 1 AS age FROM r) SELECT user_id, span, age FROM k WHERE age < 200")
def sent_newest(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("span"), "event_id")
    return S.newest(rows, "user_id", ["span"], "event_id").select("user_id", "span", F.col("age").cast("long").alias("age"))


@query("WITH m AS (SELECT event_id, epoch_us(ts) // 1000000 AS stored, event_id % 3 * 40000 AS ttl FROM events) SELECT event_id, ttl FROM m WHERE ttl = 0 OR stored + ttl > (SELECT max(stored) - 1000000 FROM m)")
def memo_ttl(spark: SparkSession, sf: str) -> DataFrame:
    entries = read(spark, sf, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("stored"), (F.col("event_id") % 3 * 40000).alias("ttl"))
    now = entries.agg((F.max("stored") - 1_000_000).alias("now"))  # one row
    return S.alive(entries.crossJoin(F.broadcast(now)), F.col("now")).select("event_id", "ttl")


@query("WITH c AS (SELECT concat(user_id % 4, ':', json_extract_string(props, '$.k')) AS key, min(round(value, 5)) AS p FROM events WHERE event_type = 'view' GROUP BY 1), q AS (SELECT event_id, concat(user_id % 4, ':', json_extract_string(props, '$.k')) AS key FROM events WHERE event_type = 'error') SELECT event_id, p, p IS NOT NULL AS hit FROM q LEFT JOIN c USING (key)")
def memo_hits(spark: SparkSession, sf: str) -> DataFrame:
    keyed = read(spark, sf, "events").withColumn("key", F.concat_ws(":", (F.col("user_id") % 4).cast("string"), F.get_json_object("props", "$.k")))
    cache = keyed.filter("event_type = 'view'").groupBy("key").agg(F.min(F.round("value", 5)).alias("p"))
    return keyed.filter("event_type = 'error'").join(cache, "key", "left").select("event_id", "p", F.col("p").isNotNull().alias("hit"))


@query("""WITH n AS (SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS batch FROM events), s AS (SELECT user_id, batch, sum(value) AS c FROM n GROUP BY 1, 2),
r AS (SELECT *, round(sum(c) OVER (PARTITION BY user_id ORDER BY batch ROWS UNBOUNDED PRECEDING), 6) AS run FROM s) SELECT n.user_id, n.event_id, n.batch FROM n JOIN r ON n.user_id = r.user_id AND n.batch = r.batch WHERE run <= 250""")
def budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return S.budget_prefix(read(spark, sf, "events"), "user_id", ["ts", "event_id"], "value", 250.0).select("user_id", "event_id", "batch")


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE CAST(user_id AS VARCHAR) LIKE '1%') SELECT user_id, event_id, event_type, k::INTEGER AS k FROM r WHERE k <= 5")
def trace_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return S.last_entries(read(spark, sf, "events"), "user_id", ["ts", "event_id"], 5, prefix="1").select("user_id", "event_id", "event_type", "k")


@query("SELECT conv_id, turn, substr(text, 1, 4000) AS prompt, length(text) AS chars, turn > 0 AS later FROM conversations WHERE role = 'user'")
def capture_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations").filter("role = 'user'")
    return rows.select("conv_id", "turn", F.substring("text", 1, 4000).alias("prompt"), F.length("text").cast("long").alias("chars"), (F.col("turn") > 0).alias("later"))


@query("SELECT event_type AS event, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_trace(spark: SparkSession, sf: str) -> DataFrame:
    from spanlens.streaming import trace

    return trace.totals(spark, f"{sf}/events.parquet")


@query(f"WITH {D.POSTINGS} SELECT term, df FROM term_df")
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    from spanlens.streaming import indexing

    return indexing.index_stream(spark, f"{sf}/documents.parquet", "doc_id")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, count(*) AS seen FROM e GROUP BY 1""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    from spanlens.streaming import sessions

    return sessions.session_counts(spark, f"{sf}/events.parquet")


@query(f"""WITH f AS (SELECT conv_id, turn, {FOLLOWING} AS text, {FOLLOWS} AS fu, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN (conv_id + turn) % 3 = 1 THEN concat(chr(10), 'parse_config src/walk.rs') ELSE '' END AS names FROM conversations WHERE role = 'user'),
t AS (SELECT *, last_value(CASE WHEN k = 1 OR NOT fu THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS topic FROM f)
SELECT conv_id, turn, md5(CASE WHEN k = 1 OR NOT fu THEN text ELSE concat(topic, names) END) AS query FROM t""")
def effective_query(spark: SparkSession, sf: str) -> DataFrame:
    """What is searched for each prompt: follow-ups are their topic and the names they add."""
    prompts = read(spark, sf, "conversations").filter("role = 'user'").withColumn("text", F.expr(FOLLOWING))
    found = S.effective_queries(prompts, "conv_id", "turn", "text", T.is_follow_up(F.col("text")), T.named(F.col("text")))
    return found.select("conv_id", "turn", F.md5("query").alias("query"))


# Events as a session's: views are results, purchases spans that were sent, clicks reads (whole or in part), signups resets.
_EVENT = """e AS (SELECT user_id, epoch_us(ts) * 1000 + event_id % 1000 AS seq, CASE event_type WHEN 'view' THEN 'result' WHEN 'purchase' THEN 'sent' WHEN 'click' THEN 'read' WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'compact' ELSE 'clear' END END AS kind,
 concat('f', k % 7) AS path, k::INTEGER AS "start", (k + 5)::INTEGER AS "end", value AS score, k % 2 = 0 AS whole, k * 10 AS tokens FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type <> 'error')"""


def _session_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "view", "result").when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "click", "read").otherwise(F.when(k % 3 == 0, "compact").otherwise("clear"))
    seq = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    none = lambda c: F.lit(None).cast(c)
    return events.filter("event_type <> 'error'").select(
        "user_id", seq.alias("seq"), kind.alias("kind"), none("string").alias("text"), none("boolean").alias("follow_up"), none("string").alias("names"), F.concat(F.lit("f"), k % 7).alias("path"),
        k.cast("int").alias("start"), (k + 5).cast("int").alias("end"), F.col("value").alias("score"), (k % 2 == 0).alias("full"), (k * 10).alias("tokens"),
    )


@query(f"""WITH {_EVENT}, w AS (SELECT user_id, path, "start", "end", max(score) AS score FROM e WHERE kind = 'result' GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, path, "start", "end") - 1 AS place FROM w),
r AS (SELECT user_id, max(seq) AS since FROM e WHERE kind IN ('clear', 'compact') GROUP BY 1), n AS (SELECT e.* FROM e LEFT JOIN r USING (user_id) WHERE seq > coalesce(since, 0)),
s AS (SELECT user_id, path, "start", "end", min(seq) AS seq FROM n WHERE kind = 'sent' GROUP BY ALL), f AS (SELECT DISTINCT user_id, path FROM n WHERE kind = 'read' AND whole),
a AS (SELECT user_id, path, "start", "end", 0 AS late, seq FROM s UNION ALL SELECT user_id, path, 1, 2147483647, 1, 0 FROM f)
SELECT user_id, 'working' AS kind, place::INTEGER AS place, path, "start", "end", score FROM p
UNION ALL SELECT user_id, 'already', (row_number() OVER (PARTITION BY user_id ORDER BY late, seq, path) - 1)::INTEGER, path, "start", "end", NULL FROM a""")
def stream_session_states(spark: SparkSession, sf: str) -> DataFrame:
    """Working sets, whole, and all that is in each session's context, as the stream of events leaves them."""
    from spanlens.streaming import common, state

    out = state.session_states(_session_events(common.table_stream(spark, f"{sf}/events.parquet")).drop("tokens"), "user_id", working=None, sent=None)
    one = lambda kind: state.answers(spark, out, "user_id", kind).select("user_id", F.lit(kind).alias("kind"), F.posexplode("spans").alias("place", "s"))
    return one("working").unionByName(one("already")).select("user_id", "kind", "place", "s.*")


@query(f"""WITH RECURSIVE {_EVENT}, c AS (SELECT user_id, seq AS since FROM e WHERE kind = 'compact'),
b AS (SELECT user_id, since, path, "start", "end", max(score) AS score, max(tokens) AS tokens FROM c JOIN e USING (user_id) WHERE kind = 'result' AND seq < since GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, since ORDER BY score DESC, path, "start", "end") - 1 AS place FROM b QUALIFY place < 8),
l AS (SELECT user_id, since, list({{'place': place, 'path': path, 's': "start", 'e': "end", 'score': score, 'tokens': tokens}} ORDER BY place) AS xs FROM p GROUP BY 1, 2),
w(user_id, since, k, used, kept, xs) AS (SELECT user_id, since, 0, 0::BIGINT, xs[1:0], xs FROM l UNION ALL SELECT user_id, since, k + 1, CASE WHEN used + xs[k + 1].tokens <= 800 THEN used + xs[k + 1].tokens ELSE used END,
 CASE WHEN used + xs[k + 1].tokens <= 800 THEN list_append(kept, xs[k + 1]) ELSE kept END, xs FROM w WHERE k < len(xs)), o AS (SELECT user_id, since, unnest(kept) AS x FROM w WHERE k = len(xs))
SELECT user_id, since AS seq, x.place::INTEGER AS place, x.path AS path, x.s AS "start", x.e AS "end", x.score AS score FROM o""")
def shown_again(spark: SparkSession, sf: str) -> DataFrame:
    """The best spans so far after each compaction, within two thirds of 1,200 tokens."""
    events = _session_events(read(spark, sf, "events"))
    return S.shown_again(events, "user_id", "seq", F.col("kind") == "compact", F.col("kind") == "result", ["path", "start", "end"], "score", "tokens", 1_200)


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events")
def rotated_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events written to a rotating log in four parts, and followed by a stream that began after the first."""
    from spanlens.sources import records
    from spanlens.sources.store import work_folder

    log, out, state = records.RotatingLog(spark, work_folder(spark, "log"), max_bytes=100_000, keep=1_000), work_folder(spark, "followed"), work_folder(spark, "followed-state")
    events = read(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    for part in range(4):
        log.append(events.filter(F.col("event_id") % 4 == part), tag=str(part))
        if part in (0, 3):
            put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
            log.follow(events.schema).writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT event_type AS event, count(*) AS calls, count(DISTINCT user_id) AS sessions, count(*) FILTER (WHERE value < 5) AS failures, round(sum(value), 4) AS total, round(max(value), 6) AS longest FROM events GROUP BY 1""")
def trace_summary(spark: SparkSession, sf: str) -> DataFrame:
    """What a log holds of each kind of event."""
    from spanlens.sources import records

    found = records.summary(read(spark, sf, "events"), "event_type", "user_id", "value", F.col("value") < 5)
    return found.select(F.col("event_type").alias("event"), "calls", "sessions", "failures", F.round("total", 4).alias("total"), F.round("longest", 6).alias("longest"))
