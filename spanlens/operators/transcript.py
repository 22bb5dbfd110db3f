"""Transcripts of agent sessions: JSON lines to calls, results and usage; turns, deltas and time.

A line is an event with a type (`assistant`, `user`, `result`), a time and a message whose content
is an array of blocks; tool calls and their results meet by id.  Lines that don't parse, or whose
blocks aren't arrays, give no rows.  Windows hold one session's events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>"
EVENT = (
    "type string, subtype string, session_id string, timestamp string, request_id string,"
    f" message struct<id:string,role:string,content:array<{BLOCK}>,usage:map<string,bigint>>,"
    " duration_ms bigint, total_cost_usd double, num_turns bigint, result string, usage map<string,bigint>"
)


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """The events of JSON lines, `at` their time in seconds; lines that don't parse are left out (`bad_lines` counts them)."""
    parsed = lines.withColumn("_e", F.from_json(line, EVENT, {"mode": "PERMISSIVE"})).filter(F.col("_e.type").isNotNull())
    rest = [c for c in lines.columns if c != line]
    return parsed.select(*rest, "_e.*").withColumn("at", F.unix_micros(F.to_timestamp("timestamp")) / 1e6)


def bad_lines(lines: DataFrame, line: str = "line") -> Column:
    """How many lines (to be aggregated) hold no event."""
    return F.count_if(F.from_json(line, EVENT, {"mode": "PERMISSIVE"})["type"].isNull())


def blocks(events: DataFrame) -> DataFrame:
    """A row for each content block of each event."""
    return events.filter("message.content is not null").select("*", F.posexplode("message.content").alias("block_no", "block"))


def turns(events: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, role, turn, text): what was said, the text blocks of an event joined."""
    said = F.filter("message.content", lambda b: b["type"] == "text")
    return events.filter(F.size(said) > 0).select(session, F.col("message.role").alias("role"), "at", F.array_join(F.transform(said, lambda b: b["text"]), "\n").alias("text"))


def calls(events: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, call_id, name, input, result, is_error, started, ended): tool calls with their results, null where none came."""
    every = blocks(events)
    used = every.filter("block.type = 'tool_use'").select(session, F.col("block.id").alias("call_id"), F.col("block.name").alias("name"), F.col("block.input").alias("input"), F.col("at").alias("started"))
    given = every.filter("block.type = 'tool_result'").select(session, F.col("block.tool_use_id").alias("call_id"), F.col("block.content").alias("result"), F.col("block.is_error").alias("is_error"), F.col("at").alias("ended"))
    return used.join(given, [session, "call_id"], "left")


def tool_calls(found: DataFrame, *by: str, name: str = "name") -> DataFrame:
    """(by, tool_calls): a map of how often each tool was called."""
    counted = found.groupBy(*by, name).agg(F.count("*").alias("_n"))
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_n")))).alias("tool_calls"))


def usage(events: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, component, tokens): usage by component, an API call counted once however many lines repeat it."""
    once = events.filter("type = 'assistant' and message.usage is not null").groupBy(session, F.coalesce("request_id", "message.id").alias("_call")).agg(F.max_by("message.usage", "at").alias("u"))
    return once.select(session, F.explode("u").alias("component", "tokens")).groupBy(session, "component").agg(F.sum("tokens").alias("tokens"))


def first_seen(rows: DataFrame, group: str, key: str, at: str) -> DataFrame:
    """(group, key, first, turn): keys by their first sight, numbered from 0 in that order."""
    seen = rows.groupBy(group, key).agg(F.min(at).alias("first"))
    return seen.withColumn("turn", F.dense_rank().over(Window.partitionBy(group).orderBy("first")) - 1)


def totals(rows: DataFrame, session: str, order: list[str], amount: str) -> DataFrame:
    """Adds `total`: the running sum of a session so far."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.round(F.sum(amount).over(w), 6))


def steps(rows: DataFrame, session: str, order: list[str], total: str = "total") -> DataFrame:
    """Adds `step`: what a running total grew by since the session's last row; the first row's is the total itself."""
    return rows.withColumn("step", F.col(total) - F.coalesce(F.lag(total).over(Window.partitionBy(session).orderBy(*order)), F.lit(0)))


def last_total(rows: DataFrame, session: str, order: list[str], total: str = "total") -> DataFrame:
    """(session, cost): the running total of the session's last row."""
    return rows.groupBy(session).agg(F.max_by(total, F.struct(*order)).alias("cost"))


def by_position(a: DataFrame, b: DataFrame, session: str, order: list[str], left: str, right: str) -> DataFrame:
    """(session, k, left, right): the k-th row of one log with the k-th of another; what is left over on either side drops out."""
    nth = F.row_number().over(Window.partitionBy(session).orderBy(*order))
    x, y = a.select(session, nth.alias("k"), F.col(left).alias("_l")), b.select(session, nth.alias("k"), F.col(right).alias("_r"))
    return x.join(y, [session, "k"]).select(session, "k", F.col("_l").alias(left), F.col("_r").alias(right))


def hit_turns(rows: DataFrame, session: str, turn: str, hit: Column, size: Column) -> DataFrame:
    """(session, first, last, tail, turns): first and last turn with a hit, and the size of all that came after the last."""
    marked = rows.withColumn("_h", F.when(hit, F.col(turn))).withColumn("_last", F.max("_h").over(Window.partitionBy(session)))
    tail = F.sum(F.when(F.col(turn) > F.col("_last"), size).otherwise(0))
    return marked.groupBy(session).agg(F.min("_h").alias("first"), F.max("_h").alias("last"), tail.alias("tail"), F.count("*").alias("turns"))


def gaps(events: DataFrame, session: str, order: list[str], at: str) -> DataFrame:
    """Adds `gap`: seconds since the session's event before; null for its first."""
    return events.withColumn("gap", F.col(at) - F.lag(at).over(Window.partitionBy(session).orderBy(*order)))


def time_split(events: DataFrame, session: str, kind: str, parts: dict[str, list[str]], gap: str = "gap", rest: str = "overhead") -> DataFrame:
    """(session, a column for each part, rest, wall): the wall time of a session by what its events were."""
    named = [k for ks in parts.values() for k in ks]
    cells = [F.sum(F.when(F.col(kind).isin(ks), F.col(gap)).otherwise(0)).alias(part) for part, ks in parts.items()]
    return events.groupBy(session).agg(*cells, F.sum(F.when(~F.col(kind).isin(named), F.col(gap)).otherwise(0)).alias(rest), F.sum(gap).alias("wall"))


def prompt_times(events: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, prompt, duration_s, tools_s, answer_s, lookups_s, lookup_calls) of each prompt of a session.

    A prompt ends with a `result` line.  The answer is the last API call, if there were more than one; tools
    are the calls' waits for results; lookups are what is left.
    """
    at_end = Window.partitionBy(session).orderBy("at", F.when(F.col("type") == "result", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("prompt", F.coalesce(F.count_if(F.col("type") == "result").over(at_end), F.lit(0)))
    before = Window.partitionBy(session, "prompt").orderBy("at")
    marked = marked.withColumn("_before", F.lag("at").over(before))
    call = F.coalesce("request_id", "message.id")
    api = marked.filter("type = 'assistant'").groupBy(session, "prompt", call.alias("_c")).agg(F.min_by("_before", "at").alias("_start"), F.max("at").alias("_end"))
    api = api.groupBy(session, "prompt").agg(F.count("*").alias("_n"), F.max_by(F.col("_end") - F.col("_start"), "_end").alias("_last"))
    waits = calls(marked.withColumn("_k", F.concat_ws(" ", F.col(session).cast("string"), F.col("prompt").cast("string"))), "_k")
    waits = waits.groupBy("_k").agg(F.sum(F.coalesce(F.col("ended") - F.col("started"), F.lit(0.0))).alias("tools_s"))
    ended = marked.filter("type = 'result'").select(session, "prompt", (F.col("duration_ms") / 1000).alias("duration_s"), F.concat_ws(" ", F.col(session).cast("string"), F.col("prompt").cast("string")).alias("_k"))
    all_ = ended.join(api, [session, "prompt"], "left").join(waits, "_k", "left").withColumn("tools_s", F.coalesce("tools_s", F.lit(0.0)))
    answer = F.when((F.col("_n") > 1) & F.col("_last").isNotNull(), F.col("_last")).otherwise(F.col("duration_s") - F.col("tools_s"))
    return all_.select(session, "prompt", "duration_s", "tools_s", answer.alias("answer_s"), (F.col("duration_s") - answer - F.col("tools_s")).alias("lookups_s"), F.greatest(F.coalesce("_n", F.lit(0)) - 1, F.lit(0)).alias("lookup_calls"))


def classify_lines(rows: DataFrame, classes: list[tuple[str, Column]], rest: str = "absent") -> DataFrame:
    """Adds `class`: the first class whose condition holds."""
    found = F.lit(rest)
    for name, holds in reversed(classes):
        found = F.when(holds, F.lit(name)).otherwise(found)
    return rows.withColumn("class", found)


def coverage(rows: DataFrame, session: str, covered: Column) -> DataFrame:
    """(size, cov, sessions): the mean covered fraction of sessions by how many lines they have."""
    per = rows.groupBy(session).agg(F.avg(covered.cast("double")).alias("_c"), F.count("*").alias("size"))
    return per.groupBy("size").agg(F.avg("_c").alias("cov"), F.count("*").alias("sessions"))


def removable(found: DataFrame, turn: str, fraction: Column, least: float = 0.8) -> DataFrame:
    """(turn, least, removable, calls): a turn could go only if each of its calls is covered far enough."""
    low = F.min(fraction)
    return found.groupBy(turn).agg(low.alias("least"), (low >= least).alias("removable"), F.count("*").alias("calls"))


def read_coverage(rows: DataFrame, session: str, file: str, lines: str, inlined: Column) -> DataFrame:
    """(session, files, inlined): files read and the part of the read lines that was shown before."""
    return rows.groupBy(session).agg(F.countDistinct(file).alias("files"), (F.sum(F.when(inlined, F.col(lines)).otherwise(0)) / F.sum(lines)).alias("inlined"))
