"""The state of sessions as a stream: topic, working set, what was sent, read counts, resets and idle sessions.

Rows go in as events of sessions and come out as what the session answers: the effective query
of a prompt, how often a file was read, what to show again after a compaction, and after
each micro-batch the session's working set and all that is in its context.  State is kept
between micro-batches and restarts, as a value and lists that run out with the session.  Each is
read once and written once for all events of a session in a micro-batch, as every call is a message
to the state store whatever it carries.  A session without events for `idle_ms` says so and is forgotten (this stands in for a bound on the
number of sessions, which no single key could keep).

Events: (session, seq, kind, text, follow_up, names, path, start, end, score, full), in order of seq
within a session across micro-batches.  Kinds: prompt (text, follow_up, names), result (a span
and its score), sent (a span), read (path, full), clear, compact.
Out: (session, seq, kind, text, count, spans).  Kinds: query (text), read (path in text, count), reinject
(spans), working (spans, best first), already (spans; a file read whole ends at `WHOLE`), idle.

The batch operators of `spanlens.operators.session` give the same for a table of all events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from spanlens.functions import text as T
from spanlens.operators.session import AGAIN, SENT, WHOLE, WORKING_SET
from spanlens.sources.store import work_folder

IDLE_MS = 30 * 24 * 3_600_000
EVENT = "seq long, kind string, text string, follow_up boolean, names string, path string, start int, end int, score double, full boolean"
SAID = "seq long, kind string, text string, count long, spans array<struct<path:string,start:int,end:int,score:double>>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Session(StatefulProcessor):
    """One session's state; `session` names the key column.

    working, sent: how many of the best spans and of the last sent ones are kept; None: all.
    """

    def __init__(self, session: str, idle_ms: int = IDLE_MS, working: int | None = WORKING_SET, sent: int | None = SENT):
        self.session, self.idle_ms, self.most_working, self.most_sent = session, idle_ms, working, sent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        span = "path string, start int, end int"
        self.topic = handle.getValueState("topic", "text string", self.idle_ms)
        self.sent = handle.getListState("sent", span, self.idle_ms)
        self.working = handle.getListState("working", f"{span}, score double", self.idle_ms)
        self.reads = handle.getListState("reads", "path string, count long, whole boolean", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((r for batch in rows for r in batch.itertuples(index=False)), key=lambda r: r.seq)
        said, out = self.topic.get(), []
        topic = said[0] if said is not None else None
        working = {tuple(s[:3]): s[3] for s in self.working.get()}
        sent = dict.fromkeys(tuple(s) for s in self.sent.get())  # in order of time
        reads, whole = {}, set()
        for path, n, full in self.reads.get():
            reads[path] = n
            if full:
                whole.add(path)
        kept = [(self.working, bool(working)), (self.sent, bool(sent)), (self.reads, bool(reads))]

        def say(seq, kind, text=None, count=None, spans=()) -> None:
            out.append((key[0], seq, kind, text, count, [dict(zip(("path", "start", "end", "score"), s, strict=True)) for s in spans]))

        for e in events:
            if e.kind == "prompt":
                if topic is not None and e.follow_up:
                    say(e.seq, "query", f"{topic}\n{e.names}" if e.names else topic)
                else:
                    topic = e.text
                    say(e.seq, "query", e.text)
            elif e.kind == "result":
                span = (e.path, int(e.start), int(e.end))
                if span not in working or e.score > working[span]:
                    working[span] = e.score
                if self.most_working is not None and len(working) > self.most_working:
                    working = dict(best(working, self.most_working))
            elif e.kind == "sent":
                span = (e.path, int(e.start), int(e.end))
                sent.setdefault(span)
                if self.most_sent is not None and len(sent) > self.most_sent:
                    del sent[next(iter(sent))]
            elif e.kind == "read":
                reads[e.path] = reads.get(e.path, 0) + 1
                if e.full:
                    whole.add(e.path)
                say(e.seq, "read", e.path, reads[e.path])
            elif e.kind in ("clear", "compact"):
                if e.kind == "compact" and working:
                    say(e.seq, "reinject", spans=[(*s, x) for s, x in best(working, AGAIN)])
                sent, whole = {}, set()
        last = int(events[-1].seq)
        say(last, "working", spans=[(*s, x) for s, x in best(working, self.most_working)])
        say(last, "already", spans=[(*s, None) for s in sent] + [(path, 1, WHOLE, None) for path in sorted(whole)])
        if topic is not None:
            self.topic.update((topic,))
        now = [[(*s, x) for s, x in working.items()], list(sent), [(path, n, path in whole) for path, n in reads.items()]]
        for (state, held), rows in zip(kept, now, strict=True):
            if rows:
                state.put(rows)
            elif held:
                state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.topic, self.sent, self.working, self.reads):
            state.clear()
        yield self._frame([(key[0], None, "idle", None, None, [])])

    def close(self) -> None:
        pass

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=[self.session, "seq", "kind", "text", "count", "spans"])
        return found.astype({"seq": "Int64", "count": "Int64"})


def best(spans: dict, most: int | None) -> list[tuple]:
    """The spans of the highest scores (None: all), equal ones in order of place."""
    return sorted(spans.items(), key=lambda s: (-s[1], s[0]))[:most]


def prompts(rows: DataFrame, session: str, seq: str, text: str) -> DataFrame:
    """Prompts as events: whether they lean on the topic and which names they add to it is said by expressions."""
    return rows.select(
        session, F.col(seq).cast("long").alias("seq"), F.lit("prompt").alias("kind"), F.col(text).alias("text"), T.is_follow_up(F.col(text)).alias("follow_up"), T.named(F.col(text)).alias("names"),
        *(F.lit(None).cast(kind).alias(c) for c, kind in (("path", "string"), ("start", "int"), ("end", "int"), ("score", "double"), ("full", "boolean"))),
    )


def states(events: DataFrame, session: str, idle_ms: int = IDLE_MS, working: int | None = WORKING_SET, sent: int | None = SENT) -> DataFrame:
    """What sessions answer to a stream of events."""
    kind = events.schema[session].dataType.simpleString()
    return events.groupBy(session).transformWithStateInPandas(Session(session, idle_ms, working, sent), f"`{session}` {kind}, {SAID}", "Update", "ProcessingTime")


def run(events: DataFrame, session: str, out: str, checkpoint: str, idle_ms: int = IDLE_MS, working: int | None = WORKING_SET, sent: int | None = SENT) -> None:
    """Works off what is there of a stream as one micro-batch, which writes its answers under its number, so that one that runs again overwrites itself.

    With timers by the clock there is always another micro-batch, so that a stream meant to go on is started from `states`.
    """
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        states(events, session, idle_ms, working, sent).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def answers(spark: SparkSession, out: str, session: str, kind: str) -> DataFrame:
    """All answers of a kind; of working and already the last one of each session."""
    rows = spark.read.parquet(out).filter(F.col("kind") == kind)
    if kind in ("working", "already"):
        last = F.max(F.struct("batch", "spans"))
        return rows.groupBy(session).agg(last.alias("l")).select(session, "l.spans")
    return rows.drop("kind", "batch")


def session_states(events: DataFrame, session: str, idle_ms: int = IDLE_MS, working: int | None = WORKING_SET, sent: int | None = SENT) -> str:
    """The folder of all answers to the events that a stream has now."""
    spark = events.sparkSession
    out = work_folder(spark, "states")
    run(events, session, out, work_folder(spark, "states-state"), idle_ms, working, sent)
    return out
