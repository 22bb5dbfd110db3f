"""Session state in a stream against plain Python and the batch operators, over several micro-batches and a restart."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanlens.functions import text as T
from spanlens.operators import session as S
from spanlens.streaming import state

EVENT = f"session string, {state.EVENT}"


def made(seed, n, sessions):
    rng = random.Random(seed)
    rows, seq = [], 0
    prompts = ["rewrite the tree walker so that nodes keep their order and names", "and tests?", "now the same for `grow_up` in src/walk.rs", "what about it", "explain how the indexer stores postings of terms in order"]
    for _ in range(n):
        seq += 1
        s, kind = f"s{rng.randrange(sessions)}", rng.choice(["prompt", "result", "result", "result", "sent", "sent", "read", "read", "clear", "compact"] if rng.random() < 0.7 else ["result", "sent"])
        a = rng.randrange(25)
        rows.append((s, seq, kind, rng.choice(prompts) if kind == "prompt" else None, None, None, f"f{a % 7}" if kind in ("result", "sent", "read") else None, a, a + 5, round(rng.random(), 2), rng.random() < 0.5))
    return rows


def plain(rows):
    """[(session, seq, kind, text, count, spans)] of all events, one by one."""
    sessions, out = {}, []
    for s, seq, kind, text, follow, names, path, a, b, score, full in sorted(rows, key=lambda r: r[1]):
        st = sessions.setdefault(s, {"topic": None, "working": {}, "sent": [], "reads": {}, "whole": set()})
        if kind == "prompt":
            if st["topic"] is not None and follow:
                out.append((s, seq, "query", st["topic"] + ("\n" + names if names else ""), None, ()))
            else:
                st["topic"] = text
                out.append((s, seq, "query", text, None, ()))
        elif kind == "result":
            st["working"][path, a, b] = max(score, st["working"].get((path, a, b), -1))
            st["working"] = dict(sorted(st["working"].items(), key=lambda x: (-x[1], x[0]))[:40])
        elif kind == "sent":
            if (path, a, b) not in st["sent"]:
                st["sent"] = [*st["sent"], (path, a, b)][-200:]
        elif kind == "read":
            st["reads"][path] = st["reads"].get(path, 0) + 1
            out.append((s, seq, "read", path, st["reads"][path], ()))
            if full:
                st["whole"].add(path)
        else:
            top = sorted(st["working"].items(), key=lambda x: (-x[1], x[0]))[:8]
            if kind == "compact" and top:
                out.append((s, seq, "reinject", None, None, tuple((*k, v) for k, v in top)))
            st["sent"], st["whole"] = [], set()
    return out, sessions


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Four micro-batches, each a run of its own that starts from the checkpoint of the one before."""
    d = tmp_path_factory.mktemp("states")
    df = spark.createDataFrame(made(1, 900, 5), EVENT).withColumn("follow_up", T.is_follow_up(F.col("text"))).withColumn("names", T.named(F.col("text")))
    rows = [tuple(r) for r in df.collect()]
    parts = [rows[:200], rows[200:201], rows[201:600], rows[600:]]

    def put(k):
        spark.createDataFrame(parts[k], df.schema).coalesce(1).write.mode("append").parquet(f"{d}/in")

    def go():
        events = spark.readStream.schema(df.schema).parquet(f"{d}/in")
        state.run(events, "session", f"{d}/out", f"{d}/state")

    for k in range(4):
        put(k)
        go()
    return rows, f"{d}/out"


def test_equals_plain_python(spark, run):
    rows, out = run
    want, sessions = plain(rows)
    got = [(r.session, r.seq, r.kind, r.text, r["count"], tuple(tuple(s) for s in r.spans)) for r in spark.read.parquet(out).filter("kind in ('query', 'read', 'reinject')").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    working = {r.session: [tuple(s) for s in r.spans] for r in state.answers(spark, out, "session", "working").collect()}
    assert working == {s: [(*k, v) for k, v in sorted(st["working"].items(), key=lambda x: (-x[1], x[0]))] for s, st in sessions.items()}
    already = {r.session: [tuple(s)[:3] for s in r.spans] for r in state.answers(spark, out, "session", "already").collect()}
    assert already == {s: st["sent"] + [(p, 1, S.WHOLE) for p in sorted(st["whole"])] for s, st in sessions.items()}
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_equals_the_batch_operators(spark, run):
    rows, out = run
    events = spark.createDataFrame(rows, f"session string, {state.EVENT}").withColumn("span", F.struct("path", "start", "end"))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    queries = S.effective_queries(events.filter("kind = 'prompt'"), "session", "seq", "text", F.col("follow_up"), F.col("names"))
    assert same(queries.select("session", "seq", "query"), state.answers(spark, out, "session", "query").select("session", "seq", "text"))
    flat = state.answers(spark, out, "session", "working").select("session", F.posexplode("spans").alias("place", "x")).select("session", "x.path", "x.start", "x.end", "x.score", "place")
    assert same(S.working_set(events.filter("kind = 'result'"), "session", ["path", "start", "end"], "score").select("session", "path", "start", "end", "score", "place"), flat)
    reads = S.read_counts(events.filter("kind = 'read'"), "session", ["seq"], "path").select("session", "seq", "path", "reads")
    assert same(reads, state.answers(spark, out, "session", "read").select("session", "seq", "text", "count"))
    reset = F.col("kind").isin("clear", "compact")
    sent = S.sent_now(events, "session", "seq", reset, F.col("kind") == "sent", ["path", "start", "end"]).select("session", "path", "start", "end")
    held = state.answers(spark, out, "session", "already").select("session", F.explode("spans").alias("x")).filter(f"x.end < {S.WHOLE}").select("session", "x.path", "x.start", "x.end")
    assert same(sent, held)
    again = S.shown_again(events.withColumn("tokens", F.lit(1)), "session", "seq", F.col("kind") == "compact", F.col("kind") == "result", ["path", "start", "end"], "score", "tokens", 100)
    told = state.answers(spark, out, "session", "reinject").select("session", "seq", F.posexplode("spans").alias("place", "x")).select("session", "seq", "place", "x.path", "x.start", "x.end", "x.score")
    assert same(again, told)


def test_shown_again_within_the_budget(spark):
    events = [("s", 1, "result", 1, 0.9, 50), ("s", 2, "result", 2, 0.8, 30), ("s", 3, "result", 3, 0.7, 16), ("s", 4, "compact", None, None, None), ("s", 5, "result", 3, 0.95, 16), ("s", 6, "compact", None, None, None), ("t", 1, "compact", None, None, None)]
    df = spark.createDataFrame(events, "session string, seq int, kind string, span int, score double, tokens int")
    got = S.shown_again(df, "session", "seq", F.col("kind") == "compact", F.col("kind") == "result", ["span"], "score", "tokens", 100)
    assert sorted(map(tuple, got.collect())) == [("s", 4, 0, 1, 0.9), ("s", 4, 2, 3, 0.7), ("s", 6, 0, 3, 0.95), ("s", 6, 1, 1, 0.9)]


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """A session whose timer has run out says so and starts anew."""
    one = [("s", 1, "prompt", "rewrite the tree walker in order of names", False, "", None, None, None, None, None)]
    two = [("u", 2, "prompt", "rewrite the tree walker in order of names", False, "", None, None, None, None, None)]
    for n, rows in enumerate((one, two)):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(spark.createDataFrame([], EVENT).schema).parquet(f"{tmp_path}/in")
        state.run(events, "session", f"{tmp_path}/out", f"{tmp_path}/state", idle_ms=1)
    kinds = [(r.session, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert ("s", "idle") in kinds and kinds.count(("s", "query")) == 1


def test_calls_to_the_state_store_do_not_grow_with_events():
    """Each state of a session is read once and written once, however many events come."""
    calls = []

    class Held:
        def __init__(self, *schema):
            self.rows = []

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name in ("put", "update"):
                    self.rows = given[0]
                return iter(self.rows) if name in ("get", "iterator", "keys") else False

            return call

    class Handle:
        getListState = getMapState = staticmethod(Held)
        getValueState = staticmethod(lambda *schema: type("Value", (Held,), {"get": lambda self: calls.append("get")})())
        registerTimer = staticmethod(lambda at: calls.append("timer"))
        listTimers = staticmethod(lambda: calls.append("timers") or [])

    used = []
    for n in (4, 400):
        session = state.Session("s")
        session.init(Handle())
        calls.clear()
        rows = [(k, ("result", "sent", "read", "prompt")[k % 4], f"t{k}", False, "", f"f{k}", k, k + 5, float(k), k % 8 == 2) for k in range(n)]
        columns = ["seq", "kind", "text", "follow_up", "names", "path", "start", "end", "score", "full"]
        (out,) = session.handleInputRows(("u",), iter([pd.DataFrame(rows, columns=columns)]), type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 0})())
        assert (out.kind == "read").sum() == n // 4
        used.append(len(calls))
    assert used[0] == used[1] <= 12


def test_best():
    assert state.best({("b", 1, 2): 0.5, ("a", 1, 2): 0.5, ("c", 1, 2): 0.9}, 2) == [(("c", 1, 2), 0.9), (("a", 1, 2), 0.5)]
    assert isinstance(state.Session("s")._frame([]), pd.DataFrame)
