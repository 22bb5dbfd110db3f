"""Operators of statistics, calibration, transcripts, grading, shaping and indexing against plain Python."""

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanlens.functions import patterns
from spanlens.functions import text as T
from spanlens.operators import calibrate, evalx, folds, grade, index, runs, shape, stats, training, transcript


def rows_of(spark, columns, rows):
    return spark.createDataFrame(rows, columns)


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(1)
    return [(t, f"r{t % 3}", rng.uniform(1, 9), rng.uniform(1, 9)) for t in range(60)]


def test_changes(spark, pairs):
    df = rows_of(spark, "task int, repo string, x double, y double", pairs)
    ratio = lambda ps: sum(p[2] for p in ps) / sum(p[3] for p in ps) - 1
    by = {r: [p for p in pairs if p[1] == r] for r in ("r0", "r1", "r2")}
    got = {r.repo: (r.change, r.n) for r in stats.changes_by(df, "repo", "x", "y").collect()}
    assert got.keys() == {*by, None} and math.isclose(got[None][0], ratio(pairs)) and got[None][1] == 60
    assert all(math.isclose(got[r][0], ratio(ps)) for r, ps in by.items())
    assert math.isclose(stats.balanced_change(df, "repo", "x", "y").first().change, sum(map(ratio, by.values())) / 3)
    assert stats.changes_by(df.limit(0), "repo", "x", "y").filter("n > 0").count() == 0


def drawn(b, i, n):
    m = 2_147_483_647
    u = (b * 1_000_003 + i * 7_919 + 17) % m
    u = (u * u) % m
    u = (u * 48_271 + 11) % m
    return (u * u) % m % n


def test_bootstrap_resamples_each_stratum(spark, pairs):
    df = rows_of(spark, "task int, repo string, x double, y double", pairs)
    strata = {r: [p for p in sorted(pairs) if p[1] == r] for r in ("r0", "r1", "r2")}
    pooled, balanced = [], []
    for b in range(400):
        picked = {r: [ps[drawn(b, i, len(ps))] for i in range(len(ps))] for r, ps in strata.items()}
        every = [p for ps in picked.values() for p in ps]
        pooled.append(sum(p[2] for p in every) / sum(p[3] for p in every) - 1)
        balanced.append(sum(sum(p[2] for p in ps) / sum(p[3] for p in ps) - 1 for ps in picked.values()) / 3)
    pooled.sort(), balanced.sort()
    r = stats.bootstrap(df, "repo", {"m": ("x", "y")}, draws=400).first()
    assert [math.isclose(a, b, abs_tol=1e-9) for a, b in zip((r.lo, r.hi, r.balanced_lo, r.balanced_hi), (pooled[10], pooled[389], balanced[10], balanced[389]))] == [True] * 4
    places = Counter(drawn(b, i, 20) for b in range(400) for i in range(20))
    assert max(places.values()) < 1.3 * min(places.values())  # every pair is drawn about as often


def test_exact_percentiles_and_ranks(spark):
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", float(rng.randrange(30)), i) for i in range(101)]
    df = rows_of(spark, "g string, v double, i int", rows)
    for r in stats.nearest_rank(df, "g", "v", "i").collect():
        xs = sorted(v for g, v, _ in rows if g == r.g)
        n = len(xs)
        assert (r.p50, r.p95, r.p95_low, r.top, r.n) == (xs[int(n * 0.5)], xs[int(n * 0.95)], xs[int((n - 1) * 0.95)], xs[-1], n)
    assert stats.median_with_never(rows_of(spark, "f int", [(3,), (None,), (None,)]), "f").first() == (None, 1, 3)
    assert stats.median_with_never(rows_of(spark, "f int", [(3,), (5,), (None,)]), "f").first() == (5.0, 2, 3)


def test_numbering_without_one_task(spark):
    ids = list(range(0, 3000, 3))
    random.Random(3).shuffle(ids)
    df = rows_of(spark, "id bigint, ok boolean", [(i, i % 2 == 0) for i in ids])
    got = {r.id: r.place for r in stats.numbered(df, "id", F.col("ok")).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids, key=lambda i: (i % 2 != 0, i)))}
    assert stats.numbered(df.limit(0), "id").count() == 0
    sample = sorted(r.k for r in stats.even_sample(df, "id", 7).collect())
    assert sample == list(range(7))


def test_balanced_plan(spark):
    tasks = rows_of(spark, "task bigint", [(i,) for i in range(12)])
    plan = stats.balanced_plan(tasks, ["a", "b", "c"], repeats=2).collect()
    runs_ = defaultdict(dict)
    for r in plan:
        runs_[r.task, r.rep][r.place] = r.arm
    assert len(runs_) == 24 and all(sorted(o.values()) == ["a", "b", "c"] for o in runs_.values())
    assert set(Counter(o[0] for o in runs_.values()).values()) == {8}
    before = Counter((x, y) for o in runs_.values() for x in "abc" for y in "abc" if [*o.values()] and list(o.keys())[list(o.values()).index(x)] < list(o.keys())[list(o.values()).index(y)])
    assert set(before.values()) == {12}


def test_calibration(spark):
    rng = random.Random(4)
    data = []
    for i in range(900):
        z = rng.gauss(0, 2)
        data.append((round(1 / (1 + math.exp(-z)), 3) or 0.001, int(rng.random() < 1 / (1 + math.exp(-z / 1.7))), f"g{i % 2}"))
    df = rows_of(spark, "p double, y int, g string", data)
    loss = lambda t: sum(-math.log(q if y else 1 - q) for p, y, _ in data for q in [min(max(1 / (1 + math.exp(-math.log(p / (1 - p)) / t)), 1e-9), 1 - 1e-9)]) / len(data)
    assert math.isclose(calibrate.nll(df).first().nll, loss(1.0), rel_tol=1e-9)
    for group in (None, "g0", "g1"):
        some = [(p, y) for p, y, g in data if group in (None, g)]
        area = sum((a > b) + (a == b) / 2 for a, y in some if y for b, x in some if not x) / (sum(y for _, y in some) * sum(1 - y for _, y in some))
        got = calibrate.auroc(df, group="g").filter(F.col("g") == group).first() if group else calibrate.auroc(df).first()
        assert math.isclose(got.auroc, area, rel_tol=1e-9) and got.n == len(some)
    bins = defaultdict(list)
    for p, y, _ in data:
        bins[min(int(p * 15), 14)].append((p, y))
    gap = sum(abs(sum(p for p, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(data)
    assert math.isclose(calibrate.ece(df).first().ece, gap, rel_tol=1e-9)
    cut = {r.threshold: r for r in calibrate.precision_recall(df, [0.3, 0.9999]).collect()}
    kept = [y for p, y, _ in data if p >= 0.3]
    assert (cut[0.3].kept, cut[0.3].precision, cut[0.3].recall) == (len(kept), sum(kept) / len(kept), sum(kept) / sum(y for _, y, _ in data))
    best = calibrate.fit_temperature(df)
    assert loss(best) <= min(loss(best * 1.001), loss(best / 1.001)) and 1.2 < best < 2.4
    assert calibrate.auroc(df.filter("y = 1")).first().auroc is None


def test_repeats_are_averaged(spark):
    data = [("t", "a", 1.0, True, "0", "m"), ("t", "a", 3.0, True, "1", "m"), ("t", "a", 99.0, False, "2", "m"), ("t", "b", 5.0, False, "3", "m"), ("u", "a", None, None, "0", "m")]
    df = rows_of(spark, "task string, arm string, cost double, ok boolean, rc string, model string", data)
    got = {(r.task, r.arm): (r.cost, r.reps, r.codes, r.unhealthy) for r in runs.average_repeats(df, ["cost"], F.col("ok"), "rc", model="model").collect()}
    assert got == {("t", "a"): (2.0, 2, ["0", "1"], False), ("t", "b"): (5.0, 1, ["3"], True), ("u", "a"): (None, 1, ["0"], False)}
    with pytest.raises(Exception, match="two models"):
        runs.average_repeats(df.withColumn("model", F.col("rc")), ["cost"], F.col("ok"), "rc", model="model").collect()
    sessions = rows_of(spark, "arm string, tool_calls map<string,bigint>", [("a", {"Read": 3, "Grep": 1, "X": 2}), ("a", None), ("b", {"X": 1})])
    ledger = {r.arm: (r.sessions, r.Read, r.Grep, r.other, r.total) for r in runs.tool_ledger(sessions, ["Read", "Grep"]).collect()}
    assert ledger == {"a": (2, 1.5, 0.5, 1.0, 3.0), "b": (1, 0.0, 0.0, 1.0, 1.0)}


def event(kind, second, content=None, **more):
    line = {"type": kind, "session_id": "s", "timestamp": f"2026-01-01T00:00:{second:02d}.000Z", **more}
    return json.dumps(line | ({"message": {"id": more.get("request_id"), "role": kind, "content": content, "usage": more.pop("usage", None)}} if content is not None else {}))


def test_transcripts(spark):
    use = lambda i, name: {"type": "tool_use", "id": i, "name": name, "input": {"path": "a"}}
    give = lambda i, text: {"type": "tool_result", "tool_use_id": i, "content": text}
    lines = [
        event("system", 0, subtype="init"),
        event("assistant", 2, [{"type": "text", "text": "let me"}, use("c1", "Read")], request_id="q1"),
        event("user", 5, [give("c1", "body")]),
        event("assistant", 6, [use("c2", "Grep")], request_id="q2"),
        event("user", 8, [give("c2", "hits")]),
        event("assistant", 12, [{"type": "text", "text": "FILES: a.rs"}], request_id="q3"),
        event("result", 13, duration_ms=13_000, num_turns=3),
        '{"type": "assist',
        "",
    ]
    df = rows_of(spark, "line string", [(x,) for x in lines])
    events = transcript.parse(df)
    assert events.count() == 7 and df.agg(transcript.bad_lines(df)).first()[0] == 2
    got = {r.call_id: (r.name, r.result, r.ended - r.started) for r in transcript.calls(events).collect()}
    assert got == {"c1": ("Read", "body", 3.0), "c2": ("Grep", "hits", 2.0)}
    assert [r.text for r in transcript.turns(events).orderBy("at").collect()] == ["let me", "FILES: a.rs"]
    assert transcript.tool_calls(transcript.calls(events), "session_id").first().tool_calls == {"Read": 1, "Grep": 1}
    r = transcript.prompt_times(events).first()
    assert (r.duration_s, r.tools_s, r.answer_s, r.lookups_s, r.lookup_calls) == (13.0, 5.0, 4.0, 4.0, 2)


def test_grading(spark):
    answer = "FILES: x.rs\nthen\nFILES: `./src/a.rs`, b.rs , /root/src/c.rs,"
    df = rows_of(spark, "a string, gold array<string>", [(answer, ["src/a.rs", "lib/b.rs", "src/c.rs", "d.rs"]), ("none", ["a"]), (None, ["a"])])
    got = [(r.named, r.recall, r.precision, r.hit_any) for r in grade.grade(df, "a", "gold").collect()]
    assert got[0] == (["src/a.rs", "b.rs", "root/src/c.rs"], 0.75, 1.0, True)
    assert got[1] == ([], 0.0, 0.0, False)
    cases = [
        (("x", ["docs/*.md"], [], True, [], False, False), "non-code"),
        (("x", [], ["a.json", "b.TOML"], True, [], False, False), "non-code"),
        (("x", ["!tests/a.rs"], [], True, [], False, False), "exact-text"),
        (("x", ["src/Tests/a.rs"], [], True, [], False, False), "tests"),
        (("fn test_walk", [], [], True, ["walk"], True, True), "tests"),
        (("fn walk", [], [], True, ["walk"], True, True), "definition"),
        (("walk", [], [], False, ["walk"], False, True), "in-file"),
        (("walk", [], [], True, ["walk"], False, True), "callers-uses"),
        (("a.*b", [], [], False, [], False, False), "other"),
    ]
    df = rows_of(spark, "p string, t array<string>, f array<string>, w boolean, i array<string>, d boolean, n boolean", [c for c, _ in cases])
    assert [r[0] for r in df.select(grade.lookup_intent(*map(F.col, "ptfwidn"))).collect()] == [w for _, w in cases]
    added = rows_of(spark, "path string, line string", [("a", "let total = 1;"), ("a", " let total = 1; "), ("a", "return the total"), ("b", "}"), ("c", "something longer"), ("d", "kept as it was here")])
    now = rows_of(spark, "path string, text string", [("a", "x\n  let total = 1;\n"), ("b", "}"), ("c", "nothing")])
    assert {r.path: (r.lines, r.share, r.state) for r in grade.stale_gold(added, now).collect()} == {"a": (2, 0.5, "present"), "b": (0, None, "removal-only"), "c": (1, 0.0, "drifted"), "d": (1, 0.0, "gone")}


def test_list_metrics(spark):
    data = [("q", "a", 0, False, False), ("q", "b", 1, True, False), ("q", "a", 2, False, False), ("q", "c", 3, True, True), ("r", "a", 0, False, False)]
    got = {r.q: r for r in evalx.list_metrics(rows_of(spark, "q string, path string, rank int, gold boolean, pos boolean", data), "q", "path", F.col("gold"), F.col("pos")).collect()}
    assert (got["q"].file_r_at_1, got["q"].file_r_at_2, got["q"].file_r_at_3, got["q"].top_2_gold, got["q"].top_3_gold, got["q"].mrr_pos) == (0.0, 0.5, 1.0, 0.5, 0.5, 0.25)
    assert (got["r"].file_r_at_5, got["r"].mrr_pos, got["r"].golds) == (0.0, 0.0, 0)


def test_losses(spark):
    data = [("l", 1.0, 3.0, 1), ("l", 2.0, 1.0, 0), ("m", 500.0, 0.0, 1), ("m", -500.0, 0.0, 1), ("n", 1.0, 1.0, 0)]
    df = rows_of(spark, "g string, t double, s double, y int", data)
    soft = lambda xs: [math.exp(x - max(xs)) / sum(math.exp(z - max(xs)) for z in xs) for x in xs]
    lists = defaultdict(list)
    for g, t, s, y in data:
        lists[g].append((t, s, y))
    want = [-sum(y / sum(v[2] for v in xs) * (math.log(p) if p > 0 else -1000.0) for (_, _, y), p in zip(xs, soft([v[0] for v in xs]))) for xs in lists.values() if sum(v[2] for v in xs)]
    got = training.listwise_loss(df, "g", F.col("t"), F.col("y")).first()
    assert got.lists == 2 and math.isclose(got.loss, sum(want) / 2, rel_tol=1e-9)
    cache = training.teacher_cache(df, "g", "s", "t")
    assert {r.g: r.logits for r in cache.collect()}["l"] == [2.0, 1.0]
    assert training.with_teacher(rows_of(spark, "g string, k int", [("l", 1), ("l", 9), ("z", 0)]), cache, "g", "k").filter("teacher is null").count() == 2


def test_merged_spans_keep_symbol_p_and_text(spark):
    data = [("q", "f", 1, 3, 0.1, None, "", "a\nb\nc"), ("q", "f", 3, 5, 0.9, 0.4, "walk", "c\nd\ne"), ("q", "f", 7, 8, 0.2, 0.3, "other", "g\nh"), ("q", "f", 30, 31, 0.5, None, "far", "x\ny"), ("q", "g", 2, 2, 0.3, None, None, "z")]
    df = rows_of(spark, "q string, path string, start int, end int, score double, p double, symbol string, text string", data)
    got = {(r.path, r.start): (r.end, r.score, r.p, r.symbol, r.text) for r in shape.merge_spans(df, "q").collect()}
    assert got == {("f", 1): (8, 0.9, 0.4, "walk", "a\nb\nc\nd\ne\ng\nh"), ("f", 30): (31, 0.5, None, "far", "x\ny"), ("g", 2): (2, 0.3, None, None, "z")}


def test_sizing_shares_one_cap_and_keeps_usages(spark):
    ranked = rows_of(spark, "q string, path string, start int, end int, rank int", [("q", p, i * 10, i * 10 + 5, i) for i, p in enumerate(["a", "README.md", "a", "b", "c", "d"])])
    sent = rows_of(spark, "q string, path string, start int, end int", [("q", "b", 32, 33)])
    related = rows_of(spark, "q string, path string, start int, end int, pos int, is_usage boolean", [("q", "a", 3, 4, 0, False), ("q", "z", 1, 2, 1, False), ("q", "z", 1, 2, 2, False), ("q", "y", 1, 2, 3, False), ("q", "a", 3, 4, 4, True)])
    limits = rows_of(spark, "q string, caps struct<full:int,listed:int,related:int>", [("q", (2, 3, 1))])
    got = shape.size_context(ranked, sent, "q", limits=limits, inlinable=~F.col("path").endswith(".md"), related=related).collect()
    assert sorted((r.bucket, r.path, r.start) for r in got) == [("already", "b", 30), ("full", "a", 0), ("full", "c", 40), ("map", "README.md", 10), ("related", "z", 1), ("usage", "a", 3)]


def test_heuristics_and_speed(spark):
    units = rows_of(spark, "task int, size bigint, gain bigint, uses bigint, at bigint", [(1, 5, 1, 9, 0), (1, 4, 8, 0, 1), (1, 2, 2, 1, 2)])
    take = lambda h, stop=False: tuple(folds.heuristic_fill(units, "task", 6, h, stop).first())[1:]
    assert take("shortest") == (2, 6, 10) and take("longest") == (1, 5, 1) and take("best") == (2, 6, 10)
    assert take("most_used") == (1, 5, 1) and take("in_order", True) == (1, 5, 1) and take("in_order") == (1, 5, 1)
    values = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("skipped")) for v, s in ((99.0, False), (8.0, False), (4.0, False), (0.0, True))))
    assert spark.range(1).select(folds.speed(values)).first()[0] == (8.0 * 0.75 + 4.0 * 0.25) * 0.75
    why = folds.misses(F.array(*map(F.lit, "abcd")), F.array(F.lit("a")), F.array(*map(F.lit, "abc")), F.create_map(F.lit("b"), F.lit(9), F.lit("c"), F.lit(1)), 5)
    assert [(m.name, m.why) for m in spark.range(1).select(why).first()[0]] == [("b", "too_big"), ("c", "not_picked"), ("d", "unknown")]


def test_terms_of_simple_words_take_the_short_way(spark):
    words = "hash Hash HASH hashMap HTTPServer parse_config utf8 a B _x x_ The i18n __ Ab aB".split()
    df = rows_of(spark, "w string", [(w,) for w in words])
    parts = T.word_parts(F.col("w"))
    long_way = F.concat(F.filter(parts, lambda p: F.length(p) > 1), F.when(F.size(parts) > 1, F.array(F.lower("w"))).otherwise(F.array().cast("array<string>")))
    assert all(r[0] == r[1] for r in df.select(T.word_terms(F.col("w")), long_way).collect())


def test_index_is_saved_and_loaded(spark, tmp_path):
    chunks = rows_of(spark, "chunk_id int, text string", [(1, "alpha beta alpha alpha"), (2, "beta gamma"), (3, None)])
    made = index.build(chunks)
    index.save(made, f"file://{tmp_path}/index", files=2)
    for kept in (index.load(spark, f"file://{tmp_path}/index"), index.written(made)):
        assert sorted(map(tuple, kept.postings.select("chunk_id", "term", "tf", "dl").collect())) == [(1, "alpha", 2, 3), (1, "beta", 1, 3), (2, "beta", 1, 2), (2, "gamma", 1, 2)]
        assert kept.corpus.first().avgdl == 2.5


def test_streamed_batches_replace_and_delete(spark, tmp_path):
    from spanlens.streaming import indexing

    out = f"file://{tmp_path}/postings"
    batches = [[(1, "alpha beta", False), (2, "beta", False)], [(1, "gamma", False), (3, "alpha", False)], [(2, "ignored", True), (3, "alpha delta", False)]]
    for n, rows in enumerate(batches):
        for _ in range(2):  # a batch that runs again changes nothing
            indexing.put_batch(rows_of(spark, "id bigint, text string, gone boolean", rows), n, out, "id", "text", "gone")
    assert {r.term: r.df for r in indexing.term_df(spark.read.parquet(out), "id").collect()} == {"gamma": 1, "alpha": 1, "delta": 1}


def test_braces():
    assert patterns.braces("a{b,c{d,e}}f") == ["abf", "acdf", "acef"]
    assert patterns.braces("{a,b}/{c,d}") == ["a/c", "a/d", "b/c", "b/d"]
    assert patterns.braces("x{a") == ["x{a"] and patterns.braces("a,b}") == ["a,b}"] and patterns.braces("{a}") == ["a"]


def test_ignore_rules(spark, tmp_path):
    from spanlens.sources import files

    tree = {
        ".gitignore": "*.log\n/made\n# note\n!keep.log\ntmp/\ndocs/*.md\n",
        "src/.ignore": "gen*\n!gen_ok.py\n",
        **{p: "x = 1\n" for p in ("a.py", "made/a.py", "src/made/a.py", "src/gen_a.py", "src/gen_ok.py", "gen_a.py", "tmp/a.py", "src/tmp/a.py", "docs/a.md", "docs/in/a.md", ".hidden/a.py", "src/tmp.py")},
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert sorted(r.path for r in files.walk(spark, f"file://{tmp_path}").collect()) == ["a.py", "docs/in/a.md", "gen_a.py", "src/gen_ok.py", "src/made/a.py", "src/tmp.py"]
    paths_ = rows_of(spark, "p string", [("x.log",), ("a/keep.log",), ("a/b.log",)])
    assert [r[0] for r in paths_.select(files.ignored(F.col("p"), [("", "*.log"), ("", "!keep.log")])).collect()] == [True, False, True]


def test_exact_lookup(spark):
    from spanlens.operators import lookup

    chunks = rows_of(spark, "chunk_id int, path string, start_line int, symbol string, defines array<string>, text string", [
        (1, "a.py", 10, "walk", ["walk"], "def walk():\n    pass\n    walk()"),
        (2, "a.py", 1, "main", [], "walk()\nx = walker()"),
        (3, "README.md", 5, "", [], "call walk"),
    ])
    found = lookup.report(chunks, "walk", per_file=2)
    assert sorted((r.path, r.symbol, r.line, r.is_definition, r.in_file, r.listed) for r in found.collect()) == [
        ("README.md", "", 5, False, 1, False), ("a.py", "main", 1, False, 3, True), ("a.py", "walk", 10, True, 3, True), ("a.py", "walk", 12, False, 3, False)]
    assert tuple(lookup.summary(found).first()) == (2, 4, 1, 1, False)
    assert lookup.summary(lookup.report(chunks, "walk")).first().complete
    assert tuple(lookup.summary(lookup.report(chunks, "nothing")).first()) == (0, 0, 0, 0, True)


def test_breaker_probes(spark):
    def run(*events):
        items = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).cast("bigint").alias("t")) for k, t in events))
        return tuple(spark.range(1).select(folds.breaker_calls(items, 2, 10)).first()[0])

    assert run(("fail", 0), ("ok", 1), ("fail", 2), ("ask", 3)) == (0, 0, "closed")
    assert run(("fail", 0), ("fail", 1), ("ask", 5), ("ask", 11), ("ask", 12)) == (1, 2, "half-open")
    assert run(("fail", 0), ("fail", 1), ("ask", 11), ("ok", 12), ("ask", 12)) == (1, 0, "closed")
    assert run(("fail", 0), ("fail", 1), ("ask", 11), ("fail", 12), ("ask", 13)) == (2, 1, "open")
    assert run(("fail", 0), ("fail", 1), ("ask", 11), ("ask", 20), ("ask", 21)) == (1, 1, "half-open")


def test_commit_words(spark):
    df = rows_of(spark, "s string, b string", [("fix(api): stop it (#4)", "First line\nsecond.\n\nNext"), ("feat(1.2): x.", None), ("word " * 100, ""), ("Tidy", "Fixes #12")])
    got = [tuple(r) for r in df.select(T.is_fix(F.col("s"), F.col("b")), T.commit_task(F.col("s"), F.col("b"))).collect()]
    assert got[0] == (True, "api: stop it. First line second.") and got[1] == (False, "x") and got[3] == (True, "Tidy. Fixes #12")
    assert len(got[2][1]) <= 400 and got[2][1].endswith("word")


SOURCES = {
    "rust": ("use std::fmt::Display;\npub struct Walker<T> { root: T }\nimpl<T: Display> Walker<T> {\n    pub async fn walk(&self) -> Vec<Entry> {\n        let s = \"fn fake() {\"; // fn no()\n        open_dir(s)\n    }\n}\nconst LIMIT: usize = 3;\nmacro_rules! twice { () => {} }\n", {"Walker", "walk", "LIMIT", "twice"}, {"Display", "Entry", "open_dir"}),
    "typescript": ("import { Reader } from './reader';\nexport interface Options { deep: boolean }\nexport const limit = 3;\nexport class Walker extends Base {\n  walk(from: Options) {\n    const inner = 3;\n    return new Reader(from);\n  }\n}\nconst go = async (x) => { run(x); };\ntype Pair = [string, string];\n", {"Options", "limit", "Walker", "walk", "go", "Pair"}, {"Reader", "Base", "run"}),
    "go": ("package a\nimport \"fmt\"\ntype Walker struct { n int }\nfunc (w *Walker) Walk(path string) error {\n\treturn openDir(path)\n}\nvar Limit = 3\n", {"Walker", "Walk", "Limit"}, {"openDir"}),
    "java": ("import a.b.Reader;\npublic class Walker extends Base implements Closer {\n  private int n;\n  public List<Entry> walk(String from) throws IOException {\n    if (n > 0) { return list(from); }\n    return null;\n  }\n}\nenum Kind { A }\n", {"Walker", "walk", "Kind"}, {"Reader", "Base", "Closer", "Entry", "list"}),
    "cpp": ("#include <a>\n#define LIMIT 3\nnamespace tree {\nclass Walker : public Base {\n public:\n  int walk(int n) { return open_dir(n); }\n};\nint Walker::size() const {\n  return 3;\n}\n}\nstruct Pair { int a; };\n", {"LIMIT", "tree", "Walker", "walk", "size", "Pair"}, {"Base", "open_dir"}),
    "csharp": ("using System.Text;\nnamespace Tree.Walk {\n  public record Pair(int A);\n  public class Walker : Base {\n    public int Walk(int n) { return OpenDir(n); }\n  }\n}\n", {"Walk", "Pair", "Walker"}, {"Base", "OpenDir"}),
    "kotlin": ("package a\nval limit = 3\nobject Tree { fun walk(n: Int): Entry = openDir(n) }\ndata class Pair(val a: Int)\nfun String.twice() { println(this) }\n", {"limit", "Tree", "walk", "Pair", "twice"}, {"Entry", "openDir"}),
    "swift": ("let limit = 3\nprotocol Walks { func walk() }\nextension Tree { func size() -> Int { return count(3) } }\nstruct Pair { let a: Int }\n", {"limit", "Walks", "walk", "size", "Pair"}, {"count"}),
    "php": ("<?php\nclass Walker extends Base {\n  const LIMIT = 3;\n  public function walk($n) { return open_dir($n); }\n}\n", {"Walker", "LIMIT", "walk"}, {"Base", "open_dir"}),
    "c": ("#define LIMIT 3\ntypedef unsigned int size;\nstruct pair { int a; };\nstatic int walk(struct pair *p) {\n  return open_dir(p);\n}\n", {"LIMIT", "size", "pair", "walk"}, {"open_dir"}),
}


@pytest.mark.parametrize("lang", SOURCES)
def test_definitions_and_references_of_languages(lang):
    from spanlens.operators import ast_chunk

    text, defines, refs = SOURCES[lang]
    chunks = ast_chunk.chunk_source(f"a.{lang}", lang, text)
    found = {n for c in chunks for n in c["defines"]}
    assert defines <= found and not found & {"fake", "no", "inner", "if", "return"}
    assert refs <= {n for c in chunks for n in c["refs"]}
    small = ast_chunk.chunk_source(f"a.{lang}", lang, text, ast_chunk.ChunkConfig(1, 3, 3))
    lines = text.rstrip("\n").split("\n")
    covered = [r for c in small for r in range(c["start_line"], c["end_line"] + 1)]
    assert len(covered) == len(set(covered)) and {r for r, l in enumerate(lines, 1) if l.strip()} <= set(covered)


def test_syntax_errors_are_data(spark):
    from spanlens.operators import ast_chunk

    files = rows_of(spark, "path string, lang string, text string", [("a.py", "python", "def f(:\n    pass\n"), ("b.py", "python", "def f():\n    pass\n"), ("c.rs", "rust", "fn f() { {{ \n"), ("d.py", "python", None)])
    got = {r.path: r.error for r in ast_chunk.chunk_files(files).collect()}
    assert got["a.py"].startswith("SyntaxError") and got["b.py"] is None and got["c.rs"] is None and "d.py" not in got
    long = "\n".join(f"fn f{i}() {{ g{i}(); }}" for i in range(20_000))
    import time

    began = time.time()
    assert len(ast_chunk.chunk_source("a.rs", "rust", long)) > 100 and time.time() - began < 20


def test_chunked_documents(spark):
    """Every line of every source file is in exactly one chunk, as it was; names and references are those of the code around the text."""
    from spanlens.plans import more_queries

    sf = "/root/testdata/sf0.001"
    files = {r.path: r for r in more_queries.source_files(spark, sf).collect()}
    by_path = defaultdict(list)
    for r in more_queries.ast_chunks(spark, sf).collect():
        by_path[r.path].append(r)
    assert set(by_path) == set(files) and {f.lang for f in files.values()} == {"python", "rust", "typescript", "go"}
    for path, chunks in by_path.items():
        lines, seen, n = files[path].text.rstrip("\n").split("\n"), set(), path[1:].split(".")[0]
        for c in sorted(chunks, key=lambda c: c.start_line):
            rows = range(c.start_line, c.end_line + 1)
            assert len(rows) <= 20 and not seen & set(rows) and c.text == "\n".join(lines[c.start_line - 1 : c.end_line]) and c.error is None
            seen |= set(rows)
        assert {i for i, l in enumerate(lines, 1) if l.strip()} <= seen
        defines = {d for c in chunks for d in c.defines}
        assert f"f{n}" in defines and (files[path].lang == "rust" or f"C{n}" in defines)
        assert "load" in {x for c in chunks for x in c.refs}


def test_tasks_of_a_log(spark):
    from spanlens.sources import commits

    log = "@@aaa\tfix(x): keep the order of all the entries (#3)\n\nsrc/a.rs\nsrc/a.rs\ngone.rs\ntests/b.rs\n@@bbb\tchore: keep the order of all the entries\n\nsrc/a.rs\n@@ccc\tfix typo in the middle of the documentation\nsrc/a.rs\n@@ddd\tkeep the order of all the entries\nsrc/c.rs\n@@eee\tnothing but documentation in this one\nREADME.md\n@@"
    found = commits.parse_log(rows_of(spark, "log string", [(log,), (None,), ("",)]))
    assert found.count() == 5
    tracked = rows_of(spark, "path string", [("src/a.rs",), ("src/c.rs",)])
    assert [tuple(r) for r in commits.tasks(found, tracked).collect()] == [("aaa", "keep the order of all the entries", ["src/a.rs"])]
    assert [r.id for r in commits.tasks(found, skip=["aaa"]).collect()] == ["ddd"]
