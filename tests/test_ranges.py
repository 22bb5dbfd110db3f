"""Sets of line ranges against Python sets of lines."""

import random

import pytest
from pyspark.sql import functions as F

from spanlens.operators import ranges as R


def lines(ranges):
    return {x for a, b in ranges or [] for x in range(a, b + 1)}


def tidy(found):
    """A set is in order and no two of its ranges touch."""
    pairs = [(r.lo, r.hi) for r in found]
    assert all(a <= b for a, b in pairs) and all(x[1] + 1 < y[0] for x, y in zip(pairs, pairs[1:]))
    return lines(pairs)


def test_algebra(spark):
    rng = random.Random(1)
    some = lambda: [(a, a + rng.randrange(-1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
    rows = [(i, some(), some()) for i in range(300)] + [(300, None, [(1, 2)]), (301, [(5, 4)], None)]
    df = spark.createDataFrame(rows, f"id int, a {R.RANGES}, b {R.RANGES}").withColumn("a", R.normal(F.col("a"))).withColumn("b", R.normal(F.col("b")))
    got = df.select("id", "a", "b", R.union(F.col("a"), F.col("b")).alias("u"), R.intersect(F.col("a"), F.col("b")).alias("i"), R.subtract(F.col("a"), F.col("b")).alias("s"), R.padded(F.col("a"), 3).alias("p"), R.measure(F.col("a")).alias("n"), R.holds(F.col("a"), F.lit(7)).alias("h"))
    for r, (_, a, b) in zip(sorted(got.collect(), key=lambda r: r.id), rows):
        a, b = lines(a), lines(b)
        assert tidy(r.a) == a and tidy(r.u) == a | b and tidy(r.i) == a & b and tidy(r.s) == a - b
        assert tidy(r.p) == {x + d for x in a for d in range(-3, 4)} and r.n == len(a) and r.h == (7 in a)


def test_merged_over_pieces(spark, monkeypatch):
    """The same sets whatever the pieces; ranges over several pieces, empty ones and nulls."""
    rng = random.Random(2)
    rows = [(rng.randrange(5), a, a + rng.choice([-1, 0, 3, 40, 300])) for a in (rng.randrange(1, 2000) for _ in range(400))] + [(9, None, 3), (9, 4, None)]
    df = spark.createDataFrame(rows, "k int, lo int, hi int")
    for piece in (16, 4096):
        monkeypatch.setattr(R, "PIECE", piece)
        got = {r.k: tidy(r.ranges) for r in R.merged(df, ["k"]).collect()}
        assert got == {k: lines([(a, b) for x, a, b in rows if x == k]) for k in range(5)}


def test_read_classes_and_removed_turns(spark):
    """Hand-made cases, one of each class, and random ones line by line."""
    rng = random.Random(3)
    shown = [("s", "a", "inlined", 10, 20, None), ("s", "a", "mapped", 40, 50, 4), ("s", "b", "related", 5, 6, None)]
    shown += [("t", rng.choice("abc"), rng.choice(R.SHOWN), a, a + rng.randrange(12), rng.randrange(1, 9)) for a in (rng.randrange(80) for _ in range(12))]
    gold = [("s", "c"), ("s", "a"), ("t", "d")]
    reads = [("s", p, lo, hi, i) for i, (p, lo, hi) in enumerate([("a", 10, 20), ("a", 5, 25), ("a", 41, 60), ("b", 1, 9), ("c", 1, 3), ("z", 1, 3), ("x/tool-results/hook-1", 1, 9), ("a", 9, 8)])]
    reads += [("t", rng.choice("abcde"), a, a + rng.randrange(30), i) for i, a in enumerate(rng.randrange(100) for _ in range(60))]
    got = R.read_classes(spark.createDataFrame(reads, "session string, path string, lo int, hi int, id int"), spark.createDataFrame(shown, "session string, path string, kind string, lo int, hi int, rank int"), spark.createDataFrame(gold, "session string, path string"), near=4)
    found = {(r.session, r.id): r for r in got.collect()}
    for s, p, lo, hi, i in reads:
        want = dict.fromkeys(R.CLASSES, 0)
        own = [(k, a, b) for x, q, k, a, b, _ in shown if (x, q) == (s, p)]
        for line in range(lo, hi + 1):
            near = lambda by: any(k == "inlined" and a - by <= line <= b + by for k, a, b in own)  # noqa: E731, B023
            listed = any(k != "inlined" and a <= line <= b for k, a, b in own)
            c = "hook_file" if "hook-" in p else "redundant" if near(0) else "expansion" if near(4) else "map_hit" if listed else "map_file" if own else "gold_miss" if (s, p) in gold else "other"
            want[c] += 1
        assert {c: found[s, i][c] for c in R.CLASSES} == want
    assert found["s", 1].asDict()["expansion"] == 8 and found["s", 7]["lines"] == 0
    calls = spark.createDataFrame([("s", 1, 10, 1.0, 2.0), ("s", 1, 10, 0.79, 2.0), ("s", 2, 5, 0.8, 3.0), ("s", 2, 5, 1.0, 3.0), ("s", 3, 7, None, None)], "session string, turn int, tokens int, f double, seconds double")
    r = R.removed(calls, F.col("f"), ["session"]).first()
    assert (r.turns, r.turns_saved, r.seconds_saved) == (3, 1, 3.0) and r.tokens_saved == pytest.approx(10 + 7.9 + 4 + 5)


def test_inline_more(spark):
    shown = [("s", "a", "mapped", 1, 10, 2, 100), ("s", "a", "mapped", 11, 20, 4, 50), ("s", "a", "mapped", 30, 40, 6, 70), ("s", "b", "mapped", 1, 9, 5, 30), ("s", "b", "inlined", 1, 9, None, 30)]
    calls = [("s", "a", 11, 20, 1, 40, 2.0), ("s", "a", 25, 34, 2, 40, 3.0), ("s", "b", 1, 9, 3, 40, 4.0)]
    got = R.inline_more(spark.createDataFrame(calls, "session string, path string, lo int, hi int, turn int, tokens int, seconds double"), spark.createDataFrame(shown, "session string, path string, kind string, lo int, hi int, rank int, tokens int"), [3, 5, 8])
    rows = {r.k: r for r in got.collect()}
    assert [(rows[k].turns_saved, rows[k].tokens_saved, rows[k].tokens_added) for k in (3, 5, 8)] == [(0, 0, 0), (1, 40, 50), (1, 60, 120)]
    assert rows[5].cost_added == pytest.approx(50 * (3.75 + 0.3 * 1) / 1e6) and rows[3].cost_added == 0


def test_coverage(spark):
    gold = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("s", "d")], "session string, path string")
    shown = spark.createDataFrame([("s", "a", "related"), ("s", "a", "inlined"), ("s", "b", "mapped"), ("s", "c", "related")], "session string, path string, kind string")
    assert {r.path: r.covered for r in R.gold_coverage(gold, shown).collect()} == {"a": "inlined", "b": "mapped", "c": "related", "d": "absent"}
    hits = spark.createDataFrame([(1, "a", 1), (1, "a", 5), (1, "b", 2), (2, "a", 3), (3, "a", 9)], "lookup int, path string, line int")
    named = spark.createDataFrame([(1, "a"), (1, "z"), (4, "q"), (3, "y")], "lookup int, path string")
    cited = spark.createDataFrame([(1, 5), (1, 2)], "lookup int, line int")
    got = spark.createDataFrame([(1, "a", 4, 6), (1, "z", None, None), (2, "b", 1, 9)], "lookup int, path string, lo int, hi int")
    rows = {r.lookup: (r.n_used, r.line_cov, r.cited_cov, r.file_cov) for r in R.lookup_coverage(hits, named, cited, got).collect()}
    # Of the third, the named file has no hits: all hits are used, the named file is still asked for.
    assert rows == {1: (2, 0.5, 1.0, 1.0), 2: (1, 0.0, None, 0.0), 3: (1, 0.0, None, 0.0), 4: (None, None, None, 0.0)}


def test_parse_shown(spark):
    text = "### a.rs:1-9 — fn x (p=0.9)\n```rust\n### b.rs:1-2\nRanked locations:\n```\n### odd\nRanked locations:\n1. c.rs — 3-4 f; 7-9\n- d.rs:1-2 — no\n2. e.rs — 5-5\n\nRelated by references:\n- d.rs:1-2 f g — calls x\n3. x.rs — 1-2\n### z.rs:4-5\n- y.rs:1-2 — no"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(R.parse_shown(F.col("t")).alias("p")).collect()
    assert [tuple(x) for x in got[0].p] == [("inlined", "a.rs", 1, 9, None), ("mapped", "c.rs", 3, 4, 1), ("mapped", "c.rs", 7, 9, 2), ("mapped", "e.rs", 5, 5, 3), ("related", "d.rs", 1, 2, None), ("inlined", "z.rs", 4, 5, None)]
    assert got[1].p == [] and got[2].p is None
