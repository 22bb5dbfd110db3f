"""Ignore rules, path signals and greedy picks against plain Python."""

import fnmatch
import itertools
import random
import time
import re

import pytest
from pyspark.sql import functions as F

from spanlens.operators import folds, index, retrieve
from spanlens.sources import files


def fits(rule, rest, is_folder):
    """Whether a rule of a folder names a path below it."""
    only, bare, tied = rule.endswith("/"), rule.strip("/"), "/" in rule.rstrip("/")
    pattern = "".join("(.*/)?" if p == "**/" else ".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.findall(r"\*\*/|\*\*|.", bare if tied else "**/" + bare))
    return (is_folder or not only) and re.fullmatch(pattern, rest) is not None


def left_out(path, rules):
    """Each folder above a path, then the path, by the last rule that fits."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        said = None
        for folder, rank, _, line in sorted(rules, key=lambda r: (r[1], len(r[0].split("/")) if r[0] else 0, r[2])):
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            back, rule = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            above = folder.split("/") if folder else []
            if len(above) < n and parts[: len(above)] == above and fits(rule, "/".join(parts[len(above) : n]), n < len(parts)):
                said = back
        if said is False:
            return True
    return False


def test_ignored_paths(spark):
    rng = random.Random(3)
    names = ["a", "b", "build", "x.log", "y.log", "keep.log", "é b"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(400)})
    lines = ["*.log", "!keep.log", "build/", "!build/keep.log", "/a", "a/b", "**/b/x.log", "# note", "", "b/**", "!b/a", "?.log", "\\!odd", "é b/", "  ", "!*.log", "a/*"]
    for k in range(6):
        rules = [(rng.choice(["", "", "a", "a/b", "b", "build"]), rng.choice([0, 1, 2]), n, rng.choice(lines)) for n in range(rng.randrange(1, 9))]
        got = files.ignored_paths(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(rules, "folder string, rank int, n int, line string"), broadcast_rules=[100, 0][k % 2])
        assert {r.path for r in got.collect()} == {p for p in paths if left_out(p, rules)}, rules
    git = [("", 1, 0, "build/"), ("", 1, 1, "!build/keep.log"), ("a", 1, 0, "!x.log"), ("", 2, 0, "x.log")]
    assert [left_out(p, git) for p in ("build/keep.log", "a/x.log", "a/y.log")] == [True, True, False]


def test_rules_of_files(spark):
    table = [(".gitignore", "*.log\n!keep.log"), ("a/b/.ignore", "x\r\ny"), (".git/info/exclude", "tmp/"), ("a/.gitignore.md", "no"), ("src/main.rs", "fn")]
    got = files.rules_of(spark.createDataFrame(table, "path string, text string")).collect()
    assert sorted(map(tuple, got)) == [("", 0, 0, "tmp/"), ("", 1, 0, "*.log"), ("", 1, 1, "!keep.log"), ("a/b", 2, 0, "x"), ("a/b", 2, 1, "y")]


def test_walk_leaves_folders_out(spark, tmp_path):
    for name in ("src/a.py", "build/keep.py", "src/gen/b.py", "src/gen/c.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    (tmp_path / ".gitignore").write_text("build/\n!build/keep.py\n")
    (tmp_path / "src/.ignore").write_text("gen/b*\n")
    assert sorted(r.path for r in files.walk(spark, f"file://{tmp_path}").collect()) == ["src/a.py", "src/gen/c.py"]


def test_path_signal(spark):
    """Chunks of the files meant come first, then those that share terms with their paths."""
    chunks = [(1, "src/tree_walker.rs", "grow"), (2, "src/tree_walker.rs", "leaf"), (3, "lib/walker.rs", "stem"), (4, "doc/other.md", "tree walker"), (5, "doc/none.md", "bark")]
    df = spark.createDataFrame(chunks, "chunk_id int, path string, text string")
    built = index.build(df, "chunk_id", F.concat_ws(" ", "path", "text"))
    said = spark.createDataFrame([("q", "tree_walker.rs"), ("q", "tree_walker.rs"), ("r", "nothing.rs"), ("s", "lib/walker.rs")], "query string, mention string")
    got = {q: [r.chunk_id for r in sorted(rs, key=lambda r: r["rank"])] for q, rs in itertools.groupby(sorted(retrieve.path_signal(df, said, built, "query", "chunk_id").collect(), key=lambda r: (r.query, r["rank"])), key=lambda r: r.query)}
    assert set(got) == {"q", "s"} and got["q"][:2] == [1, 2] and got["s"][0] == 3 and 5 not in got["q"]
    assert {(r.query, r.path) for r in retrieve.resolve_paths(df, said, "query").collect()} == {("q", "src/tree_walker.rs"), ("s", "lib/walker.rs")}


def picked(calls, costs, budget):
    """Step by step: the lacking items of a call that cost least for each call they answer."""
    usable = [sorted(set(c)) for c in calls if c and all(i in costs for i in c)]
    usable = [c for n, c in enumerate(usable) if c not in usable[:n]]
    items, used = [], 0
    for _ in usable:
        best = None
        for c in usable:
            lack = [i for i in c if i not in items]
            cost = sum(costs[i] for i in lack)
            if lack and used + cost <= budget:
                n = sum(any(i not in items for i in d) and all(i in items or i in lack for i in d) for d in calls)
                best = min(x for x in (best, (cost / n, cost, lack)) if x)
        if best:
            items, used = items + best[2], used + best[1]
    return items, used, sum(bool(c) and all(i in items for i in c) for c in calls)


def test_greedy_picks(spark):
    rng = random.Random(7)
    names = "abcdefgh"
    rows = [(n, [rng.sample(names, rng.randrange(0, 4)) for _ in range(rng.randrange(0, 8))], {c: rng.randrange(1, 60) for c in names[:7]}) for n in range(200)]
    got = spark.createDataFrame(rows, "id int, calls array<array<string>>, costs map<string,int>").select("id", folds.greedy_picks(F.col("calls"), F.col("costs"), 90).alias("g")).collect()
    want = {n: picked(calls, costs, 90) for n, calls, costs in rows}
    assert {r.id: (list(r.g["items"]), r.g["used"], r.g["covered"]) for r in got} == want
    assert all(used <= 90 for _, used, _ in want.values()) and any(covered > 2 for *_, covered in want.values())


def test_greedy_picks_of_many_calls(spark):
    """The work follows the picks, not the cube of the calls: 3,000 calls, of which few sets of items are left after each pick."""
    calls = [[f"n{(7 * i + j) % 12}" for j in range(1 + i % 4)] for i in range(3_000)] + [[], ["n0", "unknown"], ["n1", None], None]
    costs = {f"n{i}": 5 + 3 * i for i in range(12)}
    began = time.time()
    got = spark.createDataFrame([(calls, costs), (None, costs), ([], costs)], "calls array<array<string>>, costs map<string,int>").select(folds.greedy_picks(F.col("calls"), F.col("costs"), 90).alias("g")).collect()
    assert set(got[0].g["items"]) <= {*costs} and got[0].g["used"] == sum(costs[i] for i in got[0].g["items"]) <= 90
    assert got[0].g["covered"] == sum(set(c) <= set(got[0].g["items"]) for c in calls if c) > 500
    assert got[1].g is None and tuple(got[2].g) == ([], 0, 0) and time.time() - began < 60


def test_break_even(spark):
    r = spark.range(1).select(folds.injection_price(F.lit(3500.0), F.lit(2)).alias("p"), folds.break_even_chars(folds.injection_price(F.lit(3500.0), F.lit(2)), F.lit(2)).alias("c"), folds.injection_price(F.lit(3500.0), F.lit(-1)).alias("z")).first()
    assert r.p == pytest.approx(1000 * (3.75 + 0.6) / 1e6) and r.c == pytest.approx(3500) and r.z == pytest.approx(0.00375)


def test_globs_agree_with_fnmatch():
    assert all(fits(g, n, False) == fnmatch.fnmatch(n, g) for g in ("*.log", "?.log", "x*") for n in ("a.log", "x.log", "xyz", "ab.log"))
