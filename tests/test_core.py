"""Functions and operators against plain Python rules on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanlens.functions import paths, text
from spanlens.operators import ast_chunk, chunk, expand, folds, index, lookup, retrieve, shape
from spanlens.operators import session as sessions


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("said", "found"),
    [
        ("HashWithTtl", ["hash", "with", "ttl", "hashwithttl"]),
        ("parse_config", ["parse", "config", "parse_config"]),
        ("HTTPServer", ["http", "server", "httpserver"]),
        ("a + 42 b", []),
        ("utf8", ["utf", "utf8"]),
        ("", []),
    ],
)
def test_terms(spark, said, found):
    assert one(spark, text.terms, said) == found


def plain_terms(s):
    out = []
    for w in re.split("[^A-Za-z0-9_]+", s):
        if not w or w[0].isdigit():
            continue
        parts = []
        for seg in w.split("_"):
            cur = ""
            for i, c in enumerate(seg):
                p = seg[i - 1] if i else ""
                n = seg[i + 1] if i + 1 < len(seg) else ""
                cut = p and ((c.isupper() and (p.islower() or p.isdigit() or (p.isupper() and n.islower()))) or c.isdigit() != p.isdigit())
                if cut:
                    parts.append(cur)
                    cur = ""
                cur += c
            if cur:
                parts.append(cur)
        out += [p.lower() for p in parts if len(p) > 1]
        if len(parts) > 1:
            out.append(w.lower())
    return out


def test_terms_on_random_names(spark):
    rng = random.Random(1)
    said = ["".join(rng.choice("aZbQ_19 x.") for _ in range(rng.randint(0, 14))) for _ in range(800)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", text.terms(F.col("s")).alias("t")).collect()
    assert all(r.t == plain_terms(said[r.i]) for r in got)


def test_signals(spark):
    prompt = "Fix HashMap::get and load() in src/lib.rs, see parse_config; Store is TODO"
    assert one(spark, text.explicit_identifiers, prompt) == ["HashMap", "get", "load", "parse_config"]
    assert one(spark, text.path_mentions, prompt) == ["src/lib.rs"]
    assert one(spark, text.is_follow_up, "now the tests")
    assert one(spark, text.is_follow_up, "apply the same change to every remaining module of the walker")
    assert not one(spark, text.is_follow_up, "apply the same change to parse_config while keeping walker module order")
    assert one(spark, text.asks_for_callers, "where is it used?") and not one(spark, text.asks_for_callers, "use it")
    assert one(spark, text.asks_for_tests, "Which TESTS?") and one(spark, text.skip_prompt, "/clear now please")
    assert one(spark, text.task_focus, 'Find “replay of write log entries” please. Be brief.') == "replay of write log entries"
    assert one(spark, text.task_focus, "Rename the cache loader. Be efficient: answer with paths.") == "Rename the cache loader."
    assert one(spark, text.asks_for_non_code, "update README") and not one(spark, text.asks_for_non_code, "update reader")


def test_has_name(spark):
    for line, name, found in (("let fooBar = 1", "foo", True), ("foobar", "foo", False), ("my_foo_x", "foo", True), ("$foo", "foo", False), ("getFoo()", "Foo", True), ("FOOD", "FOO", False), ("a-b c", "a-b", True)):
        assert one(spark, lambda c, n=name: text.has_name(c, n), line) is found


def test_paths(spark):
    for path, lang in (("src/main.rs", "rust"), ("a/node_modules/x.js", None), ("x/Cargo.lock", None), (".env.local", None), ("app.min.js", None), ("Makefile", "text"), ("lib/Rakefile", "ruby"), ("a\\b.PY", "python"), ("x.unknown", None), ("", None)):
        assert one(spark, paths.language, path) == lang
    for path, test in (("tests/a.rs", True), ("src/test_a.py", True), ("src/a_test.go", True), ("src/FooTests.cs", True), ("src/latest.rs", False), ("Spec/x.rb", True)):
        assert one(spark, paths.is_test, path) is test
    assert one(spark, paths.is_prose, "docs/README") and one(spark, paths.is_prose, "a.md") and not one(spark, paths.is_prose, "a.toml")


def test_lines(spark):
    rows = chunk.lines(spark.createDataFrame([(1, "a\n\n  b\r\nc"), (2, ""), (3, "x\n")], "id int, text string"), "id").orderBy("id", "line").collect()
    assert [(r.id, r.line, r.body, r.blank, r.nonblank_before) for r in rows] == [(1, 1, "a", False, 0), (1, 2, "", True, 1), (1, 3, "  b", False, 1), (1, 4, "c", False, 2), (3, 1, "x", False, 0)]


def plain_windows(source, cfg):
    rows = source[:-1].split("\n") if source.endswith("\n") else source.split("\n") if source else []
    blank = [not r.strip() for r in rows]
    spans = [(s, e) for s, e, _ in ast_chunk.text_spans(blank, cfg)]
    out, pend = [], -1
    for k, (s, e) in enumerate(spans):
        s = pend if pend >= 0 else s
        pend = -1
        if e - s + 1 >= cfg.min_lines:
            out.append((s, e))
        elif out and e - out[-1][0] + 1 <= cfg.max_lines:
            out[-1] = (out[-1][0], e)
        elif k + 1 < len(spans) and spans[k + 1][1] - s + 1 <= cfg.max_lines:
            pend = s
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("cfg", [chunk.ChunkConfig(2, 8, 5), chunk.ChunkConfig(), chunk.ChunkConfig(3, 4, 9)])
def test_text_windows(spark, cfg):
    rng = random.Random(2)
    said = ["\n".join(rng.choice(["", "x", "yy z", " "]) for _ in range(rng.randint(0, 70))) + rng.choice(["", "\n"]) for _ in range(120)]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", chunk.windows(F.col("s"), cfg).alias("w")).collect()
    for r in got:
        found = [(w.s, w.e) for w in r.w]
        assert found == plain_windows(said[r.i], cfg)
        rows = said[r.i].split("\n")
        covered = {k for s, e in found for k in range(s, e + 1)}
        assert all(k in covered for k, x in enumerate(rows) if x.strip()) and all(e - s + 1 <= cfg.max_lines for s, e in found)
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))


def test_term_choice(spark):
    asked = spark.createDataFrame([("q", ["parse", "parse", "a", "@x", "foo-bar", "ok_1", "", "x" * 65])], "q string, t array<string>")
    assert [r.term for r in retrieve.prepare_terms(asked, "q", "t").orderBy("pos").collect()] == ["parse", "ok_1"]
    capped = spark.createDataFrame([("q", ["id", "configuration", "fn", "loader", "xy"])], "q string, t array<string>")
    assert [r.term for r in retrieve.prepare_terms(capped, "q", "t", 3).orderBy("pos").collect()] == ["id", "configuration", "loader"]
    known = spark.createDataFrame([("common", 900), ("rare", 3), ("mid", 40)], "term string, df long")
    terms = spark.createDataFrame([("q", t, i) for i, t in enumerate(["common", "rare", "absent", "mid"])], "q string, term string, pos long")
    assert {r.term for r in retrieve.select_terms(terms, known, "q").collect()} == {"rare", "mid", "common"}
    assert {r.term for r in retrieve.select_terms(terms, known, "q", max_terms=2).collect()} == {"rare", "mid"}
    assert {r.term for r in retrieve.select_terms(terms, known, "q", budget=1700).collect()} == {"rare", "mid"}


def test_bm25_adds_up(spark):
    docs = spark.createDataFrame([(1, "flush flush flush wal"), (2, "wal replay"), (3, "other words here")], "id long, text string")
    built = index.build(docs, "id")
    assert {(r.term, r.tf) for r in built.postings.filter("id = 1").collect()} == {("flush", 2), ("wal", 1)}

    def scores(*terms):
        asked = spark.createDataFrame([("q", t, i) for i, t in enumerate(terms)], "q string, term string, pos long")
        return {r.id: r.score for r in retrieve.bm25(retrieve.select_terms(asked, built.term_df, "q"), built, "q", "id").collect()}

    both, a, b = scores("flush", "wal"), scores("flush"), scores("wal")
    assert all(abs(both[i] - a.get(i, 0) - b.get(i, 0)) < 2e-6 for i in both)


def test_frequency_changes(spark):
    old = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "id long, text string")
    new = spark.createDataFrame([(1, "alpha gamma"), (2, "beta")], "id long, text string")
    got = {r.term: r.delta for r in index.df_delta(index.postings(old, "id"), index.postings(new, "id")).collect()}
    assert got == {"beta": -1, "gamma": 1}


def test_text_delta(spark, monkeypatch):
    """What the postings of both texts differ in, though only ids that changed are cut into terms."""
    rng = random.Random(11)
    word = lambda: rng.choice(["parseConfig", "parse", "config", "HTTPServer", "server", "x2y", "_a", "9z", "é", "tree"])
    rows = []
    for n in range(120):
        a = None if n % 17 == 0 else " ".join(word() for _ in range(rng.randrange(0, 6)))
        b = a if n % 3 else None if n % 13 == 0 else " ".join(word() for _ in range(rng.randrange(0, 6)))
        rows.append((None if n == 5 else n // 2 if n < 40 else n, a, b))
    chunks = spark.createDataFrame(rows, "id int, a string, b string")
    want = {r.term: r.delta for r in index.df_delta(index.postings(chunks, "id", "a"), index.postings(chunks, "id", "b")).collect()}
    assert {r.term: r.delta for r in index.text_delta(chunks, "a", "b", "id").collect()} == want and len(want) > 4
    same = index.text_delta(chunks, "a", "a", "id")
    assert same.count() == 0
    # Nothing is cut into terms where nothing changed.
    from spanlens.registry import QUERIES

    monkeypatch.setattr(index, "postings", None)
    assert QUERIES["df_delta"](spark, "/root/testdata/sf0.001").filter("term = 'freshly'").count() == 1



def test_rrf(spark):
    make = lambda ids: spark.createDataFrame([("q", x, i) for i, x in enumerate(ids)], "q string, id string, rank long")
    fused = [r.id for r in retrieve.rrf([make("abc"), make("dxc"), make("ec")], "q", "id").orderBy("rank").collect()]
    assert fused[0] == "c" and fused[1] == "a"


def test_merge_and_budget(spark):
    spans = [("q", "f", 1, 10, 1.0), ("q", "f", 13, 20, 2.0), ("q", "g", 1, 10, 1.0), ("q", "g", 20, 30, 1.0), ("q", "h", 1, 40, 1.0), ("q", "h", 41, 60, 1.0)]
    df = spark.createDataFrame(spans, "q string, path string, start int, end int, score double")
    got = sorted((r.path, r.start, r.end, r.score) for r in shape.merge_spans(df, "q").collect())
    assert got == [("f", 1, 20, 2.0), ("g", 1, 10, 1.0), ("g", 20, 30, 1.0), ("h", 1, 40, 1.0), ("h", 41, 60, 1.0)]
    two = spark.createDataFrame([("q", "a", 1, 30, 2.0), ("q", "b", 1, 30, 1.0)], df.schema)
    assert sorted((r.path, r.end) for r in shape.line_budget(two, "q", budget=40).collect()) == [("a", 30), ("b", 10)]


def test_accept_keeps_order_and_caps(spark):
    items = [("f", 1, 5), ("f", 4, 9), ("f", 20, 25), ("f", 30, 31), ("g", 1, 2)]
    df = spark.createDataFrame([(items,)], "x array<struct<path:string,start:int,end:int>>")
    assert [(r.path, r.start) for r in df.select(expand.accept(F.col("x")).alias("y")).first().y] == [("f", 1), ("f", 20), ("g", 1)]


def test_gate(spark):
    rows = [("q", "a", 0, 0.1), ("q", "b", 1, 0.9), ("q", "c", 2, None)]
    blended = retrieve.blend(spark.createDataFrame(rows, "q string, id string, rank long, p double"), "q")
    assert [r.id for r in retrieve.gate(blended, "q", threshold=0.0).orderBy("place").collect()] == ["b", "a", "c"]
    assert [r.id for r in retrieve.gate(blended, "q", threshold=0.95, min_keep=2).orderBy("place").collect()] == ["b", "a"]


def test_folds(spark):
    assert one(spark, lambda c: folds.fill(c, 10)["taken"], [6, 5, 4, 1], "array<bigint>") == 2
    assert abs(one(spark, lambda c: folds.ema(c, 0.5), [1.0, 3.0], "array<double>") - 2.0) < 1e-9
    assert one(spark, lambda c: folds.batches(c, 2, 10.0), [4.0, 4.0, 4.0, 9.0], "array<double>") == 3


def test_lookup(spark):
    for q, found in (("parse_config", True), ("where is HashMap used", True), ("find the walker", True), ("why does the walker skip symlinks", False), ("load|store", True)):
        assert one(spark, lookup.is_lookup, q) is found


def test_sessions(spark):
    rows = [(1, 0, "now", True), (1, 1, "a whole task", False), (1, 2, "and tests", True)]
    got = sessions.topics(spark.createDataFrame(rows, "s int, t int, x string, f boolean"), "s", "t", "x", F.col("f")).orderBy("t").collect()
    assert [r.topic for r in got] == ["now", "a whole task", "a whole task"]


PYTHON = '''"""doc"""
import os
LIMIT = 3


class Foo(Base):
    def bar(self, path: Path):
        return load(path)

    # about baz
    def baz(self):
        return os.walk(self.bar())


def top_level():
    return Foo().baz()
'''


def test_python_chunks(spark):
    chunks = ast_chunk.chunk_source("a.py", "python", PYTHON, chunk.ChunkConfig(4, 8, 8))
    lines = PYTHON.split("\n")
    covered = {k for c in chunks for k in range(c["start_line"], c["end_line"] + 1)}
    assert all(k + 1 in covered for k, x in enumerate(lines) if x.strip())
    assert all(c["end_line"] - c["start_line"] < 8 and c["text"] == "\n".join(lines[c["start_line"] - 1 : c["end_line"]]) for c in chunks)
    assert {d for c in chunks for d in c["defines"]} == {"LIMIT", "Foo", "bar", "baz", "top_level"}
    assert {"Base", "load", "Path", "walk"} <= {r for c in chunks for r in c["refs"]}
    assert any("class Foo" in c["symbol"] for c in chunks)


RUST = """use std::fs;

pub struct Walker { depth: usize }

impl Walker {
    /// next { entry
    pub fn next(&mut self) -> Option<Entry> {
        let s = "}";
        self.advance(s)
    }
}

fn main() {
    Walker::start(read_config());
}
"""


def test_brace_chunks_and_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/walk.rs").write_text(RUST)
    (tmp_path / "src/broken.py").write_text("def f(:\n  x\n")
    (tmp_path / "bad.py").write_bytes(b"x = '\xff\xfe'\n")
    (tmp_path / "bin.py").write_bytes(b"\0\1")
    (tmp_path / ".hidden.py").write_text("x = 1")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.js").write_text("f()")
    from spanlens.sources.files import walk

    found = {r.path: r for r in walk(spark, str(tmp_path)).collect()}
    assert {p: r.error for p, r in found.items()} == {"src/walk.rs": None, "src/broken.py": None, "bad.py": "not utf-8", "bin.py": "binary"}
    rows = ast_chunk.chunk_files(walk(spark, str(tmp_path)).filter("error is null"), chunk.ChunkConfig(2, 8, 5)).collect()
    rust = [r for r in rows if r.lang == "rust"]
    assert {"Walker", "next", "main"} <= {d for r in rust for d in r.defines}
    assert {"advance", "read_config", "start"} <= {x for r in rust for x in r.refs}
    assert any(r.path == "src/broken.py" and r.kind == "window" for r in rows)


def test_terms_of_awkward_runs():
    """Parts are cut as by the four rules of `text.word_parts`, one after another."""
    rng = random.Random(3)
    for _ in range(20_000):
        run = "".join(rng.choice("aAbBcC19_zZ") for _ in range(rng.randrange(1, 12)))
        cut = run.replace("_", " ")
        for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])"):
            cut = re.sub(pattern, r"\1 \2", cut)
        parts = cut.lower().split()
        want = () if run[0].isdigit() else (*(p for p in parts if len(p) > 1), *([run.lower()] if len(parts) > 1 else []))
        assert index.terms_of(run.encode()) == want
