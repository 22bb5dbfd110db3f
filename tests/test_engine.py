"""The engine end to end on a few small files, and what is registered."""

import random

from pyspark.sql import functions as F
from spanlens.functions import text as T
from spanlens.operators import index as I
from spanlens.engine import DEFAULT_SCORER, Engine
from spanlens.registry import ORACLES, QUERIES


def test_engine(spark):
    files = [
        ("src/cache.py", "python", "class TtlCache:\n    def evict(self, key):\n        return drop_entry(key)\n\n\ndef drop_entry(key):\n    return key\n"),
        ("src/walk.py", "python", "def walk_repo(root):\n    for path in list_paths(root):\n        yield path\n"),
        ("README.md", "text", "The cache evicts entries by age.\n"),
    ]
    engine = Engine.from_files(spark.createDataFrame(files, "path string, lang string, text string"))
    prompts = spark.createDataFrame([(1, "How does TtlCache evict stale cache entries?"), (2, "walk_repo and paths")], "query_id long, prompt string")
    found = engine.search(prompts).collect()
    best = {q: max((r for r in found if r.query_id == q), key=lambda r: r.score).path for q in (1, 2)}
    assert best == {1: "src/cache.py", 2: "src/walk.py"}
    scored = engine.search(prompts, scorer=DEFAULT_SCORER).collect()
    assert {r.query_id for r in scored} == {1, 2}
    assert {r.line for r in engine.find("drop_entry").collect()} == {3, 6}
    assert engine.related(prompts).columns == ["query_id", "ident", "chunk_id", "relation"]


def test_registry():
    assert len(QUERIES) > 150 and set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"retrieve_spans", "ast_chunks"}


def test_terms_of_words_as_in_expressions(spark):
    """Terms counted in Arrow are those of the expressions; rows with one id are one chunk, whatever they hold."""
    from collections import Counter

    rng = random.Random(4)
    bodies = ["".join(rng.choice(["a", "b", "Z", "Q", "7", "_", "é", " ", "-", "xy", "HTTPServer", "load_all", "\n", "ſ", "İ"]) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "9", "_", "__", "a"]
    df = spark.createDataFrame([(i % 150 if i < 200 else None if i == 200 else i, b) for i, b in enumerate(bodies)], "chunk_id long, text string")
    wanted = Counter((r.chunk_id, t) for r in df.select("chunk_id", T.terms(F.col("text")).alias("ts")).collect() for t in r.ts or [])
    found = {(r.chunk_id, r.term): r.tf for r in I.postings(df, max_tf=0).collect()}
    assert found == dict(wanted) and any("_" in t for _, t in found)
    lengths = Counter()
    for (i, _), n in wanted.items():
        lengths[i] += min(n, 2)
    asked = spark.createDataFrame([("xy",), ("load",), ("nowhere",), ("xy",)], "term string")
    for built in (I.build(df), I.written_for(df, asked)):
        assert {r.chunk_id: r.dl for r in built.doc_len.collect()} == dict(lengths)
    assert {(r.chunk_id, r.term): r.tf for r in built.postings.collect()} == {k: min(n, 2) for k, n in wanted.items() if k[1] in ("xy", "load")}


def test_postings_are_never_broadcast(spark, monkeypatch):
    """Their files may be small where what they hold is not."""
    df = spark.range(500).select(F.col("id").alias("chunk_id"), F.concat(F.lit("walk tree item"), "id").alias("text"))
    asked = spark.createDataFrame([(1, "walk", 0, 500), (2, "item", 0, 500)], "q int, term string, pos long, df long")
    index = I.written_for(df, asked)
    for few in (500_000, 0):
        monkeypatch.setattr(I, "BROADCAST_TERMS", few)
        met = I.met(asked, index)
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert met.count() == 1_000 and "BuildLeft" not in plan and ("BroadcastHashJoin" in plan) == bool(few)


def test_texts_are_not_shuffled_for_what_few_ask(spark, monkeypatch):
    """Texts are counted where they are read, and candidates go to the texts; only texts whose id comes again are brought together."""
    plans, kept = [], I.stored
    monkeypatch.setattr(I, "stored", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), kept(df, label))[1])
    rows = [(1, "walk Tree walk"), (2, None), (3, ""), (4, "7 _ - a"), (5, "treeWalk walk")]
    asked = spark.createDataFrame([("walk",), ("tree",)], "term string")
    index = I.written_for(spark.createDataFrame(rows, "chunk_id int, text string"), asked, label="once")
    assert ["Exchange" in plan for label, plan in plans if label == "once"] == [False]
    assert sorted(map(tuple, index.postings.collect())) == [(1, "tree", 1, 3), (1, "walk", 2, 3), (5, "tree", 1, 4), (5, "walk", 2, 4)]
    twice = I.written_for(spark.createDataFrame([*rows, (1, "walk tree"), (None, "walk"), (None, "leaf")], "chunk_id int, text string"), asked)
    assert {tuple(r) for r in twice.postings.collect()} == {(1, "tree", 2, 4), (1, "walk", 2, 4), (5, "tree", 1, 4), (5, "walk", 2, 4), (None, "walk", 1, 2)}
    monkeypatch.setattr(I, "BROADCAST_TERMS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n, name in ((2, "BroadcastHashJoin"), (3, "SortMergeJoin")):
            chosen = I.get_chunks(spark.createDataFrame([(i % 2, i) for i in range(n)], "q int, chunk_id long"), spark.range(9).selectExpr("id as chunk_id", "'x' as text"))
            assert name in chosen._jdf.queryExecution().executedPlan().toString() and sorted(r.chunk_id for r in chosen.collect()) == list(range(n))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
