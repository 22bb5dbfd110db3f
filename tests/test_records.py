"""A rotating log and its follower; bootstrap draws in arrays and in joins."""

import random

import pytest
from pyspark.sql import functions as F

from spanlens.operators import stats
from spanlens.sources.records import RotatingLog, summary


def test_rotation_and_following(spark, tmp_path):
    log = RotatingLog(spark, f"file://{tmp_path}/log", max_bytes=600, keep=2)
    schema, seen = spark.createDataFrame([], "id int, text string").schema, []
    rows = lambda a, b: spark.createDataFrame([(i, "x" * 40) for i in range(a, b)], schema).coalesce(1)

    def follow():
        put = lambda batch, _: seen.extend(r.id for r in batch.collect())
        log.follow(schema).writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    assert log.append(rows(0, 15), "a") == 1 and log.append(rows(15, 20), "b") == 2
    follow()
    assert log.append(rows(15, 20), "b") == 2  # again: nothing is there twice
    assert sorted(r.id for r in log.read(schema).collect()) == list(range(20))
    assert log.append(rows(20, 40), "c") == 2 and log.append(rows(40, 41), "d") == 3
    assert log.generations() == [2, 3] and log.append(rows(41, 42)) == 3
    follow()
    assert set(seen) == set(range(42))  # the first generation was read before it went
    with open(f"{tmp_path}/log/gen-00000003/bad.json", "w") as f:
        f.write('{"id": 99, "te\n')
    assert sorted(r.id for r in log.read(schema).collect()) == list(range(15, 42))


def test_summary(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 9.0)], "kind string, s int, d double")
    assert sorted(map(tuple, summary(df, "kind", "s", "d", F.col("d") > 2.5).collect())) == [("a", 2, 1, 1, 5.0, 3.0), ("b", 1, 1, 1, 9.0, 9.0)]


def test_draws_in_arrays_equal_draws_in_a_join(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, rng.choice(["r", "s", None]), rng.uniform(1, 9), rng.uniform(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "task int, repo string, x double, y double")
    fast = stats.bootstrap(df, "repo", {"m": ("x", "y")}, draws=300).first()
    monkeypatch.setattr(stats, "BLOCK", 50)
    blocks = stats.bootstrap(df, "repo", {"m": ("x", "y")}, draws=300).first()
    monkeypatch.setattr(stats, "_drawn_sums", lambda *_: None)
    joined = stats.bootstrap(df.filter("repo is not null"), "repo", {"m": ("x", "y")}, draws=300).first()
    assert list(fast)[1:] == pytest.approx(list(blocks)[1:])
    monkeypatch.undo()
    same = stats.bootstrap(df.filter("repo is not null"), "repo", {"m": ("x", "y")}, draws=300).first()
    assert list(same)[1:] == pytest.approx(list(joined)[1:])
    missing = spark.createDataFrame([(1, "r", None, 2.0), (2, "r", 3.0, 2.0)], df.schema)
    assert stats.bootstrap(missing, "repo", {"m": ("x", "y")}, draws=50).first().pooled == pytest.approx(-0.25)


def test_many_pairs_are_drawn_in_pieces(spark, monkeypatch):
    """Whatever the pieces, the picks are those of plain Python; no row is made for a draw of a pair."""
    rng = random.Random(2)
    rows = [(i, rng.choice(["r", "s", None]), rng.choice([None, rng.uniform(1, 9)]), rng.uniform(1, 9)) for i in range(80)] + [(99, "alone", None, 2.0)]
    df = spark.createDataFrame(rows, "task int, repo string, x double, y double")
    strata = [[(x, y) for _, s, x, y in rows if s == k] for k in ("r", "s", None, "alone")]
    wanted = []
    for b in range(200):
        picked = [xy[stats.drawn(b, i, len(xy))] for xy in strata for i in range(len(xy))]
        wanted.append(sum(x for x, _ in picked if x is not None) / sum(y for _, y in picked) - 1)
    wanted.sort()
    monkeypatch.setattr(stats, "BROADCAST_PAIRS", 10)
    for piece, block in ((500_000, 2_000_000), (7, 50), (7, 5)):
        monkeypatch.setattr(stats, "PIECE", piece)
        monkeypatch.setattr(stats, "BLOCK", block)
        r = stats.bootstrap(df, "repo", {"m": ("x", "y")}, draws=200)
        assert "_slot" not in r._jdf.queryExecution().analyzed().toString()
        r = r.first()
        assert (r.lo, r.hi) == pytest.approx((wanted[5], wanted[194]))


def test_intermediate_files_are_deleted(spark, tmp_path_factory):
    """A query's intermediate tables are gone once its result was consumed inside `scratch`."""
    import os

    from spanlens.operators.index import build, written
    from spanlens.sources import store

    df = spark.createDataFrame([("a", "tree walk"), ("b", "tree")], "chunk_id string, text string")
    with store.scratch(spark) as made:
        index = written(build(df))
        assert index.postings.count() == 3
        folders = [p.removeprefix("file://") for p in made[-1:]]
        assert folders and all(os.path.isdir(f) for f in folders)
    assert not any(os.path.exists(f) for f in folders) and index.postings.count is not None


def test_a_document_meets_the_items_whose_rarest_word_it_holds(spark):
    from spanlens.operators import leakage

    docs = spark.createDataFrame([(1, "a b rare c d"), (2, "b b c"), (3, "xb rare cx"), (4, None), (5, "")], "doc int, t string")
    items = spark.createDataFrame([(7, "b rare c"), (8, "x b y"), (9, "q nowhere q"), (10, "")], "item int, u string")
    got = leakage.sharing_rarest(docs, items, "doc", "item", "t", "u")
    assert sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (2, 8), (3, 7)] or sorted(map(tuple, got.collect())) == [(1, 7), (1, 8), (2, 8), (3, 7), (5, 10)]


def test_an_index_of_asked_terms(spark, monkeypatch):
    """Postings of the asked terms; lengths, counts and means of everything."""
    from spanlens.operators import index

    df = spark.createDataFrame([("a", "tree walk tree tree"), ("b", "tree"), ("c", "leaf"), ("d", "")], "chunk_id string, text string")
    terms = spark.createDataFrame([("tree",), ("tree",), ("none",)], "term string")
    whole = index.build(df)
    for bound in (500_000, 0):
        monkeypatch.setattr(index, "BROADCAST_TERMS", bound)
        got = index.written_for(df, terms)
        same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        assert same(got.postings.select("chunk_id", "term", "tf", "dl"), whole.postings.filter("term = 'tree'").select("chunk_id", "term", "tf", "dl"))
        assert same(got.doc_len.select("chunk_id", "dl"), whole.doc_len.select("chunk_id", "dl")) and same(got.corpus, whole.corpus)
        assert same(got.term_df.select("term", "df"), whole.term_df.filter("term = 'tree'").select("term", "df"))
