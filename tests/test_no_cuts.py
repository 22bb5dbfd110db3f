"""Queries that once left out a part of their candidates, against plain Python over all of them."""

import hashlib
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanlens.registry import QUERIES
from spanlens.sources.versions import ChunkStore


def put(folder, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    return str(folder)


def test_gold_of_short_and_repeated_items(spark, tmp_path):
    """Items of few or no words, items with one id, empty and null texts, documents without an id."""
    docs = {1: "the walker stores trees", 2: "a b c d", 3: "42 + 7", 4: "restores tree", 5: None, 6: "stores trees of the old walker", None: "tree walker stores trees"}
    items = [(1, "stores trees"), (2, "tree"), (3, "b c"), (4, "42 + 7"), (5, ""), (6, None), (7, "the walker stores"), (7, "stores trees of the"), (8, "nowhere at all"), (9, "tree"), (10, "\u00e9")]
    sf = put(tmp_path, documents={"doc_id": list(docs), "text": list(docs.values())}, benchmark={"item_id": [i for i, _ in items], "text": [t for _, t in items]})
    wanted = [(i, d) for i, t in items for d, body in docs.items() if t is not None and body is not None and t in body]
    got = [(r.item_id, r.doc_id) for r in QUERIES["gold_match"](spark, sf).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_states_of_long_sessions(spark, tmp_path):
    """More results and sent spans than a bounded session keeps."""
    kinds = ["view"] * 90 + ["purchase"] * 450
    rows = [(7, i, datetime(2024, 1, 1) + timedelta(seconds=i), kind, i * 37 % 101 / 7, f'{{"k": {i}}}') for i, kind in enumerate(kinds)]
    columns = ["user_id", "event_id", "ts", "event_type", "value", "props"]
    sf = put(tmp_path, events=dict(zip(columns, zip(*rows), strict=True)))
    got = {(r.kind, r.place): (r.path, r.start, r.end, r.score) for r in QUERIES["stream_session_states"](spark, sf).collect()}
    span = lambda i: (f"f{i % 7}", i, i + 5)
    working = sorted((-(i * 37 % 101 / 7), *span(i)) for i in range(90))
    wanted = {("working", n): (*s, -x) for n, (x, *s) in enumerate(working)} | {("already", i - 90): (*span(i), None) for i in range(90, 540)}
    assert got == wanted


RARE = [a + b + "q" for a in "bcdf" for b in "klmnpr"]  # as many terms as a bounded search takes; too short for names
ITEMS = {1: " ".join([*RARE, "zulu"]), 2: "yank xray"}
DOCS = {0: " ".join(RARE)} | {i: "zulu " + "pad " * i for i in range(1, 61)} | {i: "xray yank" for i in range(70, 85)} | {90: "yank xray " + "fill " * 400, 91: None}


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    documents = {"doc_id": list(DOCS), "text": list(DOCS.values()), "lang": ["en"] * len(DOCS), "source": ["s"] * len(DOCS)}
    labels = {"doc_id": list(DOCS), "quality": [i % 2 for i in DOCS], "toxic": [i % 3 % 2 for i in DOCS]}
    return put(tmp_path_factory.mktemp("crowd"), documents=documents, labels=labels, benchmark={"item_id": list(ITEMS), "text": list(ITEMS.values())})


def ranked(docs):
    """{item: [(doc, score)]} of all documents that hold a term, best first."""
    tf = {d: {w: min(n, 2) for w, n in Counter(t.split()).items()} for d, t in docs.items() if t}
    length = {d: sum(c.values()) for d, c in tf.items()}
    df, mean = Counter(w for c in tf.values() for w in c), sum(length.values()) / len(tf)
    gain = lambda w, d: math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * length[d] / mean))
    found = {i: {d: round(sum(gain(w, d) for w in text.split() if w in tf[d]), 6) for d in tf if tf[d].keys() & set(text.split())} for i, text in ITEMS.items()}
    return {i: sorted(x.items(), key=lambda p: (-p[1], p[0])) for i, x in found.items()}


def test_reciprocal_rank_of_the_whole_list(spark, crowd):
    place = {i: [d for d, _ in x] for i, x in ranked(DOCS).items()}
    gold = {i: [d for d, t in DOCS.items() if t and text in t] for i, text in ITEMS.items()}
    assert gold == {1: [], 2: [90]} and place[2].index(90) == 15
    (row,) = QUERIES["mrr_hit_recall"](spark, crowd).collect()
    assert tuple(row) == (1, 0.0, 0.0, round(1 / 16, 6), 0.0)


def test_every_candidate_passes_the_gate_or_not(spark, crowd):
    chance = lambda i, d: int(hashlib.md5(f"{i}-{d}".encode()).hexdigest()[:6], 16) % 1000 / 1000
    wanted = {(i, d) for i, x in ranked(DOCS).items() for d, _ in x if chance(i, d) >= 0.5}
    assert {(r.item_id, r.doc_id) for r in QUERIES["rerank_gate"](spark, crowd).collect()} == wanted


def test_spans_of_frequent_terms(spark, crowd):
    """The item's last term is beyond those that a bounded search takes."""
    paths = {r.path for r in QUERIES["retrieve_spans"](spark, crowd).filter("item_id = 1").collect()}
    assert "s/en/0.md" in paths and len(paths) == 10


def test_whole_lists_are_fused(spark, crowd):
    wanted = {}
    for i, x in ranked(DOCS).items():
        lexical = [d for d, _ in x]
        quality = sorted(lexical, key=lambda d: (-(d % 2), d % 3 % 2, d))
        wanted |= {(i, d): round(1 / (60 + lexical.index(d)) + 1 / (60 + quality.index(d)), 9) for d in lexical}
    got = {(r.item_id, r.doc_id): r.fused for r in QUERIES["rrf_fusion"](spark, crowd).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-8 for k in wanted)


def test_store_search_by_all_terms(spark, crowd):
    later = {d: f"{t} changed text changed_text again" if t and d % 10 == 3 else t for d, t in DOCS.items() if d % 10 != 7}
    wanted = {i: {str(d): s for d, s in x[:10]} for i, x in ranked(later).items()}
    rows = QUERIES["store_search"](spark, crowd).collect()
    got = {i: {r.chunk_id: r.score for r in rows if r.item_id == i} for i in ITEMS}
    assert {i: x.keys() for i, x in got.items()} == {i: x.keys() for i, x in wanted.items()}
    assert all(abs(got[i][d] - s) < 2e-6 for i, x in wanted.items() for d, s in x.items())


def test_a_store_shuffles_no_texts(spark, tmp_path):
    """Neither puts nor compactions; rows of one chunk count as one all the same."""
    rng = random.Random(3)
    noise = ["".join(rng.choice("!#$%&()*+,-./:;<=>?@[]^{|}~") for _ in range(20_000)) for _ in range(60)]
    rows = [(str(i), f"f{i}", f"tree {n} walk", ["tree"], ["walk"]) for i, n in enumerate(noise)]
    spark.createDataFrame(rows, "chunk_id string, path string, text string, defines array<string>, refs array<string>").repartition(4).write.parquet(f"{tmp_path}/in")
    chunks = spark.read.parquet(f"{tmp_path}/in")
    status = spark.sparkContext._jsc.sc().statusStore()
    shuffled = lambda: status.executorList(False).head().totalShuffleWrite()
    store, before = ChunkStore(spark, f"file://{tmp_path}/s"), shuffled()
    store.put(chunks)
    store.put(chunks.filter("chunk_id < '3'"), chunks.filter("chunk_id >= '5'").select("path"))
    made = store.compact()
    assert shuffled() - before < sum(map(len, noise)) / 10
    left = sum(str(i) < "5" for i in range(60))
    assert {r.term: r.df for r in made.term_df().collect()} == {"tree": left, "walk": left}
    assert made.terms().count() == left == made.corpus().first().n
    store.put(chunks.filter("chunk_id = '4'").unionByName(chunks.filter("chunk_id = '4'")))
    assert {(r.term, r.tf, r.dl) for r in store.snapshot().postings().filter("chunk_id = '4'").collect()} == {("tree", 2, 4), ("walk", 2, 4)}
    assert store.snapshot().corpus().first().n == left
