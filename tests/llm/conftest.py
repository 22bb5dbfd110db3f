"""A small table set with every awkward case."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest


def documents():
    rng = random.Random(3)
    vocab = [a + b for a in ("ba", "ko", "ti", "lu", "ræ", "é") for b in ("no", "mi", "sha", "d", "rel", "vo", "x")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [say(120) + ".\n" + say(60) + "." for _ in range(6)]
    texts = [None, "", " ", "one", "Two words", "  \n\n ", base[0], base[0], base[0].upper(), base[1] + " tail of it"]
    for b in base:
        words = b.split(" ")
        for k in range(8):
            near = list(words)
            near[rng.randrange(len(near))] = f"new{k}"
            texts.append(" ".join(near))
    texts += ["footer of the site\n" + say(30 + i) for i in range(20)]
    texts += [say(9000), "a" * 70_000, "<|endoftext|> it's 12,5 % \t tab\r\nend", "same same same same"]
    texts += [f"{say(15)} you stupid clown {say(15)}" if i % 2 else say(32) for i in range(60)]
    rows = [{"doc_id": i, "text": t, "lang": None if i % 7 == 0 else "en", "source": None if i % 11 == 0 else f"s{i % 3}", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def sf(tmp_path_factory, rows):
    d = tmp_path_factory.mktemp("sf")
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist(rows, kinds), d / "documents.parquet")
    words = rows[6]["text"].split()
    items = [" ".join(words[10:30]), " ".join(words[40:47]), "nothing like this is in any of the documents at all really", None, "", "Two words", " ".join(rows[60]["text"].split()[3:20])]
    pq.write_table(pa.table({"item_id": list(range(len(items))), "text": items}), d / "benchmark.parquet")
    labelled = [r for r in rows if r["text"]]
    pq.write_table(
        pa.table({"doc_id": [r["doc_id"] for r in labelled], "quality": [1] * len(labelled), "toxic": [int("stupid" in r["text"]) for r in labelled]}), d / "labels.parquet"
    )
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q=1#f", "https://net/", "http://net", "ftp://x.example.com/de/1", "http://q.org/fr/", "http://q.org/frx", "http://notexample.net/en/", "http://a.b/c://d.net/"]
    urls += [f"http://h{i % 9}.example.{('net', 'com', 'org')[i % 3]}/{('de', 'en', 'fr')[i % 7 % 3]}/{i}" for i in range(90)]
    pq.write_table(pa.table({"page_id": list(range(len(urls))), "url": urls, "html": [""] * len(urls)}), d / "pages.parquet")
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    vectors = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0] * 8]
    vectors += base + base[:3] + [[x + rng.gauss(0, s) for x in b] for b in base for s in (0.02, 0.1, 0.2, 0.5)]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0] * len(vectors)}), d / "embeddings.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty(tmp_path_factory, sf):
    d = tmp_path_factory.mktemp("empty")
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        pq.write_table(pq.read_table(f"{sf}/{name}.parquet").slice(0, 0), d / f"{name}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def awkward(spark, sf):
    """documents twice over, with null ids and columns whose names the operators use inside."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "null id", "en", "s1", 7), (None, None, None, None, None)], docs.schema))
    for name in ("row", "score", "word", "items", "spans", "bucket", "h1", "id", "component_id", "n", "_t", "slot", "host"):
        from pyspark.sql import functions as F

        extra = extra.withColumn(name, F.lit("x"))
    return extra
