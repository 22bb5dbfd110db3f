"""URL filter, embeddings and the pipeline against brute force."""

import re

import numpy as np
from conftest_helpers import union_find
from test_text_ops import brute_decontam, brute_groups

from spanlens.llm import embdedup, urlfilter
from spanlens.llm.common import components

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute_url(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_url_rules(spark, sf, empty):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in urlfilter.op1_url_filter(spark, sf).collect()}
    assert set(got) == set(urls)
    for i, url in urls.items():
        host, path, rule = brute_url(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and (rule is None or got[i].verdict == RULES[rule])
    assert urlfilter.op1_url_filter(spark, empty).count() == 0


def test_url_filter_runs_no_python(spark, sf):
    plan = urlfilter.op1_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_boosted_trees_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = urlfilter.grow(x[:1500], y[:1500], np.ones(1500))

    def value(t, r):
        return t if not isinstance(t, tuple) else value(t[2] if r[t[0]] <= t[1] else t[3], r)

    right = [(trees.base + sum(value(t, r) for t in trees.trees) > 0) == bool(k) for r, k in zip(x[1500:], y[1500:], strict=True)]
    assert np.mean(right) > 0.95
    assert urlfilter.grow(x[:0], y[:0], y[:0]).trees == () and urlfilter.grow(x[:9], np.ones(9), np.ones(9)).trees == ()


def brute_vectors(rows):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    n, links = {i: 0 for i, _ in rows}, []
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9:
                n[a] += 1
                n[b] += 1
                links.append((a, b))
    return n, union_find([i for i, _ in rows], links)


def test_embeddings_match_brute_force(spark, sf, empty):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    n, groups = brute_vectors([(r.vec_id, r.embedding) for r in df.collect()])
    got = {r.vec_id: r for r in embdedup.op3_embedding_dedup(spark, sf).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (n[i], groups[i], groups[i] == i) for i in n}
    assert max(n.values()) >= 3
    small = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(df, block=2).collect()}
    assert small == {i: (r.n_links, r.component_id) for i, r in got.items()}
    assert embdedup.op3_embedding_dedup(spark, empty).count() == 0


def test_hadamard_is_orthogonal():
    h = embdedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 20), (20, 21), (7, 7), (30, 29), (29, 28), (28, 27), (27, 26)]
    nodes = sorted({x for p in links for x in p})
    found = components(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(links, "a long, b long"))
    got = {i: i for i in nodes} | {r.id: r.component_id for r in found.collect()}
    assert got == union_find(nodes, links)


def test_pipeline_against_brute_force(spark, sf, rows):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = [r.asDict() for r in docs.collect()]
    assert {r["doc_id"] for r in kept["toxicity"]} == {r["doc_id"] for r in rows if not (r["text"] and "stupid" in r["text"])}
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    assert not any("footer of the site" in (r["text"] or "") for r in kept["line_dedup"] if r["source"])
    _, groups = brute_groups(kept["line_dedup"], 5, 80)
    assert {r["doc_id"] for r in kept["minhash"]} == set(groups.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute_decontam(kept["minhash"], items)
    assert {r["doc_id"] for r in kept["decontamination"]} == {i for i, v in hit.items() if not v[4]}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == {r["doc_id"] for r in kept["decontamination"]}
    assert all(len(r.ids) == r.length for r in packed)


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_url_features_in_plain_python(spark, sf):
    """Every lexical feature of every URL of the fixture, and some awkward ones, computed one URL at a time."""
    import math
    from collections import Counter

    from pyspark.sql import functions as F

    from spanlens.llm import urlfilter

    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    urls += ["HTTPS://A.b-c.example.org:80//x/y//z.html?a=1&&b=2#f?g=3", "http://é.net/ü?ö", "x://", "http://h?q", "http://1.2.3.4/5-6", "a" * 500]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    got = df.select("url", *(c.alias(k) for k, c in urlfilter.lexical(F.col("url"), F.col("host"), F.col("path")).items())).collect()
    assert len(got) == len(urls)
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        n, digits = len(u), lambda s: sum(c in "0123456789" for c in s)
        want = {
            "length": n, "host_length": len(host), "path_length": len(path), "depth": sum(p != "" for p in path.split("/")), "dots": host.count("."), "hyphens": u.count("-"),
            "digit_ratio": digits(u) / n if n else 0, "entropy": -sum(c / n * math.log2(c / n) for c in Counter(u).values()), "parameters": sum(p != "" for p in query.split("&")),
            "secure": u[:6].lower() == "https:", "fragment": "#" in u, "host_digits": digits(host),
        }
        for name, value in want.items():
            assert abs(r[name] - value) < 1e-9, (u, name, r[name], value)
