"""Filter outcomes by matrix product against applying the filters one after another."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import audit


def fails(docs):
    """The letters each document fails, one document at a time."""
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    out = []
    for key, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = set()
        bad |= {"A"} if len(words) < 200 else set()
        bad |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        bad |= {"D"} if re.search("[#$%&*|]", text) else set()
        bad |= {"E"} if key is not None and key > least[text] else set()
        out.append(bad)
    return out


def plain(docs, labels):
    """Every row of the result, by walking the documents through each order."""
    quality, toxic = {}, {}
    for key, q, t in labels:
        quality[key] = max(quality.get(key, 0), q == 1)
        toxic[key] = max(toxic.get(key, 0), t == 1)
    rows, shapley, bad = {}, Counter(), fails(docs)
    for part in {p or "" for *_, p in docs}:
        for order in itertools.permutations("ABCDE"):
            rows |= {(part, "".join(order), step): Counter() for step in range(1, 6)}
    for (key, _, part), own in zip(docs, bad, strict=True):
        part = part or ""
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = rows[part, "".join(order), step]
                if f in own and not gone:
                    row["removed"] += 1
                    row["good_lost"] += quality.get(key, 0)
                    row["toxic_lost"] += toxic.get(key, 0)
                    shapley[part, f] += 1
                    gone = True
                elif f in own:
                    row["redundant"] += 1
                row["kept"] += not gone
                row["unique_fails"] += own == {f}
    return {k: (*(r[c] for c in audit.COLUMNS[:-1]), shapley[k[0], k[1][k[2] - 1]]) for k, r in rows.items()}


def got(df):
    rows = df.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in audit.COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_walking_through(spark, sf, empty):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    found = got(audit.op11_filter_audit(spark, sf))
    assert found == plain(docs, labels) and len(found) == 1200
    assert all(any(r[i] for r in found.values()) for i in range(len(audit.COLUMNS) - 1) if audit.COLUMNS[i] != "toxic_lost")
    assert audit.op11_filter_audit(spark, empty).count() == 0


def test_sql(spark, sf):
    with duckdb.connect() as db:
        for name in ("documents", "labels"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
        result = db.execute(audit.OP11_SQL)
        names = [c[0] for c in result.description]
        rows = [dict(zip(names, r)) for r in result.fetchall()]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COLUMNS) for r in rows} == got(audit.op11_filter_audit(spark, sf))


def test_awkward_rows(spark, awkward):
    """Null and repeated keys, labels that repeat or are null, texts at each bound, clashing names."""
    edge = [" ".join(["w"] * n) for n in (199, 200)] + [" ".join(f"w{i % m}" for i in range(200)) for m in (99, 100)]
    edge += ["A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "É" * 10, "a|b", "\x0b\t a \r\n", "a b c " * 100, "#" * 100_000]
    docs = awkward.unionByName(spark.createDataFrame([(1000 + i, t, "xx", "s", 1) for i, t in enumerate(edge * 2)] + [(None, edge[0], "", "s", 1), (5, edge[0], None, "s", 1)], awkward.columns[:5]), allowMissingColumns=True)
    docs = docs.withColumn("mask", F.lit("x")).withColumn("key", F.lit(1)).withColumn("part", F.lit("p")).withColumn("hash", F.lit("h"))
    labels = spark.createDataFrame([(i, *qt) for i in range(0, 1015) for qt in [(i % 2, i % 3 % 2), (None, 1), (1, None)][: i % 3 + 1]] + [(None, 1, 1)], "doc_id long, quality int, toxic int").withColumn("n", F.lit(1))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    known = [(k, q, t) for k, q, t in (tuple(r)[:3] for r in labels.collect()) if k is not None]
    assert got(audit.outcomes(audit.histograms(audit.masks(docs), labels))) == plain(rows, known)
    assert got(audit.outcomes(audit.histograms(audit.masks(docs), labels), parts_at_once=1)) == plain(rows, known)


@pytest.mark.parametrize("filters", ["A", "AB", "ABCDE"])
def test_matrices(filters):
    columns, m = audit.incidence(filters)
    assert all(v.shape == (2 ** len(filters), len(columns)) and v.dtype == np.int64 for v in m.values())
    # Each mask is removed once in each order, or kept at its last step; each failure is removed or redundant.
    orders = len(columns) // len(filters)
    last = np.array([step == len(filters) for _, step in columns])
    for mask in range(2 ** len(filters)):
        assert m["removed"][mask].sum() + m["kept"][mask][last].sum() == orders
        assert (m["removed"] + m["redundant"])[mask].sum() == orders * bin(mask).count("1")
