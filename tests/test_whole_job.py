"""Queries that once read a part of their input, against plain Python over all of it."""

import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spanlens.registry import QUERIES


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """Line items with many orders, late lines and large groups; spans that begin alike."""
    rng = random.Random(11)
    rows = [{"l_orderkey": rng.choice((7, 99, 499, 6001, 25_000)) + i, "l_partkey": rng.randrange(200), "l_suppkey": i % 12, "l_linenumber": i % 7 + 1, "l_quantity": float(rng.randint(1, 50)), "l_discount": rng.randrange(11) / 100, "l_tax": rng.randrange(9) / 100} for i in range(900)]
    d = tmp_path_factory.mktemp("lines")
    pq.write_table(pa.Table.from_pylist(rows), d / "lineitem.parquet")
    return str(d), rows


def merged(rows):
    groups = defaultdict(list)
    for r in rows:
        s = r["l_partkey"] % 60
        groups[r["l_suppkey"] // 5, f"f{r['l_suppkey'] % 5}"].append((s, int(s + r["l_quantity"]), round(r["l_discount"] + r["l_tax"], 2)))
    out = defaultdict(list)
    for (q, path), spans in groups.items():
        done = []
        for s, e, score in sorted(spans):
            if done and s - done[-1][1] - 1 <= 3 and max(done[-1][1], e) - done[-1][0] + 1 <= 50:
                done[-1] = (done[-1][0], max(done[-1][1], e), max(done[-1][2], score))
            else:
                done.append((s, e, score))
        out[q] += [(-score, path, s, e) for s, e, score in done]
    return {q: sorted(x) for q, x in out.items()}, {k: min(x)[0] for k, x in groups.items() if k[1] in ("f1", "f3")}


def budgeted(spans, left=100):
    for _, path, s, e in spans:
        if left > 0:
            yield path, s, min(e, s + left - 1)
        left -= e - s + 1


def got(spark, name, sf, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, sf).collect())


def test_spans_of_all_line_items(spark, lines):
    sf, rows = lines
    by_query, first = merged(rows)
    span = ("query_id", "path", "start", "end")
    assert got(spark, "merge_spans", sf, *span, "score") == sorted((q, p, s, e, -x) for q, xs in by_query.items() for x, p, s, e in xs)
    assert got(spark, "line_budget", sf, *span) == sorted((q, *x) for q, xs in by_query.items() for x in budgeted(xs))
    assert got(spark, "shape_spans", sf, *span) == sorted((q, *x) for q, xs in by_query.items() for x in budgeted(xs[:10]))
    sent = lambda q, p, s, e: (q, p) in first and s <= first[q, p] + 10 and first[q, p] <= e
    every = [(q, p, s, e) for q, xs in by_query.items() for _, p, s, e in xs]
    assert got(spark, "interval_overlap_join", sf, *span) == sorted(x for x in every if sent(*x))
    assert got(spark, "already_sent_anti", sf, *span) == sorted(x for x in every if not sent(*x))
    said, fits = defaultdict(list), []
    for q, xs in by_query.items():
        used, took = 0, []
        for rank, (_, p, s, e) in enumerate(xs):
            said[q, p].append((rank, f"{s}-{e}"))
            took.append(used + e - s + 1 <= 60)
            used += (e - s + 1) * took[-1]
        fits.append((q, took))
    assert got(spark, "ranked_locations", sf, "query_id", "path", "line", "first") == sorted((*k, "; ".join(t for _, t in x), x[0][0]) for k, x in said.items())
    assert got(spark, "budget_append", sf, "query_id", "fits") == sorted(fits)
    sized = []
    for q, xs in by_query.items():
        # Full and listed spans share the cap of ten.
        room = 10 - min(2, len({p for _, p, s, e in xs if not sent(q, p, s, e)}))
        seen, listed = [], 0
        for _, p, s, e in xs:
            if sent(q, p, s, e):
                sized.append((q, p, s, e, "already"))
            elif p not in seen and len(seen) < 2:
                seen.append(p)
                sized.append((q, p, s, e, "full"))
            elif listed < room:
                listed += 1
                sized.append((q, p, s, e, "map"))
    assert got(spark, "size_context", sf, *span, "bucket") == sorted(sized)


def test_leaks_in_long_documents(spark, tmp_path):
    item = "Where does the quick walker store what it parsed yesterday?"
    filler = " ".join(f"filler{i % 97}" for i in range(3_000))
    bodies = [filler, f"{filler} {item} {filler}", item, f"{filler} {item.upper()}", None]
    pq.write_table(pa.table({"doc_id": list(range(len(bodies))), "text": bodies}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [5, 6], "text": [item, "an item that no document holds"]}), tmp_path / "benchmark.parquet")
    assert got(spark, "leakage_check", str(tmp_path), "doc_id", "item_id", "exact") == [(1, 5, False), (2, 5, True), (3, 5, False)]


def test_frequency_changes_of_all_documents(spark, tmp_path):
    bodies = {1: "alpha beta", 5: "alpha gamma", 10: "delta added", 51: "beta freshly", 70: "omega", 7: None}
    pq.write_table(pa.table({"doc_id": list(bodies), "text": list(bodies.values())}), tmp_path / "documents.parquet")
    assert got(spark, "df_delta", str(tmp_path), "term", "delta") == [("added", 2), ("freshly", 3)]


def test_best_subset_of_all_orders(spark, tmp_path):
    rng = random.Random(5)
    tasks = {1: 1, 2: 6, 3: 11, 4: 14, 5: 30, 6: 1}
    rows = [{"o_custkey": t, "o_orderkey": 100 * t + i, "o_totalprice": float(rng.randrange(500, 500_000))} for t, n in tasks.items() for i in range(n)]
    rows[-1]["o_totalprice"] = 900_000.0  # fits nowhere
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "orders.parquet")
    wanted = []
    for t in tasks:
        states = {(0, 0, 0)}  # loss, size, mask of every subset, without those that another beats whatever follows
        for k, r in enumerate(x for x in rows if x["o_custkey"] == t):
            n, g = int(r["o_totalprice"] // 1000), int(r["o_totalprice"] * 7 // 1000) % 97
            states |= {(a - g, b + n, m + 2**k) for a, b, m in states if b + n <= 700}
            if t == 5:
                least = {}
                for a, b, m in states:
                    least[b] = min(least.get(b, (a, m)), (a, m))
                states = {(a, b, m) for b, (a, m) in least.items()}
        a, b, m = min(states)
        wanted.append((t, m, b, -a))
    assert got(spark, "subset_oracle", str(tmp_path), "task", "mask", "size", "gain") == wanted
    assert any(m >= 2**16 for _, m, _, _ in wanted)


def test_prompts_and_states_are_whole(spark, tmp_path):
    said = ["x" * 50, "y" * 101, "z" * 5_000, None]
    pq.write_table(pa.table({"conv_id": [1] * 4, "turn": list(range(4)), "role": ["user"] * 4, "text": said}), tmp_path / "conversations.parquet")
    rows = QUERIES["capture_record"](spark, str(tmp_path)).collect()
    assert {r.turn: (r.prompt, r.chars) for r in rows} == {i: (t and t[:4_000], t and len(t)) for i, t in enumerate(said)}
    words = [f"w{i}" for i in range(900)]
    bodies = ["one\n  two\n", " ".join(words[:252]), " ".join(words[:253]), "\n".join(words), ""]
    pq.write_table(pa.table({"doc_id": list(range(5)), "text": bodies, "lang": ["en"] * 5, "source": ["s"] * 5}), tmp_path / "documents.parquet")
    states = {r.doc_id: r.state for r in QUERIES["render_state"](spark, str(tmp_path)).collect()}
    # The header has four tokens.
    head = lambda i: f"file: s/en/{i}.md (lines 1-{len(bodies[i].split(chr(10)))})\n"
    assert states == {0: head(0) + bodies[0], 1: head(1) + bodies[1], 2: head(2) + bodies[1], 3: head(3) + "\n".join(words[:252]), 4: head(4)}
