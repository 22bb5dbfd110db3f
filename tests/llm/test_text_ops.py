"""Operators on documents against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest_helpers import lower, union_find

from spanlens.llm import decontam, linededup, lm, minhash, packing, sharding, tokenfile, toxicity

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingle_set(text, k):
    w = BLANK_WORD.findall(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_groups(rows, k, per_cent):
    sets = {r["doc_id"]: shingle_set(r["text"], k) for r in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return sets, union_find(ids, links)


def test_minhash_matches_brute_force(spark, sf, rows):
    got = {r.doc_id: r for r in minhash.op4_minhash(spark, sf).collect()}
    sets, groups = brute_groups(rows, 3, 85)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), groups[i], groups[i] == i) for i in sets}


def test_minhash_awkward_and_empty(spark, empty, awkward, rows):
    assert minhash.op4_minhash(spark, empty).count() == 0
    _, groups = brute_groups(rows, 5, 80)
    got = minhash.near_duplicates(awkward).collect()
    assert len(got) == 2 * len(rows) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == groups
    kept = minhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(groups.values()))
    assert kept.filter("doc_id is null").count() == 2


def test_one_permutation_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:360], rng.integers(0, 2**63, 40).astype(np.uint64) * np.uint64(2)]))
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - truth) < 0.15
    few = a[:3]
    assert set(minhash.signature(few)) <= set(few)  # empty bins borrow


def brute_decontam(rows, items, span=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM_WORD.findall(lower(t)) if t else []
        for at in range(max(1, len(w) - span + 1) if w else 0):
            windows[tuple(w[at : at + span])].add(str(i))
    lengths = {len(w) for w in windows}
    out = {}
    for r in rows:
        w = ALNUM_WORD.findall(lower(r["text"])) if r["text"] else []
        hit, found = set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (name := windows.get(tuple(w[at : at + n]))) is not None:
                    hit.update(range(at, at + n))
                    found |= name
        out[r["doc_id"]] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontam_matches_brute_force(spark, sf, rows):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in decontam.op5_decontam(spark, sf).collect()}
    truth = brute_decontam(rows, items)
    assert got == truth
    assert sum(v[4] for v in truth.values()) > 5


def test_decontam_in_blocks_and_filter(spark, sf, empty, awkward, rows):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    cols = ["doc_id", "n_words", "spans", "items"]
    one = sorted(map(str, decontam.find(docs, bench).select(cols).collect()))
    many = sorted(map(str, decontam.find(docs, bench, block_chars=80).select(cols).collect()))
    assert one == many
    clean = decontam.drop_contaminated(awkward, bench, block_chars=80)
    truth = brute_decontam(rows, [(r.item_id, r.text) for r in bench.collect()])
    assert clean.columns == awkward.columns
    assert {r.doc_id for r in clean.collect()} - {None} == {i for i, v in truth.items() if not v[4]}
    assert decontam.op5_decontam(spark, empty).count() == 0
    assert not decontam.find(docs, bench.limit(0)).filter("size(items) > 0").count()


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        shared = rng.integers(0, 2**63, 10).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64), shared, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])
        item = np.concatenate([rng.integers(0, 2**63, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(0, 2**63, 4).astype(np.uint64)])
        spans, found = decontam.Items([("a", item)]).hits(doc)
        assert found == {"a"} and any(e - s >= 10 for s, e in spans)


def encoded(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, sf, empty, rows):
    ids, at = encoded(rows), 0
    got = {r.doc_id: r for r in tokenfile.op7_token_file(spark, sf).collect()}
    assert len(got) == len(rows)
    for i in sorted(ids):
        whole = ids[i] + [0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(whole), crc(whole))
        at += len(whole)
    assert tokenfile.op7_token_file(spark, empty).count() == 0


def test_token_file_metadata_reads_no_ids(spark, sf, awkward, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(awkward, path, shards=3)
    meta = tokenfile.read_tokens(spark, path, columns=())
    assert meta.count() == awkward.count()
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()


def test_packing_is_whole_ordered_and_tight(spark, sf, empty, rows):
    ids = {i: x + [1] for i, x in encoded(rows).items()}
    got = packing.op2_packing(spark, sf)
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in got.collect():
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == crc(ids[i][at : at + r.length])
            at += r.length
        assert at == len(ids[i])
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    stats = packing.padding(got).first()
    assert stats.padding <= 0.02 * stats.ids
    assert packing.op2_packing(spark, empty).count() == 0


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        at = np.unique(rng.integers(1, 60, 12))
        at = np.unique(np.concatenate([at, np.arange(8, at[-1], 8)]))
        cost = rng.integers(0, 6, len(at)).astype(float)
        cost[-1] = 0

        def value(edges, size=20):
            total, last = 0.0, 0
            for e in edges:
                total += size - (e - last) + cost[np.searchsorted(at, e)]
                last = e
            return total

        best = {0: 0.0}
        for j, c in enumerate(at.tolist()):
            best[c] = min(v + 20 - (c - i) + cost[j] for i, v in best.items() if i < c and c - i <= 20)
        assert value(packing.best_cuts(at, cost, 20)) == best[int(at[-1])]


def test_packer_carries_over(spark, rows):
    ends = np.zeros(100, bool)
    packer = packing.Packer(ends, 16, 2.0, 8.0, 8)
    said = []
    for k in range(30):
        packer.add(k, np.full(k % 23 + 1, 5, np.uint32))
        if packer.held > 60:
            said += [p for w in packer.windows(False) for p in w]
    said += [p for w in packer.windows(True) for p in w]
    seen = defaultdict(int)
    for key, ids, start, total in said:
        assert start == seen[key] and total == key % 23 + 1
        seen[key] += len(ids)
    assert dict(seen) == {k: k % 23 + 1 for k in range(30)}


def test_sharding_law(spark, sf, empty, awkward, rows):
    got = sharding.op6_sharding(spark, sf).collect()
    text = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.op6_sharding(spark, empty).count() == 0
    twice = sharding.assign(awkward).collect()
    where = defaultdict(set)
    for r in twice:
        where[r.doc_id].add(r.shard)
    assert len(twice) == 2 * len(rows) + 2 and all(len(s) == 1 for s in where.values())
    assert all(where[r.doc_id] == {r.shard} for r in got)


def test_sharding_weights(spark):
    keys = spark.range(20_000)
    from pyspark.sql import functions as F

    share = {r.s: r.n for r in keys.groupBy(sharding.rendezvous(F.col("id"), (1.0, 2.0, 1.0)).alias("s")).agg(F.count("*").alias("n")).collect()}
    assert abs(share[1] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02


def test_line_dedup_matches_brute_force(spark, sf, empty, awkward, rows):
    pages, often = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        for line in {x.strip(" ") for x in (r["text"] or "").split("\n")} - {""}:
            often[r["source"], line] += 1
    bad = {k for k, n in often.items() if n >= linededup.MIN_PAGES and n > pages[k[0]] * linededup.RATIO}
    assert any("footer" in line for _, line in bad)
    got = {r.doc_id: r for r in linededup.op8_line_dedup(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if r["text"] is None:
            assert got[r["doc_id"]].text is None and got[r["doc_id"]].n_lines == 0
            continue
        kept = [x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in bad]
        assert got[r["doc_id"]].text == "\n".join(kept)
        assert got[r["doc_id"]].n_dropped == len(r["text"].split("\n")) - len(kept)
    assert linededup.op8_line_dedup(spark, empty).count() == 0
    assert linededup.drop_boilerplate(awkward).count() == awkward.count()


def test_line_dedup_runs_no_python(spark, sf):
    plan = linededup.op8_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_deobfuscation():
    words = "idiot stupid clown loser moron hello there the this that wall well".split()
    grams = Counter()
    for w in words:
        p = f"  {w} "
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    model = toxicity.CharModel(dict(grams))
    for said, meant in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("$tup1d", "stupid"), ("iiidiooot", "idiot"), ("l0ser", "loser"), ("m.o.r.o.n", "moron"), ("w3ll", "well")):
        assert toxicity.restore(said, model) == [meant]
    restorer = toxicity.Restorer(model)
    assert "idiot" in restorer.of("you i d i o t now") and "clown" in restorer.of("CL0WN!!!")
    assert restorer.of(None) == set() and restorer.of("12 34 --") == set()


def test_toxicity_on_held_out(spark, sf, empty, rows):
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert g.held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7)
    bad = [r for r in rows if r["text"] and "stupid" in r["text"]]
    held = [r for r in bad if got[r["doc_id"]].held_out]
    assert held and sum(got[r["doc_id"]].predicted for r in held) >= 0.8 * len(held)
    assert not any(got[r["doc_id"]].predicted for r in rows if r not in bad)
    assert toxicity.op9_toxicity(spark, empty).count() == 0


def test_toxicity_without_labels(spark, sf, awkward):
    model = toxicity.fit(awkward, spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 0"))
    scored = toxicity.annotate(awkward, model, out="tox")
    assert scored.columns == [*awkward.columns, "tox"] and scored.filter("tox >= 0.7").count() == 0


def test_lm_base_and_score(spark, sf, empty, rows):
    got = {r.doc_id: r for r in lm.op10_lm_score(spark, sf).collect()}
    words = {r["doc_id"]: [*BLANK_WORD.findall(lower(r["text"])), None] for r in rows}
    seen = Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            seen.update(w)
    n, v = sum(seen.values()), len(seen)
    for i, w in words.items():
        base = sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(seen[x] > 0 for x in w), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base))
        assert math.isfinite(got[i].score) and got[i].score < 0
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
    assert got[6].score == got[7].score  # copies
    assert lm.op10_lm_score(spark, empty).count() == 0


def test_attention_windows_score_each_id_once_and_sum_to_one():
    rng = np.random.default_rng(6)
    v, end = 40, 39
    starts = np.zeros(v, bool)
    starts[:20] = starts[end] = True
    counts = rng.integers(1, 50, v).astype(float)
    runs = [np.concatenate([[end], rng.integers(0, 39, 200), [end]]) for _ in range(20)]
    beside = (rng.integers(0, v, 300), rng.integers(0, 14, 300), rng.integers(1, 9, 300).astype(float))
    sh = lm.shape(counts, beside, 6, 3, 12)
    pairs, seen = lm.bigrams(runs, sh)
    bigram = lm.odds(pairs)
    fitted = lm.train(lm.initial(sh.v, sh.c, 4), lm.windows_of(runs, 4), sh.row, sh.klass, bigram, 4, epochs=2)
    model = lm.assemble(counts, starts, sh, bigram, seen, fitted, 4)
    ids = rng.integers(0, 39, 33)
    # Chances of all next ids after a prefix add up to one.
    rows = model.row[np.concatenate([[end], ids])]
    total = 0.0
    pad = (-len(rows)) % 4
    context = np.concatenate([rows, rows[:1].repeat(pad)]).reshape(-1, 4)
    follows = np.arange(len(context)) > 0
    at = len(ids)
    for nxt in range(v):
        goal = np.full(context.shape, model.klass[nxt])
        logs, _ = model.logs(context, goal, follows)
        last = ids[-1]
        total += math.exp(logs.reshape(-1)[at] + model.share[model.klass[last], model.row[nxt]] + model.alone[nxt])
    assert abs(total - 1) < 1e-4
    # Scoring texts together or alone is the same.
    each, words = np.ones(33, np.int64), np.array([10, 0, 23])
    both, logs = model.score(ids, each, words, np.zeros(33), 0.3, end, 0.1)
    alone = [model.score(ids[a:b], each[a:b], np.array([b - a]), np.zeros(b - a), 0.3, end, 0.1)[0][0] for a, b in ((0, 10), (10, 10), (10, 33))]
    assert np.allclose(both, alone) and len(logs) == 33


def test_attention_stays_finite_with_large_weights():
    rng = np.random.default_rng(8)
    counts, starts = np.ones(20), np.ones(20, bool)
    sh = lm.shape(counts, (np.zeros(0, int),) * 3, 4, 2, 8)
    weights = {k: x * 200 for k, x in lm.initial(sh.v, sh.c, 4).items()}
    weights["o"] = rng.normal(0, 300, weights["o"].shape).astype(np.float32)
    model = lm.assemble(counts, starts, sh, lm.odds(np.ones((sh.v, sh.c))), np.ones((sh.c, sh.v)), weights, 4)
    scores, _ = model.score(rng.integers(0, 19, 50), np.ones(50, np.int64), np.array([50]), np.zeros(50), 0.3, 19, 0.1)
    assert np.isfinite(scores).all()


def brute_memory(rows, every, trust):
    """What each document's score owes to remembered contexts, given ln P of its words without them."""
    import xxhash

    from spanlens.llm.words import grams

    def chosen(text):
        w = [x.encode() for x in BLANK_WORD.findall(lower(text))]
        h = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
        for i in range(4, len(w)):
            c = int(grams(h[i - 4 : i], 4)[0])
            if c % every == 0:
                yield i, tuple(w[i - 4 : i]), w[i]

    seen = defaultdict(Counter)
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            for _, before, after in chosen(r["text"]):
                seen[before][after] += 1
    best = {}
    for before, nexts in seen.items():
        n = max(nexts.values())
        if n >= 2:
            best[before] = ({w for w, k in nexts.items() if k == n}, trust * (n - 1) / sum(nexts.values()))
    return {r["doc_id"]: [(i, best[b][1], a in best[b][0] if len(best[b][0]) == 1 else None) for i, b, a in chosen(r["text"]) if b in best] for r in rows}


def test_lm_remembers_what_training_texts_repeat(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    fitted, known = lm.fit(docs.filter(~toxicity.held_out("doc_id", 7, 2)), contexts=2)
    with_memory = {r.doc_id: r.score for r in lm.score(docs, fitted, known).collect()}
    without = {r.doc_id: r.score for r in lm.score(docs, fitted, known.filter("trust is null")).collect()}
    met = brute_memory(rows, 2, lm.TRUST)
    assert sum(map(len, met.values())) > 200
    for i, hits in met.items():
        if not hits:
            assert abs(with_memory[i] - without[i]) < 1e-9
        elif any(right is None for _, _, right in hits):
            continue  # words that follow equally often: either may be remembered
        elif all(not right for _, _, right in hits):
            assert abs(with_memory[i] - without[i] - sum(math.log10(1 - t) for _, t, _ in hits)) < 1e-6
        elif all(right for _, _, right in hits):
            assert with_memory[i] > without[i]


def test_lm_remembers_every_context(spark, sf, rows):
    """The query's memory leaves out no context that repeats."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    coded = lm.code(docs.filter(~toxicity.held_out("doc_id", 7, 2)), "doc_id", "text", lm.VOCABULARY, lm.CONTEXTS)
    seen = defaultdict(Counter)
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            w = BLANK_WORD.findall(lower(r["text"]))
            for i in range(4, len(w)):
                seen[tuple(w[i - 4 : i])][w[i]] += 1
    assert lm.remembered(lm.key_counts(coded, lm.VOCABULARY), lm.TRUST).count() == sum(max(nexts.values()) >= 2 for nexts in seen.values())


def test_lm_is_fitted_on_all_ids_of_all_training_texts(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = lm.fit(docs)[0].model
    enc = lm.subwords()
    runs = []
    for r in rows:
        ids = [i for w in BLANK_WORD.findall(lower(r["text"])) for i in enc.encoding.encode_ordinary(" " + w)]
        runs.append(np.array([enc.end, *ids, enc.end]))
    sh = lm.Shape(model.row, model.klass, lm.ROWS + lm.HEAD + lm.TAIL, lm.HEAD + lm.TAIL)
    pairs, seen = lm.bigrams(runs, sh)
    assert np.allclose(model.bigram, lm.odds(pairs))
    counts = np.bincount(np.concatenate([r[1:] for r in runs]), minlength=enc.size).astype(float)
    assert np.allclose(model.share, lm.shares(counts, seen, sh.klass, sh.row)[0])
    # After any id the chances of all ids of a class add up to one, and those of ids that begin a word to the model's mass.
    for last in (0, 3, sh.c - 1):
        each = np.exp(model.share[last, model.row] + model.alone)
        assert np.allclose(np.bincount(model.klass, each, sh.c)[np.unique(model.klass)], 1, atol=1e-4)
        assert np.allclose(np.bincount(model.klass, each * enc.starts, sh.c).clip(1e-9), model.begins[last], atol=1e-5)


def test_lm_splits_and_encodes_each_text_once(spark, sf, rows):
    import pyarrow as pa
    import xxhash

    # Neither fitting nor scoring goes back to the texts.
    read = lm.op10_lm_score(spark, sf).inputFiles()
    assert read and not any("documents" in f for f in read)
    enc = lm.subwords()
    odd = ["a\u00a0 b", "\u00a0\u00a0 x\u2003", "x \u3000 y\u0085", "it's 'S ''s", "\x1c \x1f", "\t\nA  b\x0b", "Ab" * 40 + " ab", "", None]
    texts = odd + [r["text"] for r in rows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in lm.code(docs, "doc_id", "text", lm.VOCABULARY, 2).collect()}
    for i, text in enumerate(texts):
        words = BLANK_WORD.findall(lower(text))
        ids = [enc.encoding.encode_ordinary(" " + w) for w in words]
        assert np.frombuffer(got[i].ids, enc.kind).tolist() == [x for w in ids for x in w]
        said = [xxhash.xxh64_intdigest(w) for w in words]
        place, after = np.frombuffer(got[i].place, "<u8"), np.frombuffer(got[i].after, "<u8")
        assert [said[k] for k in place.tolist()] == after.tolist() and len(place) * 8 == len(got[i].before)
        coded = lm.Coded.of(pa.array([got[i].ids], pa.binary()), enc)
        distinct, codes = coded.words()
        assert [distinct[c] for c in codes.tolist()] == [np.array(w, enc.kind).tobytes() for w in ids] and coded.sizes().tolist() == [len(words)]


def test_attention_windows_take_every_id_as_a_goal_once():
    span = 4
    runs = [np.arange(n) + 100 * n for n in (2, 3, 5, 6, 9, 10, 30)]
    data = lm.windows_of(runs, span)
    goals = data[:, span + 1 :]
    assert sorted(goals[goals >= 0].tolist()) == sorted(i for r in runs for i in r[1:].tolist())
    at = {int(i): r[:k] for r in runs for k, i in enumerate(r.tolist())}
    for w in data.tolist():
        for j in range(span + 1, 2 * span + 1):
            if w[j] >= 0:
                before = [i for i in w[:j] if i >= 0]
                assert before == at[w[j]][-len(before) :].tolist() and len(before) >= min(span, len(at[w[j]]))
    assert lm.windows_of([], span).shape == (0, 2 * span + 1)


def test_marked_words_and_numbers_need_no_whole_encoding():
    from spanlens.llm.bpe import UnitEncoder, public_file

    enc = UnitEncoder(public_file())
    odd = ["it's 12, 34! (ab) a,b c'd. x'; <|endoftext|>. don't? 5's ...'ll été*** ٤٢, ²! -- _a_ q'", "12 words: 7; a'", "a\tb  c"]
    for text in odd:
        assert enc.encode_block([text])[0].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
    whole = enc.tokenizer.encode("so été*** 2024 word! 7;", add_special_tokens=False).ids
    for marks in ("***", "!", ";"):
        enc.bare[marks]
    enc.after_space.tokenizer = None  # any whole encoding fails
    assert enc.encode_block(["so été*** 2024 word! 7;"])[0].tolist() == whole


def test_lm_contexts_are_sent_packed_and_settled_by_ranges(spark):
    """What tasks send of contexts is a row for each range, and what comes of it is what counting row by row gives."""
    rng = random.Random(5)
    pairs = [(rng.choice([0, 1, 2**55, 2**56 - 1, rng.randrange(2**56)]) << 8, rng.choice([0, 3, 2**31, 2**32 - 1]) << 32) for _ in range(900)]
    blob = lambda xs: np.array(xs, "<u8").tobytes()
    rows = [(blob([a for a, _ in part]), blob([b for _, b in part])) for part in (pairs[:400], [], pairs[400:])]
    seen = defaultdict(Counter)
    for a, b in pairs:
        seen[a][b >> 32] += 1
    want = {a: (max(s.values()), sum(s.values()), max((n, b) for b, n in s.items())[1]) for a, s in seen.items() if max(s.values()) > 1}
    coded = spark.createDataFrame(rows, "before binary, after binary")
    for ranges in (1, 5):
        got = {int.from_bytes(r.key[1:], "little"): (r.c, r.n, int.from_bytes(r.after, "little")) for r in lm.context_counts(coded, ranges).collect()}
        assert got == want and len(got) >= 4
    assert lm.context_counts(coded.limit(0), 3).count() == 0
    columns = [np.array(x, np.uint64) for x in ([1, 2**56 - 1], [2**32 - 1, 0], [7, 300])]
    assert all((a == b).all() for a, b in zip(lm.unpacked(lm.packed(columns)), columns, strict=True))
    assert lm.encoded(spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), "doc_id", "text", lm.VOCABULARY).columns == ["id", "ids"]


def test_lm_scores_meet_memory_by_range(spark, sf, rows, monkeypatch):
    """What memory adds is the same however many ranges contexts are sent in."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    fitted, known = lm.fit(docs)
    got = []
    for bound in (10**9, 100):
        monkeypatch.setattr(lm, "RANGE", bound)
        got.append({r.doc_id: (r.n_tokens, r.score) for r in lm.score(docs, fitted, known).collect()})
    without = {r.doc_id: r.score for r in lm.score(docs, fitted, known.filter("trust is null")).collect()}
    assert all(a[0] == got[1][i][0] and abs(a[1] - got[1][i][1]) < 1e-9 for i, a in got[0].items()) and len(got[0]) == len(rows)
    assert any(abs(a[1] - without[i]) > 0.1 for i, a in got[0].items())
