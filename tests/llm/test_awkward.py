"""Awkward rows for every operator and the pipeline, and methods against exhaustive or plain versions."""

import itertools
import math
import re
import shutil
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_text_ops import brute_groups
from test_urls_vectors_pipeline import brute_url, brute_vectors

from spanlens.llm import common, decontam, embdedup, linededup, lm, minhash, packing, tokenfile, toxicity, urlfilter
from spanlens.llm.words import alnum_hashes


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_scratch_folders(spark, monkeypatch):
    df = spark.range(5)
    kept = common.materialise(df, "test")
    assert kept.count() == 5 and kept.inputFiles()
    common.discard(kept, df)
    assert not spark.sparkContext._jvm.java.io.File(kept.stored_at.removeprefix("file:").replace("//", "/")).exists()

    from spanlens.sources import store

    with store.scratch(spark) as made:
        again = common.materialise(df, "test")
        place = made[-1].removeprefix("file://")
        assert again.count() == 5 and place.split("/")[-1].startswith("spanlens-test")
    assert not spark.sparkContext._jvm.java.io.File(place).exists()

    class Elsewhere:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_free_names():
    assert common.free_names(["a", "_KEY"], "_key", "_drop") == ["_key_", "_drop_"]
    assert common.free_names([], "x") == ["x"]


def test_equal_words_take_no_time():
    items = decontam.Items([(str(i), alnum_hashes("same " * 1000)) for i in range(5)] + [("one", alnum_hashes("same")), ("other", alnum_hashes("else " * 30))])
    began = time.time()
    spans, found = items.hits(alnum_hashes("same " * 20_000))
    assert time.time() - began < 1 and spans == [(0, 20_000)] and found == {"0", "1", "2", "3", "4", "one"}
    assert items.hits(alnum_hashes("same else " * 50)) == ([(i, i + 1) for i in range(0, 100, 2)], {"one"})


def test_minhash_finds_links_that_stars_miss(spark):
    """A chain in which each text is alike to its neighbours only, and a crowd around a text that is not there."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[i * 4 : i * 4 + 120]) for i in range(20)]
    rng = np.random.default_rng(5)
    crowd = []
    for k in range(60):
        own = [f"c{i}" for i in range(200)]
        for j in rng.integers(0, 200, 1 + k % 4):
            own[j] = f"n{k}x{j}"
        crowd.append(" ".join(own))
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(chain + crowd)]
    _, groups = brute_groups(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows), k=3, per_cent=85).collect()}
    assert got == groups and len(set(groups.values())) < len(rows)


def test_minhash_judges_each_row_by_its_own_text(spark):
    long = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long), (1, "something else here entirely"), (2, long + " tail"), (3, long), (3, long), (4, "something else here entirely")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert got == [(1, 1, 1), (1, 46, 1), (2, 47, 1), (3, 46, 1), (3, 46, 1), (4, 1, 1)]
    assert sorted(map(tuple, minhash.drop_near_duplicates(docs).collect())) == [(1, "something else here entirely"), (1, long)]


def test_prefix_join_misses_no_link(spark):
    """Random sets of small alphabets: every pair that is alike enough is among the candidates."""
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(150):
        base = rng.integers(0, 2**62, 30) if not sets or rng.random() < 0.2 else sets[rng.integers(len(sets))].copy()
        for j in rng.integers(0, len(base), rng.integers(0, 5)):
            base[j] = rng.integers(0, 2**62)
        sets.append(np.unique(base))
    marks = [bytes([i]) * 16 for i in range(len(sets))]
    table = spark.createDataFrame([(bytearray(m), bytearray(s.astype(np.int64).tobytes())) for m, s in zip(marks, sets)], "mark binary, hashes binary").cache()
    parts = spark.createDataFrame([(bytearray(m), len(s), bytearray(m)) for m, s in zip(marks, sets)], "mark binary, n int, comp binary")
    for per_cent in (60, 80, 85):
        got = {(bytes(r.a), bytes(r.b)) for r in minhash.prefix_pairs(parts, table, per_cent).collect()}
        alike = set()
        for (m, a), (k, b) in itertools.combinations(zip(marks, sets), 2):
            both = len(np.intersect1d(a, b))
            if 100 * both >= per_cent * (len(a) + len(b) - both):
                alike.add((m, k))
        assert alike <= got and len(alike) > 20


def test_urls_awkward(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    long = "http://x.example.net/" + "a/" * 50_000 + "?q=" + "%20" * 10_000
    more = spark.createDataFrame([(None, long, ""), (None, None, None), (9_000, long, "")], pages.schema)
    extra = pages.unionByName(pages).unionByName(more)
    for name in ("host", "path", "score", "_url", "_rule", "suffix_pages", "length", "verdict"):
        extra = extra.withColumn(name, F.lit("x"))
    urls = extra.select("page_id", "url").collect()
    got = urlfilter.judge(extra).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(Counter(r.page_id for r in got).items(), key=key) == sorted(Counter(r.page_id for r in urls).items(), key=key)
    by_id = {r.page_id: r for r in urls if r.page_id is not None}
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule) == brute_url(by_id[r.page_id].url)
        assert 0 <= r.score <= 1


def test_trees_as_expressions_equal_numpy(spark):
    rng = np.random.default_rng(3)
    names = urlfilter.FEATURES
    x = np.round(rng.normal(size=(400, len(names))), 2)
    trees = urlfilter.grow(x, (x[:, 0] + x[:, 3] ** 2 > 0.5).astype(float), np.ones(400))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *names])
    got = {r.i: r.s for r in df.select("i", trees.column({n: F.col(n) for n in names}).alias("s")).collect()}

    def value(t, r):
        return t if not isinstance(t, tuple) else value(t[2] if r[t[0]] <= t[1] else t[3], r)

    for i, r in enumerate(x):
        assert abs(got[i] - 1 / (1 + math.exp(-trees.base - sum(value(t, r) for t in trees.trees)))) < 1e-9


def test_embeddings_awkward(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    c = math.sqrt(1 - 0.9**2)
    rows = [(0, [1e200, 2e200, 0.0]), (1, [1e-200, 2e-200, 0.0]), (2, [1.0, 2.0, 0.0]), (None, [1.0, 2.0, 0.0]), (2, [1.0, 2.0, 0.0])]
    rows += [(10, [1.0, 0.0]), (11, [0.9, c]), (12, [0.5, 0.0]), (20, base.tolist()), (21, (base * 3).tolist()), (22, [0.0, None, 1.0]), (23, []), (24, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "w", "vector", "codes", "h1", "n", "bucket", "home"):
        df = df.withColumn(name, F.lit("x"))
    got = embdedup.near_vectors(df).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == len(rows) and (by[None].n_links, by[None].component_id) == (0, None)
    assert by[0].component_id == by[1].component_id == by[2].component_id == 0 and by[21].component_id == 20
    assert all((by[i].n_links, by[i].component_id) == (0, i) for i in (22, 23, 24))
    cosine = 0.9 / math.sqrt(0.9**2 + c**2)
    assert by[11].component_id == (10 if cosine >= 0.9 else 11)


def test_token_files_awkward(spark, awkward, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in rows}
    path = f"file://{tmp_path}/tokens"
    tokenfile.write_tokens(awkward, path, shards=3)
    found = tokenfile.read_tokens(spark, path).collect()
    assert Counter(r.doc_id for r in found) == Counter([*ids, *ids, None, None])
    assert all(list(r.tokens) == ids[r.doc_id] for r in found if r.doc_id is not None)


def test_packing_awkward(spark, awkward, rows):
    got = packing.pack(awkward).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
        assert len(r.ids) == r.length
    assert set(total) == {r["doc_id"] for r in rows} | {None}


def test_lm_awkward(spark, awkward, rows):
    fitted, known = lm.fit(awkward)
    got = lm.score(awkward, fitted, known).collect()
    assert len(got) == 2 * len(rows) + 2 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    twice = Counter((r.doc_id, round(r.score, 6)) for r in got if r.doc_id is not None)
    assert set(twice.values()) == {2}
    # Long words are among the frequent ones too, by a hash.
    assert any(len(w) == 17 and w[:1] == b" " for w in fitted.head)


def test_line_dedup_takes_any_names(spark, awkward):
    taken = awkward.withColumn("_drop", F.lit(1)).withColumn("_KEY", F.lit(2)).withColumn("pages", F.lit(3))
    cut = linededup.drop_boilerplate(taken)
    assert cut.columns == [*taken.columns, "n_lines", "n_dropped"] and cut.count() == taken.count()
    assert cut.filter("_drop = 1 and pages = 3").count() == taken.count()
    with pytest.raises(ValueError):
        linededup.drop_boilerplate(taken.withColumn("n_lines", F.lit(1)))


def exhaustive(token, model):
    """The least cost over all ways through the lattice."""
    best = math.inf
    for way in itertools.product(*toxicity.lattice(token)):
        cost, two = sum(c for _, c in way), "  "
        for c in "".join(w for w, _ in way):
            if c == " " and two[1] == " ":
                continue
            cost -= model.log(two + c)
            two = two[1] + c
        best = min(best, cost - (model.log(two + " ") if two[1] != " " else 0.0))
    return best


def cost_of(words, token, model):
    """The least cost of the ways that restore the given words."""
    best = math.inf
    for way in itertools.product(*toxicity.lattice(token)):
        if "".join(w for w, _ in way).split() == words:
            cost, two = sum(c for _, c in way), "  "
            for c in "".join(w for w, _ in way):
                if c == " " and two[1] == " ":
                    continue
                cost -= model.log(two + c)
                two = two[1] + c
            best = min(best, cost - (model.log(two + " ") if two[1] != " " else 0.0))
    return best


def test_viterbi_equals_exhaustive_decoding():
    grams = Counter()
    for w in "idiot stupid clown loser hello wall all tall bag gab assault as at".split():
        p = f"  {w} "
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    model = toxicity.CharModel(dict(grams))
    for token in ("1d10t", "$tup1d", "c.l.o.w.n", "w@11", "looooser", "@$", "6a9", "a  b", "h-e-ll0", "111", "!!d!!", "7a1l."):
        assert math.isclose(cost_of(toxicity.restore(token, model), token, model), exhaustive(token, model), rel_tol=1e-9), token


def test_symbols_and_wide_blanks_are_decoded():
    assert toxicity.plain("@$$") is None and toxicity.plain("$5.00") == "" == toxicity.plain("7175") == toxicity.plain("50%")
    assert toxicity._SINGLES.findall("x i  d\ti   o t now") == ["x i  d\ti   o t"]
    model = toxicity.CharModel({"  a": 3, " ab": 2, "ab ": 2})
    began = time.time()
    toxicity.restore("a1b." * 20_000, model)
    assert time.time() - began < 20


def test_toxicity_score_by_hand(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    for r in toxicity.annotate(docs, model, out="score").collect():
        found = set()
        low = (r.text or "").lower()
        for token in [*low.split(), *toxicity._SINGLES.findall(low)]:
            core = toxicity.plain(token)
            for w in [core] if core else [] if core == "" else toxicity.restore(token, model.chars):
                found.update(f for f in toxicity.features(w) if f in model.numbers)
        z = model.bias + sum(model.weights[model.numbers[f]] for f in found)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_attention_window_by_window():
    """The batched pass against one window at a time, in double precision."""
    rng = np.random.default_rng(4)
    v, end, span = 30, 29, 4
    counts, starts = rng.integers(1, 50, v).astype(float), np.arange(v) % 2 == 1
    sh = lm.shape(counts, (np.arange(20), np.arange(20) % 12, np.ones(20)), 5, 3, 10)
    pairs, seen = rng.integers(0, 9, (sh.v, sh.c)), rng.integers(0, 9, (sh.c, sh.v)) * (np.bincount(sh.row, minlength=sh.v) > 0)
    p = {k: x + rng.normal(0, 0.1, x.shape).astype(np.float32) for k, x in lm.initial(sh.v, sh.c, span).items()}
    model = lm.assemble(counts, starts, sh, lm.odds(pairs), seen, p, span)
    ids = rng.integers(0, 29, 21)
    whole, logs = model.score(ids, np.ones(21, np.int64), np.array([21]), np.full(21, 0.01), 0.3, end, 0.2)
    said, begins, context = [], [], [end, *ids.tolist()]
    for t in range(22):
        first = 0 if t < span else (t // span) * span - span
        keys = context[first : t + 1]
        r = model.row[keys]
        a = model.key[r].astype(float) @ model.query[r[-1]].astype(float) + np.array([model.bias[t - first - i] for i in range(len(keys))], float)
        w = np.exp(a - a.max())
        h = np.tanh((w / w.sum()) @ model.value[r].astype(float) + model.rest[r[-1]])
        z = h @ model.out.astype(float) + model.bigram[r[-1]]
        q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        goal = ids[t] if t < 21 else end
        said.append(math.log(q[model.klass[goal]]) + model.share[model.klass[keys[-1]], model.row[goal]] + model.alone[goal])
        # The chances of all ids add up to one, and those of ids that begin a word to what `logs` gives: so chances of words do, too.
        every = np.exp(np.log(q[model.klass]) + model.share[model.klass[keys[-1]], model.row] + model.alone)
        assert abs(every.sum() - q[np.unique(model.klass)].sum()) < 1e-5
        begins.append(math.log(every[starts].sum()))
    words = [math.log(0.3 * 0.01 + 0.7 * math.exp(said[t] - begins[t] + begins[t + 1])) for t in range(21)]
    assert np.allclose(logs, words, atol=1e-3) and len({round(b, 3) for b in begins}) > 5
    half = model.logs(model.row[np.array([context[:span]])], model.klass[np.array([context[1 : span + 1]])], np.array([False]))[1]
    assert np.allclose(half[0], begins[:span], atol=1e-4)
    assert abs(whole[0] - (sum(words) + math.log(0.3 * 0.2 + 0.7 * math.exp(said[21] - begins[21]))) / math.log(10)) < 1e-2


def test_pipeline_awkward(spark, sf, empty, awkward, rows, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("benchmark", "labels"):
        shutil.copy(f"{sf}/{name}.parquet", folder / f"{name}.parquet")
    docs = awkward
    for name in ("_toxicity", "_lines", "_dropped", "_key", "h1x", "mark", "_y"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"file://{folder}/documents.parquet")
    packed = corpus_pipeline.run(spark, f"file://{folder}").collect()
    # Twice the pages make more lines boilerplate, so texts differ from those of a single copy; what is decided before that doesn't.
    toxic = {r["doc_id"] for r in rows if r["text"] and "stupid" in r["text"]}
    kept = {r.doc_id for r in packed}
    assert None in kept and not kept & toxic and len(kept) > 20
    total = {}
    for r in packed:
        total.setdefault((r.doc_id, r.doc_tokens), 0)
        total[r.doc_id, r.doc_tokens] += r.length
    assert all(n % size == 0 for (_, size), n in total.items())
    assert pq.read_schema(next((folder / "documents.parquet").glob("*.parquet"))).names[-1] == "_y"


def test_vectors_helper():
    n, groups = brute_vectors([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 0.0])])
    assert n == {1: 1, 2: 1, 3: 0} and groups == {1: 1, 2: 1, 3: 3}


def test_runs_of_marks_take_no_time():
    """Long runs of every kind of mark inside, before and behind letters; the scan says what the pattern says."""
    chars = toxicity.CharModel({"  s": 3, " st": 3, "stu": 3, "tup": 3, "upi": 3, "pid": 3, "id ": 3})
    restorer = toxicity.Restorer(chars)
    for mark in sorted({*toxicity.EDGE, *toxicity.SEPARATORS, *toxicity.LEET, "$", "%", "_", "é", "1"}):
        for token in ("a" + mark * 100_000 + "b", "a" + mark * 100_000, mark * 100_000 + "b", "a" + (mark * 3 + "x") * 20_000 + "b", "a" + (mark * 3 + "-") * 20_000 + "$b"):
            began = time.time()
            toxicity.plain(token)
            assert time.time() - began < 0.1, (mark, token[:5])
    began = time.time()
    assert len(restorer.words("Title" + "-" * 100_000 + "text")) >= 1 and time.time() - began < 5
    pattern = re.compile(r"(?:([^\w\s])\1\1+[" + re.escape(toxicity.EDGE) + r"]*)+$")
    rng = np.random.default_rng(6)
    for _ in range(20_000):
        token = "".join(rng.choice(list("ab$$--%%%_1.")) * int(rng.choice([1, 1, 2, 3, 4])) for _ in range(rng.integers(1, 6)))
        assert toxicity.untailed(token) == pattern.sub("", token), token


def test_token_files_of_ordered_input(spark, tmp_path):
    """Files of ascending ids in ranges of their own are read as they are; any other order is sorted; the result is the same."""
    rows = [(i * 3, f"text {i} of it" * (i % 5)) for i in range(200)]
    for n, part in enumerate((rows[150:], rows[:60], rows[60:150])):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ordered")
    docs = spark.read.parquet(f"{tmp_path}/ordered")
    spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/falling")
    falling = spark.read.parquet(f"{tmp_path}/falling")
    assert tokenfile.ordered_parts(docs, "doc_id") is not None
    assert tokenfile.ordered_parts(falling, "doc_id") is None and tokenfile.ordered_parts(docs.repartition(2), "doc_id") is None
    assert tokenfile.ordered_parts(docs.unionByName(docs), "doc_id") is None
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "doc_id long, text string").coalesce(1)
    twice.write.parquet(f"{tmp_path}/twice")
    assert tokenfile.ordered_parts(spark.read.parquet(f"{tmp_path}/twice"), "doc_id") is None
    found = []
    for name, df in (("a", docs), ("b", falling)):
        tokenfile.write_tokens(df, f"{tmp_path}/{name}")
        found.append(sorted((r.doc_id, r.start, r.n_tokens, tuple(r.tokens)) for r in tokenfile.read_tokens(spark, f"{tmp_path}/{name}").collect()))
    assert found[0] == found[1] and [r[0] for r in found[0]] == [r[0] for r in rows]
    assert all(a[1] + a[2] == b[1] for a, b in zip(found[0], found[0][1:]))
