"""Lookups of many names, their answers and usage lists against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanlens.operators import answer, expand, lookup


def has_name(line, name):
    """At word, underscore or hump boundaries; names with - or / as they are."""
    if "-" in name or "/" in name:
        return name in line
    before = "" if name[0] == "_" else "(^|[^$])" if name[0].isupper() else "(^|[^A-Za-z0-9$])"
    after = "" if name[-1] == "_" else "([^A-Za-z0-9$]|$)" if name[-1].isupper() else "([^a-z0-9$]|$)"
    return re.search(before + re.escape(name) + after, line) is not None


NAMES = ["Config", "parse", "parse_config", "HTTPS", "MAX_LEN", "_x", "x_", "_", "$el", "el$", "x2Y", "--dry-run", "dry-run", "src/walk", "walk.rs", "a-b", "É", "naïve", "A", "AB", "ZAB", "fig", "..."]
PIECES = ["Config", "parse", "_", "HTTPS", "X", "MAX_LEN", "$", "el", "x2Y", " ", "--dry-run", "-", "src/walk", ".rs", "a-b", "É", "naïve", "AB", "Z", "fig", "con", "9", "(", "é", "x"]


def test_lines_of_names(spark, monkeypatch):
    """Every pair of line and name that holds, for names of all shapes, broadcast or joined."""
    rng = random.Random(8)
    texts = [(i, "\n".join("".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 6))) for _ in range(12))) for i in range(150)]
    texts += [(900, "\n".join(NAMES)), (901, None), (902, "")]
    asked = [(i % 4, n) for i, n in enumerate(NAMES)] + [(7, "parse"), (7, "nothing"), (7, "")]
    want = {}
    for id, text in texts:
        for line, body in enumerate((text or "").split("\n"), 1):
            for q, n in asked:
                if n not in ("", "...") and has_name(body, n):
                    want.setdefault((q, id, line), set()).add(n)
    for bound in (100_000, 3):
        monkeypatch.setattr(lookup, "BROADCAST_NAMES", bound)
        got = lookup.lines_of_names(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(asked, "query int, name string"), "id").collect()
        assert {(r.query, r.id, r.line): set(r.names) for r in got} == want and len(got) == len(want)
    assert {n for ns in want.values() for n in ns} == {n for _, n in asked} - {"", "...", "nothing"}


def test_reports(spark):
    chunks = [("a#0", "a", 1, "", [], "use Tree;\nno"), ("a#1", "a", 3, "fn grow", ["grow", "Tree"], "x\nfn grow(t: Tree)\nTree grow"), ("b#0", "b", 1, "fn z", ["leaf"], "grow\ngrow leaf")]
    names = [(1, "Tree"), (1, "grow"), (2, "leaf"), (3, "none")]
    got = lookup.reports(spark.createDataFrame(chunks, "chunk_id string, path string, start_line int, symbol string, defines array<string>, text string"), spark.createDataFrame(names, "query int, name string"))
    assert sorted((r.query, r.path, r.line, r.symbol, r.is_definition, r.names) for r in got.collect()) == [
        (1, "a", 1, "", False, ["Tree"]), (1, "a", 4, "fn grow", True, ["Tree", "grow"]), (1, "a", 5, "fn grow", False, ["Tree", "grow"]), (1, "b", 1, "fn z", False, ["grow"]), (1, "b", 2, "fn z", False, ["grow"]),
        (2, "b", 2, "fn z", True, ["leaf"]),
    ]


def test_reports_shuffle_nothing_for_few_names(spark, monkeypatch):
    """Lines that hold names of many queries are neither shuffled nor written on their way, and are those that the join of many names gives."""
    rng = random.Random(5)
    text = lambda: "\n".join(" ".join(rng.choice(["Tree", "grow", "leaf", "É_x", "AB", "x"]) for _ in range(4)) + rng.choice(["", "\r"]) for _ in range(6))
    chunks = [(f"c{i}", f"p{i % 3}", 1 + 6 * (i // 3), None if i % 4 else "fn a", rng.choice([None, [], ["leaf", None], ["Tree", "AB"]]), None if i == 7 else text()) for i in range(30)]
    chunks = spark.createDataFrame(chunks, "chunk_id string, path string, start_line int, symbol string, defines array<string>, text string")
    names = spark.createDataFrame([(q, n) for q in range(6) for n in ("Tree", "leaf", "É_x", "AB")[: 1 + q % 4]], "query int, name string")
    found = lookup.reports(chunks, names)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    columns = ["query", "path", "line", "symbol", "body", "names", "is_definition"]
    few = sorted(map(str, found.select(columns).collect()))
    monkeypatch.setattr(lookup, "BROADCAST_NAMES", 1)
    assert few == sorted(map(str, lookup.reports(chunks, names).select(columns).collect())) and len(few) > 100


def rendered(names, found, files_read, most, summary, tail, file_lines, code=None):
    """One answer, file after file."""
    prose = lambda p: p.endswith(".md")
    by = {}
    for f in sorted(found, key=lambda f: f[2]):
        by.setdefault(f[0], []).append(f)
    head = "`" + "|".join(names) + "`"
    if not by:
        return f"No match for {head} in the {files_read} files read.\n"
    files = sorted(by, key=lambda p: (-len(by[p]), p))
    code_matched = not all(map(prose, files))
    listed = [p for p in files if not (code_matched and prose(p))]
    body, shown, budget = "", dict.fromkeys(files, 0), most - summary - tail
    size = lambda s: len(s.encode())

    def fill():
        nonlocal body
        for p in listed:
            heading = p + (" (test)" if p.startswith("tests/") else "") + "\n"
            if size(body) + size(heading) > budget:
                return
            body += heading
            groups = []
            for f in by[p]:
                groups[-1].append(f) if groups and groups[-1][0][1] == f[1] else groups.append([f])
            for g in groups:
                short = g[0][1].removeprefix("fn ")
                opens = bool(short) and short in g[0][3]
                for i, (_, _, line, text, is_def) in enumerate(g):
                    if shown[p] == file_lines:
                        break
                    header = f" ‹{short}›\n" if short and not opens and len(g) > 1 and i == 0 else ""
                    indent = " " if not short or len(g) == 1 or (opens and i == 0) else "  "
                    said = f"{header}{indent}{line}: {text}{' [def]' if is_def else ''}{f' ‹{short}›' if short and len(g) == 1 and not opens else ''}\n"
                    if size(body) + size(said) > budget:
                        return
                    body += said
                    shown[p] += 1

    fill()
    total, n_listed = len(found), sum(len(by[p]) for p in listed)
    tests = sum(p.startswith("tests/") for p in files)
    out = f"{head}: {total} lines in {len(files)} files{'' if not tests else ' (1 test)' if tests == 1 else f' ({tests} tests)'} of {files_read} files read"
    if sum(shown.values()) == n_listed:
        out += "; complete, docs counted.\n" if len(listed) < len(files) else "; complete.\n"
    else:
        out += f"; first {sum(shown.values())} shown, the rest counted below.\n"
    out += body
    room = tail
    hidden = [f"{p} ({len(by[p])})" if not shown[p] else f"{p} ({shown[p]} of {len(by[p])} shown)" for p in listed if shown[p] < len(by[p])]
    docs = [f"{p} ({len(by[p])})" for p in files if p not in listed]
    for label, items in (("Not shown: ", hidden), ("Docs: ", docs)):
        if items:
            said = label
            for k, item in enumerate(items):
                more = f"and {len(items) - k} more files."
                if size(said) + size(item) + 2 + size(more) + 4 > room:
                    said += (", " if k else "") + more + "\n"
                    break
                said += (", " if k else "") + item
            else:
                said += ".\n"
            out += said
            room = max(0, room - size(said))
    if code and size(out) + 1 + size(code) <= most:
        out += "\n" + code
    return out


@pytest.mark.parametrize("most, summary, tail, file_lines", [(6000, 300, 700, 40), (900, 100, 200, 4), (400, 100, 60, 3), (6000, 300, 90, 2)])
def test_answers(spark, most, summary, tail, file_lines):
    rng = random.Random(most + tail)
    found, asked = {}, [(q, [f"n{q}", "other"][: 1 + q % 2]) for q in range(25)]
    for q, _ in asked[1:]:
        exts = [".md"] if q % 7 == 0 else [".rs", ".rs", ".md"]
        for p in {rng.choice(["", "tests/"]) + f"é{rng.randrange(60)}" + rng.choice(exts) for _ in range(rng.choice([1, 3, 40]))}:
            for line in rng.sample(range(1, 90), rng.choice([1, 2, 7, 50])):
                symbol = rng.choice(["", "fn grow", "fn tree", f"fn s{line // 20}"])
                found.setdefault(q, []).append((p, symbol, line, rng.choice(["grow it", "let x = ü", "tree"]), rng.random() < 0.2))
    rows = [(q, *f) for q, fs in found.items() for f in fs]
    code = [(q, "### def\n" + "x" * 30) for q in range(0, 25, 3)]
    got = answer.render(
        spark.createDataFrame(rows, "query int, path string, symbol string, line int, text string, is_definition boolean"),
        spark.createDataFrame(asked, "query int, names array<string>"), 77, "query", most, summary, tail, file_lines, spark.createDataFrame(code, "query int, block string"),
    ).collect()
    assert len(got) == 25
    for r in got:
        assert r.answer == rendered(dict(asked)[r.query], found.get(r.query, []), 77, most, summary, tail, file_lines, dict(code).get(r.query)), r.query
        assert r.complete == ("complete" in r.answer.split("\n")[0] or not found.get(r.query))


def usage(asked, defs, refs, chunks):
    """One query's list, name after name."""
    out = []
    for name in asked[:6]:
        if len(out) >= 10:
            break
        d, u = sorted(c for n, c in defs if n == name)[:4], sorted(c for n, c in refs if n == name)[:8]
        if len(d) > 3 or not d + u:
            continue
        listed, shown, own = 0, 0, []
        for kind, c in [("definition of", c) for c in d] + [("use of", c) for c in u]:
            if listed >= 4 or len(out) >= 10:
                break
            path, start, text = chunks[c]
            at = next((i for i, x in enumerate(text.split("\n")) if re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", x)), None)
            if at is None:
                continue
            shown += 1
            if any(o[:2] == [path, start + at] for o in out):
                continue
            if kind == "definition of":
                own.append(len(out))
            out.append([path, start + at, text.split("\n")[at].strip(" ")[:120], f"{kind} `{name}`"])
            listed += 1
        if len(u) < 8 and shown == len(d) + len(u):
            for i in own:
                out[i][3] += " (all indexed uses shown)"
    return [tuple(o) for o in out]


def test_usage_list(spark):
    rng = random.Random(11)
    words = ["tree", "grow_up", "$x", "leaf", "root", "bark", "twig", "stem"]
    chunks = {f"c{i:03}": (f"p{i % 9}", 1 + 5 * i, "\n".join(" ".join(rng.choice([*words, "fill"]) for _ in range(3)) for _ in range(5))) for i in range(60)}
    defs = {(rng.choice(words), rng.choice(sorted(chunks))) for _ in range(14)}
    refs = {(w, c) for c in chunks for w in words if rng.random() < (0.02 if w in "leafbark" else 0.2)}
    chunks |= {"z0": ("pz", 1, "tree\nonly_one here"), "z1": ("pz", 9, "x\n  only_one(2)")}
    defs, refs = defs | {("only_one", "z0")}, refs | {("only_one", "z1")}
    asked = [(q, w, i) for q in range(30) for i, w in enumerate(rng.sample([*words, "nobody", "only_one"], rng.randrange(1, 9)))]
    got = expand.usage_list(
        spark.createDataFrame(asked, "query int, ident string, nth int"), spark.createDataFrame(sorted(defs), "ident string, chunk_id string"), spark.createDataFrame(sorted(refs), "ident string, chunk_id string"),
        spark.createDataFrame([(c, *v) for c, v in chunks.items()], "chunk_id string, path string, start_line int, text string"), "query",
    )
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query, r.place)):
        found.setdefault(r.query, []).append((r.path, r.line, r.text, r.relation))
    want = {q: usage([w for x, w, _ in asked if x == q], defs, refs, chunks) for q in range(30)}
    assert found == {q: v for q, v in want.items() if v}
    said = [x[3] for v in want.values() for x in v]
    assert any("all indexed" in s for s in said) and any("definition" in s and "all" not in s for s in said) and any(len(v) == 10 for v in want.values())
