"""Chunks of source code along its syntax, with symbols, definitions and references.

Parsing is the one thing column functions cannot do, so it runs as an Arrow batch function over
whole files, one file a row.  Python is parsed by its own grammar; Ruby by its opening words and
`end`, languages with braces by their brackets, both after a lexer that knows each language's strings
and comments, with rules for each language (approximate: no grammars for them are at hand); all else
by the text chunker's rule.  A file that doesn't parse falls back
to text, and its rows say why in `error`; nothing fails.

A tree node is (first row, last row, kind, children).  Neighbours are packed into chunks of at
most `max_lines`; what is larger is opened, its first rows staying with its first piece; a leaf
that is too large is cut.  Pieces below `min_lines` join the neighbour that stays smaller.
"""

from __future__ import annotations

import ast
import bisect
import builtins
import hashlib
import itertools
import keyword
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from spanlens.operators import languages
from spanlens.operators.chunk import ChunkConfig
from spanlens.operators.lexer import quieted

MAX_REFS, MAX_DEPTH = 48, 64
BRACED = ("rust", "typescript", "tsx", "javascript", "go", "java", "c", "cpp", "csharp", "php", "kotlin", "swift")
# Names that would link every chunk to every other: keywords and built-ins, by rule.
COMMON = frozenset({*keyword.kwlist, *keyword.softkwlist, *(n for n in dir(builtins) if not n.startswith("_")), "self", "cls", "this", "super", "new", "return", "while", "switch", "sizeof"})


@dataclass
class Node:
    start: int
    end: int
    kind: str
    children: list[Node] = field(default_factory=list)


@dataclass
class Symbol:
    name: str
    label: str
    start: int
    end: int
    row: int
    depth: int


@dataclass
class Tree:
    nodes: list[Node]
    symbols: list[Symbol]
    refs: list[tuple[int, str]]


def _tail(node: ast.AST) -> str | None:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def parse_python(source: str) -> Tree:
    symbols: list[Symbol] = []
    refs: list[tuple[int, int, str]] = []

    lines = source.split("\n")

    def first(n: ast.AST) -> int:
        """The first row of a statement with its decorators and the comments right above it."""
        row = min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1
        while row and lines[row - 1].strip().startswith("#"):
            row -= 1
        return row

    def nodes(body: list[ast.stmt], depth: int) -> list[Node]:
        out = []
        for n in body:
            inner = nodes(n.body, depth + 1) if isinstance(n, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and depth < MAX_DEPTH else []
            kind = {"ClassDef": "class", "FunctionDef": "function", "AsyncFunctionDef": "function"}.get(type(n).__name__, "statement")
            out.append(Node(first(n), n.end_lineno - 1, kind, inner))
            if kind != "statement":
                symbols.append(Symbol(n.name, f"{'class' if kind == 'class' else 'def'} {n.name}", first(n), n.end_lineno - 1, n.lineno - 1, depth))
            elif depth == 0 and isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and t.id.isupper():
                        symbols.append(Symbol(t.id, "", first(n), n.end_lineno - 1, n.lineno - 1, -1))
        return out

    tree = ast.parse(source)
    for n in ast.walk(tree):
        names: list[ast.AST | str] = []
        if isinstance(n, ast.Call):
            names = [n.func]
        elif isinstance(n, ast.ClassDef):
            names = list(n.bases)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            names = [a.name.split(".")[-1] for a in n.names]
        elif isinstance(n, (ast.AnnAssign, ast.arg)) and n.annotation is not None:
            names = [n.annotation]
        for x in names:
            name = x if isinstance(x, str) else _tail(x)
            if name:
                refs.append((n.lineno - 1, n.col_offset, name))
    return Tree(nodes(tree.body, 0), sorted(symbols, key=lambda s: (s.start, -s.end)), [(r, n) for r, _, n in sorted(refs)])


def parse_braces(source: str, lang: str = "java") -> Tree:
    """Blocks between brackets and the rows that lead up to them; strings and comments are blanked first."""
    quiet = quieted(source, lang)
    rows = quiet.split("\n")

    def blocks(lo: int, hi: int, depth: int) -> list[Node]:
        out, level, start = [], 0, None
        for r in range(lo, hi + 1):
            text = rows[r]
            if start is None and source_rows[r].strip():
                start = r
            level += text.count("{") - text.count("}")
            # Comments stay with what comes after them, unless an empty row lies between.
            whole = level <= 0 and (text.rstrip().endswith(("}", ";", "};", "})", "});")) or not source_rows[r].strip())
            if start is not None and whole:
                end = r if source_rows[r].strip() else r - 1
                body = end - start > 1 and depth < MAX_DEPTH and any("{" in rows[x] for x in range(start, end))
                inner = blocks(next(x for x in range(start, end) if "{" in rows[x]) + 1, end - 1, depth + 1) if body else []
                out.append(Node(start, end, "block" if body else "statement", inner))
                start, level = None, 0
        if start is not None:
            out.append(Node(start, hi, "statement"))
        return out

    source_rows = source.split("\n")
    starts = list(itertools.accumulate((len(line) + 1 for line in rows), initial=0))
    row_of = lambda i: bisect.bisect_right(starts, i, 0, len(rows)) - 1
    # Where brackets open and close: the depth of a place, and the end of the block that opens there.
    marks, levels, closes, stack = [], [0], {}, []
    for m in re.finditer(r"[{}]", quiet):
        marks.append(m.start())
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closes[stack.pop()] = m.start()
        levels.append(len(stack))
    depth_at = lambda i: levels[bisect.bisect_left(marks, i)]
    symbols: list[Symbol] = []
    open_ends: list[int] = []  # rows where the symbols around end
    for i, name, label, defines in languages.definitions(quiet, lang, depth_at):
        row = end = row_of(i)
        open_at, stop = quiet.find("{", i), quiet.find(";", i)
        if open_at >= 0 and not 0 <= stop < open_at:
            end = row_of(closes.get(open_at, len(quiet) - 1))
        while open_ends and open_ends[-1] < row:
            open_ends.pop()
        symbols.append(Symbol(name if defines else "", label, row, end, row, len(open_ends)))
        if end > row:
            open_ends.append(end)
    return Tree(blocks(0, len(rows) - 1, 0), symbols, [(row_of(i), name) for i, name in languages.references(quiet)])


EITHER, BACK, FORWARD = "", "back", "forward"


_RUBY_OPENS = re.compile(r"^[ \t]*(?:(?:private|protected|public|module_function|private_class_method)[ \t]+)?(def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b[ \t]*(?:\|[^|\n]*\|)?[ \t]*$|=[ \t]*(?:if|unless|case|begin|while)\b", re.M)
_RUBY_NAMED = re.compile(r"^[ \t]*(?:\w+[ \t]+)?(def|class|module)[ \t]+(?:self\.|[A-Z]\w*\.)?(?:[A-Z]\w*::)*([A-Za-z_]\w*[?!=]?)", re.M)
_RUBY_CONST = re.compile(r"^[ \t]*([A-Z]\w*)[ \t]*=(?![=~>])", re.M)
_RUBY_ENDLESS = re.compile(r"^[ \t]*(?:\w+[ \t]+)?def[ \t]+[^\n=]*?\)?[ \t]=(?![=~>])[ \t]*\S")


def parse_ruby(source: str) -> Tree:
    """Blocks between opening words and `end`; a word that only qualifies a statement opens nothing."""
    quiet = quieted(source, "ruby")
    rows, source_rows = quiet.split("\n"), source.split("\n")
    symbols: list[Symbol] = []
    tops: list[Node] = []
    stack: list[tuple[Node | None, Symbol | None]] = []
    comment: int | None = None
    for r, text in enumerate(rows):
        bare = text.strip()
        if not bare:
            comment = (r if comment is None else comment) if source_rows[r].strip() else None
            continue
        first = r if comment is None else comment
        comment = None
        named = _RUBY_NAMED.match(text)
        symbol = None
        if named:
            label = f"{named[1]} {named[2]}"
            symbol = Symbol(named[2], label, first, r, r, sum(s is not None for _, s in stack))
            symbols.append(symbol)
        elif not stack or all(n is not None and n.kind in ("class", "module") for n, _ in stack):
            if const := _RUBY_CONST.match(text):
                symbols.append(Symbol(const[1], "", first, r, r, -1))
        closes = len(re.findall(r"(?<![\w.:])end\b(?![?!:])", text))
        opens = 0 if _RUBY_ENDLESS.match(text) else len(_RUBY_OPENS.findall(text))
        if opens:
            for k in range(opens):
                node = Node(first, r, {"def": "function"}.get(named[1], named[1]) if named and k == 0 else "block")
                (stack[-1][0].children if stack else tops).append(node)
                stack.append((node, symbol if k == 0 else None))
        else:
            where = stack[-1][0].children if stack else tops
            if not (bare == "end" or re.match(r"(?:else|elsif|when|in|rescue|ensure)\b", bare)):
                where.append(Node(first, r, "statement"))
        for _ in range(min(closes, len(stack))):
            node, held = stack.pop()
            node.end = r
            if held:
                held.end = r
    for node, held in stack:  # never closed
        node.end = len(rows) - 1
        if held:
            held.end = len(rows) - 1
    starts = list(itertools.accumulate((len(line) + 1 for line in rows), initial=0))
    found = [(bisect.bisect_right(starts, i, 0, len(rows)) - 1, name) for i, name in languages.ruby_references(quiet)]
    return Tree(tops, sorted(symbols, key=lambda s: (s.start, -s.end)), found)


def segments(nodes: list[Node], lo: int, hi: int, cfg: ChunkConfig, depth: int = 0) -> list[tuple[int, int, str, str]]:
    """Row spans (first, last, kind, side) of at most max_lines that cover lo .. hi; nodes that are too large are opened.

    side: which neighbour a small span joins.  What lies before a node that is opened belongs to what follows; what is
    left at the end of an opened node, its closing bracket, to what is before.
    """
    out: list[tuple[int, int, str, str]] = []
    start, kind = lo, ""

    def flush(end: int, side: str = EITHER) -> None:
        nonlocal start
        while start <= end:
            cut = min(end, start + cfg.max_lines - 1)
            out.append((start, cut, kind or "text", side))
            start = cut + 1

    reached = lo - 1
    for n in nodes:
        end = min(n.end, hi)
        if end <= reached:
            continue
        begin = max(n.start, reached + 1)
        if end - start + 1 > cfg.max_lines and begin > start:
            opened = end - begin + 1 > cfg.max_lines and n.children and depth < MAX_DEPTH
            flush(begin - 1, FORWARD if opened else EITHER)
            kind = ""
        if end - start + 1 > cfg.max_lines and n.children and depth < MAX_DEPTH:
            out += segments(n.children, start, end, cfg, depth + 1)
            start, kind = end + 1, ""
        elif end - start + 1 > cfg.max_lines:
            kind = n.kind
            flush(end)
            kind = ""
        elif not kind or n.kind != "statement":
            kind = kind if kind in ("class", "function", "block") else n.kind
        reached = end
    flush(hi, BACK if depth else EITHER)
    return out


def merge_small(spans: list[tuple], cfg: ChunkConfig) -> list[tuple[int, int, str]]:
    """Pieces (first, last, kind[, side]) below min_lines join a neighbour if both stay within max_lines: that of their side, else the one that stays smaller."""
    spans = [(*s, EITHER)[:4] for s in spans]
    i = 0
    while i < len(spans):
        s, e, kind, side = spans[i]
        if e - s + 1 >= cfg.min_lines:
            i += 1
            continue
        near = {BACK: (i - 1,), FORWARD: (i + 1,)}.get(side, (i - 1, i + 1))
        fits = lambda j: 0 <= j < len(spans) and max(e, spans[j][1]) - min(s, spans[j][0]) + 1 <= cfg.max_lines  # noqa: E731, B023
        choices = [(spans[j][1] - spans[j][0], j) for j in near if fits(j)] or [(spans[j][1] - spans[j][0], j) for j in (i - 1, i + 1) if fits(j)]
        if not choices:
            i += 1
            continue
        j = min(choices)[1]
        a, b = sorted((i, j))
        big = spans[j][2] if spans[j][1] - spans[j][0] >= e - s else kind
        spans[a : b + 1] = [(spans[a][0], spans[b][1], big, spans[j][3])]
        i = a
    return [s[:3] for s in spans]


def text_spans(blank: list[bool], cfg: ChunkConfig) -> list[tuple[int, int, str]]:
    """The text chunker's windows: cut at the latest blank row of a window."""
    out, i, n, win = [], 0, len(blank), max(1, min(cfg.window_lines, cfg.max_lines))
    while i < n:
        if blank[i]:
            i += 1
            continue
        if i + win - 1 >= n - 1:
            end = n - 1
        else:
            cut = [k for k in range(i + min(cfg.min_lines, win), i + win + 1) if k < n and blank[k]]
            end = cut[-1] - 1 if cut else i + win - 1
        while blank[end]:
            end -= 1
        out.append((i, end, "window"))
        i = end + 1
    return out


def chunk_source(path: str, lang: str, text: str, cfg: ChunkConfig = ChunkConfig()) -> list[dict]:
    """Chunks of one file as rows."""
    rows = text[:-1].split("\n") if text.endswith("\n") else text.split("\n") if text else []
    if not rows:
        return []
    blank = [not r.strip() for r in rows]
    tree = error = None
    try:
        tree = parse_python(text) if lang == "python" else parse_ruby(text) if lang == "ruby" else parse_braces(text, lang) if lang in BRACED else None
    except (SyntaxError, ValueError, RecursionError) as e:
        error = f"{type(e).__name__}: {e}"
    spans = merge_small(segments(tree.nodes, 0, len(rows) - 1, cfg), cfg) if tree else merge_small(text_spans(blank, cfg), cfg)
    common = COMMON if lang == "python" else languages.RUBY_COMMON if lang == "ruby" else languages.CONTROL | {"self", "this", "base"}
    out = []
    for s, e, kind in spans:
        while s <= e and blank[s]:
            s += 1
        while e >= s and blank[e]:
            e -= 1
        if s > e:
            continue
        symbols = tree.symbols if tree else []
        defines = list(dict.fromkeys(x.name for x in symbols if x.name and s <= x.row <= e))
        named = [x for x in symbols if x.depth >= 0]
        around = [x for x in named if x.start <= s and e <= x.end]
        best = [x for x in named if s <= x.start and x.end <= e and 2 * sum(not b for b in blank[x.start : x.end + 1]) > sum(not b for b in blank[s : e + 1])]
        chain = sorted(around, key=lambda x: (x.start, -x.end)) + ([min(best, key=lambda x: (x.start, -x.end))] if best else [])
        refs = [n for r, n in (tree.refs if tree else []) if s <= r <= e and len(n) >= 3 and n not in common and n not in defines]
        body = "\n".join(rows[s : e + 1])
        out.append(
            {
                "chunk_id": hashlib.sha256(f"{path}\0{s + 1}\0{e + 1}\0{body}".encode("utf-8", "surrogatepass")).hexdigest()[:32],
                "path": path,
                "start_line": s + 1,
                "end_line": e + 1,
                "lang": lang,
                "symbol": " > ".join(dict.fromkeys(x.label for x in chain)),
                "kind": kind,
                "defines": defines,
                "refs": list(dict.fromkeys(refs))[:MAX_REFS],
                "text": body,
                "error": error,
            }
        )
    return out


SCHEMA = "chunk_id string, path string, start_line int, end_line int, lang string, symbol string, kind string, defines array<string>, refs array<string>, text string, error string"
_ARROW = pa.schema(
    [("chunk_id", pa.string()), ("path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("lang", pa.string()), ("symbol", pa.string()), ("kind", pa.string())]
    + [("defines", pa.list_(pa.string())), ("refs", pa.list_(pa.string())), ("text", pa.string()), ("error", pa.string())]
)


def chunk_files(files: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of files (path, lang, text); rows without text give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += chunk_source(path, lang or "text", text or "", cfg)
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.select("path", "lang", "text").mapInArrow(run, SCHEMA)
