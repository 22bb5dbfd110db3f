"""Source code with its comments and strings blanked: one pass of a small state machine for each language.

What is blanked keeps its length and its line breaks, so that places stay what they are.  Code inside
template strings (`${...}`, Ruby's `#{...}`) stays code.  Each character is looked at once or
jumped over by a search for what ends a string or comment; what is never closed ends with the source.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """How a language writes what is no code."""

    line: tuple[str, ...] = ("//",)
    nested: bool = False  # block comments nest
    block: bool = True  # /* */
    triple: tuple[str, ...] = ()  # strings that end where they begin again, over lines
    quotes: str = '"'  # strings of one line with backslash escapes
    raw: str = ""  # strings over lines without escapes
    template: str = ""  # strings over lines with code in them
    opener: str = "${"  # what begins code in a template
    chars: bool = True  # 'x' is a character
    lifetimes: bool = False  # 'x is a name
    prefixed: re.Pattern | None = None  # raw strings with a prefix; group `hash` or `tag` is said again at the end
    closing: str = ""  # what stands before that group in the end
    regexes: bool = False  # /x/ where no value stands before
    heredoc: re.Pattern | None = None


_RUST_RAW = re.compile(r'b?r(?P<hash>#*)"')
_CPP_RAW = re.compile(r'(?:u8|[uUL])?R"(?P<tag>[^\s()\\"]{0,16})\(')
_CS_VERBATIM = re.compile(r'(?:\$@|@\$|@)"')
_PHP_HEREDOC = re.compile(r"<<<[ \t]*(['\"]?)(?P<tag>[A-Za-z_]\w*)\1[ \t]*\n")
_RUBY_HEREDOC = re.compile(r"<<[~-]?(['\"`]?)(?P<tag>[A-Z_][A-Z0-9_]*)\1")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else yield await and or not if unless while until when puts".split())

LEXICONS = {
    "rust": Lexicon(nested=True, lifetimes=True, prefixed=_RUST_RAW, quotes='"'),
    "swift": Lexicon(nested=True, triple=('"""',), chars=False),
    "kotlin": Lexicon(nested=True, triple=('"""',)),
    "java": Lexicon(triple=('"""',)),
    "csharp": Lexicon(triple=('"""',), prefixed=_CS_VERBATIM),
    "go": Lexicon(raw="`"),
    "c": Lexicon(),
    "cpp": Lexicon(prefixed=_CPP_RAW, closing=")"),
    "php": Lexicon(line=("//", "#"), quotes="\"'", chars=False, heredoc=_PHP_HEREDOC),
    "javascript": Lexicon(quotes="\"'", chars=False, template="`", regexes=True),
    "ruby": Lexicon(line=("#",), block=False, quotes="'", chars=False, template='"', opener="#{", regexes=True, heredoc=_RUBY_HEREDOC),
}
_PREFIXES = {"rust": "rb", "cpp": "RuUL", "csharp": "@$"}  # what a raw string may begin with
LEXICONS |= {"typescript": LEXICONS["javascript"], "tsx": LEXICONS["javascript"]}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _string_end(source: str, at: int, quote: str, over_lines: bool) -> int:
    """The place after a string with backslash escapes that begins at `at`."""
    i = at + len(quote)
    pattern = re.compile(r"\\.|" + re.escape(quote) + ("" if over_lines else r"|\n"), re.S)
    while m := pattern.search(source, i):
        if m[0] == "\n":
            return m.start()
        i = m.end()
        if m[0] == quote:
            return i
    return len(source)


def _comment_end(source: str, at: int, nested: bool) -> int:
    if not nested:
        end = source.find("*/", at + 2)
        return len(source) if end < 0 else end + 2
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(source)


def _regex_end(source: str, at: int) -> int | None:
    """The place after a regular expression that begins at `at`; None if its line holds no end."""
    i, inside = at + 1, False
    while i < len(source) and source[i] != "\n":
        c = source[i]
        if c == "\\":
            i += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "/" and not inside:
            return re.compile(r"[A-Za-z]*").match(source, i + 1).end()
        i += 1
    return None


def quieted(source: str, lang: str) -> str:
    """The source of the same length in which only code is left."""
    lex = LEXICONS.get(lang, LEXICONS["java"])
    out: list[str] = []
    done = i = 0
    depths: list[int] = []  # of each template around: open braces since its code began
    docs: list[str] = []  # heredocs whose bodies begin on the next line
    starts = set("/#\"'`<{}\n") | set(lex.quotes) | set(lex.raw) | set(lex.template) | set(_PREFIXES.get(lang, ""))
    jump = re.compile("[" + re.escape("".join(sorted(starts))) + "]")
    last = ""  # the last code that is no blank: a name, or a mark

    def drop(a: int, b: int) -> None:
        """Blanks source[a:b]."""
        nonlocal done
        out.append(source[done:a])
        out.append(_blank(source[a:b]))
        done = b

    def template(a: int) -> int:
        """From the inside of a template string: blanks up to its end or to code in it, and goes on there."""
        pattern = re.compile(r"\\.|" + re.escape(lex.template) + "|" + re.escape(lex.opener), re.S)
        j = a
        while m := pattern.search(source, j):
            j = m.end()
            if m[0] == lex.opener:
                drop(a, j)
                depths.append(0)
                return j
            if m[0] == lex.template:
                drop(a, j)
                return j
        drop(a, len(source))
        return len(source)

    def begun(a: int) -> int:
        """The place after a Ruby comment block that begins at a line's start."""
        if lang != "ruby" or not source.startswith("=begin", a):
            return a
        end = re.compile(r"^=end\b[^\n]*", re.M).search(source, a)
        stop = end.end() if end else len(source)
        drop(a, stop)
        return stop

    i = begun(0)
    while m := jump.search(source, i):
        between = source[i : m.start()].rstrip()
        if between:
            names = _WORD.findall(between[-40:])
            last = names[-1] if names and between.endswith(names[-1]) else between[-1]
        i, c = m.start(), m[0]
        if c == "\n":
            i += 1
            i = begun(i)
            while docs and i < len(source):
                end = re.compile(rf"^[ \t]*{re.escape(docs.pop(0))}\b", re.M).search(source, i)
                stop = end.end() if end else len(source)
                drop(i, stop)
                i = stop
            continue
        if c in "{}" and depths:
            if c == "{":
                depths[-1] += 1
            elif depths[-1]:
                depths[-1] -= 1
            else:
                depths.pop()
                drop(i, i + 1)
                i = template(i + 1)
                last = '"'
                continue
        if any(source.startswith(x, i) for x in lex.line) and not (c == "#" and lang == "php" and source.startswith("#[", i)):
            end = source.find("\n", i)
            end = len(source) if end < 0 else end
            drop(i, end)
            i = end
            continue
        if lex.block and source.startswith("/*", i):
            end = _comment_end(source, i, lex.nested)
            drop(i, end)
            i = end
            continue
        if lex.heredoc and c == "<" and (h := lex.heredoc.match(source, i)):
            docs.append(h["tag"])
            stop = h.end() - h[0].endswith("\n")
            drop(i, stop)
            i, last = stop, '"'
            continue
        before = source[i - 1] if i else ""
        if lex.prefixed and not (before.isalnum() or before == "_") and (p := lex.prefixed.match(source, i)):
            if lang == "csharp":
                end = re.compile(r'(?:[^"]|"")*+"?').match(source, p.end()).end()
            else:
                close = '"' + p["hash"] if lang == "rust" else lex.closing + p["tag"] + '"'
                end = source.find(close, p.end())
                end = len(source) if end < 0 else end + len(close)
            drop(i, end)
            i, last = end, '"'
            continue
        if triple := next((t for t in lex.triple if source.startswith(t, i)), None):
            end = _string_end(source, i, triple, True)
            drop(i, end)
            i, last = end, '"'
            continue
        if c and c in lex.template:
            i = template(i + 1) if not drop(i, i + 1) else i
            last = '"'
            continue
        if c and c in lex.raw:
            end = source.find(c, i + 1)
            end = len(source) if end < 0 else end + 1
            drop(i, end)
            i, last = end, '"'
            continue
        if c in lex.quotes:
            end = _string_end(source, i, c, lang in ("php", "rust", "ruby"))
            drop(i, end)
            i, last = end, '"'
            continue
        if c == "'" and lex.chars:
            char = re.compile(r"'(?:\\(?:u\{[0-9A-Fa-f_]+\}|x[0-9A-Fa-f]{1,2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[0-7]{1,3}|.)|[^'\\\n])'").match(source, i)
            if char:
                drop(i, char.end())
                i, last = char.end(), '"'
                continue
        if c == "/" and lex.regexes and (not last or last in "(,=:[!&|?{};<>+-*%~^" or last in _BEFORE_REGEX):
            end = _regex_end(source, i)
            if end is not None:
                drop(i, end)
                i, last = end, '"'
                continue
        i += 1
        last = c
    out.append(source[done:])
    return "".join(out)
