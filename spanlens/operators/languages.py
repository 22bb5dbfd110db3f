"""What defines and what refers to a name in languages with braces, as patterns over source without strings and comments.

A definition rule is (label, pattern, defines): its first group is the name; a rule that defines
nothing only names a region (an implementation block).  Rules marked `TOP` hold outside of all
blocks only.  References are calls, names after `new`, types, bases and imports.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from dataclasses import dataclass

N = r"([A-Za-z_$][\w$]*)"
TOP, ANY = True, False


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    defines: bool = True
    top: bool = False


def rules(*found: tuple) -> tuple[Rule, ...]:
    return tuple(Rule(label, re.compile(pattern, re.M), *more) for label, pattern, *more in found)


_JS = rules(
    ("function", rf"\bfunction\s*\*?\s+{N}"),
    ("class", rf"\bclass\s+{N}"),
    ("interface", rf"\binterface\s+{N}"),
    ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{N}\s*(?:<[^=;]*>)?\s*="),
    ("enum", rf"\benum\s+{N}"),
    ("namespace", rf"\b(?:namespace|module)\s+{N}"),
    ("const", rf"\b(?:const|let|var)\s+{N}\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\b|class\b|\([^()]*\)\s*(?::[^=;{{}}]+)?=>|[A-Za-z_$][\w$]*\s*=>)"),
    ("const", rf"^(?:export\s+)?(?:const|let|var)\s+{N}\s*[:=]", True, TOP),
)
_JAVA_LIKE = (("class", rf"\bclass\s+{N}"), ("interface", rf"(?<!@)\binterface\s+{N}"), ("enum", rf"\benum\s+{N}"), ("record", rf"\brecord\s+{N}\s*[(<]"))
_C = (("struct", rf"\bstruct\s+{N}\s*(?::[^{{;]*)?\{{"), ("union", rf"\bunion\s+{N}\s*\{{"), ("enum", rf"\benum\s+(?:class\s+|struct\s+)?{N}\s*(?::[^{{;]*)?\{{"), ("typedef", rf"\btypedef\b[^;{{}}]*?\b{N}\s*;"), ("#define", rf"^[ \t]*#[ \t]*define[ \t]+{N}"))

DEFINITIONS = {
    "rust": rules(
        ("fn", rf"\bfn\s+{N}"), ("struct", rf"\bstruct\s+{N}"), ("enum", rf"\benum\s+{N}"), ("union", rf"\bunion\s+{N}\s*[{{<]"), ("trait", rf"\btrait\s+{N}"), ("mod", rf"\bmod\s+{N}"),
        ("const", rf"\bconst\s+{N}\s*:"), ("static", rf"\bstatic\s+(?:mut\s+)?{N}\s*:"), ("type", rf"\btype\s+{N}"), ("macro_rules!", rf"\bmacro_rules!\s*{N}"),
        ("impl", rf"\bimpl\b\s*(?:<[^{{}}]*?>\s*)?(?:[\w:<>, &']+?\s+for\s+)?(?:\w+::)*{N}", False),
    ),
    "go": rules(("func", rf"\bfunc\s+(?:\([^)]*\)\s*)?{N}"), ("type", rf"\btype\s+{N}"), ("const", rf"^const\s+{N}", True, TOP), ("var", rf"^var\s+{N}", True, TOP)),
    "java": rules(*_JAVA_LIKE, ("@interface", rf"@interface\s+{N}")),
    "csharp": rules(*_JAVA_LIKE, ("struct", rf"\bstruct\s+{N}"), ("namespace", rf"\bnamespace\s+(?:\w+\.)*{N}"), ("delegate", rf"\bdelegate\s+[\w<>\[\], ]+?\s+{N}\s*\(")),
    "kotlin": rules(*_JAVA_LIKE, ("fun", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>]+\.)?{N}\s*\("), ("object", rf"\bobject\s+{N}"), ("typealias", rf"\btypealias\s+{N}"), ("val", rf"^(?:[a-z]+ )*va[lr]\s+{N}", True, TOP)),
    "swift": rules(
        ("func", rf"\bfunc\s+{N}"), ("class", rf"\bclass\s+(?!func\b|var\b){N}"), ("struct", rf"\bstruct\s+{N}"), ("enum", rf"\benum\s+{N}"), ("protocol", rf"\bprotocol\s+{N}"), ("actor", rf"\bactor\s+{N}"),
        ("extension", rf"\bextension\s+{N}", False), ("typealias", rf"\btypealias\s+{N}"), ("let", rf"^(?:[a-z]+ )*(?:let|var)\s+{N}", True, TOP),
    ),
    "c": rules(*_C),
    "cpp": rules(*_C, ("class", rf"\bclass\s+{N}\s*(?:final\s*)?(?::[^{{;]*)?\{{"), ("namespace", rf"\bnamespace\s+(?:\w+::)*{N}"), ("using", rf"\busing\s+{N}\s*=")),
    "php": rules(("function", rf"\bfunction\s+&?\s*{N}"), ("class", rf"\bclass\s+{N}"), ("interface", rf"\binterface\s+{N}"), ("trait", rf"\btrait\s+{N}"), ("enum", rf"\benum\s+{N}"), ("const", rf"\bconst\s+{N}\s*=")),
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
}
# A method without a keyword: a name, its parameters and a block, after what ends a statement or its modifiers and type.
METHOD = re.compile(r"(?:^|[;{}])[ \t]*(?:@\w+[ \t]+)?(?:[\w<>\[\],?*&:. ]+[ \t*&])?(?:\w+::)?~?([A-Za-z_$][\w$]*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)[^;{}()=]*\{", re.M)
WITH_METHODS = frozenset({"java", "csharp", "c", "cpp", "javascript", "typescript", "tsx"})
# Keywords that stand before parentheses and blocks without being calls or methods.
CONTROL = frozenset("if for while switch catch return sizeof function fn func when guard match using lock foreach elseif else do try synchronized with typeof await yield throw delete new in of super constructor".split())

CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*!?\s*(?=\()")
MADE = re.compile(r"\bnew\s+(?:\w+\.)*([A-Za-z_$][\w$]*)")
TYPED = re.compile(r"\b([A-Z][\w$]*[a-z][\w$]*)\b")
BASES = re.compile(r"\b(?:extends|implements)\s+([\w$.,<> \t]+)|\bclass\s+[\w$]+\s*(?:<[^{}]*?>)?\s*:\s*([\w$:.,<> \t]+)")
IMPORTS = re.compile(r"^[ \t]*(?:pub[ \t]+)?(?:use|import|using|require|from)\b([^;\n]*(?:\{[^}]*\})?[^;\n]*)", re.M)
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_WORDS = frozenset("use import using require from as static type public private protected virtual self crate super pub extends implements".split())


# What is left of a run: no rule tells longer runs from it, and their backtracking would grow with the square of a run.
_LONG_RUN = re.compile(r"(?<= {4}) +|(?<=\t{4})\t+")
_LONG_GAP = re.compile(r"(?<=\n)(?:[ \t]*\n){5,}")


def squeezed(quiet: str) -> tuple[str, Callable[[int], int]]:
    """The source with long runs of blanks and of blank lines cut short, and the place in the source of a place in it."""

    def cut(text: str, runs: re.Pattern, keep: str) -> tuple[str, Callable[[int], int]]:
        parts, starts, shifts, done, gone = [], [0], [0], 0, 0
        for m in runs.finditer(text):
            parts += [text[done : m.start()], keep]
            done = m.end()
            gone += done - m.start() - len(keep)
            starts.append(done - gone)
            shifts.append(gone)
        parts.append(text[done:])
        return "".join(parts), lambda i: i + shifts[bisect.bisect_right(starts, i) - 1]

    narrow, across = cut(quiet, _LONG_RUN, "")
    short, down = cut(narrow, _LONG_GAP, "\n" * 4)
    return short, lambda i: across(down(i))


def references(quiet: str) -> list[tuple[int, str]]:
    """(place, name) of all names that a source refers to, in order."""
    quiet, place = squeezed(quiet)
    found = {(m.start(1), m[1]) for p in (CALL, MADE, TYPED) for m in p.finditer(quiet) if m[1] not in CONTROL}
    for p in (BASES, IMPORTS):
        for m in p.finditer(quiet):
            for g in range(1, p.groups + 1):
                if m[g]:
                    found.update((m.start(g) + x.start(), x[0]) for x in _NAME.finditer(m[g]) if x[0] not in _WORDS)
    return [(place(i), name) for i, name in sorted(found)]


def definitions(quiet: str, lang: str, depth_at) -> list[tuple[int, str, str, bool]]:
    """(place, name, label, defines) in order; a place counts once, by the first rule that fits."""
    found: dict[int, tuple[str, str, bool]] = {}
    quiet, place = squeezed(quiet)
    for rule in DEFINITIONS.get(lang, DEFINITIONS["java"]):
        for m in rule.pattern.finditer(quiet):
            if not (rule.top and depth_at(place(m.start(1)))):
                found.setdefault(m.start(1), (m[1], f"{rule.label} {m[1]}", rule.defines))
    if lang in WITH_METHODS:
        for m in METHOD.finditer(quiet):
            if m[1] not in CONTROL:
                found.setdefault(m.start(1), (m[1], m[1], True))
    return [(place(i), *found[i]) for i in sorted(found)]


RUBY_COMMON = frozenset("alias and begin break case class def defined do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield puts require require_relative include extend attr_reader attr_writer attr_accessor raise private public protected new lambda proc loop".split())
_RUBY_CALL = re.compile(r"(?<![\w@$:])([a-z_]\w*[?!]?)(?=\()|(?<=\.)([a-z_]\w*[?!]?)|\b([A-Z]\w*)\b")
_RUBY_DEFINED = re.compile(r"\b(?:def|class|module)[ \t]+$")


def ruby_references(quiet: str) -> list[tuple[int, str]]:
    """(place, name) of calls with parentheses or a receiver, and of constants."""
    found = []
    for m in _RUBY_CALL.finditer(quiet):
        name = m[1] or m[2] or m[3]
        if name not in RUBY_COMMON and not _RUBY_DEFINED.search(quiet, max(0, m.start() - 12), m.start()):
            found.append((m.start(), name))
    return found
