"""Personal data by anchor expansion.

One Aho-Corasick automaton over the whole text finds anchors: at-signs (also written out, as
in "(at)"), schemes, plus signs, digits and identifier cues ("iban", "ssn", "account" ...).  At
each anchor a small parser, which never guesses and never goes back behind what its kind has
taken already, expands to the left and right and checks what it finds.

Base kinds, each leftmost and without overlaps; a match that fails its check is dropped and
not tried again in part:
    email   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip      [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), each part at most 255
    card    [0-9]([\\x20-]?[0-9])+, 12 to 19 digits that pass Luhn's check
    phone   \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits
Added kinds, which may overlap base ones:
    mailbox   an address spelled with "(at)" or "(dot)" in round, square, curly or angle brackets, or with
              letters beyond ASCII; its last label is two letters or more
    login     scheme://user@host or scheme://user:password@host, with the port
    tel       7 to 15 digits after "tel:"
    iban      after "iban": the longest run of 15 to 34 letters and digits whose remainder by 97 is 1
    ssn       after "ssn" or "social security": nine digits, 3-2-4, of ranges that are given out
    account   after "account", "acct" or "konto" with "number", "no", "nr", "#" or ":": 6 to 17 digits
    passport  after "passport": up to two capitals and 6 to 9 digits

Every parser reads a stretch that no other anchor of its kind reads, so a text takes time linear in
its length whatever it holds (a regular expression for emails takes the square of a run of letters).
Rows are worked on where they are read: no shuffle, and no state beyond one text.

Defined results: null and empty texts have no spans; spans count code points, ends exclusive;
they are sorted by start, then by kind in the order above; repeated rows and null keys are
rows like any other; an empty table gives an empty result; other columns pass through, and a
name asked for the spans that is taken is an error.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import freed, spread, table, text_blocks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "mailbox", "login", "tel", "iban", "ssn", "account", "passport")
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"

# Anchors of the added kinds.
AT_MARKS = ("(at)", "[at]", "{at}", "<at>", "＠")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "konto": "account", "passport": "passport", "tel:": "tel"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"[0-9][ ().0-9-]*+")
_WIDE_DOMAIN = re.compile(r"[^\W_]++(?:-++[^\W_]++)*+(?:(?:\.| ?[(\[{<](?:dot|DOT)[)\]}>] ?)[^\W_]++(?:-++[^\W_]++)*+)++")
_LABEL = re.compile(r"[^\W\d_]{2,}")
_USER = re.compile(r"[^\s/?#@]++@[^\s/?#@:]*[^\W_](?::[0-9]{1,5})?")
_NUMBER_WORD = r"(?:\s?(?:number|nummer|no\.?|nr\.?))"
_AFTER = {
    "iban": re.compile(rf"(?i:{_NUMBER_WORD}?)[\s:#]{{0,3}}([A-Z]{{2}}[0-9]{{2}}(?:[ -]?[A-Z0-9]){{11,30}})"),
    "ssn": re.compile(rf"(?i:{_NUMBER_WORD}?)[\s:#]{{0,3}}(([0-9]{{3}})[ -]?([0-9]{{2}})[ -]?([0-9]{{4}}))(?!\w)"),
    "account": re.compile(rf"(?i:{_NUMBER_WORD}[\s:#]{{0,3}}|\s?[:#][\s#]{{0,2}}|nummer[\s:]{{0,2}})([0-9](?:[ -]?[0-9]){{5,16}})(?![ -]?\w*[0-9])"),
    "passport": re.compile(rf"(?i:{_NUMBER_WORD}?)[\s:#]{{0,3}}([A-Z]{{0,2}}[0-9]{{6,9}})(?!\w)"),
    "tel": re.compile(r"(\+?[0-9](?:[().-]{0,2}[0-9]){6,14})(?![0-9])"),
}
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_SCHEME_CHARS = 32  # longer runs before :// are no scheme

Span = tuple[str, int, int]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Anchors with what stands behind them: what to parse and the anchor's length."""
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for mark in AT_MARKS:
        for form in {mark, mark.upper()}:
            found.add_word(form, ("mark", len(form)))
    for cue, kind in CUES.items():
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ips(text: str, at: int) -> tuple[list[Span], int]:
    """Addresses in the chain of numbers and dots that starts here, and where the chain ends."""
    end = _CHAIN.match(text, at).end()
    found, parts = [], text[at:end].split(".")
    for i in range(0, len(parts) - 3, 4):
        four = parts[i : i + 4]
        size = sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            found.append(("ip", at, at + size))
        at += size + 1
    return found, end


def _card(text: str, at: int) -> tuple[list[Span], int]:
    end = _RUN.match(text, at).end()
    if end - at >= 12 and 12 <= len(digits := _digits(text[at:end])) <= 19 and luhn(digits):
        return [("card", at, end)], end
    return [], end


def _phone(text: str, at: int) -> Span | None:
    """What follows the plus sign at `at`, up to its last digit."""
    run = _PHONE.match(text, at + 1)
    if run is None:
        return None
    end = run.end()
    while not "0" <= text[end - 1] <= "9":
        end -= 1
    if end - at < 4 or not 9 <= len(_digits(text[at:end])) <= 15:
        return None
    return ("phone", at, end)


def _email(text: str, at: int, free: int) -> Span | None:
    """The address around the at-sign at `at`; what is before `free` is taken."""
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    if start == at or (domain := _DOMAIN.match(text, at + 1)) is None:
        return None
    return ("email", start, domain.end())


def _mailbox(text: str, at: int, width: int, free: int, spelled: bool) -> Span | None:
    """An address spelled out or with letters beyond ASCII around the mark at `at`."""
    end, start = at + width, at
    if spelled:
        end += text[end : end + 1] == " "
        start -= start > free and text[start - 1] == " "
    last = start
    while start > free and ((c := text[start - 1]).isalnum() or c in "._%+-"):
        start -= 1
    while start < last and not text[start].isalnum():
        start += 1
    domain = _WIDE_DOMAIN.match(text, end)
    if start == last or domain is None or not _LABEL.fullmatch(re.split(r"\.|[)\]}>] ?", domain[0])[-1]):
        return None
    whole = text[start : domain.end()]
    return ("mailbox", start, domain.end()) if spelled or not whole.isascii() or re.search(r"[(\[{<]", domain[0]) else None


def _login(text: str, at: int, free: int) -> Span | None:
    start = at
    while start > free and at - start < _SCHEME_CHARS and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and not text[start].isalpha():
        start += 1
    user = _USER.match(text, at + 3)
    return ("login", start, user.end()) if start < at and user else None


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the longest run from `start` that is a valid number and no part of a longer word."""
    while end > start:
        body = re.sub("[ -]", "", text[start:end])
        if len(body) < 15:
            return None
        if not text[end : end + 1].isalnum() and int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1:
            return end
        end -= 1
        while text[end - 1] in " -":
            end -= 1
    return None


def _cued(text: str, kind: str, start: int, end: int) -> Span | None:
    """The identifier behind a cue at start:end."""
    if start and text[start - 1].isalnum():
        return None
    found = _AFTER[kind].match(text, end)
    if found is None:
        return None
    first, last = found.span(1)
    if kind == "iban" and (last := _iban_end(text, first, last)) is None:
        return None
    if kind == "ssn" and (found[2] in ("000", "666") or found[2] >= "900" or found[3] == "00" or found[4] == "0000"):
        return None
    return (kind, first, last)


def spans(text: str | None) -> list[Span]:
    """(kind, start, end) of a text, by start, then kind."""
    if not text:
        return []
    found: list[Span] = []
    free = dict.fromkeys(KINDS, 0)  # where each kind may begin

    def take(span: Span | None) -> bool:
        if span is None or span[1] < free[span[0]]:
            return False
        found.append(span)
        free[span[0]] = span[2]
        return True

    for last, (what, width) in automaton().iter(text):
        at = last + 1 - width
        if what == "digit":
            if at >= free["ip"]:
                more, free["ip"] = _ips(text, at)
                found += more
            if at >= free["card"]:
                more, free["card"] = _card(text, at)
                found += more
        elif what == "plus":
            take(_phone(text, at))
        elif what == "at":
            take(_email(text, at, free["email"]))
            take(_mailbox(text, at, 1, free["mailbox"], False))
        elif what == "mark":
            take(_mailbox(text, at, width, free["mailbox"], True))
        elif what == "scheme":
            take(_login(text, at, free["login"]))
        else:
            take(_cued(text, what, at, last + 1))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind in square brackets; overlapping spans become one of the first's kind."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find(docs: DataFrame, text: str = "text", out: str = "pii", keep: list[str] | None = None, mask: bool = False) -> DataFrame:
    """The rows (their columns `keep`, by default all) with the column `out`: the spans of their whole text.

    mask: the text, if kept, has its spans replaced by their kinds.
    """
    keep = docs.columns if keep is None else keep
    if out in keep:
        raise ValueError(f"documents have a column {out} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, text):
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            each = [spans(body) for body in bodies]
            flat = [s for found in each for s in found]
            ends = [0]
            for found in each:
                ends.append(ends[-1] + len(found))
            parts = pa.StructArray.from_arrays(
                [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())], names=["kind", "start", "end"]
            )
            kept = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            if mask and text in kept:
                kept[text] = pa.array([body and masked(body, found) for body, found in zip(bodies, each, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*kept.values(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)], names=[*kept, out])

    asked = docs.select(*dict.fromkeys([*keep, text]))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return asked.mapInArrow(freed(run), f"{fields}{', ' if fields else ''}`{out}` {SPANS}")


def redact(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """The rows with their spans and the text masked."""
    return find(docs, text, out, mask=True)


def written(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    found = find(docs, out="found", keep=["doc_id"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
