"""Words, terms and signals of a text as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions import vocab


def _any_of(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def words(text: Column) -> Column:
    """Identifier-like words in order: runs of ASCII letters, digits and underscores that don't start with a digit."""
    return F.filter(F.split(text, "[^A-Za-z0-9_]+"), is_word)


def is_word(run: Column) -> Column:
    """Whether a run of letters, digits and underscores is a word: not empty, and no digit first."""
    return (run != "") & ~((run >= "0") & (run < ":"))  # the colon follows the nine


def word_parts(word: Column) -> Column:
    """Lower-case parts of a word, cut at underscores, humps and between digits and letters."""
    cut = F.translate(word, "_", " ")
    for pattern in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([0-9])([A-Za-z])", "([A-Za-z])([0-9])"):
        cut = F.regexp_replace(cut, pattern, "$1 $2")
    return F.filter(F.split(F.lower(cut), " +"), lambda p: p != "")


def terms(text: Column) -> Column:
    """Search terms in order: the parts of each word that have two letters or more, and a word of several parts as a whole."""

    return F.flatten(F.transform(words(text), word_terms))


def word_terms(w: Column) -> Column:
    """The terms of one word; a word of small letters, or one capital and small letters, is its own."""
    none = F.array().cast("array<string>")
    parts = word_parts(w)
    whole = F.when(F.size(parts) > 1, F.array(F.lower(w))).otherwise(none)
    cut = F.concat(F.filter(parts, lambda p: F.length(p) > 1), whole)
    return F.when(w.rlike(r"^[A-Za-z][a-z]*\z"), F.when(F.length(w) > 1, F.array(F.lower(w))).otherwise(none)).otherwise(cut)


def content_terms(text: Column) -> Column:
    """Terms that are not on the stop list, repeats kept."""
    return F.filter(terms(text), lambda t: ~t.isin(*vocab.PROMPT_STOPLIST))


def lower_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(items: Column) -> Column:
    """Neighbours of an array as structs (a, b)."""
    n = F.size(items)
    left, right = F.slice(items, 1, F.greatest(n - 1, F.lit(0))), F.slice(items, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(left, right, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def tokens(prompt: Column) -> Column:
    """Blank-separated tokens without the punctuation at their ends that no name or path has."""
    trimmed = F.transform(F.split(prompt, r"\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"^[^A-Za-z0-9_/.:()]+", ""), r"[^A-Za-z0-9_/.:()]+\z", ""))
    return F.filter(trimmed, lambda t: t != "")


def _path_of(token: Column) -> Column:
    return F.regexp_replace(token, r"[,;).]+\z", "")


def _is_path(token: Column) -> Column:
    core = _path_of(token)
    name = F.element_at(F.split(core, "/"), -1)
    return F.regexp_extract(core, r"\.([A-Za-z0-9]+)\z", 1).isin(*vocab.PATH_EXTENSIONS) & name.rlike(r"^.+\.[^.]*\z")


def path_mentions(prompt: Column) -> Column:
    """Sorted distinct tokens that look like a source or configuration file."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(tokens(prompt), _is_path), _path_of)))


def explicit_identifiers(prompt: Column) -> Column:
    """Sorted distinct names that are clearly code: scoped, called, snake_case or with an inner hump."""
    shaped = r"^[A-Za-z_][A-Za-z0-9_]*\z"

    def of_token(t: Column) -> Column:
        core = F.regexp_replace(t, r"[,;.]+\z", "")
        scoped = F.contains(core, F.lit("::"))
        parts = F.split(core, "::")
        explicit = lambda p: p.rlike(shaped) & (F.contains(p, F.lit("_")) | (p.rlike("^.+[A-Z]") & p.rlike("[a-z]")))
        called = lambda p: p.rlike(r"^[A-Za-z_][A-Za-z0-9_]*\(\)\z")
        kept = F.filter(parts, lambda p: called(p) | (scoped & p.rlike(shaped)) | explicit(p))
        return F.transform(kept, lambda p: F.regexp_replace(p, r"\(\)\z", ""))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(tokens(prompt), lambda t: ~_is_path(t)), of_token))))


def named(prompt: Column) -> Column:
    """The names and then the paths that a prompt names, blank-separated."""
    return F.array_join(F.concat(explicit_identifiers(prompt), path_mentions(prompt)), " ")


def is_follow_up(prompt: Column) -> Column:
    """Whether a prompt leans on what came before: hardly any content, or a word that points back and no names."""
    points_back = F.arrays_overlap(F.transform(words(prompt), F.lower), _any_of(vocab.BACK_REFERENCES))
    bare = (F.size(explicit_identifiers(prompt)) == 0) & (F.size(path_mentions(prompt)) == 0)
    return (F.size(F.array_distinct(content_terms(prompt))) < 4) | (points_back & bare)


def asks_for_tests(prompt: Column) -> Column:
    return F.arrays_overlap(lower_words(prompt), _any_of(vocab.TEST_WORDS))


def asks_for_callers(prompt: Column) -> Column:
    found = lower_words(prompt)
    pairs = F.exists(bigrams(found), lambda p: ((p["a"] == "call") & p["b"].isin("site", "sites")) | (p["a"].isin("used", "referenced") & (p["b"] == "by")))
    where = F.array_contains(found, "where") & F.arrays_overlap(found, _any_of(("used", "referenced")))
    return F.arrays_overlap(found, _any_of(vocab.CALLER_WORDS)) | pairs | where


def asks_for_non_code(prompt: Column) -> Column:
    return F.arrays_overlap(lower_words(prompt), _any_of(vocab.NON_CODE_INTENT))


def skip_prompt(prompt: Column) -> Column:
    """Prompts that get no search: under three bytes, commands and comments, fewer than two terms."""
    t = F.trim(prompt)
    return (F.octet_length(t) < 3) | t.startswith("/") | t.startswith("#") | (F.size(terms(t)) < 2)


def sentences(prompt: Column) -> Column:
    """Trimmed sentences: cut after . ! ? before a blank or the end, and at line breaks."""
    cut = F.regexp_replace(prompt, r"([.!?])(\s|\z)", "$1\n")
    return F.filter(F.transform(F.split(cut, "\n"), F.trim), lambda s: s != "")


def task_focus(prompt: Column) -> Column:
    """The part of a prompt that says the task: quoted passages, else the sentences that don't ask for a format, else all."""
    passages = F.regexp_extract_all(prompt, F.lit('"([^"]*)"|“([^”]*)”'), F.lit(0))
    quoted = F.filter(F.transform(passages, lambda q: F.trim(F.translate(q, '"“”', ""))), lambda q: F.size(F.array_distinct(content_terms(q))) >= 3)

    def asks_format(s: Column) -> Column:
        low = F.lower(s)
        found = low.startswith("files:")
        for m in vocab.OUTPUT_FORMAT_MARKERS:
            found = found | F.contains(low, F.lit(m))
        return found

    kept = F.array_join(F.filter(sentences(prompt), lambda s: ~asks_format(s)), " ")
    return F.when(F.size(quoted) > 0, F.array_join(quoted, "\n")).when(F.size(content_terms(kept)) == 0, prompt).otherwise(kept)


def admissible_refs(names: Column, defined: Column, common: frozenset[str], most: int = 48) -> Column:
    """The first `most` distinct names of three letters or more that are neither common nor defined here."""
    kept = F.filter(names, lambda x: (F.length(x) >= 3) & ~x.isin(*sorted(common)))
    return F.slice(F.array_except(kept, defined), 1, most)


def contains_word(text: Column, word: str) -> Column:
    """Whether an identifier occurs as a whole word."""
    return text.rlike(f"(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)")


def has_name(line: Column, name: str) -> Column:
    """Whether a name occurs in a line at word, underscore or hump boundaries; other literals as they are."""
    if "-" in name or "/" in name:
        return F.contains(line, F.lit(name))
    first, last = name[0], name[-1]
    before = "" if first == "_" else "(^|[^$])" if first.isupper() else "(^|[^A-Za-z0-9$])"
    after = "" if last == "_" else "([^A-Za-z0-9$]|$)" if last.isupper() else "([^a-z0-9$]|$)"
    return F.contains(line, F.lit(name)) & line.rlike(before + name.replace("$", r"\$") + after)


def name_pattern(name: Column) -> Column:
    """The pattern of `has_name` for names in a column; null where a name is looked for as it is."""
    first = F.when(F.startswith(name, F.lit("_")), "").when(name.rlike(r"^\p{Lu}"), "(^|[^$])").otherwise("(^|[^A-Za-z0-9$])")
    last = F.when(F.endswith(name, F.lit("_")), "").when(name.rlike(r"\p{Lu}\z"), "([^A-Za-z0-9$]|$)").otherwise("([^a-z0-9$]|$)")
    plain = F.contains(name, F.lit("-")) | F.contains(name, F.lit("/"))
    return F.when(~plain, F.concat(first, F.regexp_replace(name, r"([^\w])", r"\\$1"), last))


def match_excerpt(line: Column, name: Column, width: int = 100, lead: int = 40) -> Column:
    """At most `width` characters around the first occurrence of a name, with marks where the line was cut."""
    n = F.length(line)
    at = F.greatest(F.instr(line, name) - 1 - lead, F.lit(0))
    start = F.when(n <= width, 0).otherwise(F.least(at, F.greatest(n - width, F.lit(0))))
    body = line.substr(start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + width < n, "…").otherwise(""))


def short_symbol(symbol: Column) -> Column:
    """The last part of a symbol path without its keyword, at most 40 characters."""
    last = F.element_at(F.split(symbol, " > "), -1)
    bare = F.regexp_replace(last, r"^((pub|async|export|default|static|public|private|fn|def|class|struct|enum|trait|impl|function|interface|type) )+", "")
    cut = F.when(F.length(bare) > 40, F.regexp_replace(F.substring(bare, 1, 40), r" [^ ]*\z", "")).otherwise(bare)
    return F.trim(cut)


def estimate_tokens(text: Column) -> Column:
    """Characters over 3.5, rounded up."""
    return F.ceil(F.length(text) / 3.5)


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


def clean_subject(subject: Column) -> Column:
    """A commit subject without its conventional prefix and trailing issue number."""
    bare = F.regexp_replace(F.trim(subject), r"^[a-z]+(\([^)]*\))?!?: *", "")
    return F.trim(F.regexp_replace(bare, r" *\(#[0-9]+\)$", ""))


# What marks a commit as a fix, a body as closing an issue, and lines that end or skip a body's first paragraph.
_FIX = r"(?i)\b(fix(e[sd]|ing)?|bug(s|fix)?|hotfix|crash(es|ed|ing)?|regression|broken|issue)\b"
_CLOSES = r"(?i)\b(fix(e[sd])?|close[sd]?|resolve[sd]?)\s*:?\s+(#\d+|https://github\.com/\S+/issues/\d+)"
_TRAILER = r"(?i)^[A-Za-z-]+-by:|^Co-authored|^Change-Id:|^\(cherry picked|^Signed-off"
_NO_PROSE = r"(?i)^(#|```|[-*>|]|\d+\.\s|https?://|\[x\]|\[ \])"
_TYPED = r"^(\w+)(?:\(([^)]*)\))?!?:\s*"
MAX_TASK_CHARS = 400


def is_fix(subject: Column, body: Column) -> Column:
    """Whether a commit fixes something: its subject says so, or its body closes an issue."""
    return subject.rlike(_FIX) | F.coalesce(body, F.lit("")).rlike(_CLOSES)


def first_paragraph(body: Column) -> Column:
    """The first lines of prose of a commit's body, joined by blanks."""
    start = F.struct(F.array().cast("array<string>").alias("said"), F.lit(False).alias("over"))

    def step(acc: Column, raw: Column) -> Column:
        line = F.trim(raw)
        prose = (line != "") & ~line.rlike(_TRAILER) & ~line.rlike(_NO_PROSE)
        ends = acc["over"] | (~prose & (F.size(acc["said"]) > 0))
        return F.struct(F.when(prose & ~ends, F.concat(acc["said"], F.array(line))).otherwise(acc["said"]).alias("said"), ends.alias("over"))

    return F.aggregate(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), start, step, lambda acc: F.array_join(acc["said"], " "))


def commit_task(subject: Column, body: Column | None = None, most: int = MAX_TASK_CHARS) -> Column:
    """A task in a commit's words: the subject with its scope in front and without type and issue number, then, if there is a body, its first paragraph."""
    bare = F.trim(F.regexp_replace(F.trim(subject), r" *\(#[0-9]+\)$", ""))
    scope = F.regexp_extract(bare, _TYPED, 2)
    named = F.when((scope != "") & ~scope.rlike(r"^[\d.\-\s]+\z"), F.concat(scope, F.lit(": "))).otherwise("")
    said = F.trim(F.concat(named, F.regexp_replace(bare, _TYPED, "")))
    if body is None:
        return F.substring(said, 1, most)
    more = first_paragraph(body)
    bare_said = F.regexp_replace(said, r"\.+$", "")
    whole = F.when(more != "", F.concat(bare_said, F.lit(". "), more)).otherwise(bare_said)
    return F.when(F.length(whole) > most, F.regexp_replace(F.substring(whole, 1, most), r" [^ ]*\z", "")).otherwise(whole)


def names_code(prompt: Column) -> Column:
    """Whether a prompt names code: an identifier or a path."""
    return (F.size(explicit_identifiers(prompt)) > 0) | (F.size(path_mentions(prompt)) > 0)


def normalise_task(text: Column) -> Column:
    """Lower case, single blanks, no characters beyond words, quotes, @ and blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_'`@\s]", ""), r"\s+", " "))


def hash_split(key: Column, modulus: int = 10) -> Column:
    """A stable fold of a key: the first eight hex digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % modulus


def looks_minified(text: Column, longest: int = 5_000, size: int = 20_000, mean: int = 300) -> Column:
    """Whether a text reads like a generated bundle: one very long line, or long lines on the whole."""
    lines = F.split(text, "\n")
    rows = F.greatest(F.size(lines) - F.when(text.endswith("\n"), 1).otherwise(0), F.lit(1))
    top = F.array_max(F.transform(lines, F.octet_length))
    return (top > longest) | ((F.octet_length(text) > size) & (F.floor(F.octet_length(text) / rows) > mean))
