"""What a path says about a file, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlens.functions import vocab


def _parts(path: Column) -> Column:
    return F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))


def _map(values: dict[str, tuple[str, ...]], x: Column) -> Column:
    found = F.lit(None).cast("string")
    for lang, names in values.items():
        found = F.when(x.isin(*names), F.lit(lang)).otherwise(found)
    return found


def language(path: Column) -> Column:
    """The language of a file by its path; null for what is not indexed (generated, locked, secret, unknown)."""
    parts = _parts(path)
    name = F.lower(F.try_element_at(parts, F.lit(-1)))
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    skipped = F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in vocab.SKIP_DIRS)))
    locked = name.isin(*vocab.SKIP_FILES) | name.endswith(".lock")
    secret = (name == ".env") | name.startswith(".env.") | name.endswith(".env")
    bundled = F.contains(name, F.lit(".min.")) | name.endswith(".map") | name.endswith(".bundle.js")
    by_ext = F.when(name.rlike(r"^.+\."), _map(vocab.EXTENSIONS, F.element_at(F.split(name, r"\."), -1)))
    return F.when((F.size(parts) == 0) | skipped | locked | secret | bundled, None).otherwise(F.coalesce(by_ext, _map(vocab.BARE_NAMES, name)))


def is_test(path: Column) -> Column:
    """Whether a path is a test file by the usual conventions."""
    parts = F.split(path, "/")
    base = F.element_at(parts, -1)
    dirs = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    in_dir = F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in vocab.TEST_DIRS)))
    ends = "|".join(e.replace(".", r"\.") for e in vocab.TEST_STEM_ENDS)
    return in_dir | base.rlike(rf"^tests\.[a-z]+\z|^test_.*\.py\z|({ends})\.[a-z]+\z")


def is_test_task(path: Column) -> Column:
    """Whether a path is a test file as tasks are made: a test folder, a name that begins with test_ or ends like one."""
    base = F.element_at(F.split(path, "/"), -1)
    return path.rlike("(^|/)(tests?|__tests__)/") | F.startswith(base, F.lit("test_")) | base.rlike(r"(_test|\.test|\.spec)\.[a-z]+\z")


# Fixed value: what a lookup's path or glob looks like if it is about tests.
TEST_LOOKUP = r"(^|/)(tests?|__tests__|spec)(/|\z)|(^|/)test_[^/]*\z|_test\.\w+\z|\.(test|spec)\.\w+\z|(^|/)tests?\.rs\z"


def is_test_lookup(path: Column) -> Column:
    """Whether a lookup's path or glob is about tests; a folder counts too, and case doesn't matter."""
    return F.lower(path).rlike(TEST_LOOKUP)


def is_prose(path: Column) -> Column:
    """Whether a path is a documentation file."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ext = F.element_at(F.split(name, r"\."), -1)
    return F.when(F.contains(name, F.lit(".")), ext.isin(*vocab.PROSE_EXTENSIONS)).otherwise(name.isin(*vocab.PROSE_NAMES))


def in_scope(path: Column, scope: Column) -> Column:
    """Whether a path is a scope or lies below it."""
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def mentions(path: Column, mention: Column) -> Column:
    """Whether a mention means a file: the whole path, its end, or its base name."""
    return (path == mention) | F.endswith(path, F.concat(F.lit("/"), mention)) | (~F.contains(mention, F.lit("/")) & (F.element_at(F.split(path, "/"), -1) == mention))
