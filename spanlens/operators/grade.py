"""Judging answers and lookups: named files against gold, what a lookup was after, where gold went stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions import paths

# What a pattern holds if it looks for the structure of tests.
TEST_STRUCTURE = r"describe|\bit\\?\(|\btest\\?\(|def test|test_|#\[test\]|#\\\[test|mod tests|expect\\?\("
CONFIG_EXTENSIONS = (".md", ".json", ".toml", ".yaml", ".yml", ".lock", ".txt")


def named_files(answer: Column) -> Column:
    """The paths on an answer's last `FILES:` line, without backticks and leading dots and slashes."""
    lists = F.regexp_extract_all(answer, F.lit(r"FILES:[ \t]*([^\n]+)"), F.lit(1))
    last = F.coalesce(F.try_element_at(lists, F.lit(-1)), F.lit(""))
    bare = F.transform(F.split(last, ","), lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), "^`+|`+$", ""), r"^[./]+", ""))
    return F.filter(bare, lambda p: p != "")


def means(name: Column, gold: Column) -> Column:
    """Whether a named path means a gold path: the same, its end after a slash, or ending in it."""
    return (name == gold) | F.endswith(gold, F.concat(F.lit("/"), name)) | F.endswith(name, gold)


def gold_matches(named: DataFrame, gold: DataFrame, key: str, name: str = "name", path: str = "gold") -> DataFrame:
    """(key, name, gold): the named paths of a key with the gold paths that they mean."""
    return named.select(key, name).join(gold.select(key, path), key).filter(means(F.col(name), F.col(path))).distinct()


def grade(rows: DataFrame, answer: str, gold: str) -> DataFrame:
    """Adds named, recall, precision and hit_any of an answer against an array of gold paths."""
    marked = rows.withColumn("named", named_files(F.col(answer)))
    hit = F.filter(gold, lambda g: F.exists("named", lambda n: means(n, g)))
    right = F.array_distinct(F.filter("named", lambda n: F.exists(gold, lambda g: means(n, g))))
    return (
        marked.withColumn("recall", F.size(hit) / F.nullif(F.size(gold), F.lit(0)))
        .withColumn("precision", F.when(F.size("named") > 0, F.size(right) / F.size("named")).otherwise(0.0))
        .withColumn("hit_any", F.size(hit) > 0)
    )


def lookup_intent(pattern: Column, targets: Column, files: Column, whole: Column, idents: Column, defining: Column, named: Column) -> Column:
    """What a lookup was after, the first of seven classes that fits.

    targets: path and glob it was given; files: paths it found; whole: it was not confined to one file;
    idents: names in the pattern; defining, named: the pattern has the shape of a definition, of a name.
    """
    other = lambda p: F.exists(F.array(*map(F.lit, CONFIG_EXTENSIONS)), lambda e: F.endswith(F.lower(F.regexp_replace(p, r"^[{}*!]+|[{}*!]+$", "")), e))
    aims = F.filter(F.coalesce(targets, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    found = F.coalesce(files, F.array().cast("array<string>"))
    tests = F.exists(aims, lambda t: ~F.startswith(t, F.lit("!")) & paths.is_test_lookup(t)) | pattern.rlike(TEST_STRUCTURE)
    return (
        F.when(F.exists(aims, other) | ((F.size(found) > 0) & F.forall(found, other)), "non-code")
        .when(tests, "tests")
        .when(defining & named, "definition")
        .when(~whole & (F.size(idents) > 0), "in-file")
        .when(named, "callers-uses")
        .when(whole, "exact-text")
        .otherwise("other")
    )


def rank_label(scored: Column, offered: Column) -> Column:
    """How a ranking came about: by the model, by the model in part, or by words alone."""
    return F.when((offered > 0) & (scored >= offered), "model").when(scored > 0, "model-partial").otherwise("lexical")


def stale_gold(added: DataFrame, current: DataFrame, path: str = "path", line: str = "line", text: str = "text", least: int = 12, kept: float = 0.5) -> DataFrame:
    """(path, lines, share, state): how many of a change's meaningful added lines a file still holds.

    Lines of `least` characters or more, blanks at the ends taken off, count once each.  State: gone (no such file),
    removal-only (nothing meaningful was added), present (at least `kept` of them), drifted.
    """
    said = added.select(path, F.trim(line).alias("_l")).filter(F.length("_l") >= least).distinct()
    counted = added.select(path).distinct().join(said.groupBy(path).agg(F.count("*").alias("lines")), path, "left")
    there = current.select(path, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), lambda x: F.trim(x)))).alias("_l"))
    still = said.join(there, [path, "_l"], "left_semi").groupBy(path).agg(F.count("*").alias("_still"))
    share = F.coalesce("_still", F.lit(0)) / F.col("lines")
    state = F.when(F.col("_live").isNull(), "gone").when(F.col("lines").isNull(), "removal-only").when(share >= kept, "present").otherwise("drifted")
    return (
        counted.join(still, path, "left")
        .join(current.select(path).distinct().withColumn("_live", F.lit(True)), path, "left")
        .select(path, F.coalesce("lines", F.lit(0)).alias("lines"), share.alias("share"), state.alias("state"))
    )


def test_pointers(refs: DataFrame, path: str, group: str, most: int = 2, order: str = "rank") -> DataFrame:
    """The first `most` references of each group that lie in test files."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return refs.filter(paths.is_test(F.col(path))).withColumn("k", nth).filter(F.col("k") <= most)


def lookup_complete(files: DataFrame, group: str, holds: Column, listed: Column) -> DataFrame:
    """(group, files, hits, complete): whether all files that hold a name were within the listing's bounds."""
    return files.groupBy(group).agg(F.count("*").alias("files"), F.count_if(holds).alias("hits"), (F.count_if(holds & listed) == F.count_if(holds)).alias("complete"))


def replay_sort(hits: DataFrame, by: str = "hits", tie: str = "path", group: list[str] | None = None) -> DataFrame:
    """Adds `place`: most hits first, then by name."""
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(*(group or [])).orderBy(F.desc(by), tie)) - 1)
