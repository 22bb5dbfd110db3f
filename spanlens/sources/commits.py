"""Commit logs as tasks: blocks of a log to commits with their files, and the rules that make tasks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlens.functions import paths
from spanlens.functions import text as T

LEAST_CHARS, MOST_GOLD = 25, 4
# Beginnings and words of subjects that describe no task.
SKIPPED_TYPES = ("chore", "docs", "style", "ci", "build", "release", "revert", "merge", "bump")
SKIPPED_WORDS = r"(?i)\b(typo|changelog|readme|version bump|dependabot)\b"


def parse_log(logs: DataFrame, log: str = "log", mark: str = "@@") -> DataFrame:
    """(sha, subject, files) of each block of a log: a mark, the hash, a tab, the subject, then a path a line."""
    blocks = logs.select(F.explode(F.filter(F.split(log, mark), lambda b: F.trim(b) != "")).alias("_b"))
    lines = F.filter(F.split("_b", r"\r?\n"), lambda x: F.trim(x) != "")
    cut = blocks.select(lines.alias("_l")).filter(F.size("_l") > 0).withColumn("_h", F.split(F.get("_l", F.lit(0)), "\\t", 2))
    return cut.select(F.get("_h", F.lit(0)).alias("sha"), F.coalesce(F.get("_h", F.lit(1)), F.lit("")).alias("subject"), F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))).alias("files"))


def informative(subject: Column) -> Column:
    """Whether a subject can stand for a task: long enough, not a kind of upkeep."""
    kind = F.lower(F.regexp_extract(subject, r"^([A-Za-z]+)(\([^)]*\))?!?[: ]", 1))
    return (F.length(T.clean_subject(subject)) >= LEAST_CHARS) & ~kind.isin(*SKIPPED_TYPES) & ~subject.rlike(SKIPPED_WORDS)


def tasks(commits: DataFrame, tracked: DataFrame | None = None, skip: list[str] = [], code_only: bool = True) -> DataFrame:  # noqa: B006
    """(id, task, gold): commits with 1 to 4 source files that say what they are about.

    tracked: (path) of files that still exist; others are no gold.  skip: hashes left out.  code_only: tests and
    documentation are no gold either.  A subject that comes twice counts once, its first hash.
    """
    rows = commits.filter(informative(F.col("subject")))
    if skip:
        rows = rows.filter(~F.col("sha").isin(skip))
    files = rows.select("sha", "subject", F.explode(F.array_distinct("files")).alias("path")).filter(paths.language(F.col("path")).isNotNull())
    if code_only:
        files = files.filter(~paths.is_test_task(F.col("path")) & ~paths.is_prose(F.col("path")))
    if tracked is not None:
        files = files.join(tracked.select("path").distinct(), "path", "left_semi")
    gold = files.groupBy("sha", "subject").agg(F.array_sort(F.collect_list("path")).alias("gold")).filter(F.size("gold") <= MOST_GOLD)
    first = gold.groupBy(T.clean_subject(F.col("subject")).alias("task")).agg(F.min(F.struct("sha", "gold")).alias("m"))
    return first.select(F.substring("m.sha", 1, 10).alias("id"), "task", "m.gold")


def changed_lines(diffs: DataFrame, diff: str) -> DataFrame:
    """(path, line): the lines of the old file that each hunk of a diff replaces; a pure insertion touches the rows on both of its sides."""
    hunks = F.regexp_extract_all(diff, F.lit(r"(?m)^@@ -([0-9]+(?:,[0-9]+)?) "), F.lit(1))
    at, n = F.split("h", ",")[0].cast("long"), F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("long"), F.lit(1))
    rows = diffs.select(F.regexp_extract(diff, r"(?m)^\+\+\+ b/(.*)$", 1).alias("path"), F.explode(hunks).alias("h"))
    return rows.select("path", F.explode(F.when(n == 0, F.array(at, at + 1)).otherwise(F.sequence(at, at + n - 1))).alias("line")).distinct()
