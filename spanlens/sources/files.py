"""Files of a folder tree: which are read, and why one is not."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanlens.functions import paths, patterns

MAX_BYTES = 1 << 20


def guard(content: Column, max_bytes: int = MAX_BYTES, marker: str = "\0", longest: int = 5_000, size: int = 20_000, mean: int = 300) -> Column:
    """Why a file's content is not chunked (null: it is). Checks go from cheap to dear; each failure is data."""
    from spanlens.functions.text import looks_minified

    head = F.decode(F.substring(content, 1, 8_192), "ISO-8859-1")
    text = F.try_validate_utf8(F.decode(content, "UTF-8"))
    return (
        F.when(F.octet_length(content) > max_bytes, "too large")
        .when(F.contains(head, F.lit(marker)), "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "not utf-8")
        .when(looks_minified(text, longest, size, mean), "minified")
    )


IGNORE_FILES = (".gitignore", ".ignore")


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether ignore rules leave a path out: (folder of the ignore file, line), in the order in which they apply.

    The last rule that fits decides; `!` takes a path back in, unless a folder above it is left out.  A rule with a
    slash before its end is tied to its folder, others fit at any depth below it; a rule that ends in a slash fits folders.
    """
    out = F.lit(False)
    for folder, line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        back = rule.startswith("!")
        rule = rule[back:].removeprefix("\\")
        only_folder = rule.endswith("/")
        bare = rule.strip("/")
        tied = "/" in rule.rstrip("/")
        inner = patterns.glob_body(bare if tied else "**/" + bare)
        base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
        fits = path.rlike(f"^{base}{inner}{'/.*' if only_folder else '(/.*)?'}$")
        below_folder = path.rlike(f"^{base}{inner}/.*$")
        out = F.when(fits & ~below_folder, F.lit(False)).otherwise(out) if back else F.when(fits, F.lit(True)).otherwise(out)
    return out


# Rules of later files win, whatever their folders; within a file name, rules of inner folders, then later lines.
RULE_FILES = {".git/info/exclude": 0, ".gitignore": 1, ".ignore": 2}


def rules_of(files: DataFrame) -> DataFrame:
    """(folder, rank, n, line): the rules of a table of files (path, text) that holds ignore files."""
    name = F.when(F.col("path") == ".git/info/exclude", F.col("path")).otherwise(F.element_at(F.split("path", "/"), -1))
    ranks = F.create_map(*(F.lit(x) for pair in RULE_FILES.items() for x in pair))
    rows = files.withColumn("_name", name).filter(F.col("_name").isin(*RULE_FILES))
    folder = F.when(F.col("_name") == ".git/info/exclude", "").otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
    return rows.select(folder.alias("folder"), F.try_element_at(ranks, F.col("_name")).alias("rank"), F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))


@F.pandas_udf(StringType())
def _rule_pattern(rules: pd.Series) -> pd.Series:
    """The pattern of a path, from the rule's folder on, that a rule names."""
    return rules.map(lambda rule: patterns.glob_body(rule.strip("/") if "/" in rule.rstrip("/") else "**/" + rule.strip("/")))


def prefixes(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, prefix, is_folder): each path and all folders it lies in."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("prefix"), (n < F.size(parts)).alias("is_folder")))
    return files.select(path, F.inline(every))


def ignored_paths(files: DataFrame, rules: DataFrame, path: str = "path", broadcast_rules: int = 100_000) -> DataFrame:
    """(path): the files that rules (folder, rank, n, line) leave out.

    Each folder and file is judged once, by the last rule that fits it of all folders it lies in: a join of
    paths with the rules of their ancestors.  What lies in a folder that is left out stays out, whatever other rules say.
    """
    line = F.regexp_replace("line", r"\s+$", "")
    read = rules.withColumn("_line", line).filter((F.col("_line") != "") & ~F.startswith("_line", F.lit("#"))).withColumn("_back", F.startswith("_line", F.lit("!")))
    bare = F.regexp_replace(F.when(F.col("_back"), F.substring("_line", 2, 1_000_000)).otherwise(F.col("_line")), r"^\\", "")
    parsed = read.withColumn("_rule", bare).select(
        F.col("folder").alias("_folder"), "_back", F.endswith("_rule", F.lit("/")).alias("_only"), F.concat(F.lit("^"), _rule_pattern("_rule"), F.lit("$")).alias("_pattern"),
        F.struct("rank", F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/"))).alias("depth"), "n").alias("_order"),
    )
    few = parsed.limit(broadcast_rules + 1).count() <= broadcast_rules
    asked = prefixes(files, path)
    things = asked.select("prefix", "is_folder").distinct()
    parts = F.split("prefix", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("_folder"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("_rest")))
    met = things.select("prefix", "is_folder", F.inline(folders)).join(F.broadcast(parsed) if few else parsed, "_folder")
    fits = met.filter((F.col("is_folder") | ~F.col("_only")) & F.rlike("_rest", F.col("_pattern")))
    judged = fits.groupBy("prefix", "is_folder").agg(F.max_by("_back", "_order").alias("_back")).filter("not _back").select("prefix", "is_folder")
    return asked.join(judged, ["prefix", "is_folder"], "left_semi").select(path).distinct()


def ignore_rules(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """The lines of all ignore files in folders that hold files below a root, from the outermost in.

    File sources hide names that begin with a dot, so the folders are listed by Spark and asked one by one.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/").split("://")[-1] + "/"
    inner = F.regexp_replace(F.substring_index("path", base, -1), "^/+|[^/]*$", "")
    folders = {""}
    for r in raw.select(inner.alias("f")).distinct().collect():
        parts = r.f.strip("/").split("/")
        folders.update("/".join(parts[:n]) for n in range(1, len(parts) + 1) if parts[0])
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for folder in sorted(folders, key=lambda f: (f.count("/") + bool(f), f)):
        for name in IGNORE_FILES:
            place = jvm.org.apache.hadoop.fs.Path("/".join(x for x in (root.rstrip("/"), folder, name) if x))
            store = place.getFileSystem(conf)
            if store.exists(place):
                stream = store.open(place)
                found += [(folder, line) for line in jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()]
                stream.close()
    return found


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, lang, hash, text, error) of the files below a folder that any Spark store holds.

    Hidden files and folders, unknown and generated paths, and what ignore files (or `rules`) name are left out;
    content guards give errors.
    """
    found = ignore_rules(spark, root) if rules is None else rules
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    # The store may add a scheme in front; the path below the root is what counts.
    below = F.regexp_replace(F.substring_index("path", base.split("://")[-1] + "/", -1), "^/+", "")
    named = raw.select(below.alias("path"), "length", "content").filter(~F.col("path").rlike(r"(^|/)\.[^/]"))
    if found:
        table = spark.createDataFrame([(folder.strip("/"), 1, n, line) for n, (folder, line) in enumerate(found)], "folder string, rank int, n int, line string")
        named = named.join(ignored_paths(named.select("path"), table), "path", "left_anti")
    typed = named.withColumn("lang", paths.language(F.col("path"))).filter(F.col("lang").isNotNull() & (F.col("length") <= max_bytes))
    error = guard(F.col("content"), max_bytes)
    return typed.select(
        "path", "lang", F.substring(F.sha2("content", 256), 1, 32).alias("hash"), F.when(error.isNull(), F.decode("content", "UTF-8")).alias("text"), error.alias("error")
    )
