"""One hop over the identifier graph: callees, callers, usages and tests of the best chunks.

defs and refs are (ident, chunk_id); seeds are (query, chunk_id, place).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_REFS, MAX_DEFS, AMBIGUOUS, CALLERS, PER_FILE, TOTAL = 6, 4, 3, 4, 2, 8


def callees(seeds: DataFrame, refs: DataFrame, defs: DataFrame, query: str, max_refs: int = MAX_REFS, ambiguous: int = AMBIGUOUS) -> DataFrame:
    """(query, ident, chunk_id): definitions of what the seeds refer to and none of them defines.

    refs: (ident, chunk_id, pos).  Names with more than `ambiguous` definitions are left out.
    """
    own = seeds.join(defs, "chunk_id").select(query, "ident").distinct()
    named = seeds.join(refs, "chunk_id").join(own, [query, "ident"], "left_anti")
    first = Window.partitionBy(query, "chunk_id").orderBy("pos")
    used = named.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_refs).select(query, "ident").distinct()
    # Only names that are asked for are counted.
    clear = defs.join(used.select("ident").distinct(), "ident", "left_semi").withColumn("_d", F.count("*").over(Window.partitionBy("ident"))).filter(F.col("_d") <= ambiguous).drop("_d")
    return used.join(clear, "ident").join(seeds.select(query, "chunk_id"), [query, "chunk_id"], "left_anti").select(query, "ident", "chunk_id")


def callers(seeds: DataFrame, refs: DataFrame, defs: DataFrame, query: str, max_defs: int = MAX_DEFS, limit: int = CALLERS) -> DataFrame:
    """(query, ident, chunk_id): the first chunks by id that refer to what the seeds define."""
    first = Window.partitionBy(query, "chunk_id").orderBy("ident")
    own = seeds.join(defs, "chunk_id").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_defs).select(query, "ident").distinct()
    asked = refs.join(own.select("ident").distinct(), "ident", "left_semi")
    few = asked.select("ident", "chunk_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("ident").orderBy("chunk_id"))).filter(F.col("_n") <= limit).drop("_n")
    return own.join(few, "ident").join(seeds.select(query, "chunk_id"), [query, "chunk_id"], "left_anti").select(query, "ident", "chunk_id")


def accept(items: Column, per_file: int = PER_FILE, total: int = TOTAL) -> Column:
    """Items struct<path, start, end, ...> in order, without those that overlap one accepted before or overfill a file."""

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda y: (y["path"] == x["path"]) & (y["start"] <= x["end"]) & (x["start"] <= y["end"]))
        crowded = F.size(F.filter(acc, lambda y: y["path"] == x["path"])) >= per_file
        return F.when(clash | crowded | (F.size(acc) >= total), acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(items, F.slice(items, 1, 0), step)


# Fixed values of the usage list: names asked for, definitions above which a name says nothing, uses looked up, lines in all and of a name, characters of a line.
USAGE_NAMES, USAGE_USES, USAGE_LINES, USAGE_PER_NAME, USAGE_CHARS = 6, 8, 10, 4, 120
ALL_USES = " (all indexed uses shown)"


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_id"))).filter(F.col("ord") <= k)


def usage_list(asked: DataFrame, defs: DataFrame, refs: DataFrame, chunks: DataFrame, query: str, most: int = USAGE_LINES, per_name: int = USAGE_PER_NAME) -> DataFrame:
    """(query, place, path, line, text, relation): where the names of a query are defined and used, a line for each chunk.

    asked: (query, ident, nth); defs, refs: (ident, chunk_id); chunks: (chunk_id, path, start_line, text).  Of each query
    the first six names count; those with more than three definitions, or with neither definition nor use, say nothing.
    A name's definitions come before its first eight uses, each with its chunk's first line that holds the name as a word.
    A fold over these lines (66 at most) stops a name at `per_name` new lines and the query at `most`; lines that are there
    already are not said again.  A name's definitions claim that all uses are shown only if none was left out.
    """
    nth = F.row_number().over(Window.partitionBy(query).orderBy("nth")) - 1
    names = asked.select(query, "ident", nth.alias("nth")).filter(F.col("nth") < USAGE_NAMES)
    known = names.select("ident").distinct()
    d = _first(defs.join(known, "ident", "left_semi").select("ident", "chunk_id").distinct(), ["ident"], AMBIGUOUS + 1).withColumn("kind", F.lit(0))
    r = _first(refs.join(known, "ident", "left_semi").select("ident", "chunk_id").distinct(), ["ident"], USAGE_USES).withColumn("kind", F.lit(1))
    both = d.unionByName(r)
    counts = both.groupBy("ident").agg(F.count_if(F.col("kind") == 0).alias("n_defs"), F.count_if(F.col("kind") == 1).alias("n_uses")).filter(F.col("n_defs") <= AMBIGUOUS)
    held = both.join(counts, "ident").join(chunks.select("chunk_id", "path", "start_line", "text"), "chunk_id")
    word = F.concat(F.lit("(^|[^A-Za-z0-9_])"), F.regexp_replace("ident", r"([^\w])", r"\\$1"), F.lit("([^A-Za-z0-9_]|$)"))
    body = F.split("text", "\n")
    held = held.withColumn("_word", word).withColumn("_at", F.array_position(F.transform(body, lambda x: F.rlike(x, F.col("_word"))), F.lit(True)).cast("int"))
    line = F.when(F.col("_at") > 0, F.col("start_line") + F.col("_at") - 1).cast("int")
    said = F.when(F.col("_at") > 0, F.substring(F.trim(F.try_element_at(body, F.greatest("_at", F.lit(1)))), 1, USAGE_CHARS))
    rows = names.join(held.select("ident", "kind", "ord", "n_defs", "n_uses", "path", line.alias("line"), said.alias("text")), "ident")
    item = F.struct("nth", "kind", "ord", "path", "line", "text", "ident", "n_defs", "n_uses")
    lists = rows.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    start = F.struct(F.slice("xs", 1, 0).alias("out"), F.array().cast("array<int>").alias("shown"), F.lit(-1).alias("nth"), F.lit(0).alias("listed"))

    def step(acc: Column, x: Column) -> Column:
        listed = F.when(acc["nth"] == x["nth"], acc["listed"]).otherwise(0)
        goes = (listed < per_name) & (F.size(acc["out"]) < most) & x["line"].isNotNull()
        new = goes & ~F.exists(acc["out"], lambda y: (y["path"] == x["path"]) & (y["line"] == x["line"]))
        return F.struct(
            F.when(new, F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
            F.when(goes, F.concat(acc["shown"], F.array(x["nth"]))).otherwise(acc["shown"]).alias("shown"),
            x["nth"].alias("nth"),
            (listed + new.cast("int")).alias("listed"),
        )

    folded = lists.select(query, F.aggregate("xs", start, step).alias("w")).select(query, "w.shown", F.posexplode("w.out").alias("place", "x"))
    n_shown = F.size(F.filter("shown", lambda n: n == F.col("x.nth")))
    whole = (F.col("x.kind") == 0) & (F.col("x.n_uses") < USAGE_USES) & (n_shown == F.col("x.n_defs") + F.col("x.n_uses"))
    relation = F.concat(F.when(F.col("x.kind") == 0, "definition of `").otherwise("use of `"), "x.ident", F.lit("`"), F.when(whole, ALL_USES).otherwise(""))
    return folded.select(query, "place", "x.path", "x.line", "x.text", relation.alias("relation"))
