"""What a lookup says: the lines found, as far as they fit, then what was left out, then a summary that knows what was shown.

The parts depend on each other the other way round than they are read: the body takes lines until
its budget is used up; files whose lines were not all shown go to the tail, which has a budget of
its own and counts what doesn't fit; the summary says whether all was shown.  Each part is
a running sum over a query's files in order.  A file takes a character at least, so that only the
first files of a query (as many as the answer may have bytes) are ordered; counts cover all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.functions import paths
from spanlens.functions import text as T

MOST, SUMMARY, TAIL, FILE_LINES = 6_000, 300, 700, 40  # bytes of an answer, of its parts, and lines of a file


def _ordered(found: DataFrame, query: str, most: int) -> DataFrame:
    """(query, path, n, prose, test, listed, place, files, lines, ...): the first files of each query, most hits first, with the query's counts."""
    files = found.groupBy(query, "path").agg(F.count("*").alias("n"))
    files = files.withColumn("prose", paths.is_prose(F.col("path"))).withColumn("test", paths.is_test(F.col("path")))
    totals = files.groupBy(query).agg(
        F.count("*").alias("files"), F.sum("n").alias("lines"), F.count_if("test").alias("tests"), F.sum(F.when(F.col("prose"), 0).otherwise(F.col("n"))).alias("code_lines"), F.count_if("prose").alias("docs")
    )
    place = F.row_number().over(Window.partitionBy(query, "prose").orderBy(F.desc("n"), "path"))
    first = files.withColumn("place", place).filter(F.col("place") <= most).join(totals, query)
    # Documentation is only counted where code matched.
    return first.withColumn("listed", ~F.col("prose") | (F.col("docs") == F.col("files")))


def _opens(line: Column, short: Column) -> Column:
    """Whether a line opens the symbol itself."""
    call = F.regexp_extract(short, r"^([^(]+)\(", 1)
    return F.when(F.contains(short, F.lit("(")), (call != "") & F.startswith(F.ltrim(line), F.concat(call, F.lit("(")))).otherwise((short != "") & F.contains(line, short))


def _units(found: DataFrame, files: DataFrame, query: str, file_lines: int) -> DataFrame:
    """(query, path, place, nth, said): the heading (0) and lines of listed files as they are said."""
    listed = files.filter("listed").select(query, "path", "place", "test")
    rows = found.join(listed, [query, "path"])
    in_file = Window.partitionBy(query, "path").orderBy("line")
    rows = rows.withColumn("short", T.short_symbol(F.coalesce("symbol", F.lit("")))).withColumn("_new", (F.coalesce(F.lag("symbol").over(in_file), F.lit("\0")) != F.coalesce("symbol", F.lit(""))).cast("int"))
    rows = rows.withColumn("_group", F.sum("_new").over(in_file)).withColumn("nth", F.row_number().over(in_file))
    group = Window.partitionBy(query, "path", "_group")
    rows = rows.withColumn("_size", F.count("*").over(group)).withColumn("_k", F.row_number().over(group.orderBy("line"))).withColumn("_first", F.min_by("text", "line").over(group))
    opens, alone, flat = _opens(F.col("_first"), F.col("short")), F.col("_size") == 1, F.col("short") == ""
    name = F.concat(F.lit("‹"), "short", F.lit("›"))
    indent = F.when(flat | alone | (opens & (F.col("_k") == 1)), " ").otherwise("  ")
    tag = F.when(~flat & alone & ~opens, F.concat(F.lit(" "), name)).otherwise("")
    header = F.when(~flat & ~alone & ~opens & (F.col("_k") == 1), F.concat(F.lit(" "), name, F.lit("\n"))).otherwise("")
    line = F.concat(header, indent, F.col("line").cast("string"), F.lit(": "), "text", F.when(F.col("is_definition"), " [def]").otherwise(""), tag, F.lit("\n"))
    lines = rows.filter(F.col("nth") <= file_lines).select(query, "path", "place", "nth", line.alias("said"))
    heads = listed.select(query, "path", "place", F.lit(0).alias("nth"), F.concat("path", F.when(F.col("test"), " (test)").otherwise(""), F.lit("\n")).alias("said"))
    return lines.unionByName(heads)


def _within(items: DataFrame, query: str, label: str, room: Column) -> DataFrame:
    """(query, said): the items (place, item, all: how many there are) after a label within `room` bytes; the rest is counted."""
    order = Window.partitionBy(query).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy("place")) - 1)
    before = F.coalesce(F.sum(F.octet_length("item") + 2).over(order) - 2, F.lit(0)) + len(label)
    more = F.concat(F.lit("and "), (F.col("all") - F.col("_k")).cast("string"), F.lit(" more files."))
    rows = rows.withColumn("_cut", F.when(before + F.octet_length("item") + 6 + F.octet_length(more) > room, F.struct("_k", more.alias("more"))))
    whole = rows.groupBy(query).agg(F.min("_cut").alias("cut"), F.array_sort(F.collect_list(F.struct("_k", "item"))).alias("xs"), F.first("all").alias("all"))
    shown = F.transform(F.filter("xs", lambda x: F.col("cut").isNull() | (x["_k"] < F.col("cut._k"))), lambda x: x["item"])
    end = F.when(F.col("cut").isNull(), ".\n").otherwise(F.concat(F.when(F.col("cut._k") > 0, ", ").otherwise(""), "cut.more", F.lit("\n")))
    return whole.select(query, F.concat(F.lit(label), F.array_join(shown, ", "), end).alias("said"))


def render(found: DataFrame, asked: DataFrame, files_read: int | Column, query: str = "query", most: int = MOST, summary: int = SUMMARY, tail: int = TAIL, file_lines: int = FILE_LINES, code: DataFrame | None = None) -> DataFrame:
    """(query, answer, shown, complete) of each query of `asked` (query, names: its names in order).

    found: (query, path, symbol, line, text, is_definition), the lines with text cut to what is said of them.
    code: (query, block), the text of a definition, which is added where it still fits.
    """
    files = _ordered(found, query, most)
    order = Window.partitionBy(query).orderBy("place", "path", "nth")
    fits = F.sum(F.octet_length("said")).over(order) <= most - summary - tail
    body = _units(found, files, query, file_lines).withColumn("_fits", fits).filter("_fits")
    text = body.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "path", "nth", "said"))), lambda x: x["said"]), "").alias("body"), F.count_if(F.col("nth") > 0).alias("shown"))
    per_file = body.filter("nth > 0").groupBy(query, "path").agg(F.count("*").alias("shown"))
    left = files.join(per_file, [query, "path"], "left").withColumn("shown", F.coalesce("shown", F.lit(0)))
    # Of the files beyond the first ones none is shown.
    all_shown = left.filter("listed").groupBy(query).agg(F.count_if(F.col("shown") == F.col("n")).alias("_whole"))
    hidden = left.filter("listed and shown < n").join(all_shown, query)
    count = F.when(F.col("shown") == 0, F.format_string("%s (%d)", "path", "n")).otherwise(F.format_string("%s (%d of %d shown)", "path", "shown", "n"))
    n_listed = F.when(F.col("docs") == F.col("files"), F.col("files")).otherwise(F.col("files") - F.col("docs"))
    not_shown = _within(hidden.select(query, "place", count.alias("item"), (n_listed - F.col("_whole")).alias("all")), query, "Not shown: ", F.lit(tail)).withColumnRenamed("said", "_hidden")
    docs = files.filter("not listed").join(not_shown, query, "left")
    docs = docs.select(query, "place", F.format_string("%s (%d)", "path", "n").alias("item"), F.col("docs").alias("all"), (tail - F.coalesce(F.octet_length("_hidden"), F.lit(0))).alias("room"))
    counted = _within(docs, query, "Docs: ", F.col("room")).withColumnRenamed("said", "_docs")
    totals = files.groupBy(query).agg(*(F.first(c).alias(c) for c in ("files", "lines", "tests", "code_lines", "docs")))
    rows = asked.join(totals, query, "left").join(text, query, "left").join(not_shown, query, "left").join(counted, query, "left")
    if code is not None:
        rows = rows.join(code.select(query, "block"), query, "left")
    names = F.concat(F.lit("`"), F.array_join("names", "|"), F.lit("`"))
    read = F.lit(files_read) if isinstance(files_read, int) else files_read
    shown, some_docs = F.coalesce("shown", F.lit(0)), (F.col("docs") > 0) & (F.col("docs") < F.col("files"))
    listed_lines = F.when(some_docs, F.col("code_lines")).otherwise(F.col("lines"))
    tests = F.when(F.col("tests") == 0, "").when(F.col("tests") == 1, " (1 test)").otherwise(F.format_string(" (%d tests)", "tests"))
    state = F.when(shown == listed_lines, F.when(some_docs, "; complete, docs counted.\n").otherwise("; complete.\n")).otherwise(F.format_string("; first %d shown, the rest counted below.\n", shown))
    head = F.concat(names, F.format_string(": %d lines in %d files%s of %d files read", "lines", "files", tests, read.cast("long")), state)
    none = F.concat(F.lit("No match for "), names, F.format_string(" in the %d files read.\n", read.cast("long")))
    empty = F.lit("")
    answer = F.when(F.col("files").isNull(), none).otherwise(F.concat(head, F.coalesce("body", empty), F.coalesce("_hidden", empty), F.coalesce("_docs", empty)))
    if code is not None:
        longer = F.concat(answer, F.lit("\n"), "block")
        answer = F.when(F.col("block").isNotNull() & F.col("files").isNotNull() & (F.octet_length(longer) <= most), longer).otherwise(answer)
    return rows.select(query, answer.alias("answer"), shown.cast("long").alias("shown"), F.coalesce(shown == listed_lines, F.lit(True)).alias("complete"))
