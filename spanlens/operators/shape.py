"""From ranked chunks to what is shown: merging, budgets, full and listed spans, rendering.

Rules that depend on what was accepted before are folds over one query's short sorted array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GAP, MAX_LINES, LINE_BUDGET, TOP_N = 3, 50, 400, 10


def merge_spans(spans: DataFrame, query: str, path: str = "path", gap: int = GAP, max_lines: int = MAX_LINES) -> DataFrame:
    """Spans (start, end, score) of one file that touch or nearly do become one while it stays within max_lines.

    The best score stays.  Columns `p` (null: not scored), `symbol` and `text`, where there are any, merge too: the
    best p, the first symbol that is not empty, the texts with lines that both have said once.  Each file's few
    candidates are one sorted array.
    """
    kinds = {"score": "double", "p": "double", "symbol": "string", "text": "string"}
    more = [c for c in kinds if c == "score" or c in spans.columns]
    span = f"struct<s:int,e:int,{','.join(f'{c}:{kinds[c]}' for c in more)}>"
    item = F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), *(F.col(c).cast(kinds[c]).alias(c) for c in more))
    items = F.array_sort(F.collect_list(item))

    def added(last: Column, x: Column) -> Column:
        """The text of x from the first line that the last span doesn't have."""
        new = F.split(x["text"], "\n")
        known = F.greatest(last["e"] - x["s"] + 1, F.lit(0))
        rest = F.slice(new, known + 1, F.greatest(F.size(new) - known, F.lit(0)))
        return F.when(F.size(rest) > 0, F.concat(last["text"], F.lit("\n"), F.array_join(rest, "\n"))).otherwise(last["text"])

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(x)), -1)
        joins = (F.size(acc) > 0) & (x["s"] - last["e"] - 1 <= gap) & (F.greatest(last["e"], x["e"]) - last["s"] + 1 <= max_lines)
        best = {"score": F.greatest(last["score"], x["score"])}
        if "p" in more:
            best["p"] = F.greatest(last["p"], x["p"])  # a null loses
        if "symbol" in more:
            best["symbol"] = F.when(F.coalesce(last["symbol"], F.lit("")) == "", x["symbol"]).otherwise(last["symbol"])
        if "text" in more:
            best["text"] = added(last, x)
        one = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), *(best[c].alias(c) for c in more))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(acc, F.array(x)))

    folded = spans.groupBy(query, path).agg(F.aggregate(items, F.array().cast(f"array<{span}>"), step).alias("_m"))
    return folded.select(query, path, F.inline("_m")).withColumnsRenamed({"s": "start", "e": "end"})


def line_budget(spans: DataFrame, query: str, path: str = "path", budget: int = LINE_BUDGET) -> DataFrame:
    """Spans by score until their lines fill the budget; the one that overflows is cut, the rest goes."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), path, "start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(order), F.lit(0))
    kept = spans.withColumn("_before", before).filter(F.col("_before") < budget)
    return kept.withColumn("end", F.least("end", (F.col("start") + budget - F.col("_before") - 1).cast("int"))).drop("_before")


def top_spans(spans: DataFrame, query: str, path: str = "path", n: int = TOP_N) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), path, "start", "end")
    return spans.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < n)


def shape_spans(spans: DataFrame, query: str, path: str = "path", n: int = TOP_N, budget: int = LINE_BUDGET, gap: int = GAP, max_lines: int = MAX_LINES) -> DataFrame:
    """Merge within files, take the best n, cut at the line budget."""
    return line_budget(top_spans(merge_spans(spans, query, path, gap, max_lines), query, path, n).drop("rank"), query, path, budget)


def distinct_files(ranked: DataFrame, query: str, path: str = "path", k: int = 2) -> DataFrame:
    """The first span of each of the first k files."""
    first = Window.partitionBy(query, path).orderBy("rank")
    files = Window.partitionBy(query).orderBy("rank")
    return ranked.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("nth", F.row_number().over(files) - 1).filter(F.col("nth") < k).drop("_n")


def overlaps(a: DataFrame, b: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Spans of a that overlap one of b in the same file (left_semi), or none (left_anti)."""
    x, y = a.alias("x"), b.alias("y")
    cond = (F.col("x.start") <= F.col("y.end")) & (F.col("y.start") <= F.col("x.end"))
    for c in on:
        cond = (F.col(f"x.{c}") == F.col(f"y.{c}")) & cond
    return x.join(y, cond, how)


def caps(full: int = 2, listed: int = 10, related: int = 8) -> Column:
    """How many spans of a query are shown whole, how many with those that are only listed, and how many neighbours."""
    return F.struct(F.lit(full).alias("full"), F.lit(listed).alias("listed"), F.lit(related).alias("related"))


def follow_up_caps(tests_or_callers: Column) -> Column:
    """Caps of a follow-up: one block, none where it asks for tests or callers, as those are answered in other ways."""
    return F.struct(F.when(tests_or_callers, 0).otherwise(1).alias("full"), F.lit(6).alias("listed"), F.lit(8).alias("related"))


def smaller_caps(a: Column, b: Column) -> Column:
    return F.struct(*(F.least(a[c], b[c]).alias(c) for c in ("full", "listed", "related")))


def size_context(
    ranked: DataFrame, sent: DataFrame, query: str, path: str = "path", limits: DataFrame | None = None, inlinable: Column | None = None, related: DataFrame | None = None
) -> DataFrame:
    """Adds `bucket`: already (sent before), full (the first files), map (listed), related and usage; leaves the rest out.

    limits: (query, caps) where they are not the usual ones.  inlinable: which spans may be shown whole; others are
    listed, and the next file takes their place.  Full and listed spans share one cap.
    related: (query, path, start, end, pos, is_usage): usages stay as they are; neighbours that overlap no span shown
    count once for each range, the first by pos up to their cap.  Related rows have no rank.
    """
    own = ranked.select(query).distinct() if related is None else ranked.select(query).unionByName(related.select(query)).distinct()
    limit = own.withColumn("_caps", caps()) if limits is None else own.join(limits.select(query, F.col("caps").alias("_given")), query, "left").select(query, F.coalesce("_given", caps()).alias("_caps"))
    already = overlaps(ranked, sent, [query, path]).select(query, "rank").withColumn("_sent", F.lit(True))
    marked = ranked.join(already.distinct(), [query, "rank"], "left").withColumn("_sent", F.coalesce("_sent", F.lit(False))).join(limit, query)
    may = marked.filter("not _sent") if inlinable is None else marked.filter("not _sent").filter(inlinable)
    first = Window.partitionBy(query, path).orderBy("rank")
    tops = may.withColumn("_n", F.row_number().over(first)).filter("_n = 1").withColumn("_f", F.row_number().over(Window.partitionBy(query).orderBy("rank")))
    tops = tops.filter(F.col("_f") <= F.col("_caps.full")).select(query, "rank", F.lit(True).alias("_full"))
    rest = marked.join(tops, [query, "rank"], "left")
    placed = rest.withColumn("bucket", F.when(F.col("_sent"), "already").when(F.col("_full"), "full").otherwise("map"))
    nth = F.row_number().over(Window.partitionBy(query, "bucket").orderBy("rank"))
    room = F.col("_caps.listed") - F.count_if(F.col("bucket") == "full").over(Window.partitionBy(query))
    shown = placed.withColumn("_nth", nth).withColumn("_room", room).filter((F.col("bucket") != "map") | (F.col("_nth") <= F.col("_room"))).drop("_nth", "_room", "_sent", "_full", "_caps")
    if related is None:
        return shown
    free = overlaps(related.filter("not is_usage"), shown, [query, path], "left_anti")
    once = free.groupBy(query, path, "start", "end").agg(F.min("pos").alias("pos")).join(limit, query)
    kept = once.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy("pos", path, "start", "end"))).filter(F.col("_r") <= F.col("_caps.related"))
    more = kept.select(query, path, "start", "end", F.lit("related").alias("bucket")).unionByName(related.filter("is_usage").select(query, path, "start", "end", F.lit("usage").alias("bucket")))
    return shown.unionByName(more, allowMissingColumns=True)


def budget_append(blocks: Column, budget: int) -> Column:
    """Which blocks (array of sizes, in order) fit: those that don't are skipped, later ones may."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<boolean>").alias("fits"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["used"] + n <= budget
        return F.struct(F.when(fits, acc["used"] + n).otherwise(acc["used"]).cast("int").alias("used"), F.concat(acc["fits"], F.array(fits)).alias("fits"))

    return F.aggregate(blocks, start, step, lambda acc: acc["fits"])


def ranked_locations(ranked: DataFrame, query: str, path: str = "path") -> DataFrame:
    """(query, path, line, first): "a-b; c-d" of each file's spans in rank order."""
    item = F.struct("rank", F.format_string("%d-%d", "start", "end").alias("t"))
    return ranked.groupBy(query, path).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "; ").alias("line"), F.min("rank").cast("long").alias("first")
    )


def render_span(path: Column, start: Column, end: Column, text: Column, lang: Column) -> Column:
    """A heading and a fenced block."""
    return F.format_string("### %s:%d-%d\n```%s\n%s\n```", path, start, end, lang, text)


def parse_rendered(text: Column) -> Column:
    """array<struct<path, start, end>> of the headings of rendered spans."""
    heads = F.regexp_extract_all(text, F.lit(r"(?m)^### (.+:[0-9]+-[0-9]+)$"), F.lit(1))
    return F.transform(
        heads,
        lambda h: F.struct(
            F.regexp_extract(h, "^(.*):([0-9]+)-([0-9]+)$", 1).alias("path"),
            F.regexp_extract(h, "^(.*):([0-9]+)-([0-9]+)$", 2).cast("int").alias("start"),
            F.regexp_extract(h, "^(.*):([0-9]+)-([0-9]+)$", 3).cast("int").alias("end"),
        ),
    )


def point_in_spans(points: DataFrame, spans: DataFrame, path: str = "path", line: str = "line") -> DataFrame:
    """(path, line, blocks): how many spans (lo, hi) of its file each point lies in; points in none are left out."""
    inside = points.join(spans.select(path, "lo", "hi"), path).filter(F.col(line).between(F.col("lo"), F.col("hi")))
    return inside.groupBy(path, line).agg(F.count("*").alias("blocks"))


def dominant_child(parents: DataFrame, children: DataFrame, parent: str = "id", child: str = "child", least: float = 0.5) -> DataFrame:
    """(parent, child, share): the child that covers the most of its parent's lines (lo, hi), if that is more than `least`."""
    inner = children.select(parent, child, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    met = parents.join(inner, parent).filter("_lo <= hi AND lo <= _hi")
    share = (F.least("hi", "_hi") - F.greatest("lo", "_lo") + 1) / (F.col("hi") - F.col("lo") + 1)
    best = met.select(parent, child, share.alias("share")).filter(F.col("share") > least)
    nth = F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("share"), child))
    return best.withColumn("_n", nth).filter("_n = 1").drop("_n")


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first in order; what comes later is a repeat."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def top_of(rows: DataFrame, group: str, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group with their place from 1."""
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("k") <= k)


def append_blocks(blocks: Column, cap: int = 9_500) -> Column:
    """Whole blocks in order, a line break after each, as far as they fit into `cap` bytes; one that doesn't fit is skipped, later ones may fit."""

    def step(acc: Column, b: Column) -> Column:
        longer = F.concat(acc, b, F.lit("\n"))
        return F.when(F.octet_length(longer) <= cap, longer).otherwise(acc)

    return F.aggregate(blocks, F.lit(""), step)


def indent_ancestors(lines: DataFrame, file: str, line: str = "line", indent: str = "indent", most: int = 400) -> DataFrame:
    """(file, line, indent): the lines above each file's last line that open a block around it, at most `most` lines up.

    Going up, each line that is indented less than all below it is such a line.
    """
    up = Window.partitionBy(file).orderBy(F.desc(line))
    below = F.min(indent).over(up.rowsBetween(Window.unboundedPreceding, -1))
    rows = lines.select(file, line, indent).withColumn("_n", F.row_number().over(up)).withColumn("_below", below)
    return rows.filter((F.col("_n") <= most + 1) & (F.col(indent) < F.col("_below"))).select(file, line, indent)
