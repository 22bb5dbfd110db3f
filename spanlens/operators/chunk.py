"""Line tables and chunks of text files, by array functions: no Python runs on the executors.

The text chunker cuts at the latest blank line inside a window and merges what is too small
with a neighbour; a window's end depends on its first line alone, so all ends are computed at
once and a fold follows the chain.  One file is one row throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class ChunkConfig:
    min_lines: int = 10
    max_lines: int = 50
    window_lines: int = 30


def line_array(text: Column) -> Column:
    """Lines split at newlines; a last newline opens no line, an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def lines(files: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, line, body, blank, nonblank_before): lines from 1, with the count of non-blank lines before each."""
    rows = files.select(id, F.posexplode(line_array(F.col(text))).alias("_at", "body"))
    rows = rows.select(id, (F.col("_at") + 1).alias("line"), F.regexp_replace("body", r"\r\z", "").alias("body"), (F.trim("body") == "").alias("blank"))
    before = Window.partitionBy(id).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("nonblank_before", F.coalesce(F.sum((~F.col("blank")).cast("int")).over(before), F.lit(0)))


def windows(text: Column, cfg: ChunkConfig = ChunkConfig()) -> Column:
    """array<struct<s, e>> of the text chunker's spans, lines from 0."""
    win = max(1, min(cfg.window_lines, cfg.max_lines))
    blank = F.transform(line_array(text), lambda x: F.trim(x) == "")

    def spans(b: Column) -> Column:
        n = F.size(b)
        rows = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def last_line(i: Column) -> Column:
            hard = i + win - 1
            cut = F.array_max(F.filter(F.sequence(i + min(cfg.min_lines, win), i + win), lambda k: (k < n) & F.get(b, k)))
            end = F.when(hard >= n - 1, n - 1).otherwise(F.coalesce(cut - 1, hard))
            return F.array_max(F.filter(F.sequence(i, end), lambda k: ~F.get(b, k)))

        def step(acc: Column, i: Column) -> Column:
            take = (i >= acc["next"]) & ~F.get(b, i)
            e = last_line(i)
            return F.when(take, F.struct((e + 1).alias("next"), F.concat(acc["out"], F.array(F.struct(i.alias("s"), e.alias("e")))).alias("out"))).otherwise(acc)

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
        return F.aggregate(rows, start, step, lambda acc: acc["out"])

    def merged(found: Column) -> Column:
        n = F.size(found)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

        def step(acc: Column, k: Column) -> Column:
            span, out = F.get(found, k), acc["out"]
            s = F.when(acc["pend"] >= 0, acc["pend"]).otherwise(span["s"])
            last = F.element_at(F.when(F.size(out) > 0, out).otherwise(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")))), -1)
            back = (F.size(out) > 0) & (span["e"] - last["s"] + 1 <= cfg.max_lines)
            ahead = (k + 1 < n) & (F.get(found, k + 1)["e"] - s + 1 <= cfg.max_lines)
            whole = span["e"] - s + 1 >= cfg.min_lines
            add = F.concat(out, F.array(F.struct(s.alias("s"), span["e"].alias("e"))))
            grown = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), span["e"].alias("e"))))
            out2 = F.when(whole, add).when(back, grown).when(ahead, out).otherwise(add)
            pend = F.when(~whole & ~back & ahead, s).otherwise(F.lit(-1))
            return F.struct(pend.alias("pend"), out2.alias("out"))

        start = F.struct(F.lit(-1).alias("pend"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
        return F.aggregate(places, start, step, lambda acc: acc["out"])

    # Two lambdas bind the intermediate arrays so that each is computed once.
    bound = F.element_at(F.transform(F.array(blank), spans), 1)
    return F.element_at(F.transform(F.array(bound), merged), 1)


def chunk_text(files: DataFrame, id: str, text: str = "text", cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(id, start_line, end_line, chunk): chunks of text files, lines from 1."""
    body = line_array(F.col(text))
    spans = files.select(id, body.alias("_lines"), F.explode(windows(F.col(text), cfg)).alias("_w"))
    return spans.select(
        id,
        (F.col("_w.s") + 1).alias("start_line"),
        (F.col("_w.e") + 1).alias("end_line"),
        F.array_join(F.slice("_lines", F.col("_w.s") + 1, F.col("_w.e") - F.col("_w.s") + 1), "\n").alias("chunk"),
    )


def sliding(files: DataFrame, id: str, text: str = "text", size: int = 40, stride: int = 30) -> DataFrame:
    """(id, start_line, end_line): fixed windows until one reaches the end; blank ones are left out."""
    body = line_array(F.col(text))
    n = F.size("_l")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)), lambda s: (s == 0) | (s - stride + size < n))
    rows = files.select(id, body.alias("_l")).filter(n > 0).select(id, "_l", F.explode(starts).alias("_s"))
    rows = rows.filter(F.exists(F.slice("_l", F.col("_s") + 1, size), lambda x: F.trim(x) != ""))
    return rows.select(id, (F.col("_s") + 1).alias("start_line"), F.least(F.col("_s") + size, n).alias("end_line"))


def headings(line_rows: DataFrame, id: str) -> DataFrame:
    """Adds `heading`: the nearest Markdown heading at or above each line."""
    mark = F.when(F.trim("body").rlike("^#{1,6} "), F.trim(F.regexp_replace(F.trim("body"), "^#{1,6} ", "")))
    return line_rows.withColumn("heading", F.last(mark, ignorenulls=True).over(Window.partitionBy(id).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
