"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate on a host if the share of the host's pages that contain it is above
`ratio` and at least `min_pages` pages do.  Pages are counted once per line; blank lines are
layout and always stay.  Lines are told apart by two 64-bit hashes of their trimmed text.

Scale: lines leave the scan as (host, hashes) and are counted with partial sums before any
shuffle.  The shares of a host's lines add up to its mean number of lines a page, so a host
has at most (lines a page) / ratio boilerplate lines: a short array, joined to the pages by
host.  Hosts with more than a thousandth of all pages are at most a thousand: their arrays are
broadcast, and their pages are never shuffled.  Only the pages of other hosts are, and no task
gets a large host.

Defined results: null text counts as a page without lines and stays null; a null host is a
host of its own; repeated rows count as pages of their own; a page of boilerplate only becomes
the empty text; an empty table gives an empty result.  Other columns pass through, whatever
their names; a name asked for the counts that is taken is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm.common import free_names, table

RATIO = 0.05
MIN_PAGES = 5


def _mark(line: Column) -> Column:
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


LARGE = 1_000  # a host is large if it has more than one in so many pages


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("-"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host_key, pages, drop: marks of the lines to drop) for hosts that have any."""
    pages = docs.groupBy(_host(host).alias("host_key")).agg(F.count("*").alias("pages"))
    marks = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), _mark))
    lines = docs.select(_host(host).alias("host_key"), F.explode(marks).alias("mark"))
    often = lines.groupBy("host_key", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    return (
        often.join(pages, "host_key")
        .filter(F.col("n") > F.col("pages") * ratio)
        .groupBy("host_key")
        .agg(F.first("pages").alias("pages"), F.collect_list("mark").alias("drop"))
    )


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, lines_out: str = "n_lines", dropped_out: str = "n_dropped"
) -> DataFrame:
    """The rows with boilerplate lines gone from `text`, plus how many lines they had and lost."""
    for name in (lines_out, dropped_out):
        if name in docs.columns:
            raise ValueError(f"documents have a column {name} already")
    key, drop, kept = free_names([*docs.columns, lines_out, dropped_out], "_key", "_drop", "_kept")
    found = boilerplate(docs, host, text, ratio, min_pages).select(F.col("host_key").alias(key), "pages", F.col("drop").alias(drop))
    large = F.col("pages") * LARGE > docs.count()
    hosts = docs.groupBy(_host(host).alias(key)).agg(F.count("*").alias("pages")).filter(large).select(key)
    few = hosts.join(found.select(key, drop), key, "left")
    keyed = docs.withColumn(key, _host(host))
    # Fewer than LARGE rows are broadcast; only pages of the other hosts are shuffled.
    in_large = keyed.join(F.broadcast(few), key)
    in_small = keyed.join(F.broadcast(hosts), key, "left_anti").join(found.filter(~large).select(key, drop), key, "left")
    joined = in_large.unionByName(in_small)
    lines = _lines(F.col(text))
    stay = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(drop), _mark(x)), F.lit(False)) | (F.trim(x) == ""))
    new = joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(stay))
    null, before = F.col(text).isNull(), F.size(lines)
    return new.select(
        *(F.col(c) if c != text else F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) for c in docs.columns),
        F.when(null, 0).otherwise(before).alias(lines_out),
        F.when(null, 0).otherwise(before - F.size(kept)).alias(dropped_out),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text rid of the lines that are boilerplate on its source."""
    docs = drop_boilerplate(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "source", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), "text")


OP8_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents
), often AS (
  SELECT source, trim(line, ' ') AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1, 2
), pages AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY 1
), bad AS (
  SELECT source, list(line) AS bad FROM often JOIN pages USING (source) WHERE n >= {MIN_PAGES} AND n > pages * {RATIO}::DOUBLE GROUP BY 1
), cut AS (
  SELECT doc_id, d.source, string_split(text, chr(10)) AS all_lines,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), trim(x, ' '))) AS kept
  FROM documents d LEFT JOIN bad ON d.source IS NOT DISTINCT FROM bad.source
)
SELECT doc_id, source, len(all_lines)::BIGINT AS n_lines, (len(all_lines) - len(kept))::BIGINT AS n_dropped,
       array_to_string(kept, chr(10)) AS text
FROM cut
"""
