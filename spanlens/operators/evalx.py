"""Ranking metrics, calibration and paired statistics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(ranked: DataFrame, gold: DataFrame, query: str, id: str, k: int = 10, whole: bool = False) -> DataFrame:
    """One row: P@k, Hit@k, MRR and R@k over the queries that have gold; MRR of the first k, or of the whole list."""
    hits = gold.join((ranked if whole else ranked.filter(F.col("rank") < k)).select(query, id, "rank"), [query, id], "left")
    per = hits.groupBy(query).agg(F.count_if(F.col("rank") < k).alias("found"), F.count("*").alias("golds"), F.min("rank").alias("first"))
    return per.agg(
        F.count("*").alias("items"),
        F.round(F.avg(F.col("found") / k), 6).alias(f"p_at_{k}"),
        F.round(F.avg((F.col("found") > 0).cast("double")), 6).alias(f"hit_at_{k}"),
        F.round(F.avg(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.col("found") / F.col("golds")), 6).alias(f"r_at_{k}"),
    )


def findable(gold: DataFrame, files: DataFrame, id: str, within: Column) -> DataFrame:
    """The gold that can be found at all: files that are indexed and pass `within`."""
    return gold.join(files.filter(within).select(id).distinct(), id, "left_semi")


def file_order(ranked: DataFrame, query: str, path: str, rank: str = "rank") -> DataFrame:
    """(query, path, first, place): files by their first entry in a list, from 0."""
    seen = ranked.groupBy(query, path).agg(F.min(rank).alias("first"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy("first", path)) - 1)


def list_metrics(ranked: DataFrame, query: str, path: str, gold: Column, label: Column, rank: str = "rank", files: tuple[int, ...] = (1, 2, 3, 5), tops: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A row for each list: file_r_at_k, top_k_gold and mrr_pos.

    gold: whether an entry's file is a gold one (the same for all its entries); label: whether the entry itself is positive.
    Ranks count from 0.  Lists without gold files get 0.
    """
    rows = ranked.select(F.col(query), F.col(path).alias("_path"), F.col(rank).alias("_r"), gold.alias("_gold"), label.alias("_label"))
    per_file = rows.groupBy(query, "_path").agg(F.min("_r").alias("_first"), F.max("_gold").alias("_gold"))
    placed = per_file.withColumn("_place", F.row_number().over(Window.partitionBy(query).orderBy("_first", "_path")) - 1)
    share = lambda cond: F.coalesce(F.count_if(F.col("_gold") & cond) / F.nullif(F.count_if("_gold"), F.lit(0)), F.lit(0.0))
    cells = [share(F.col("_place") < k).alias(f"file_r_at_{k}") for k in files] + [share(F.col("_first") < k).alias(f"top_{k}_gold") for k in tops]
    first = rows.groupBy(query).agg(F.coalesce(1 / (F.min(F.when(F.col("_label"), F.col("_r"))) + 1), F.lit(0.0)).alias("mrr_pos"))
    return placed.groupBy(query).agg(*cells, F.count_if("_gold").alias("golds")).join(first, query)
