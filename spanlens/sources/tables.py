"""The driver's tables as files, tasks, sessions and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.functions import paths
from spanlens.plans.base import read


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: path source/lang/doc_id.md."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "lang", "source", "text")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", "text")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, path): the path part of each URL, without its first slash."""
    path = F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_paths(spark, sf_dir).withColumn("lang", paths.language(F.col("path")))
