"""How queries are registered: a Spark function and, where SQL can say the same, text for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Tables whose rows take long to work on: a table in fewer parts than there are cores is dealt out by its key first.
_HEAVY = {"documents": "doc_id"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in _HEAVY and found.rdd.getNumPartitions() * 2 <= cores:
        return found.repartition(cores, _HEAVY[name])
    return found


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register
