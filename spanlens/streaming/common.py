"""Sources of the streaming wrappers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlens.sources.store import work_folder  # noqa: F401  (the wrappers take it from here)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream: a folder of files, or one file."""
    schema = spark.read.parquet(path).schema
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
