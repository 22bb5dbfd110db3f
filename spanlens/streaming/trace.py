"""Following a log: totals by kind of event over whatever files have arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.streaming.common import table_stream, work_folder


def totals(spark: SparkSession, path: str, kind: str = "event_type", value: str = "value") -> DataFrame:
    """Reads all files that are there now as one stream and gives calls and totals by kind of event."""
    out, state = work_folder(spark, "totals"), work_folder(spark, "totals-state")
    counted = table_stream(spark, path).groupBy(F.col(kind).alias("event")).agg(F.count("*").alias("calls"), F.sum(value).alias("total"))

    def put(batch: DataFrame, _: int) -> None:
        batch.select("event", "calls", F.round("total", 4).alias("total")).write.mode("overwrite").parquet(out)

    counted.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
