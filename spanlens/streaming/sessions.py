"""Per-session state in a stream: a running count and the last event, kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanlens.streaming.common import table_stream, work_folder


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get[0] if state.exists else 0
    for batch in batches:
        seen += len(batch)
    state.update((seen,))
    yield pd.DataFrame({"user_id": [key[0]], "seen": [seen]})


def session_counts(spark: SparkSession, path: str, session: str = "user_id") -> DataFrame:
    """(session, seen) after all files that are there now."""
    out, state = work_folder(spark, "sessions"), work_folder(spark, "sessions-state")
    counted = table_stream(spark, path).groupBy(session).applyInPandasWithState(_count, "user_id long, seen long", "seen long", "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg({"seen": "max"}).withColumnRenamed("max(seen)", "seen")
