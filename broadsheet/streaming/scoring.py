"""Scoring of samples as they arrive: row-local steps only, so no state and no watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def score_stream(rows: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes score(batch) of each micro-batch; score may aggregate inside of a sample, as a batch has whole samples."""

    def put(batch: DataFrame, n: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    w = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (w.trigger(availableNow=True) if once else w).start()
