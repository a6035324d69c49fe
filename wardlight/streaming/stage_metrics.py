"""Stage table of the call journal by windows of call time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardlight.operators.journal import stage_measures
from wardlight.plans.session import exists, materialise

DAY = "start_day"


def stage_windows(
    calls: DataFrame, window: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """The measures of the batch stage table per window; on a stream, calls
    later than ``delay`` behind the newest one are dropped."""
    timed = calls.withWatermark("created_at", delay) if calls.isStreaming else calls
    span = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return timed.groupBy(span.alias("w"), "agent", "stage").agg(*stage_measures()).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "agent", "stage", "calls", "mean_ms", "max_ms", "ok",
    )


def append_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows once; the last open ones wait for newer calls."""
    return (
        windows.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def replace_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole table, open windows included, up to date under ``path``, one
    folder per day of window starts. Only windows that a batch changes are handed on, and only
    the days they start on are written again; a batch that runs twice writes the same. Windows that
    the watermark has closed leave the state. See :func:`current_windows`."""
    key = ["window_start", "agent", "stage"]

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = materialise(batch.withColumn(DAY, F.to_date("window_start")))
        days = [r[0] for r in changed.select(DAY).distinct().collect()]  # within the watermark's reach
        if not days:
            return
        if exists(spark, path):
            held = spark.read.schema(changed.schema).parquet(path).where(F.col(DAY).isin(days))
            same = reduce(lambda a, b: a & b, [held[c].eqNullSafe(changed[c]) for c in key])
            changed = materialise(changed.unionByName(held.join(changed, same, "left_anti")))
        changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)

    return (
        windows.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_windows(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`replace_windows` keeps."""
    return spark.read.parquet(path).drop(DAY)
