"""Normal form of journal rows and the metric table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: defaults of a call that was not labelled
AGENT, STAGE, REQUEST = "sistema", "llm", "—"
ERROR_CHARS = 300
MISSING = "—"


def _or(name: str, default: str):
    """Missing and empty labels take the default."""
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default)).alias(name)


def normalise_calls(df: DataFrame) -> DataFrame:
    """Raw call records (succeeded boolean) in the journal's form."""
    error = F.nullif(F.substring("error", 1, ERROR_CHARS), F.lit(""))
    return df.select(
        "call_id",
        "created_at",
        _or("request_id", REQUEST),
        _or("agent", AGENT),
        _or("stage", STAGE),
        "model",
        F.round("duration_ms", 1).alias("duration_ms"),
        F.when(F.col("succeeded"), 1).otherwise(0).alias("success"),
        "prompt_tokens",
        "completion_tokens",
        error.alias("error"),
    )


def append_calls(df: DataFrame, path: str) -> None:
    """Append to the journal, one folder per day so readers can prune."""
    normalise_calls(df).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def metrics_matrix(metrics: DataFrame, models: list[str]) -> DataFrame:
    """One row per metric, one column per model, a dash where a model lacks the
    metric. ``metrics`` has a column ``model`` and one column per metric."""
    names = [c for c in metrics.columns if c != "model"]
    long = metrics.select("model", *[F.col(c).cast("string").alias(c) for c in names]).unpivot(
        ["model"], names, "metric", "value"
    )
    wide = long.groupBy("metric").pivot("model", models).agg(F.first("value", ignorenulls=True))
    return wide.na.fill(MISSING, models)
