"""Analytics over the journal of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.plans.ordering import GROUP_ROWS, numbered


def stage_measures() -> list[Column]:
    """Shared by the batch table and its streaming version."""
    return [
        F.count("*").alias("calls"),
        F.round(F.avg("duration_ms"), 0).alias("mean_ms"),
        F.round(F.max("duration_ms"), 0).alias("max_ms"),
        F.sum("success").alias("ok"),
    ]


def call_summary(calls: DataFrame) -> DataFrame:
    """Volume, latency, success and tokens; zeros on an empty journal, null
    tokens when no call reports any."""
    return calls.agg(
        F.count("*").alias("calls"),
        F.count_distinct("request_id").alias("requests"),
        F.round(F.coalesce(F.avg("duration_ms"), F.lit(0.0)), 0).alias("mean_ms"),
        F.round(F.coalesce(F.max("duration_ms"), F.lit(0.0)), 0).alias("max_ms"),
        F.coalesce(F.sum("success"), F.lit(0)).alias("ok"),
        F.count_if(F.col("success") == 0).alias("failures"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def by_stage(calls: DataFrame) -> DataFrame:
    return (
        calls.groupBy("agent", "stage")
        .agg(*stage_measures())
        .orderBy(F.desc("calls"), "stage", "agent")
    )


def latest(calls: DataFrame, n: int = 25) -> DataFrame:
    return calls.orderBy(F.desc("call_id")).limit(n)


def request_timeline(
    calls: DataFrame, request_id=None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Calls of one request, or of all, in order with the time spent so far."""
    chosen = calls if request_id is None else calls.where(F.col("request_id") == request_id)
    return numbered(
        chosen.select("request_id", "call_id", "agent", "stage", "duration_ms", "success"),
        ["request_id"],
        ["call_id"],
        "step",
        {"elapsed_ms": "duration_ms"},
        group_rows,
    ).withColumn("elapsed_ms", F.round("elapsed_ms", 2))


def call_rates(calls: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Success rate and token totals; totals are null when no call in the group
    reports prompt tokens."""
    spent = F.sum("prompt_tokens")
    return calls.groupBy(*by).agg(
        F.round(F.try_divide(100.0 * F.sum("success"), F.count("*")), 1).alias("ok_pct"),
        spent.alias("tokens_in"),
        F.sum("completion_tokens").alias("tokens_out"),
        F.when(
            spent.isNotNull(), spent + F.coalesce(F.sum("completion_tokens"), F.lit(0))
        ).alias("tokens_total"),
    )


def failures(calls: DataFrame) -> DataFrame:
    """Failed calls by the first 60 characters of their error. Stages are
    pipeline steps, made distinct before they are listed."""
    failed = calls.where(F.col("success") == 0).withColumn(
        "error_start", F.substring(F.coalesce("error", F.lit("")), 1, 60)
    )
    per_stage = failed.groupBy("error_start", "stage").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last_at")
    )
    return per_stage.groupBy("error_start").agg(
        F.sum("n").alias("failures"),
        F.array_join(F.array_sort(F.collect_list("stage")), ", ").alias("stages"),
        F.max("last_at").alias("last_at"),
    )
