"""Aggregation of evaluation runs: per-run verdict columns, per-case folding,
overall figures, trend and SQL correctness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.measures import clamp01
from wardlight.functions.text import comparable


def coverage(covered: Column, facts: Column) -> Column:
    """Covered share of the expected facts, 0 when none is expected."""
    return F.when(facts > 0, clamp01(F.coalesce(covered, F.lit(0)) / facts)).otherwise(0.0)


def faithfulness(claims: Column, supported: Column, has_context: Column) -> Column:
    """Supported share of the claims: null without context, 1 without claims."""
    return (
        F.when(~has_context | claims.isNull(), F.lit(None).cast("double"))
        .when(claims <= 0, 1.0)
        .otherwise(clamp01(F.coalesce(supported, F.lit(0)) / claims))
    )


def relevance(text: Column) -> Column:
    """Judge value clamped to [0, 1]; null when it is no number."""
    return clamp01(text.try_cast("double"))


def with_scores(runs: DataFrame) -> DataFrame:
    """Adds the three scores to verdict rows (n_facts, n_covered, claims,
    supported, relevance_text); rows without claims had no context."""
    return (
        runs.withColumn("coverage", F.round(coverage(F.col("n_covered"), F.col("n_facts")), 2))
        .withColumn(
            "faithfulness",
            F.round(faithfulness(F.col("claims"), F.col("supported"), F.col("claims").isNotNull()), 2),
        )
        .withColumn("relevance", F.round(relevance(F.col("relevance_text")), 2))
    )


def per_case(scored: DataFrame) -> DataFrame:
    """Across the runs of a case: mean and worst coverage, mean grade and time,
    any hallucination, means of the nullable scores; routing and citation come
    from the last run."""
    return scored.groupBy("case_id").agg(
        F.count("*").alias("runs"),
        F.avg("coverage").alias("coverage"),
        F.min("coverage").alias("worst"),
        F.avg("grade").alias("grade"),
        F.avg("seconds").alias("seconds"),
        F.bool_or(F.col("hallucinated") == 1).alias("hallucinated"),
        F.avg("faithfulness").alias("faithfulness"),
        F.avg("relevance").alias("relevance"),
        F.avg("sql_correct").alias("sql_correct"),
        F.max_by(F.struct("routed", "cited"), "run").alias("_last"),
    ).select("*", "_last.routed", "_last.cited").drop("_last")


def overall(cases: DataFrame) -> DataFrame:
    """One row of means and shares; the citation share is over the cases that
    expect a document."""
    return cases.agg(
        F.count("*").alias("cases"),
        F.round(F.avg("coverage"), 3).alias("coverage"),
        F.round(F.avg("routed"), 3).alias("routing"),
        F.round(F.avg("cited"), 3).alias("citation"),
        F.round(F.avg(F.col("hallucinated").cast("int")), 3).alias("hallucination"),
        F.round(F.avg("grade"), 2).alias("grade"),
        F.round(F.avg("seconds"), 1).alias("latency"),
        F.round(F.avg("faithfulness"), 3).alias("faithfulness"),
        F.round(F.avg("relevance"), 3).alias("relevance"),
        F.round(F.avg("sql_correct"), 3).alias("sql_correct"),
    )


def history_row(cases: DataFrame, runs: int, ran_at: str) -> DataFrame:
    """The overall figures of an evaluation as one row of the run history."""
    return overall(cases).select(
        F.lit(ran_at).cast("timestamp").alias("ran_at"), F.lit(runs).alias("runs"),
        "cases", "coverage", "routing", "hallucination", "grade", "latency",
        "faithfulness", "relevance", "sql_correct",
    )


def trend(history: DataFrame, n: int = 5, metric: str = "coverage") -> DataFrame:
    """The last ``n`` runs with the change of ``metric`` to the run before. Only
    n + 1 rows reach the window."""
    recent = history.orderBy(F.desc("ran_at")).limit(n + 1).withColumn("_one", F.lit(1))
    w = Window.partitionBy("_one").orderBy("ran_at")
    back = Window.partitionBy("_one").orderBy(F.desc("ran_at"))
    return (
        recent.withColumn("change", F.round(F.col(metric) - F.lag(metric).over(w), 3))
        .withColumn("_back", F.row_number().over(back))
        .where(F.col("_back") <= n)
        .drop("_one", "_back")
    )


def uncovered(runs: DataFrame) -> DataFrame:
    """One row per case and missing fact; ``runs`` has an array ``missing``."""
    return runs.select("case_id", F.explode("missing").alias("fact"))


def sql_correctness(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: do the rows of the generated query equal those of the reference
    query as multisets of comparable cells? ``cases`` has (case_id, ran), ran telling
    whether a generated query ran; ``results`` has (case_id, side, row) with side
    ``generated`` or ``reference`` and row an array of cells. A query that ran and
    returned nothing is wrong unless the reference is empty too; null when none ran."""
    sign = F.when(F.col("side") == "generated", 1).otherwise(-1)
    balance = results.groupBy(
        "case_id", F.transform("row", lambda c: comparable(c)).alias("cells")
    ).agg(F.sum(sign).alias("balance"))
    apart = balance.groupBy("case_id").agg(F.bool_and(F.col("balance") == 0).alias("_same"))
    return cases.join(apart, "case_id", "left").select(
        "case_id",
        F.when(F.col("ran"), F.coalesce("_same", F.lit(True)).cast("double")).alias("sql_correct"),
    )
