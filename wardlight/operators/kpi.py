"""Operational indicators over incidents, assets and vulnerabilities.

Joins to assets happen after the incidents are counted per asset, so an asset
with a third of all incidents costs one row in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.measures import percent
from wardlight.plans.skew import salted_join

ACTIVE = ("Open", "In progress")


def active() -> Column:
    return F.col("status").isin(*ACTIVE)


def is_false_positive() -> Column:
    return F.col("false_positive") == "Yes"


def _count(name: str) -> Column:
    return F.count("*").alias(name)


def open_incidents(inc: DataFrame) -> DataFrame:
    return inc.where(active()).agg(_count("open_incidents"))


def critical_active(inc: DataFrame) -> DataFrame:
    return inc.where(active() & (F.col("severity") == "Critical")).agg(_count("critical_active"))


def fp_rate(inc: DataFrame) -> DataFrame:
    return inc.agg(percent(is_false_positive(), 1).alias("fp_pct"))


def critical_vulns_open(vul: DataFrame) -> DataFrame:
    return vul.where((F.col("cvss") >= 9.0) & (F.col("status") == "Open")).agg(
        _count("critical_vulns_open")
    )


def mttr(inc: DataFrame) -> DataFrame:
    return inc.where(F.col("status") == "Resolved").agg(
        F.round(F.avg("hours_to_resolve"), 1).alias("mttr_hours")
    )


def by_kind(inc: DataFrame) -> DataFrame:
    return inc.groupBy("kind").agg(_count("total")).orderBy(F.desc("total"), "kind")


def monthly(inc: DataFrame) -> DataFrame:
    return (
        inc.groupBy(F.date_format("opened_on", "yyyy-MM").alias("month"))
        .agg(_count("total"))
        .orderBy("month")
    )


def fp_rate_by(inc: DataFrame, by: str) -> DataFrame:
    return (
        inc.groupBy(by)
        .agg(percent(is_false_positive(), 1).alias("fp_pct"))
        .orderBy(F.desc("fp_pct"), by)
    )


def per_asset(inc: DataFrame) -> DataFrame:
    return inc.groupBy("asset_id").agg(
        _count("n"), F.count_if(is_false_positive()).alias("n_fp")
    )


def top_assets(inc: DataFrame, ast: DataFrame, k: int = 10) -> DataFrame:
    return (
        per_asset(inc)
        .join(ast.select("asset_id", "hostname", "environment"), "asset_id")
        .groupBy("hostname", "environment")
        .agg(
            F.sum("n").alias("incidents"),
            F.round(100.0 * F.sum("n_fp").cast("double") / F.sum("n"), 0).alias("fp_pct"),
        )
        .orderBy(F.desc("incidents"), "hostname", "environment")
        .limit(k)
    )


def critical_open(inc: DataFrame) -> DataFrame:
    return inc.where((F.col("severity") == "Critical") & (F.col("status") == "Open")).agg(
        _count("n")
    )


def fp_rate_of(inc: DataFrame, kind: str) -> DataFrame:
    return fp_rate(inc.where(F.col("kind") == kind))


def exposed_assets(ast: DataFrame) -> DataFrame:
    return ast.where(F.col("internet_exposed") == "Yes").agg(_count("n"))


def since(inc: DataFrame, date: str) -> DataFrame:
    return inc.where(F.col("opened_on") >= F.lit(date).cast("date")).agg(_count("n"))


def critical_open_assets(inc: DataFrame, ast: DataFrame) -> DataFrame:
    """Listing of critical open incidents with their asset; rows of a hot asset
    are spread over many tasks."""
    listed = inc.where((F.col("severity") == "Critical") & (F.col("status") == "Open")).select(
        "asset_id", "incident_id", "kind", "opened_on"
    )
    profile = ast.select("asset_id", "hostname", "environment", "criticality", "internet_exposed")
    return salted_join(listed, profile, ["asset_id"])


def count_by_asset(inc: DataFrame, ast: DataFrame, keep: Column, attr: str) -> DataFrame:
    return (
        inc.where(keep)
        .groupBy("asset_id")
        .agg(_count("n"))
        .join(ast.select("asset_id", attr), "asset_id")
        .groupBy(attr)
        .agg(F.sum("n").alias("incidents"))
        .orderBy(F.desc("incidents"), attr)
    )


def by_host(inc: DataFrame, ast: DataFrame) -> DataFrame:
    return count_by_asset(inc, ast, F.lit(True), "hostname")


def dashboard(inc: DataFrame, vul: DataFrame) -> DataFrame:
    """All headline numbers in one row and one pass per table. The two partial
    rows are stacked and folded, so no join is needed."""
    left = inc.agg(
        F.count_if(active()).alias("open_incidents"),
        F.count_if(active() & (F.col("severity") == "Critical")).alias("critical_active"),
        percent(is_false_positive(), 1).alias("fp_pct"),
        F.round(
            F.avg(F.when(F.col("status") == "Resolved", F.col("hours_to_resolve"))), 1
        ).alias("mttr_hours"),
    )
    right = vul.agg(
        F.count_if((F.col("cvss") >= 9.0) & (F.col("status") == "Open")).alias(
            "critical_vulns_open"
        )
    )
    both = left.unionByName(right, allowMissingColumns=True)
    return (
        both.agg(*[F.max(c).alias(c) for c in both.columns])
        .withColumn("critical_alert", F.col("critical_active") > 0)
        .withColumn("fp_warn", F.coalesce(F.col("fp_pct") > 25, F.lit(False)))
        .withColumn("vulns_warn", F.col("critical_vulns_open") > 5)
    )
