"""Security metrics written down as rules: resolution time, recurrence, SLA,
remediation priority, watch-lists, duplicates, numbering.

Dates have day granularity, so questions about "an earlier row of the same key"
are answered from one row per key and day; the number of days bounds every
window, whatever share of the rows one key holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.functions.measures import percent
from wardlight.plans.ordering import GROUP_ROWS, numbered
from wardlight.plans.session import materialise
from wardlight.plans.skew import salted_join

# fixed values: (lowest CVSS, class, days to fix), highest band first
GUIDE_BANDS = [
    (9.0, "Critical", 7),
    (7.0, "High", 14),
    (4.0, "Medium", 30),
    (0.1, "Low", 90),
]
SHORT_BANDS = [(9.0, "Critical", 7), (7.0, "High", 14), (0.0, "Other", 30)]

CRITICALITY_RANK = {"High": 3, "Medium": 2, "Low": 1}


def mttr_by(inc: DataFrame, by: str) -> DataFrame:
    return inc.groupBy(by).agg(F.round(F.avg("hours_to_resolve"), 1).alias("mttr_hours"))


def recurrence(inc: DataFrame, at_least: int = 2) -> DataFrame:
    return (
        inc.groupBy("asset_id", "kind")
        .agg(
            F.count("*").alias("incidents"),
            F.min("opened_on").alias("first_on"),
            F.max("opened_on").alias("last_on"),
        )
        .where(F.col("incidents") >= at_least)
    )


def _band(bands, field: int) -> Column:
    out = None
    for band in bands:
        hit = F.col("cvss") >= band[0]
        out = F.when(hit, band[field]) if out is None else out.when(hit, band[field])
    return out


def with_sla(vul: DataFrame, bands=GUIDE_BANDS) -> DataFrame:
    """Class and days to fix from a band table; a score under every band gets
    nulls. The few bands become one CASE, so nothing is joined."""
    return vul.withColumn("cvss_class", _band(bands, 1)).withColumn("fix_days", _band(bands, 2))


def is_open() -> Column:
    return F.col("status") == "Open"


def open_by_class(vul: DataFrame, bands=GUIDE_BANDS) -> DataFrame:
    return with_sla(vul.where(is_open()), bands).groupBy("cvss_class").agg(
        F.count("*").alias("open_vulns")
    )


def _age(as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), F.col("detected_on"))


def within_sla(vul: DataFrame, as_of: str) -> DataFrame:
    return vul.where(is_open()).agg(
        F.count("*").alias("open_vulns"),
        percent(_age(as_of) <= F.col("sla_days"), 1).alias("within_sla_pct"),
    )


def mean_age_by_department(vul: DataFrame, ast: DataFrame, as_of: str) -> DataFrame:
    per_asset = (
        vul.where(is_open())
        .groupBy("asset_id")
        .agg(F.sum(_age(as_of).cast("long")).alias("days"), F.count("*").alias("n"))
    )
    return (
        per_asset.join(ast.select("asset_id", "department"), "asset_id")
        .groupBy("department")
        .agg(
            F.sum("n").alias("open_vulns"),
            F.round(F.sum("days").cast("double") / F.sum("n"), 1).alias("mean_age_days"),
        )
    )


def repeat_vulns(vul: DataFrame) -> DataFrame:
    """Rows of a CVE seen again on an asset after an earlier row marked fixed."""
    key = ["asset_id", "cve"]
    first_fixed = (
        vul.where(F.col("status") == "Fixed")
        .groupBy(*key)
        .agg(F.min(F.struct("detected_on", "vuln_id")).alias("_fixed"))
    )
    seen = F.struct("detected_on", "vuln_id")
    return (
        salted_join(vul, first_fixed, key)
        .where(seen > F.col("_fixed"))
        .select(*key, "vuln_id", "detected_on", F.col("_fixed.detected_on").alias("fixed_on"))
    )


def prioritise(vul: DataFrame, ast: DataFrame, as_of: str, k: int = 50) -> DataFrame:
    """The k open vulnerabilities to fix first: exposed assets, then critical
    ones, then the oldest. Within an asset only its k oldest can be listed."""
    w = Window.partitionBy("asset_id").orderBy("detected_on", "vuln_id")
    oldest = (
        vul.where(is_open())
        .withColumn("_pos", F.row_number().over(w))
        .where(F.col("_pos") <= k)
        .drop("_pos")
    )
    rank = F.lit(0)
    for label, value in CRITICALITY_RANK.items():
        rank = F.when(F.col("criticality") == label, value).otherwise(rank)
    return (
        oldest.join(ast.select("asset_id", "criticality", "internet_exposed"), "asset_id")
        .withColumn("age_days", _age(as_of))
        .withColumn("criticality_rank", rank)
        .orderBy(
            F.desc(F.col("internet_exposed") == "Yes"),
            F.desc("criticality_rank"),
            F.desc("age_days"),
            "vuln_id",
        )
        .limit(k)
        .select("vuln_id", "asset_id", "internet_exposed", "criticality", "cvss", "age_days")
    )


def _severe(vul: DataFrame) -> DataFrame:
    return vul.where(F.col("cvss") >= 9)


def emergency_assets(ast: DataFrame, vul: DataFrame) -> DataFrame:
    hit = _severe(vul).where(is_open()).select("asset_id").distinct()
    return (
        ast.where((F.col("criticality") == "High") & (F.col("internet_exposed") == "Yes"))
        .join(hit, "asset_id", "left_semi")
        .select("asset_id", "hostname", "department")
    )


def watch_hits(inc: DataFrame, vul: DataFrame, ast: DataFrame, days: int = 14) -> DataFrame:
    """Incidents opened on an exposed asset at most ``days`` after a CVSS 9+
    detection there, with the latest such detection.

    A detection marks the days it keeps its asset under watch; one row per asset
    and watched day is then matched by equality, never detection by incident.
    """
    exposed = ast.where(F.col("internet_exposed") == "Yes").select("asset_id")
    watched = (
        _severe(vul)
        .select("asset_id", "detected_on")
        .distinct()
        .join(exposed, "asset_id", "left_semi")
        .withColumn(
            "opened_on",
            F.explode(F.sequence("detected_on", F.date_add("detected_on", days))),
        )
        .groupBy("asset_id", "opened_on")
        .agg(F.max("detected_on").alias("detected_on"))
    )
    return (
        salted_join(
            inc.select("asset_id", "opened_on", "incident_id", "kind"),
            watched,
            ["asset_id", "opened_on"],
        )
        .withColumn("days_after", F.datediff("opened_on", "detected_on"))
    )


def duplicates(inc: DataFrame, days: int, keys: tuple[str, ...] = ("asset_id", "kind")) -> DataFrame:
    """Incidents whose previous one with the same keys is at most ``days`` older.

    Order is by day, then id. The first incident of a day looks at the last
    earlier day, all others look at their own day, so only days are windowed.
    """
    by_day = inc.groupBy(*keys, "opened_on").agg(F.min("incident_id").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("opened_on")
    by_day = by_day.withColumn("_before", F.lag("opened_on").over(w))
    previous = F.when(F.col("incident_id") == F.col("_first"), F.col("_before")).otherwise(
        F.col("opened_on")
    )
    return (
        salted_join(inc.select(*keys, "opened_on", "incident_id"), by_day, [*keys, "opened_on"])
        .withColumn("previous_on", previous)
        .where(F.datediff("opened_on", "previous_on") <= days)
        .select(*keys, "incident_id", "opened_on", "previous_on")
    )


def yearly_ids(inc: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``INC-YYYY-NNNN``, counting by opening day and id inside each year."""
    rows = inc.select("incident_id", "opened_on").withColumn("year", F.year("opened_on"))
    return numbered(
        rows, ["year"], ["opened_on", "incident_id"], "position", group_rows=group_rows
    ).select(
        "incident_id",
        "opened_on",
        F.format_string("INC-%04d-%04d", "year", "position").alias("yearly_id"),
    )


def load_by_environment(inc: DataFrame, vul: DataFrame, ast: DataFrame) -> DataFrame:
    """Counts and shares of incidents and vulnerabilities per environment and
    exposure; each table is counted per asset first."""
    place = ["environment", "internet_exposed"]
    profile = ast.select("asset_id", *place)

    def load(df: DataFrame, name: str) -> DataFrame:
        return (
            df.groupBy("asset_id")
            .agg(F.count("*").alias("n"))
            .join(profile, "asset_id")
            .groupBy(*place)
            .agg(F.sum("n").alias(name))
        )

    both = load(inc, "incidents").join(load(vul, "vulns"), place, "full")
    # a handful of environment rows, written once: totals and shares read that copy
    counts = materialise(both.na.fill(0, ["incidents", "vulns"]))
    total = counts.agg(F.sum("incidents").alias("ti"), F.sum("vulns").alias("tv")).first()
    return counts.select(
        *place,
        "incidents",
        "vulns",
        F.round(F.try_divide(100.0 * F.col("incidents"), F.lit(total["ti"] or 0)), 1).alias(
            "incident_pct"
        ),
        F.round(F.try_divide(100.0 * F.col("vulns"), F.lit(total["tv"] or 0)), 1).alias("vuln_pct"),
    )
