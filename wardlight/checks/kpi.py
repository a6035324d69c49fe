"""KPI-1..17."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import kpi

FP = "round(100.0 * CAST(sum(CASE WHEN false_positive = 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1)"
CRIT_VULN = "cvss >= 9.0 AND status = 'Open'"
ACTIVE = "status IN ('Open', 'In progress')"


@check("kpi_01_open_incidents", over("incident", f"SELECT count(*) AS open_incidents FROM incident WHERE {ACTIVE}"))
def _(t):
    return kpi.open_incidents(t.incident)


@check("kpi_02_critical_active", over(
    "incident", f"SELECT count(*) AS critical_active FROM incident WHERE severity = 'Critical' AND {ACTIVE}"))
def _(t):
    return kpi.critical_active(t.incident)


@check("kpi_03_fp_rate", over("incident", f"SELECT {FP} AS fp_pct FROM incident"))
def _(t):
    return kpi.fp_rate(t.incident)


@check("kpi_04_critical_vulns_open", over(
    "vulnerability", f"SELECT count(*) AS critical_vulns_open FROM vulnerability WHERE {CRIT_VULN}"))
def _(t):
    return kpi.critical_vulns_open(t.vulnerability)


@check("kpi_05_mttr", over(
    "incident", "SELECT round(avg(hours_to_resolve), 1) AS mttr_hours FROM incident WHERE status = 'Resolved'"))
def _(t):
    return kpi.mttr(t.incident)


@check("kpi_06_by_kind", over(
    "incident", "SELECT kind, count(*) AS total FROM incident GROUP BY kind ORDER BY total DESC, kind"))
def _(t):
    return kpi.by_kind(t.incident)


@check("kpi_07_monthly", over(
    "incident",
    "SELECT strftime(opened_on, '%Y-%m') AS month, count(*) AS total FROM incident GROUP BY 1 ORDER BY 1"))
def _(t):
    return kpi.monthly(t.incident)


@check("kpi_08_fp_rate_by_kind", over(
    "incident", f"SELECT kind, {FP} AS fp_pct FROM incident GROUP BY kind ORDER BY fp_pct DESC, kind"))
def _(t):
    return kpi.fp_rate_by(t.incident, "kind")


@check("kpi_09_top_assets", over("asset incident", """
SELECT a.hostname, a.environment, count(*) AS incidents,
 round(100.0 * CAST(sum(CASE WHEN i.false_positive = 'Yes' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 0) AS fp_pct
FROM incident i JOIN asset a USING (asset_id) GROUP BY 1, 2 ORDER BY incidents DESC, 1, 2 LIMIT 10"""))
def _(t):
    return kpi.top_assets(t.incident, t.asset)


@check("kpi_10_critical_open", over(
    "incident", "SELECT count(*) AS n FROM incident WHERE severity = 'Critical' AND status = 'Open'"))
def _(t):
    return kpi.critical_open(t.incident)


@check("kpi_11_fp_rate_of_kind", over("incident", f"SELECT {FP} AS fp_pct FROM incident WHERE kind = 'Brute Force'"))
def _(t):
    return kpi.fp_rate_of(t.incident, "Brute Force")


@check("kpi_12_exposed_assets", over("asset", "SELECT count(*) AS n FROM asset WHERE internet_exposed = 'Yes'"))
def _(t):
    return kpi.exposed_assets(t.asset)


@check("kpi_13_since", over("incident", "SELECT count(*) AS n FROM incident WHERE opened_on >= DATE '2000-01-01'"))
def _(t):
    return kpi.since(t.incident, "2000-01-01")


@check("kpi_14_critical_open_assets", over("asset incident", """
SELECT a.asset_id, i.incident_id, i.kind, i.opened_on, a.hostname, a.environment, a.criticality, a.internet_exposed
FROM incident i JOIN asset a USING (asset_id) WHERE i.severity = 'Critical' AND i.status = 'Open'"""))
def _(t):
    return kpi.critical_open_assets(t.incident, t.asset)


@check("kpi_15_count_by_department", over("asset incident", """
SELECT a.department, count(*) AS incidents FROM incident i JOIN asset a USING (asset_id)
WHERE i.severity IN ('Critical', 'High') AND i.status = 'Open' GROUP BY 1 ORDER BY 2 DESC, 1"""))
def _(t):
    keep = F.col("severity").isin("Critical", "High") & (F.col("status") == "Open")
    return kpi.count_by_asset(t.incident, t.asset, keep, "department")


@check("kpi_16_by_host", over("asset incident", """
SELECT a.hostname, count(*) AS incidents FROM incident i JOIN asset a USING (asset_id) GROUP BY 1 ORDER BY 2 DESC, 1"""))
def _(t):
    return kpi.by_host(t.incident, t.asset)


@check("kpi_17_dashboard", over("incident vulnerability", f"""
SELECT o AS open_incidents, c AS critical_active, fp AS fp_pct, m AS mttr_hours, v AS critical_vulns_open,
 c > 0 AS critical_alert, fp > 25 AS fp_warn, v > 5 AS vulns_warn FROM
 (SELECT CAST(sum(CASE WHEN {ACTIVE} THEN 1 ELSE 0 END) AS BIGINT) AS o,
   CAST(sum(CASE WHEN {ACTIVE} AND severity = 'Critical' THEN 1 ELSE 0 END) AS BIGINT) AS c, {FP} AS fp,
   round(avg(CASE WHEN status = 'Resolved' THEN hours_to_resolve END), 1) AS m FROM incident)
 CROSS JOIN (SELECT count(*) AS v FROM vulnerability WHERE {CRIT_VULN})"""))
def _(t):
    return kpi.dashboard(t.incident, t.vulnerability)
