"""MET-1..13."""

from __future__ import annotations

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import metrics as m

AS_OF = "2001-12-31"
GUIDE = ("CASE WHEN cvss >= 9 THEN 'Critical' WHEN cvss >= 7 THEN 'High' WHEN cvss >= 4 THEN 'Medium' "
         "WHEN cvss >= 0.1 THEN 'Low' END")
GUIDE_DAYS = "CASE WHEN cvss >= 9 THEN 7 WHEN cvss >= 7 THEN 14 WHEN cvss >= 4 THEN 30 WHEN cvss >= 0.1 THEN 90 END"
AGE = f"date_diff('day', detected_on, DATE '{AS_OF}')"


@check("met_01_mttr_by_severity", over(
    "incident", "SELECT severity, round(avg(hours_to_resolve), 1) AS mttr_hours FROM incident GROUP BY 1"))
def _(t):
    return m.mttr_by(t.incident, "severity")


@check("met_02_recurrence", over("incident", """
SELECT asset_id, kind, count(*) AS incidents, min(opened_on) AS first_on, max(opened_on) AS last_on
FROM incident GROUP BY 1, 2 HAVING count(*) >= 2"""))
def _(t):
    return m.recurrence(t.incident)


@check("met_03_with_sla", over("vulnerability", f"""
SELECT vuln_id, cvss, {GUIDE} AS cvss_class, {GUIDE_DAYS} AS fix_days FROM vulnerability"""))
def _(t):
    return m.with_sla(t.vulnerability).select("vuln_id", "cvss", "cvss_class", "fix_days")


@check("met_03_with_sla_short_bands", over("vulnerability", """
SELECT vuln_id, CASE WHEN cvss >= 9 THEN 'Critical' WHEN cvss >= 7 THEN 'High' ELSE 'Other' END AS cvss_class,
 CASE WHEN cvss >= 9 THEN 7 WHEN cvss >= 7 THEN 14 ELSE 30 END AS fix_days FROM vulnerability"""))
def _(t):
    return m.with_sla(t.vulnerability, m.SHORT_BANDS).select("vuln_id", "cvss_class", "fix_days")


@check("met_04_open_by_class", over("vulnerability", f"""
SELECT {GUIDE} AS cvss_class, count(*) AS open_vulns FROM vulnerability WHERE status = 'Open' GROUP BY 1"""))
def _(t):
    return m.open_by_class(t.vulnerability)


@check("met_05_within_sla", over("vulnerability", f"""
SELECT count(*) AS open_vulns, round(100.0 * CAST(sum(CASE WHEN date_diff('day', detected_on, DATE '1998-06-30')
 <= sla_days THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1) AS within_sla_pct
FROM vulnerability WHERE status = 'Open'"""))
def _(t):
    return m.within_sla(t.vulnerability, "1998-06-30")


@check("met_06_mean_age_by_department", over("asset vulnerability", f"""
SELECT a.department, count(*) AS open_vulns, round(avg({AGE}), 1) AS mean_age_days
FROM vulnerability v JOIN asset a USING (asset_id) WHERE v.status = 'Open' GROUP BY 1"""))
def _(t):
    return m.mean_age_by_department(t.vulnerability, t.asset, AS_OF)


@check("met_07_repeat_vulns", over("vulnerability", """
SELECT asset_id, cve, vuln_id, detected_on, fixed_on FROM (
 SELECT *, min(CASE WHEN status = 'Fixed' THEN detected_on END) OVER (PARTITION BY asset_id, cve
   ORDER BY detected_on, vuln_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fixed_on FROM vulnerability)
WHERE fixed_on IS NOT NULL"""))
def _(t):
    return m.repeat_vulns(t.vulnerability)


@check("met_08_prioritise", over("asset vulnerability", f"""
SELECT v.vuln_id, v.asset_id, a.internet_exposed, a.criticality, v.cvss, CAST({AGE} AS INTEGER) AS age_days
FROM vulnerability v JOIN asset a USING (asset_id) WHERE v.status = 'Open'
ORDER BY a.internet_exposed DESC, CASE a.criticality WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END DESC,
 age_days DESC, vuln_id LIMIT 50"""))
def _(t):
    return m.prioritise(t.vulnerability, t.asset, AS_OF)


@check("met_09_emergency_assets", over("asset vulnerability", """
SELECT asset_id, hostname, department FROM asset a WHERE criticality = 'High' AND internet_exposed = 'Yes'
 AND EXISTS (SELECT 1 FROM vulnerability v WHERE v.asset_id = a.asset_id AND v.status = 'Open' AND v.cvss >= 9)"""))
def _(t):
    return m.emergency_assets(t.asset, t.vulnerability)


@check("met_10_watch_hits", over("asset incident vulnerability", """
SELECT i.asset_id, i.opened_on, i.incident_id, i.kind, max(v.detected_on) AS detected_on,
 CAST(date_diff('day', max(v.detected_on), i.opened_on) AS INTEGER) AS days_after
FROM incident i JOIN asset a USING (asset_id) JOIN vulnerability v USING (asset_id)
WHERE a.internet_exposed = 'Yes' AND v.cvss >= 9
 AND date_diff('day', v.detected_on, i.opened_on) BETWEEN 0 AND 14 GROUP BY 1, 2, 3, 4"""))
def _(t):
    return m.watch_hits(t.incident, t.vulnerability, t.asset)


@check("met_11_duplicates", over("incident", """
SELECT asset_id, kind, incident_id, opened_on, previous_on FROM (
 SELECT *, lag(opened_on) OVER (PARTITION BY asset_id, kind ORDER BY opened_on, incident_id) AS previous_on
 FROM incident) WHERE date_diff('day', previous_on, opened_on) <= 30"""))
def _(t):
    return m.duplicates(t.incident, 30)


@check("met_12_yearly_ids", over("incident", """
SELECT incident_id, opened_on, 'INC-' || CAST(year(opened_on) AS VARCHAR) || '-' || CASE WHEN rn < 1000
  THEN lpad(CAST(rn AS VARCHAR), 4, '0') ELSE CAST(rn AS VARCHAR) END AS yearly_id
FROM (SELECT *, row_number() OVER (PARTITION BY year(opened_on) ORDER BY opened_on, incident_id) AS rn FROM incident)"""))
def _(t):
    return m.yearly_ids(t.incident)


@check("met_13_load_by_environment", over("asset incident vulnerability", """
WITH i AS (SELECT environment, internet_exposed, count(*) AS incidents FROM incident JOIN asset USING (asset_id) GROUP BY 1, 2),
v AS (SELECT environment, internet_exposed, count(*) AS vulns FROM vulnerability JOIN asset USING (asset_id) GROUP BY 1, 2),
b AS (SELECT environment, internet_exposed, coalesce(incidents, 0) AS incidents, coalesce(vulns, 0) AS vulns
 FROM i FULL JOIN v USING (environment, internet_exposed))
SELECT *, round(100.0 * CAST(incidents AS DOUBLE) / (SELECT sum(incidents) FROM b), 1) AS incident_pct,
 round(100.0 * CAST(vulns AS DOUBLE) / (SELECT sum(vulns) FROM b), 1) AS vuln_pct FROM b"""))
def _(t):
    return m.load_by_environment(t.incident, t.vulnerability, t.asset)
