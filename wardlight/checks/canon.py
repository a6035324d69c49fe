"""CAN-1..5."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.profile import _ENUMS, THREE, three
from wardlight.checks.views_sql import over
from wardlight.functions.text import comparable, fold
from wardlight.operators import canon
from wardlight.operators.profile import detect_enums

# statuses as hand-typed: wrong case, one wrong letter, unknown words
_TYPED = """CASE incident_id % 6 WHEN 0 THEN status WHEN 1 THEN lower(status) WHEN 2 THEN upper(status)
 WHEN 3 THEN substr(status, 1, length(status) - 1) WHEN 4 THEN concat(status, 'x') ELSE 'unknown' END"""


def _typed(t):
    return t.incident.select(
        "incident_id", F.expr(_TYPED.replace("length", "char_length")).alias("status")
    )


@check("can_01_canonicalise", over("incident", f"""
WITH typed AS (SELECT incident_id, {_TYPED} AS status FROM incident), words AS (SELECT DISTINCT status FROM incident)
SELECT incident_id, coalesce(w.status, y.status) AS status FROM typed y LEFT JOIN words w ON lower(w.status) = lower(y.status)"""))
def _(t):
    return canon.canonicalise(_typed(t), "incident", "status", detect_enums({"incident": t.incident}))


@check("can_02_near_misses", over("incident", f"""
WITH typed AS (SELECT {_TYPED} AS value FROM incident), words AS (SELECT DISTINCT status FROM incident),
v AS (SELECT value, count(*) AS n_rows FROM typed GROUP BY 1)
SELECT 'status' AS "column", value, min(w.status) AS suggestion, n_rows FROM v JOIN words w
 ON levenshtein(lower(w.status), lower(v.value)) <= 1
WHERE lower(value) NOT IN (SELECT lower(status) FROM words) GROUP BY value, n_rows"""))
def _(t):
    return canon.near_misses(_typed(t), "incident", "status", detect_enums({"incident": t.incident}))


@check("can_03_fold", "SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(fold(F.col("text"))).alias("folded_md5"))


@check("can_04_comparable", """
SELECT event_id, CAST(round(value, 2) AS VARCHAR) AS value_cell, lower(trim(' ' || upper(event_type) || ' ')) AS kind_cell,
 CASE WHEN event_id % 2 = 0 THEN 'none' ELSE CAST(round(CAST(user_id AS DOUBLE), 2) AS VARCHAR) END AS user_cell
FROM events""")
def _(t):
    return t.events.select(
        "event_id",
        comparable(F.col("value")).alias("value_cell"),
        comparable(F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).alias("kind_cell"),
        comparable(F.when(F.col("event_id") % 2 == 1, F.col("user_id"))).alias("user_cell"),
    )


@check("can_05_scope_dictionary", over(THREE, f"""WITH {_ENUMS}
SELECT "column", CASE WHEN count(DISTINCT "table") = 1 THEN min("table") END AS only_table,
 count(DISTINCT "table") AS n_tables,
 (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT value AS v FROM enums d WHERE d."column" = e."column")) AS allowed
FROM enums e GROUP BY "column\""""))
def _(t):
    return canon.scope_dictionary(detect_enums(three(t))).withColumn(
        "allowed", F.array_join("allowed", ", ")
    )
