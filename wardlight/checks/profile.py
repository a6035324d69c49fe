"""PRF-1..4."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import profile as p

THREE = "asset incident vulnerability"
ENUM_COLUMNS = {
    "asset": "hostname environment department criticality os internet_exposed",
    "incident": "kind severity technique status false_positive",
    "vulnerability": "vuln_id cve status",
}
_CELLS = " UNION ".join(
    f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {table} WHERE {c} IS NOT NULL"
    for table, columns in ENUM_COLUMNS.items()
    for c in columns.split()
)
_ENUMS = f"""cells AS ({_CELLS}), enums AS (SELECT * FROM cells c WHERE
 (SELECT count(*) FROM cells d WHERE d."table" = c."table" AND d."column" = c."column") <= 10)"""


def three(t):
    return {"asset": t.asset, "incident": t.incident, "vulnerability": t.vulnerability}


def _relation(key, left, right):
    return f"""SELECT '{key}' AS key_column, '{left}' AS left_table, '{right}' AS right_table,
 count(l.k) AS left_keys, count(r.k) AS right_keys,
 CAST(sum(CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS shared_keys,
 round(CAST(sum(CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(l.k), 4) AS left_found,
 round(CAST(sum(CASE WHEN l.k IS NOT NULL AND r.k IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(r.k), 4) AS right_found,
 max(l.n) = 1 AS left_unique, max(r.n) = 1 AS right_unique
FROM (SELECT {key} AS k, count(*) AS n FROM {left} GROUP BY 1) l
FULL JOIN (SELECT {key} AS k, count(*) AS n FROM {right} GROUP BY 1) r ON l.k = r.k"""


@check("prf_01_table_counts", over(THREE, " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS n_rows FROM {n}" for n in THREE.split())))
def _(t):
    return p.table_counts(three(t))


@check("prf_02_detect_enums", over(THREE, f"""WITH {_ENUMS}
SELECT "table", "column", count(*) AS n_values, string_agg(value, ', ' ORDER BY value) AS "values"
FROM enums GROUP BY 1, 2"""))
def _(t):
    return p.enum_lists(p.detect_enums(three(t)))


@check("prf_03_key_relations", over(THREE, " UNION ALL ".join([
    _relation("asset_id", "asset", "incident"), _relation("asset_id", "asset", "vulnerability"),
    _relation("asset_id", "incident", "vulnerability")])))
def _(t):
    return p.key_relations(three(t))


@check("prf_03_key_relations_documents", _relation("doc_id", "documents", "labels"))
def _(t):
    return p.key_relations({"documents": t.documents, "labels": t.labels})


@check("prf_04_orphans", """SELECT doc_id, source, n_chars FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def _(t):
    return p.orphans(t.documents.select("doc_id", "source", "n_chars"), t.labels, "doc_id")


@check("prf_04_orphan_summary", over("vulnerability incident", """
SELECT v.asset_id, count(*) AS n_rows, min(v.vuln_id) AS sample_id FROM vulnerability v
WHERE NOT EXISTS (SELECT 1 FROM incident i WHERE i.asset_id = v.asset_id AND i.severity = 'Critical') GROUP BY 1"""))
def _(t):
    critical = t.incident.where(F.col("severity") == "Critical")
    return p.orphan_summary(t.vulnerability, critical, "asset_id", "vuln_id")
