"""AUD-1..9 and SQL-1..3."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from wardlight.checks import check
from wardlight.checks.profile import _ENUMS, THREE, three
from wardlight.checks.views_sql import over
from wardlight.functions.text import DOMAIN_TERMS, PREDICTION_TERMS, RATIO_TERMS, prediction_intent, strip_reasoning
from wardlight.operators import adhoc, audit
from wardlight.operators.profile import detect_enums



def _re2(pattern: str) -> str:
    """A pattern of the library for the other engine: it has no Unicode flag, so its
    word characters are spelled out where a letter with a mark may stand."""
    flags, body = re.match(r"\(\?(\w+)\)(.*)", pattern, re.S).groups()
    return f"(?{flags.replace('U', '')}){body}".replace("'", "''")


_VERDICT = f"""CASE WHEN NOT regexp_matches(s, '{_re2(audit.READS)}') THEN 'not_select'
 WHEN contains(s, ';') THEN 'several_statements'
 WHEN regexp_matches(s, '{_re2(audit.FORBIDDEN)}') OR regexp_matches(s, '{_re2(audit.OUTSIDE)}') THEN 'blocked_word'
 ELSE 'ok' END"""
_NOT_ALIAS = ", ".join(f"'{w}'" for w in audit.NOT_ALIAS)
_CLEAN = "trim(rtrim(trim(sql_text), ';'))"
_INTENT = f"regexp_matches(question, '{_re2(PREDICTION_TERMS)}')"
_DOMAIN = f"regexp_matches(question, '{_re2(DOMAIN_TERMS)}')"


@check("aud_01_read_only", over("query_log", f"""
SELECT query_id, {_VERDICT} AS verdict FROM (SELECT query_id, {_CLEAN} AS s FROM query_log)"""))
def _(t):
    return audit.audit_read_only(t.query_log).select("query_id", "verdict")


@check("aud_01_verdict_counts", over("query_log", f"""
SELECT {_VERDICT} AS verdict, count(*) AS n FROM (SELECT {_CLEAN} AS s FROM query_log) GROUP BY 1"""))
def _(t):
    return audit.verdict_counts(audit.audit_read_only(t.query_log))


@check("aud_02_lint_ratio", over("query_log", f"""
SELECT query_id, regexp_matches(question, '{_re2(RATIO_TERMS)}')
 AND NOT contains(sql_text, '/') AS no_division FROM query_log"""))
def _(t):
    return audit.lint_ratio(t.query_log).select("query_id", "no_division")


@check("aud_03_lint_denominator", over("query_log", rf"""
SELECT query_id, contains(regexp_replace(upper(sql_text), '\s+', '', 'g'), '{audit.BY_ALL_ROWS}')
 AND contains(upper(regexp_extract(sql_text, '{_re2(audit.CASE_CONDITION)}', 1)), ' AND ') AS wide_denominator FROM query_log"""))
def _(t):
    return audit.lint_denominator(t.query_log).select("query_id", "wide_denominator")


# the oracle resolves aliases as joined rows; templates use each alias once
@check("aud_04_literal_findings", over("asset incident vulnerability query_log", rf"""
WITH {_ENUMS},
src AS (SELECT query_id, unnest(regexp_extract_all(sql_text, '{_re2(audit.SOURCE)}', 1)) AS tbl,
  unnest(regexp_extract_all(sql_text, '{_re2(audit.SOURCE)}', 2)) AS ali FROM query_log),
nm AS (SELECT query_id, tbl AS name, tbl FROM src UNION
  SELECT query_id, ali, tbl FROM src WHERE ali <> '' AND upper(ali) NOT IN ({_NOT_ALIAS})),
pr AS (SELECT query_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS q, unnest(b) AS col, unnest(c) AS lit FROM
  (SELECT query_id, regexp_extract_all(sql_text, '{_re2(audit.EQUALS_TEXT)}', 1) AS a,
   regexp_extract_all(sql_text, '{_re2(audit.EQUALS_TEXT)}', 2) AS b,
   regexp_extract_all(sql_text, '{_re2(audit.EQUALS_TEXT)}', 3) AS c FROM query_log)),
rs AS (SELECT p.*, n.tbl FROM pr p LEFT JOIN nm n ON n.query_id = p.query_id
  AND n.name = CASE WHEN q = '' THEN col ELSE rtrim(q, '.') END),
own AS (SELECT r.*, EXISTS (SELECT 1 FROM enums e WHERE e."table" = tbl AND e."column" = col) AS known,
  (SELECT min(value) FROM enums e WHERE e."table" = tbl AND e."column" = col AND lower(value) = lower(lit)) AS o,
  (SELECT min(value) FROM enums e WHERE e."column" = col AND lower(value) = lower(lit)) AS a,
  (SELECT min(value) FROM enums e WHERE e."table" = tbl AND e."column" = col AND levenshtein(lower(value), lower(lit)) <= 1) AS nr
  FROM rs r),
f AS (SELECT *, CASE WHEN known THEN o ELSE a END AS fx FROM own)
SELECT query_id, CAST(pos AS INTEGER) AS pos, tbl AS "table", col AS "column", lit AS literal,
 CASE WHEN fx <> lit THEN 'case' ELSE 'near' END AS finding, CASE WHEN fx <> lit THEN fx ELSE nr END AS suggestion
FROM f WHERE fx <> lit OR (fx IS NULL AND known AND nr IS NOT NULL)"""))
def _(t):
    return audit.literal_findings(t.query_log, detect_enums(three(t)))


_MODEL_TEXT = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Here: ', props, ' as asked') WHEN 2
 THEN concat('first line', chr(10), replace(props, ':', concat(':', chr(10)))) ELSE 'no object here' END"""


@check("aud_05_extract_json", rf"""
SELECT event_id, CAST(json_extract_string(j, '$.k') AS BIGINT) AS k, j IS NOT NULL AS has_json
FROM (SELECT event_id, nullif(regexp_extract({_MODEL_TEXT}, '(?s)\{{.*\}}'), '') AS j FROM events)""")
def _(t):
    texts = t.events.select("event_id", F.expr(_MODEL_TEXT).alias("text"))
    schema = StructType().add("k", LongType())
    return audit.extract_json(texts, schema).select("event_id", F.col("parsed.k").alias("k"), "has_json")


@check("aud_06_strip_reasoning", r"""
SELECT doc_id, md5(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE text END, '^\s+|\s+$', '', 'g')) AS answer_md5 FROM documents""")
def _(t):
    thought = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("<think> step one\n</think> \n"), F.col("text"))
    ).otherwise(F.col("text"))
    return t.documents.select("doc_id", F.md5(strip_reasoning(thought)).alias("answer_md5"))


@check("aud_07_reroute", over("query_log", f"""
SELECT query_id, CASE WHEN route = 'direto' AND {_DOMAIN} THEN CASE WHEN {_INTENT} THEN 'ml' ELSE 'rag' END
 ELSE route END AS final_route FROM query_log"""))
def _(t):
    return audit.reroute(t.query_log).select("query_id", "final_route")


@check("aud_08_prediction_intent", over("query_log", f"SELECT query_id, {_INTENT} AS prediction FROM query_log"))
def _(t):
    return t.query_log.select("query_id", prediction_intent(F.col("question")).alias("prediction"))


def attempts(t):
    """Three attempts per query; errors and sign-ups did not work."""
    ok = ~F.col("event_type").isin("error", "signup", "click")
    return t.events.select(
        F.floor(F.col("event_id") / 3).alias("query_id"),
        (F.col("event_id") % 3 + 1).alias("attempt"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("bad "), F.col("event_type"))).alias("reason"),
    )


@check("aud_09_retry_summary", """
WITH a AS (SELECT CAST(floor(event_id / 3) AS BIGINT) AS query_id, event_id % 3 + 1 AS attempt,
 event_type NOT IN ('error', 'signup', 'click') AS ok, 'bad ' || event_type AS reason FROM events),
s AS (SELECT query_id, min(CASE WHEN ok THEN attempt END) AS solved_at, max(attempt) AS last_try FROM a GROUP BY 1)
SELECT query_id, (SELECT count(*) FROM a WHERE a.query_id = s.query_id) AS logged, coalesce(solved_at, last_try) AS attempts, solved_at, coalesce(solved_at > 1, false) AS self_corrected,
 solved_at IS NULL AND last_try >= 3 AS failed,
 coalesce((SELECT string_agg(reason, '; ' ORDER BY attempt) FROM a WHERE a.query_id = s.query_id AND NOT a.ok
   AND a.attempt <= coalesce(solved_at, last_try)), '') AS reasons FROM s""")
def _(t):
    return audit.retry_summary(attempts(t))


_ADHOC = """SELECT a.department, i.severity, COUNT(*) AS n, ROUND(AVG(i.hours_to_resolve), 1) AS hours
FROM incident i JOIN asset a ON i.asset_id = a.asset_id WHERE i.status = 'Resolved' GROUP BY a.department, i.severity"""


@check("sql_01_run_select", over("asset incident", _ADHOC))
def _(t):
    return adhoc.run_select(t.spark, _ADHOC + ";", {"asset": t.asset, "incident": t.incident})


_PER_ASSET = "SELECT asset_id, severity, COUNT(*) AS n FROM incident GROUP BY asset_id, severity"


@check("sql_01_all_rows", over("incident", _PER_ASSET))
def _(t):
    return adhoc.run_select(t.spark, _PER_ASSET, {"incident": t.incident})


@check("sql_02_same_result", over("incident", """
WITH a AS (SELECT CAST(CAST(incident_id AS DOUBLE) AS VARCHAR) AS x, lower(kind) AS y, coalesce(CAST(round(hours_to_resolve, 2) AS VARCHAR), 'none') AS z FROM incident),
b AS (SELECT CAST(CAST(incident_id AS DOUBLE) AS VARCHAR) AS x, lower(trim(upper(kind) || '  ')) AS y, coalesce(CAST(round(hours_to_resolve, 2) AS VARCHAR), 'none') AS z FROM incident),
d AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
SELECT count(*) = 0 AS same, count(*) AS rows_apart FROM d"""))
def _(t):
    a = t.incident.select("incident_id", "kind", F.round("hours_to_resolve", 2).alias("h"))
    b = t.incident.select(
        F.col("incident_id").cast("double").alias("x"),
        F.upper(F.concat(F.col("kind"), F.lit("  "))).alias("y"),
        F.round("hours_to_resolve", 2).cast("string").alias("z"),
    ).orderBy(F.desc("x"))
    return adhoc.same_result(a, b)


@check("sql_02_result_difference", over("incident", """
SELECT false AS same, 2 * count(*) AS rows_apart FROM incident WHERE severity = 'Low'"""))
def _(t):
    a = t.incident.select("incident_id", "severity")
    b = t.incident.select(
        "incident_id", F.when(F.col("severity") == "Low", "None").otherwise(F.col("severity")).alias("s")
    )
    return adhoc.same_result(a, b)


@check("sql_03_derive_facts", """
SELECT doc_id AS case_id, concat('document of ', CAST(n_chars AS VARCHAR), ' chars in ', lang, ', ', lang) AS fact FROM documents
UNION ALL SELECT doc_id, concat('{unknown} and ', '{lang}') FROM documents
UNION ALL SELECT doc_id, concat('source is ', source) FROM documents""")
def _(t):
    docs = t.documents
    values = docs.select(
        F.col("doc_id").alias("case_id"),
        F.explode(F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang"))).alias("name", "value"),
    )
    templates = docs.select(
        F.col("doc_id").alias("case_id"),
        F.explode(F.array(F.lit("document of {n} chars in {lang}, {lang}"), F.lit("{unknown} and {lang}"))).alias("template"),
    )
    fixed = docs.select(
        F.col("doc_id").alias("case_id"), F.concat(F.lit("source is "), "source").alias("fact")
    )
    return adhoc.derive_facts(templates, values, fixed)
