"""TRC-1..6."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import traces as tr

_EXPECTED = """e AS (SELECT answer_id, answer_id % 3 <> 1 AS want_sql, answer_id % 3 <> 0 AS want_rag,
 bool_or(kind = 'sql') AS has_sql, bool_or(kind = 'rag') AS has_rag FROM trace_event GROUP BY answer_id)"""


def _answers(t):
    return t.trace_event.select("answer_id").distinct()


@check("trc_01_routing_ok", over("trace_event", f"""WITH {_EXPECTED}
SELECT answer_id, concat_ws('+', CASE WHEN has_sql THEN 'sql' END, CASE WHEN has_rag THEN 'rag' END) AS used,
 (has_sql OR NOT want_sql) AND (has_rag OR NOT want_rag) AS routing_ok FROM e"""))
def _(t):
    slot = F.col("answer_id") % 3
    expected = _answers(t).withColumn(
        "tools",
        F.when(slot == 0, F.array(F.lit("sql")))
        .when(slot == 1, F.array(F.lit("rag")))
        .otherwise(F.array(F.lit("sql"), F.lit("rag"))),
    )
    return tr.routing_ok(t.trace_event, expected).select(
        "answer_id", F.array_join("used", "+").alias("used"), "routing_ok"
    )


@check("trc_02_cited", over("trace_event", """
SELECT answer_id, 'doc-' || CAST(answer_id % 10 AS VARCHAR) AS doc,
 coalesce(bool_or(kind = 'rag' AND (contains(source_doc, 'doc-' || CAST(answer_id % 10 AS VARCHAR)) OR answer_id % 10 = 0)), false) AS cited
FROM trace_event GROUP BY answer_id"""))
def _(t):
    expected = _answers(t).withColumn(
        "doc", F.concat(F.lit("doc-"), (F.col("answer_id") % 10).cast("string"))
    )
    return tr.cited(t.trace_event, expected)


@check("trc_03_stage_timings", over("trace_event", """
SELECT stage, count(*) AS n, round(avg(seconds), 3) AS mean_s, max(seconds) AS max_s
FROM trace_event WHERE kind = 'tempo' GROUP BY 1"""))
def _(t):
    return tr.stage_timings(t.trace_event)


@check("trc_03_answer_seconds", over("trace_event", """
SELECT answer_id, round(sum(seconds), 3) AS total_s FROM trace_event WHERE kind = 'tempo' GROUP BY 1"""))
def _(t):
    return tr.answer_seconds(t.trace_event)


@check("trc_04_event_table", over("trace_event", """
SELECT answer_id, pos, kind, CASE kind
 WHEN 'tempo' THEN stage || ' · ' || CAST(round(seconds, 1) AS VARCHAR) || 's'
 WHEN 'sql' THEN substr(sql, 1, 130) || ' · ' || CAST(n_rows AS VARCHAR) || ' linha(s)'
 WHEN 'rag' THEN 'consulta: ' || substr(query, 1, 60) || ' · 2 trechos'
 WHEN 'ml' THEN 'filtro: ' || filter || ' · ' || CAST(n_incidents AS VARCHAR) || ' incidentes · FP médio '
   || CAST(CAST(round(mean_prob, 0) AS BIGINT) AS VARCHAR) || '%'
 ELSE upper(role) || ' · ' || substr(action, 1, 90) END AS line FROM trace_event"""))
def _(t):
    return tr.event_table(t.trace_event)


@check("trc_04_kinds_per_answer", over("trace_event", "SELECT answer_id, " + ", ".join(
    f"CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in tr.KINDS)
    + " FROM trace_event GROUP BY answer_id"))
def _(t):
    return tr.kinds_per_answer(t.trace_event)


@check("trc_05_first_sql", over("trace_event", """
SELECT answer_id, arg_min(sql, pos) AS sql, arg_min(n_rows, pos) AS n_rows FROM trace_event WHERE kind = 'sql' GROUP BY 1"""))
def _(t):
    return tr.first_sql(t.trace_event)


@check("trc_06_roles", over("trace_event", """
SELECT answer_id, string_agg(role, '+' ORDER BY first_pos) AS roles FROM
 (SELECT answer_id, role, min(pos) AS first_pos FROM trace_event WHERE kind = 'agente' GROUP BY 1, 2) GROUP BY 1"""))
def _(t):
    return tr.roles(t.trace_event)
