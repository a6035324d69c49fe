"""SQL text of the derived tables, for use as WITH members of the check SQL."""

from __future__ import annotations

from wardlight.sources.views import (
    COMPOSED_FROM, CONDITION_PIECES, KINDS, LOGGED_REQUESTS, QUESTION_PIECES, SAID_FROM, SOURCE_PIECES, TAIL_PIECES, VERB_PIECES,
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _slot(which: int) -> str:
    arms = " ".join(f"WHEN {i} THEN {_q(k[which])}" for i, k in enumerate(KINDS[:-1]))
    return f"CASE o_orderkey % 8 {arms} ELSE {_q(KINDS[-1][which])} END"


def _piece(pieces: list[str], number: str) -> str:
    """The piece that the number picks, counting from 0."""
    return f"[{', '.join(map(_q, pieces))}][CAST({number} AS BIGINT) % {len(pieces)} + 1]"


_V, _S, _C = len(VERB_PIECES), len(SOURCE_PIECES), len(CONDITION_PIECES)
_CONDITION = _piece(CONDITION_PIECES, f"event_id // {_V * _S}")
_COMPOSED = f"""SELECT {COMPOSED_FROM} + event_id, concat_ws(' ', {_piece(QUESTION_PIECES, 'event_id')}, event_type),
 concat({_piece(VERB_PIECES, 'event_id')}, {_piece(SOURCE_PIECES, f'event_id // {_V}')}, {_CONDITION},
  CASE WHEN ends_with({_CONDITION}, '= ') THEN concat(chr(39), event_type, chr(39)) ELSE '' END, {_piece(TAIL_PIECES, f'event_id // {_V * _S * _C}')}),
 CASE WHEN event_id % 3 = 0 THEN 'direto' ELSE 'consultar' END FROM events"""

VIEWS = {
    "asset": """
SELECT c.c_custkey AS asset_id, c.c_name AS hostname, c.c_mktsegment AS environment, n.n_name AS department,
 CASE WHEN c.c_acctbal >= 6000 THEN 'High' WHEN c.c_acctbal >= 2000 THEN 'Medium' ELSE 'Low' END AS criticality,
 concat('OS-', CAST(c.c_custkey % 5 AS STRING)) AS os,
 CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'Yes' ELSE 'No' END AS internet_exposed
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "incident": f"""
SELECT o_orderkey AS incident_id, o_custkey AS asset_id, CAST(o_orderdate AS DATE) AS opened_on,
 {_slot(0)} AS kind,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
  ELSE 'Low' END AS severity,
 {_slot(1)} AS technique,
 CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In progress' ELSE 'Resolved' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 5000 END AS hours_to_resolve,
 CASE WHEN (o_orderkey * 7919) % 100 < CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 12
  WHEN '3-MEDIUM' THEN 30 ELSE 55 END THEN 'Yes' ELSE 'No' END AS false_positive
FROM orders""",
    "vulnerability": """
SELECT concat_ws('-', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING),
  CAST(l.l_suppkey AS STRING)) AS vuln_id,
 o.o_custkey AS asset_id, concat('CVE-', CAST(l.l_partkey % 10 AS STRING)) AS cve, l.l_quantity / 5 AS cvss,
 CAST(l.l_shipdate AS DATE) AS detected_on,
 CASE l.l_returnflag WHEN 'A' THEN 'Open' WHEN 'N' THEN 'In fix' ELSE 'Fixed' END AS status,
 CASE WHEN l.l_quantity / 5 >= 9 THEN 7 WHEN l.l_quantity / 5 >= 7 THEN 14 ELSE 30 END AS sla_days
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "llm_call": """
SELECT event_id AS call_id, ts AS created_at, CAST(floor(event_id / 4) AS BIGINT) AS request_id,
 CASE WHEN event_type IN ('click', 'view') THEN 'writer' ELSE 'collector' END AS agent, event_type AS stage,
 concat('model-', CAST(user_id % 3 AS STRING)) AS model,
 value AS duration_ms, CASE WHEN (event_id * 31) % 20 = 0 THEN 0 ELSE 1 END AS success,
 CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE event_id % 500 END AS prompt_tokens,
 CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE event_id % 90 END AS completion_tokens,
 CASE WHEN (event_id * 31) % 20 = 0 THEN concat('ProviderError at stage ', event_type,
  ': the upstream service gave no answer for user ', CAST(user_id AS STRING)) END AS error
FROM events""",
    "message": """
SELECT conv_id, conv_id * 100 + turn AS msg_seq, role, text,
 CASE WHEN role = 'user' THEN NULL WHEN turn % 3 = 0 THEN '[{broken' ELSE
  concat('[{"tipo":"sql","sql":"SELECT ', CAST(turn AS STRING), '","linhas":1},{"tipo":"agente","papel":"triador"}]')
 END AS trace
FROM conversations WHERE role IN ('user', 'assistant')""",
    "trace_event": """
SELECT CAST(floor(event_id / 4) AS BIGINT) AS answer_id, event_id % 4 AS pos, kind,
 CASE WHEN kind = 'tempo' THEN concat('stage-', CAST(user_id % 3 AS STRING)) END AS stage,
 CASE WHEN kind = 'tempo' THEN value END AS seconds,
 CASE WHEN kind = 'sql' THEN concat('SELECT COUNT(*) FROM incident WHERE asset_id = ', CAST(user_id AS STRING)) END AS sql,
 CASE WHEN kind = 'sql' THEN event_id % 9 END AS n_rows,
 CASE WHEN kind = 'rag' THEN concat('question ', CAST(user_id AS STRING)) END AS query,
 CASE WHEN kind = 'rag' THEN concat('doc-', CAST(user_id % 20 AS STRING)) END AS source_doc,
 CASE WHEN kind = 'ml' THEN concat('kind=', CAST(user_id % 8 AS STRING)) END AS filter,
 CASE WHEN kind = 'ml' THEN event_id % 50 END AS n_incidents,
 CASE WHEN kind = 'ml' THEN CAST(user_id % 100 AS DOUBLE) END AS mean_prob,
 CASE WHEN kind = 'agente' THEN 'handed over' END AS action,
 CASE WHEN kind = 'agente' THEN CASE WHEN user_id % 2 = 0 THEN 'triador' ELSE 'redator' END END AS role
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'sql' WHEN 'error' THEN 'rag' WHEN 'click' THEN 'tempo'
  WHEN 'view' THEN 'agente' ELSE 'ml' END AS kind FROM events)""",
    "run_verdict": """
SELECT CAST(floor(event_id / 3) AS BIGINT) AS case_id, event_id % 3 + 1 AS run, event_id % 4 AS n_facts,
 (event_id * 7) % 5 AS n_covered, CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS hallucinated,
 event_id % 5 + 1 AS grade, value / 50 AS seconds,
 CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 6 END AS claims, (event_id * 3) % 6 AS supported,
 CAST(event_id % 13 AS DOUBLE) / 10 - 0.1 AS relevance,
 CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(CAST(event_id % 13 AS DOUBLE) / 10 - 0.1 AS VARCHAR) END AS relevance_text,
 CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 < 3 THEN 1 ELSE 0 END AS cited,
 CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END AS routed,
 CASE WHEN event_id % 4 <> 0 THEN CAST(CASE WHEN event_id % 9 <> 0 THEN 1 ELSE 0 END AS DOUBLE) END AS sql_correct
FROM events""",
    "query_log": """
SELECT e.event_id AS query_id, concat_ws(' ', t.question, e.event_type, CAST(e.user_id AS VARCHAR)) AS question,
 CASE WHEN contains(t.sql_text, 'WHERE') THEN concat(t.sql_text, ' AND asset_id = ', CAST(e.user_id AS VARCHAR))
  ELSE t.sql_text END AS sql_text, t.route
FROM events e JOIN (VALUES """
    + ", ".join(f"({i}, {_q(q)}, {_q(s)}, {_q(r)})" for i, q, s, r in LOGGED_REQUESTS)
    + f""") AS t(tid, question, sql_text, route) ON e.event_id % {len(LOGGED_REQUESTS)} = t.tid
UNION ALL SELECT {SAID_FROM} + conv_id * 100 + turn, text,
 concat('SELECT 1 FROM incident i WHERE i.kind = ''', replace(text, '''', ''), ''''),
 CASE WHEN turn % 2 = 0 THEN 'direto' ELSE 'consultar' END FROM conversations
UNION ALL {_COMPOSED}""",
}


def over(views: str, body: str, recursive: bool = False) -> str:
    """``body`` with the named views in front; ``body`` may bring its own WITH
    members when it starts with ``WITH``."""
    members = [f"{v} AS ({VIEWS[v].strip()})" for v in views.split()]
    body = body.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:]
        head = ", ".join(members)
        joined = f"{head}, {rest}" if members else rest
    else:
        joined = f"{', '.join(members)} {body}" if members else body
        if not members:
            return joined
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}"
