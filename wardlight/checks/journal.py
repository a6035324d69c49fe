"""OBS-1..6."""

from __future__ import annotations

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import journal as j


@check("obs_01_call_summary", over("llm_call", """
SELECT count(*) AS calls, count(DISTINCT request_id) AS requests, round(avg(duration_ms), 0) AS mean_ms,
 round(max(duration_ms), 0) AS max_ms, CAST(sum(success) AS BIGINT) AS ok,
 CAST(sum(1 - success) AS BIGINT) AS failures, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
 CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM llm_call"""))
def _(t):
    return j.call_summary(t.llm_call)


@check("obs_02_by_stage", over("llm_call", """
SELECT agent, stage, count(*) AS calls, round(avg(duration_ms), 0) AS mean_ms, round(max(duration_ms), 0) AS max_ms,
 CAST(sum(success) AS BIGINT) AS ok FROM llm_call GROUP BY 1, 2 ORDER BY calls DESC, stage"""))
def _(t):
    return j.by_stage(t.llm_call)


@check("obs_03_latest", over("llm_call", """
SELECT call_id, request_id, agent, stage, duration_ms, success FROM llm_call ORDER BY call_id DESC LIMIT 25"""))
def _(t):
    return j.latest(t.llm_call.select("call_id", "request_id", "agent", "stage", "duration_ms", "success"))


_TIMELINE = """SELECT request_id, call_id, agent, stage, duration_ms, success,
 row_number() OVER w AS step, round(sum(duration_ms) OVER w, 2) AS elapsed_ms FROM llm_call {0}
WINDOW w AS (PARTITION BY request_id ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@check("obs_04_request_timeline", over("llm_call", _TIMELINE.format("WHERE request_id = 7")))
def _(t):
    return j.request_timeline(t.llm_call, 7)


@check("obs_04_all_timelines", over("llm_call", _TIMELINE.format("")))
def _(t):
    return j.request_timeline(t.llm_call)


_RATES = """round(100.0 * CAST(sum(success) AS DOUBLE) / count(*), 1) AS ok_pct,
 CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in, CAST(sum(completion_tokens) AS BIGINT) AS tokens_out,
 CAST(sum(prompt_tokens) + coalesce(sum(completion_tokens), 0) AS BIGINT) AS tokens_total FROM llm_call"""


@check("obs_05_call_rates", over("llm_call", f"SELECT {_RATES}"))
def _(t):
    return j.call_rates(t.llm_call)


@check("obs_05_call_rates_by_stage", over("llm_call", f"SELECT agent, stage, {_RATES} GROUP BY 1, 2"))
def _(t):
    return j.call_rates(t.llm_call, ("agent", "stage"))


@check("obs_06_failures", over("llm_call", """
SELECT substr(error, 1, 60) AS error_start, count(*) AS failures,
 string_agg(DISTINCT stage, ', ' ORDER BY stage) AS stages, max(created_at) AS last_at
FROM llm_call WHERE success = 0 GROUP BY 1"""))
def _(t):
    return j.failures(t.llm_call)
