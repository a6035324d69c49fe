"""STR-1..3."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.model import SAVED, saved_model
from wardlight.checks.views_sql import over
from wardlight.operators import fp_model
from wardlight.plans.session import scratch_path
from wardlight.streaming import dedupe, scoring, stage_metrics
from wardlight.streaming.tables import StreamTables, finish

_WINDOWS = """SELECT {start} AS window_start, {start} + INTERVAL 1 DAY AS window_end, agent, stage, count(*) AS calls,
 round(avg(duration_ms), 0) AS mean_ms, round(max(duration_ms), 0) AS max_ms, CAST(sum(success) AS BIGINT) AS ok
FROM {source} GROUP BY {start}, agent, stage"""


def _naive(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _calls(t):
    return StreamTables(t.spark, t.directory, ("events",)).llm_call


@check("str_01_stage_windows", over("llm_call", _WINDOWS.format(start="date_trunc('day', created_at)", source="llm_call")))
def _(t):
    path, mark = scratch_path(t.spark, "windows"), scratch_path(t.spark, "mark")
    finish(stage_metrics.replace_windows(stage_metrics.stage_windows(_calls(t), "1 day"), path, mark))
    return _naive(stage_metrics.current_windows(t.spark, path))


@check("str_01_sliding_windows", over("llm_call", "WITH s AS (SELECT *, date_trunc('day', created_at) + INTERVAL 12 HOUR * k AS st FROM llm_call, (VALUES (-1), (0), (1)) AS o(k) "
    "WHERE created_at >= date_trunc('day', created_at) + INTERVAL 12 HOUR * k AND created_at < date_trunc('day', created_at) + INTERVAL 12 HOUR * k + INTERVAL 1 DAY) "
    + _WINDOWS.format(start="st", source="s")))
def _(t):
    path, mark = scratch_path(t.spark, "windows"), scratch_path(t.spark, "mark")
    windows = stage_metrics.stage_windows(_calls(t), "1 day", "12 hours")
    finish(stage_metrics.replace_windows(windows, path, mark))
    return _naive(stage_metrics.current_windows(t.spark, path))


@check("str_01_closed_windows", over("llm_call", f"""SELECT * FROM ({_WINDOWS.format(start="date_trunc('day', created_at)", source="llm_call")})
WHERE window_end <= (SELECT max(created_at) FROM llm_call) - INTERVAL 1 HOUR"""))
def _(t):
    path, mark = scratch_path(t.spark, "windows"), scratch_path(t.spark, "mark")
    finish(stage_metrics.append_windows(stage_metrics.stage_windows(_calls(t), "1 day"), path, mark))
    return _naive(t.spark.read.parquet(path))


@check("str_02_stream_dedupe", over("incident", """
SELECT asset_id, kind, incident_id, opened_on, previous_on FROM (
 SELECT *, lag(opened_on) OVER (PARTITION BY asset_id, kind ORDER BY opened_on, incident_id) AS previous_on
 FROM incident) WHERE date_diff('day', previous_on, opened_on) <= 30"""))
def _(t):
    """Incidents arrive year by year; each arrival is one run of the stream."""
    base = scratch_path(t.spark, "alerts")
    alerts = t.incident.select("asset_id", "kind", "incident_id", "opened_on")
    years = sorted(r[0] for r in alerts.select(F.year("opened_on")).distinct().collect())
    for year in years:
        alerts.where(F.year("opened_on") == year).write.mode("append").parquet(f"{base}/in")
        arriving = t.spark.readStream.schema(alerts.schema).parquet(f"{base}/in")
        finish(dedupe.stream_dedupe(arriving, f"{base}/out", f"{base}/state", f"{base}/mark", 30))
    found = t.spark.read.parquet(f"{base}/out").where("duplicate")
    return found.select("asset_id", "kind", "incident_id", "opened_on", "previous_on")


@check("str_03_stream_score", SAVED)
def _(t):
    model = fp_model.load_model(t.spark, saved_model(t))
    path, mark = scratch_path(t.spark, "scored"), scratch_path(t.spark, "mark")
    arriving = StreamTables(t.spark, t.directory, ("orders",)).incident
    finish(scoring.stream_score(model, arriving, t.asset, 0.239, path, mark))
    return t.spark.read.parquet(path).drop("batch")
