import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wardlight.operators import fp_model
from wardlight.operators.metrics import duplicates
from wardlight.plans.session import folders
from wardlight.streaming import dedupe, scoring, stage_metrics
from wardlight.streaming.tables import StreamTables, finish


def test_stream_score_equals_batch(spark, tables, tmp_path):
    rows = fp_model.fp_features(tables.incident, tables.asset)
    model = fp_model.fit_fp(rows)
    arriving = StreamTables(spark, SMALL, ("orders",)).incident
    finish(scoring.stream_score(model, arriving, tables.asset, 0.239, str(tmp_path / "o"), str(tmp_path / "c")))
    batch = fp_model.score_fp(model, rows, 0.239)
    assert spark.read.parquet(str(tmp_path / "o")).drop("batch").exceptAll(batch).count() == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == rows.count()


def alerts(spark, rows):
    base = dt.date(2026, 1, 1)
    return spark.createDataFrame(
        [(a, "k", i, base + dt.timedelta(d)) for a, i, d in rows],
        "asset_id long, kind string, incident_id long, opened_on date")


def test_dedupe_across_batches_and_rerun(spark, tmp_path):
    batches = [
        [(1, 1, 0), (1, 2, 0), (2, 3, 0)],
        [(1, 4, 5), (2, 5, 10), (1, 6, 5)],
        [(1, 7, 5), (1, 8, 20), (3, 9, 20)],
    ]
    path = str(tmp_path)
    for rows in batches:
        alerts(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(alerts(spark, rows).schema).parquet(f"{path}/in")
        finish(dedupe.stream_dedupe(arriving, f"{path}/out", f"{path}/state", f"{path}/mark", 7))
    out = spark.read.parquet(f"{path}/out")
    assert out.count() == 9
    got = {(r["incident_id"], r["previous_on"]) for r in out.where("duplicate").collect()}
    everything = alerts(spark, [r for b in batches for r in b])
    assert got == {(r["incident_id"], r["previous_on"]) for r in duplicates(everything, 7).collect()}
    # only days within reach are left, each in the version of the last batch that changed it
    key = alerts(spark, []).select("asset_id", "kind").schema
    seen = dedupe.days_seen(spark, f"{path}/state", 3, 7, key)
    assert {r["asset_id"] for r in seen.collect()} == {1, 3}
    held = {(d, v) for d in folders(spark, f"{path}/state") for v in folders(spark, f"{path}/state/{d}")}
    day = lambda d: f"day={dt.date(2026, 1, 1) + dt.timedelta(d)}"
    assert held == {(day(5), "batch=1"), (day(10), "batch=1"), (day(20), "batch=2")}
    # a batch run again gives the same rows: it reads the days as the batch before it left them
    before = dedupe.days_seen(spark, f"{path}/state", 2, 7, key)
    again, _ = dedupe.flag_batch(alerts(spark, batches[2]), before, 7, ("asset_id", "kind"))
    last = spark.read.parquet(f"{path}/out/batch=2")
    assert sorted(again.collect()) == sorted(last.select(*again.columns).collect())


def test_a_batch_writes_only_the_days_it_touches(spark, tmp_path):
    path = str(tmp_path)
    for rows in ([(i, i, i % 6) for i in range(60)], [(100, 100, 3)], [(101, 101, 3), (102, 102, 5)]):
        alerts(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(alerts(spark, rows).schema).parquet(f"{path}/in")
        finish(dedupe.stream_dedupe(arriving, f"{path}/out", f"{path}/state", f"{path}/mark", 7))
    written = {d: folders(spark, f"{path}/state/{d}") for d in folders(spark, f"{path}/state") if d.startswith("day=")}
    newest = {d: max(int(v.partition("=")[2]) for v in own) for d, own in written.items()}
    assert [newest[d] for d in sorted(newest)] == [0, 0, 0, 2, 0, 2]
    # the version that the last batch replaced stays until that batch cannot run again; older ones are gone
    assert written[sorted(written)[3]] == ["batch=1", "batch=2"]


def test_windows_are_written_by_day(spark, tmp_path):
    """Only days with changed windows are written again, and the table equals the batch one."""
    base = dt.datetime(2026, 3, 1, 12)
    def calls(rows):
        return spark.createDataFrame(
            [(base + dt.timedelta(hours=h), a, "s", float(ms), 1) for h, a, ms in rows],
            "created_at timestamp, agent string, stage string, duration_ms double, success int")
    path, everything = str(tmp_path), []
    stamps = []
    for rows in ([(0, "a", 5), (30, "b", 7), (50, "a", 9)], [(51, "a", 1), (52, "c", 3)], []):
        everything += rows
        calls(rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(calls(rows).schema).parquet(f"{path}/in")
        windows = stage_metrics.stage_windows(arriving, "1 day", delay="10 days")
        finish(stage_metrics.replace_windows(windows, f"{path}/out", f"{path}/mark"))
        stamps.append({p.parent.name: p.name for p in sorted((tmp_path / "out").glob("*/*.parquet"))})
        got = stage_metrics.current_windows(spark, f"{path}/out")
        expected = stage_metrics.stage_windows(calls(everything), "1 day").select(*got.columns)
        assert sorted(got.collect()) == sorted(expected.collect())
    changed = {day for day in stamps[1] if stamps[1][day] != stamps[0].get(day)}
    assert changed == {"start_day=2026-03-03"} and len(stamps[1]) == 3


def test_hot_asset_in_a_stream_is_spread(spark, tables, tmp_path, monkeypatch):
    from wardlight.plans import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    rows = fp_model.fp_features(tables.incident, tables.asset)
    model = fp_model.LinearModel.of(fp_model.fit_fp(rows))
    arriving = StreamTables(spark, SMALL, ("orders",)).incident
    finish(scoring.stream_score(model, arriving, tables.asset, 0.239, str(tmp_path / "o"), str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "o")).drop("batch")
    assert sorted(got.collect()) == sorted(fp_model.score_fp(model, rows, 0.239).collect())
    with pytest.raises(ValueError):
        fp_model.fp_features(arriving, tables.asset)


def test_late_alert_finds_its_predecessor(spark, tmp_path):
    path = str(tmp_path)
    for rows in ([(1, 1, 0), (2, 2, 1)], [(1, 3, 20)], [(1, 4, 5), (2, 5, 30)]):
        alerts(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(alerts(spark, rows).schema).parquet(f"{path}/in")
        finish(dedupe.stream_dedupe(arriving, f"{path}/out", f"{path}/state", f"{path}/mark", 7, late_days=20))
    out = {r["incident_id"]: r for r in spark.read.parquet(f"{path}/out").collect()}
    # 4 comes after 3 but belongs before it
    assert out[4]["duplicate"] and out[4]["previous_on"] == dt.date(2026, 1, 1)
    assert not out[3]["duplicate"] and not out[5]["duplicate"]


def test_empty_batch(spark):
    flagged, newest = dedupe.flag_batch(alerts(spark, []), None, 7, ("asset_id", "kind"))
    assert flagged.count() == 0 and newest.agg(F.max("last_on")).first()[0] is None
