"""Small literal cases for profiling, metrics, journal, traces, memory and
evaluation, empty tables included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardlight.plans.ordering import numbered
from wardlight.operators import evaluation, journal, kpi, memory, metrics, profile, traces
from wardlight.sources.files import append_history, read_history
from wardlight.sources.journal import append_calls, metrics_matrix, normalise_calls
from wardlight.sources.tables import load_tables, refresh_tables, save_tables

INC = ("incident_id long, asset_id long, opened_on date, kind string, severity string, technique string, "
       "status string, hours_to_resolve double, false_positive string")
VUL = "vuln_id string, asset_id long, cve string, cvss double, detected_on date, status string, sla_days int"
AST = "asset_id long, hostname string, environment string, department string, criticality string, os string, internet_exposed string"
CALL = ("call_id long, created_at timestamp, request_id string, agent string, stage string, model string, duration_ms double, "
        "success int, prompt_tokens long, completion_tokens long, error string")


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(n)


@pytest.fixture
def soc(frame):
    inc = frame([
        (1, 1, day(0), "Malware", "Critical", "T1", "Open", None, "No"),
        (2, 1, day(3), "Malware", "Low", "T1", "Resolved", 4.0, "Yes"),
        (3, 2, day(3), "DDoS", "High", "T2", "In progress", None, "No"),
        (4, 9, day(9), "DDoS", "Low", "T2", "Resolved", None, "No"),
    ], INC)
    vul = frame([
        ("v1", 1, "C1", 9.5, day(0), "Fixed", 7), ("v2", 1, "C1", 9.5, day(5), "Open", 7),
        ("v3", 2, "C2", 3.9, day(1), "Open", 30), ("v4", 2, "C2", 0.0, day(1), "Open", 30),
    ], VUL)
    ast = frame([
        (1, "h1", "DMZ", "IT", "High", "L", "Yes"), (2, "h2", "LAN", "HR", "Low", "W", "No"),
        (3, "h3", "LAN", "HR", "Low", "W", "No"),
    ], AST)
    return inc, vul, ast


def test_indicators_on_empty_tables(frame):
    inc, vul, ast = frame([], INC), frame([], VUL), frame([], AST)
    row = kpi.dashboard(inc, vul).first()
    assert (row["open_incidents"], row["critical_vulns_open"], row["fp_pct"], row["fp_warn"]) == (0, 0, None, False)
    assert kpi.top_assets(inc, ast).count() == 0
    assert metrics.within_sla(vul, "2026-01-01").first()["within_sla_pct"] is None
    assert kpi.critical_open_assets(inc, ast).count() == 0
    assert metrics.yearly_ids(inc).count() == 0


def test_dashboard(soc):
    inc, vul, _ = soc
    row = kpi.dashboard(inc, vul).first()
    assert (row["open_incidents"], row["critical_active"], row["fp_pct"], row["mttr_hours"]) == (2, 1, 25.0, 4.0)
    assert (row["fp_warn"], row["vulns_warn"], row["critical_alert"]) == (False, False, True)


def test_rules(soc):
    inc, vul, ast = soc
    bands = {r["vuln_id"]: (r["cvss_class"], r["fix_days"]) for r in metrics.with_sla(vul).collect()}
    assert bands == {"v1": ("Critical", 7), "v2": ("Critical", 7), "v3": ("Low", 90), "v4": (None, None)}
    assert [r["vuln_id"] for r in metrics.repeat_vulns(vul).collect()] == ["v2"]
    assert [r["asset_id"] for r in metrics.emergency_assets(ast, vul).collect()] == [1]
    hits = {(r["incident_id"], r["days_after"]) for r in metrics.watch_hits(inc, vul, ast).collect()}
    assert hits == {(1, 0), (2, 3)}
    first = metrics.prioritise(vul, ast, "2026-02-01", 1).first()
    assert first["vuln_id"] == "v2"
    ids = {r["incident_id"]: r["yearly_id"] for r in metrics.yearly_ids(inc).collect()}
    assert ids[1] == "INC-2026-0001" and ids[4] == "INC-2026-0004"
    assert [(r["asset_id"], r["incidents"]) for r in metrics.recurrence(inc).collect()] == [(1, 2)]


def test_profile(soc):
    inc, vul, ast = soc
    t = {"asset": ast, "incident": inc, "vulnerability": vul}
    assert {r[0]: r[1] for r in profile.table_counts(t).collect()} == {"asset": 3, "incident": 4, "vulnerability": 4}
    rel = {(r["left_table"], r["right_table"]): r for r in profile.key_relations(t).collect()}
    got = rel[("asset", "incident")]
    assert (got["left_keys"], got["right_keys"], got["shared_keys"], got["left_unique"], got["right_unique"]) == (3, 3, 2, True, False)
    assert [r["incident_id"] for r in profile.orphans(inc, ast, "asset_id").collect()] == [4]


def test_enum_limit(frame):
    df = frame([(f"v{i % 10}", f"w{i % 11}", None, f"x{i}") for i in range(100)], "ten string, eleven string, nothing string, wide string")
    found = {(r["column"], r["n_values"]) for r in profile.enum_lists(profile.detect_enums({"t": df})).collect()}
    assert found == {("ten", 10)}


def test_journal(frame, spark, tmp_path):
    raw = frame([
        (1, dt.datetime(2026, 1, 1, 10), "r-7", "triador", "fila", "m", 640.5, True, 70, 9, None),
        (2, dt.datetime(2026, 1, 2, 10), None, None, "", "m", 1800.0, False, None, None, "E" * 400),
    ], CALL.replace("success int", "succeeded boolean"))
    calls = normalise_calls(raw)
    two = calls.where("call_id = 2").first()
    assert (two["agent"], two["stage"], two["request_id"], two["success"], len(two["error"])) == ("sistema", "llm", "—", 0, 300)
    row = journal.call_summary(calls).first()
    assert (row["calls"], row["requests"], row["ok"], row["failures"], row["prompt_tokens"]) == (2, 2, 1, 1, 70)
    assert row["max_ms"] >= row["mean_ms"] > 0
    empty = journal.call_summary(calls.limit(0)).first()
    assert (empty["calls"], empty["mean_ms"], empty["ok"], empty["prompt_tokens"]) == (0, 0.0, 0, None)
    rates = {r["stage"]: r for r in journal.call_rates(calls, ("stage",)).collect()}
    assert rates["fila"]["tokens_total"] == 79 and rates["llm"]["tokens_total"] is None
    assert [r["call_id"] for r in journal.latest(calls, 1).collect()] == [2]
    assert journal.failures(calls).first()["error_start"] == "E" * 60
    append_calls(raw, str(tmp_path / "j"))
    append_calls(raw, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "j")).where("day = '2026-01-02'").count() == 2


def test_metrics_matrix(frame):
    m = frame([("a", 1.5, None), ("b", 2.0, 3)], "model string, auc double, n int")
    got = {r["metric"]: (r["a"], r["b"]) for r in metrics_matrix(m, ["a", "b"]).collect()}
    assert got == {"auc": ("1.5", "2.0"), "n": ("—", "3")}


def test_traces(frame):
    text = ('[{"tipo":"request","id":"ab"},{"tipo":"agente","papel":"triador","acao":"x"},{"tipo":"sql","sql":"SELECT 1","linhas":1},'
            '{"tipo":"rag","consulta":"lote 7","fontes":["guide.md :: 2"]},{"tipo":"tempo","etapa":"fila","segundos":2.26},'
            '{"tipo":"agente","papel":"redator"},{"tipo":"agente","papel":"triador"},{"tipo":"novo","detalhe":"w"},'
            '{"tipo":"contexto","reescrita":"turno da noite"},{"tipo":"ml","filtro":"lote","incidentes":8,"prob_media":12.2}]')
    answers = frame([(1, text), (2, "[]"), (3, "nope"), (4, None)], "id int, trace string")
    events = traces.trace_events(answers, "id", "trace")
    assert events.select("answer_id").distinct().count() == 1
    lines = {r["pos"]: r["line"] for r in traces.event_table(events).collect()}
    assert 0 not in lines and lines[4] == "fila · 2.3s" and lines[7] == "detail=w"
    assert lines[3] == "consulta: lote 7 · 1 trechos" and lines[8] == "seguimento reformulado → turno da noite"
    assert lines[9] == "filtro: lote · 8 incidentes · FP médio 12%"
    assert traces.roles(events).first()["roles"] == "triador+redator"
    want = frame([(1, ["sql", "rag"]), (2, ["sql"]), (5, [])], "answer_id int, tools array<string>")
    assert {r["answer_id"]: r["routing_ok"] for r in traces.routing_ok(events, want).collect()} == {1: True, 2: False, 5: True}
    docs = frame([(1, "guide.md"), (2, "guide.md")], "answer_id int, doc string")
    assert {r["answer_id"]: r["cited"] for r in traces.cited(events, docs).collect()} == {1: True, 2: False}
    assert traces.first_sql(events).first()["sql"] == "SELECT 1"


def test_memory(frame, spark, tmp_path):
    msgs = frame([
        (1, 1, "user", "  hello ", None), (1, 2, "assistant", "sao 12", '[{"tipo":"sql"}]'),
        (1, 3, "user", "   ", None), (2, 1, "user", "x" * 400, "[{bad"),
    ], "conv_id int, msg_seq long, role string, text string, trace string")
    one = memory.messages_of(msgs, 1).collect()
    assert [r["role"] for r in one] == ["user", "assistant", "user"]
    assert one[1]["events"][0]["tipo"] == "sql" and one[0]["events"] == []
    ctx = {r["conv_id"]: r["context"] for r in memory.context_window(msgs).collect()}
    assert ctx[1] == "analista: hello\nassistente: sao 12" and len(ctx[2]) == 310
    assert {r["conv_id"] for r in memory.due_for_facts(msgs).collect()} == {1}
    memory.write_transcripts(memory.transcripts(msgs), str(tmp_path / "t"), None)
    memory.write_transcripts(memory.transcripts(msgs), str(tmp_path / "u"), 3)
    assert spark.read.text(str(tmp_path / "u")).count() == spark.read.text(str(tmp_path / "t")).count()
    written = spark.read.text(str(tmp_path / "t" / "conv_id=1")).collect()
    assert [r[0] for r in written if r[0]][:3] == ["# Conversa", "**Analista**", "  hello "]
    conv = frame([(1, "t" * 200, dt.datetime(2026, 1, 1))], "conv_id int, title string, updated_at timestamp")
    assert len(memory.recent_conversations(conv).first()["title"]) == 60


def test_facts(frame):
    known = frame([], "fact string, created_at timestamp, updated_at timestamp")
    offered = frame([(1, "Prefers tables by Region"), (2, "prefers tables by region."), (3, "ab"), (4, ""), (5, "y" * 201)], "seq int, fact string")
    profile_, added = memory.upsert_facts(known, offered, "2026-01-01 00:00:00")
    assert [r["fact"] for r in added.collect()] == ["Prefers tables by Region"]
    again, none = memory.upsert_facts(profile_, offered, "2026-01-02 00:00:00")
    assert none.count() == 0 and again.count() == 1
    assert memory.clear_profile(again).count() == 0
    # beyond the latest twelve the same text only gets a new update time
    many = frame([(f"fact {i:02d}", dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1, i)) for i in range(14)], "fact string, created_at timestamp, updated_at timestamp")
    merged, more = memory.upsert_facts(many, frame([(1, "fact 00"), (2, "fact 13")], "seq int, fact string"), "2026-02-01 00:00:00")
    assert [r["fact"] for r in more.collect()] == ["fact 00"] and merged.count() == 14
    assert merged.where("updated_at > '2026-01-31'").first()["created_at"] == dt.datetime(2026, 1, 1)


def test_scores(frame):
    df = frame([(0, 0, 4, 3, "1.5"), (2, 1, 0, 0, "-0.3"), (2, 3, None, None, "n/a"), (1, 1, 2, 5, "0.5")],
               "n_facts int, n_covered int, claims int, supported int, relevance_text string")
    got = [(r["coverage"], r["faithfulness"], r["relevance"]) for r in evaluation.with_scores(df).collect()]
    assert got == [(0.0, 0.75, 1.0), (0.5, 1.0, 0.0), (1.0, None, None), (1.0, 1.0, 0.5)]


def test_overall_on_empty(frame):
    cases = frame([], "coverage double, routed int, cited int, hallucinated boolean, grade double, seconds double, faithfulness double, relevance double, sql_correct double")
    assert evaluation.overall(cases).first()["cases"] == 0


def test_history_row(frame, spark, tmp_path):
    cases = frame([(0.5, 1, None, False, 4.0, 2.04, None, 0.9, 1.0), (1.0, 0, 1, True, 5.0, 4.0, 0.7, None, None)],
                  "coverage double, routed int, cited int, hallucinated boolean, grade double, seconds double, faithfulness double, relevance double, sql_correct double")
    for runs in (1, 3):
        append_history(evaluation.history_row(cases, runs, "2026-01-01 00:00:00"), str(tmp_path / "h"))
    got = read_history(spark, str(tmp_path / "h")).orderBy("runs").collect()
    assert [r["runs"] for r in got] == [1, 3]
    assert (got[1]["coverage"], got[1]["routing"], got[1]["hallucination"], got[1]["sql_correct"]) == (0.75, 0.5, 0.5, 1.0)


def test_sql_correctness(frame):
    rows = [(1, s, r) for s, r in (("reference", ["1", "A"]), ("generated", ["1.0", "a "]))]
    rows += [(2, "reference", ["5"]), (2, "generated", ["5"]), (2, "generated", ["5"]), (3, "reference", ["7"])]
    # 4 ran and returned nothing, 5 likewise and rightly so, 6 never ran
    rows += [(4, "reference", ["7"])]
    cases = frame([(1, True), (2, True), (3, False), (4, True), (5, True), (6, False)], "case_id int, ran boolean")
    got = evaluation.sql_correctness(cases, frame(rows, "case_id int, side string, row array<string>"))
    assert {r["case_id"]: r["sql_correct"] for r in got.collect()} == {1: 1.0, 2: 0.0, 3: None, 4: 0.0, 5: 1.0, 6: None}


def test_numbered_gives_one_result(frame):
    """Both paths agree with null keys and values over several slices."""
    rows = [(None if i % 4 == 0 else i % 3, i, float(i) if 20 < i < 60 else None) for i in range(400)]
    df = frame(rows, "g int, k int, v double").repartition(7)
    for group in (["g"], []):
        by = group or ["one"]
        given = df if group else df.withColumn("one", F.lit(None).cast("int"))
        plain = numbered(given, by, ["k"], "no", {"run": "v"}).orderBy("k").collect()
        sliced = numbered(given, by, ["k"], "no", {"run": "v"}, group_rows=10).orderBy("k").collect()
        assert plain == sliced and len(plain) == 400


def test_trend_with_few_runs(frame):
    h = frame([(day(i), float(i * i)) for i in range(3)], "ran_at date, coverage double")
    got = {r["ran_at"]: r["change"] for r in evaluation.trend(h).collect()}
    assert got == {day(0): None, day(1): 1.0, day(2): 3.0}


def test_load_and_refresh(spark, soc, tmp_path):
    inc, vul, ast = soc
    save_tables({"asset": ast, "incident": inc, "vulnerability": vul}, str(tmp_path / "csv"), "csv")
    loaded = load_tables(spark, str(tmp_path / "csv"))
    assert sorted(loaded["incident"].collect()) == sorted(inc.collect())
    assert spark.sql("SELECT count(*) FROM vulnerability WHERE cvss > 9").first()[0] == 2
    for _ in range(2):
        refreshed = refresh_tables(spark, str(tmp_path / "csv"), str(tmp_path / "pq"))
    assert sorted(refreshed["vulnerability"].collect()) == sorted(vul.collect())
    inferred = load_tables(spark, str(tmp_path / "csv"), schemas={"incident": None}, views=False)["incident"]
    assert inferred.schema["opened_on"].dataType.simpleString() == "date"
