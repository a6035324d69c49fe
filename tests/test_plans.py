"""Skew-safe paths give the plain answers, and plans hold no forbidden steps."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from compare import compare, connect
from tests.conftest import SMALL
from wardlight.operators import fp_model, lexical, metrics, neighbours, relevance
from wardlight.plans import automaton, skew
from wardlight.plans.ordering import numbered
from wardlight.plans.skew import salted_join


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds a third of the rows."""
    rnd = random.Random(7)
    data = [(0 if rnd.random() < 0.34 else rnd.randrange(1, 200), i, float(rnd.randrange(100))) for i in range(3000)]
    return spark.createDataFrame(data, "k int, id long, v double").repartition(6)


def test_salted_join(spark, skewed):
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 300, 2)], "k int, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert "_salt" in salted_join(skewed, right, ["k"], how, 5, 100)._jdf.queryExecution().toString()
        assert rows(salted_join(skewed, right, ["k"], how, salts=5, hot_rows=100)) == rows(skewed.join(right, ["k"], how))


def test_numbered_by_range_equals_window(skewed):
    plain = numbered(skewed, ["k"], ["id"], "n", {"s": "v"})
    split = numbered(skewed, ["k"], ["id"], "n", {"s": "v"}, group_rows=10)
    assert rows(split.select(*plain.columns)) == rows(plain)


def test_yearly_ids_by_range(tables):
    assert rows(metrics.yearly_ids(tables.incident, group_rows=10)) == rows(metrics.yearly_ids(tables.incident))


def test_timelines_by_range(tables):
    from wardlight.operators.journal import request_timeline

    plain = request_timeline(tables.llm_call)
    assert rows(request_timeline(tables.llm_call, group_rows=2).select(*plain.columns)) == rows(plain)


HOT = ["kpi_14_critical_open_assets", "met_07_repeat_vulns", "met_10_watch_hits", "met_11_duplicates",
       "prf_04_orphans", "ml_01_fp_features"]


@pytest.mark.parametrize("name", HOT)
def test_hot_keys_change_nothing(spark, monkeypatch, name):
    """With every repeated key treated as hot, the SQL still agrees."""
    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    con = connect(SMALL)
    found, _, _ = compare(queries()[name](spark, SMALL), con, oracle_sql()[name])
    assert not found


def test_salted_null_keys(spark):
    left = spark.createDataFrame([(None if i % 3 == 0 else i % 4, i) for i in range(60)], "k int, id int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(left, right, ["k"], how, 4, hot_rows=5)) == rows(left.join(right, ["k"], how))


def test_duplicates_with_hot_key(spark):
    rnd = random.Random(3)
    data = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 30), "a", i, rnd.randrange(60)) for i in range(800)]
    df = spark.createDataFrame(data, "asset_id long, kind string, incident_id long, d int").select(
        "asset_id", "kind", "incident_id", F.date_add(F.lit("2026-01-01").cast("date"), F.col("d")).alias("opened_on"))
    got = {(r["incident_id"], r["previous_on"]) for r in metrics.duplicates(df, 3).collect()}
    expected, last = set(), {}
    base = df.agg(F.min("opened_on")).first()[0]
    for asset, kind, iid, day in sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=lambda r: (r[3], r[2])):
        before = last.get((asset, kind))
        if before is not None and (day - before).days <= 3:
            expected.add((iid, before))
        last[(asset, kind)] = day
    assert base is not None and got == expected


def _searched(tables):
    docs = tables.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    return lexical.bm25_index(docs), tables.benchmark.select(F.col("item_id").alias("query_id"), "text")


def test_bm25_shards_and_query_blocks_change_nothing(tables, monkeypatch):
    index, asked = _searched(tables)
    whole = rows(lexical.bm25_search(index, asked, 4))
    assert rows(lexical.bm25_search(index, asked, 4, broadcast_rows=300)) == whole
    monkeypatch.setattr(lexical, "SHARD_CHUNKS", 17)
    monkeypatch.setattr(lexical, "FIRST_BLOCK", 2)
    assert rows(lexical.bm25_search(_searched(tables)[0], asked, 4)) == whole


def test_bm25_hands_on_few_rows(tables):
    """Before the final ranking there are at most n rows per query and shard."""
    index, asked = _searched(tables)
    per_query = lexical.shard_best(index, asked, 3).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert per_query <= 3 * 4  # cores, and so shards of this small corpus
    plan = lexical.shard_best(index, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard" in plan
    assert "hashpartitioning(query_id" not in plan and "hashpartitioning(chunk_id" not in plan


def lists_of(postings):
    """``Lists`` of ``{token: {chunk: impact}}``."""
    found = [(t, c, v) for t, held in postings.items() for c, v in held.items()]
    return lexical.Lists(pa.table({n: pa.array(x) for n, x in zip(("token", "chunk_id", "impact"), zip(*found))}))


@pytest.mark.parametrize("seed", range(12))
def test_bm25_early_stop_is_exact(seed):
    rnd = np.random.default_rng(seed)
    n, k = 2_000, int(rnd.integers(1, 20))
    postings = {}
    for t in range(int(rnd.integers(1, 9))):
        held = rnd.choice(n, int(rnd.integers(1, n)), replace=False)
        name = (lambda c: f"c{c:05d}") if seed % 2 else int  # ids may be texts
        # few distinct impacts: many ties
        postings[f"t{t}"] = {name(c): float(v) for c, v in zip(held, np.round(rnd.random(len(held)) ** 3 * 2, 2) + 0.01)}
    weights = rnd.random(len(postings)) * 3 - (0.5 if seed % 4 == 0 else 0)  # also terms that count against a chunk
    held = lists_of(postings)
    places, scores, _ = held.best(np.arange(len(postings)), weights, k)
    expected = {}
    for (_, chunks), w in zip(postings.items(), weights):
        for c, v in chunks.items():
            expected[c] = expected.get(c, 0.0) + w * v
    best = sorted((-round(v, 6), c) for c, v in expected.items() if round(v, 6) > 0)[:k]
    assert held.ids[places].tolist() == [c for _, c in best]
    assert np.allclose(scores, [-v for v, _ in best])


def test_bm25_stops_early():
    rnd = np.random.default_rng(1)
    impact = np.sort(rnd.pareto(1.0, 20_000))[::-1]
    held = lists_of({"a": dict(enumerate(impact.tolist())), "b": {i: float(v) for i, v in enumerate(impact)}})
    places, _, read = held.best(np.array([0, 1]), np.array([1.0, 0.5]), 5)
    assert places.tolist() == [0, 1, 2, 3, 4] and read < 4_000


def test_bm25_index_moves_no_texts(tables):
    docs = tables.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    seen = []
    real = lexical.materialise
    try:
        lexical.materialise = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
        lexical.bm25_index(docs)
    finally:
        lexical.materialise = real
    # counting needs no exchange; small scans are spread over the cores before it by the caller
    assert seen and "Exchange" not in seen[0]


def test_knn_blocks_equal_one_block_and_numpy(spark):
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(120, 8)).round(3)
    v[60:80] = v[0]  # many equal vectors: ties go to the lower id
    v[90] = 0  # no direction
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    q = spark.createDataFrame(data, "query_id long, vector array<double>")
    c = q.withColumnRenamed("query_id", "chunk_id").repartition(7)
    one, many = neighbours.knn(q, c, 5), neighbours.knn(q, c, 5, block_queries=25)
    assert rows(one) == rows(many.select(*one.columns))
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
    away = np.round(1 - unit @ unit.T, 6) + 0.0
    expected = {(i, int(j)) for i in range(120) for j in np.lexsort((np.arange(120), away[i]))[:5]}
    assert {(r["query_id"], r["chunk_id"]) for r in one.collect()} == expected
    assert neighbours.knn(q, c.limit(3), 5).count() == 360
    named = neighbours.knn(q, c.withColumn("chunk_id", F.concat(F.lit("c"), F.lpad("chunk_id", 4, "0"))), 5)
    assert {(r["query_id"], int(r["chunk_id"][1:])) for r in named.collect()} == expected
    missing = c.withColumn("vector", F.when(F.col("chunk_id") != 7, F.col("vector")))
    assert not neighbours.knn(q, missing, 5).where("chunk_id = 7").count()


def test_knn_leaves_the_corpus_where_it_is(spark, tables):
    vectors = tables.embeddings
    found = neighbours.knn(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), 3,
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert "Exchange" not in below and "Exchange hashpartitioning(query_id" in plan


def test_knn_skips_cells_by_pivots():
    rnd = np.random.default_rng(2)
    near = np.repeat(np.eye(6), 200, axis=0) + rnd.normal(scale=0.01, size=(1200, 6))
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    heap = neighbours.NearestHeap(unit[::50], 3)
    for i in range(0, 1200, 300):
        heap.add(np.arange(i, i + 300), unit[i : i + 300])
    _, ids, _ = heap.found()
    expected = [np.lexsort((np.arange(1200), row))[:3] for row in np.round(1 - unit[::50] @ unit.T, 6)]
    assert ids.tolist() == np.concatenate(expected).tolist() and heap.skipped > 10_000


@pytest.mark.parametrize("least", [1, 20, 5_000])
def test_frequent_keys_are_exact(spark, skewed, least):
    found = {r["k"]: r["count"] for r in skew.frequent_keys(skewed, ["k"], least).collect()}
    assert found == {r["k"]: r["count"] for r in skewed.groupBy("k").count().where(F.col("count") > least).collect()}


def test_frequent_keys_among_many(spark):
    """Far more keys than counters: the heavy ones are found and counted exactly."""
    df = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(-2)).otherwise(F.col("id")).alias("k")
    )
    found = {r["k"]: r["count"] for r in skew.frequent_keys(df, ["k"], 1_000).collect()}
    assert found == {r["k"]: r["count"] for r in df.where("k < 0").groupBy("k").count().collect()}


def test_no_shuffle_by_key_looks_for_hot_keys(spark, skewed, monkeypatch):
    """Only merged summaries and the recount of candidates are shuffled."""
    plans = []
    real = type(skewed).first
    monkeypatch.setattr(type(skewed), "first", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    salted_join(skewed, skewed.limit(5).select("k"), ["k"], hot_rows=1_000_000)
    assert plans and all("hashpartitioning(k" not in p for p in plans)


CONTAINED = ["the cat sat on the mat today", "concat sat on them", "a, b; c d e f g", "xx", "", "b; c d e f g h", "Été à la mer, oui", None]
PASSAGES = ["cat sat", "sat on the", "b; c d e f g", "x", "nothing here at all today", "cat sat on the m", "b; c d e f g", "à la mer", ", ", "", None]


@pytest.mark.parametrize("chars,shards", [(2_000_000, 8), (10, 1_000), (2_000_000, 0), (10, 0)])
def test_containment_against_brute_force(spark, monkeypatch, chars, shards):
    """One automaton, many of them, and look-ups of rare word runs beside them."""
    monkeypatch.setattr(automaton, "SHARD_CHARS", chars)
    monkeypatch.setattr(automaton, "SHARDS", shards)
    d = spark.createDataFrame(list(enumerate(CONTAINED)), "doc_id long, text string")
    p = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, text string")
    got = rows(relevance.containment_gold(p, d))
    assert got == rows(spark.createDataFrame(
        [(i, j) for i, a in enumerate(PASSAGES) for j, t in enumerate(CONTAINED) if None not in (a, t) and a in t], "a long, b long"))
    names = p.withColumn("item_id", F.concat(F.lit("p"), "item_id"))
    assert {(int(r["item_id"][1:]), r["doc_id"]) for r in relevance.containment_gold(names, d).collect()} == set(got)


def test_automata_leave_the_texts_where_they_are(tables):
    found = automaton.find_strings(
        tables.benchmark.select("item_id", F.col("text").alias("string")), tables.documents.select("doc_id", "text"), 1
    )
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_filter_values_equal_few(tables, monkeypatch):
    asked = tables.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.concat(F.lit("phishing critical machinery t1190 "), "text").alias("question"))
    profile = fp_model.fp_features(tables.incident, tables.asset)
    few = rows(fp_model.match_filters(asked, profile))
    monkeypatch.setattr(fp_model, "LISTED_VALUES", 1)
    many = fp_model.match_filters(asked, profile)
    assert rows(many.select("question_id", *fp_model.FILTER_FIELDS, "exposed_only")) == few


# heavy queries run jobs while planning; these stand for each family
PLANNED = [
    "kpi_09_top_assets", "kpi_14_critical_open_assets", "kpi_17_dashboard", "met_07_repeat_vulns",
    "met_10_watch_hits", "met_11_duplicates", "met_13_load_by_environment", "prf_03_key_relations",
    "aud_04_literal_findings", "trc_02_cited", "eve_08_sql_correctness", "mem_08_context_window",
    "ret_03_chunks", "ret_06_bm25_search", "ret_10_hybrid_search", "evr_03_containment_gold",
    "ml_08_selection_counts", "ml_09_most_recent", "sql_02_same_result", "can_01_canonicalise",
    "can_02_near_misses", "ml_02_stratified_split", "ml_10_selection_summary",
]


@pytest.mark.parametrize("name", PLANNED)
def test_no_crossing_steps(spark, name):
    plan = queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_small_sides_are_broadcast(spark, tables):
    """Neither the label nor the dictionary column is a shuffle key of the rows."""
    rows_ = fp_model.fp_features(tables.incident, tables.asset)
    plan = fp_model.stratified_split(rows_, "label", "incident_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [label" not in plan
    plan = queries()["aud_04_literal_findings"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin [table" not in plan


def test_pushdown(spark, tables):
    plan = tables.raw("lineitem")
    from wardlight.operators import kpi

    text = kpi.critical_open(tables.incident)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in text.split("ReadSchema")[-1]
    assert "PushedFilters: [" in text and plan is not None


def test_group_limit_before_shuffle(tables):
    from wardlight.operators.memory import context_window

    text = context_window(tables.message)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text
