"""EVE-1..8."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.operators import evaluation as e

_SCORED = """s AS (SELECT *, round(CASE WHEN n_facts > 0 THEN least(1.0, CAST(n_covered AS DOUBLE) / n_facts) ELSE 0.0 END, 2) AS coverage,
 round(CASE WHEN claims IS NULL THEN NULL WHEN claims <= 0 THEN 1.0 ELSE least(1.0, CAST(supported AS DOUBLE) / claims) END, 2) AS faithfulness,
 CASE WHEN TRY_CAST(relevance_text AS DOUBLE) IS NOT NULL THEN round(greatest(0.0, least(1.0, TRY_CAST(relevance_text AS DOUBLE))), 2) END AS rel FROM run_verdict)"""
_CASES = f"""{_SCORED}, c AS (SELECT case_id, count(*) AS runs, avg(coverage) AS coverage, min(coverage) AS worst, avg(grade) AS grade,
 avg(seconds) AS seconds, bool_or(hallucinated = 1) AS hallucinated, avg(faithfulness) AS faithfulness, avg(rel) AS relevance, avg(sql_correct) AS sql_correct,
 arg_max(routed, run) AS routed, arg_max(cited, run) AS cited_raw, max(run) AS last_run FROM s GROUP BY 1),
cc AS (SELECT c.*, (SELECT s.cited FROM s WHERE s.case_id = c.case_id AND s.run = c.last_run) AS cited FROM c)"""


@check("eve_01_coverage", over("run_verdict", f"WITH {_SCORED} SELECT case_id, run, CAST(coverage AS DOUBLE) AS coverage FROM s"))
def _(t):
    return e.with_scores(t.run_verdict).select("case_id", "run", "coverage")


@check("eve_02_faithfulness", over("run_verdict", f"WITH {_SCORED} SELECT case_id, run, CAST(faithfulness AS DOUBLE) AS faithfulness FROM s"))
def _(t):
    return e.with_scores(t.run_verdict).select("case_id", "run", "faithfulness")


@check("eve_03_relevance", over("run_verdict", f"WITH {_SCORED} SELECT case_id, run, CAST(rel AS DOUBLE) AS relevance FROM s"))
def _(t):
    return e.with_scores(t.run_verdict).select("case_id", "run", "relevance")


@check("eve_04_per_case", over("run_verdict", f"""WITH {_CASES}
SELECT case_id, runs, round(coverage, 3) AS coverage, CAST(worst AS DOUBLE) AS worst, round(grade, 3) AS grade,
 round(seconds, 3) AS seconds, hallucinated, round(faithfulness, 3) AS faithfulness,
 round(relevance, 3) AS relevance, round(sql_correct, 3) AS sql_correct, routed, cited FROM cc"""))
def _(t):
    cases = e.per_case(e.with_scores(t.run_verdict))
    rounded = ["coverage", "grade", "seconds", "faithfulness", "relevance", "sql_correct"]
    return cases.withColumns({c: F.round(c, 3) for c in rounded})


@check("eve_05_overall", over("run_verdict", f"""WITH {_CASES}
SELECT count(*) AS cases, round(avg(coverage), 3) AS coverage, round(avg(routed), 3) AS routing, round(avg(cited), 3) AS citation,
 round(avg(CASE WHEN hallucinated THEN 1 ELSE 0 END), 3) AS hallucination, round(avg(grade), 2) AS grade,
 round(avg(seconds), 1) AS latency, round(avg(faithfulness), 3) AS faithfulness, round(avg(relevance), 3) AS relevance,
 round(avg(sql_correct), 3) AS sql_correct FROM cc"""))
def _(t):
    return e.overall(e.per_case(e.with_scores(t.run_verdict)))


def history(t):
    """One evaluation run per day of events."""
    return t.events.groupBy(F.to_date("ts").alias("ran_at")).agg(
        F.count("*").alias("cases"), F.round(F.avg("value"), 3).alias("coverage")
    )


@check("eve_06_trend", """
WITH h AS (SELECT CAST(ts AS DATE) AS ran_at, count(*) AS cases, round(avg(value), 3) AS coverage FROM events GROUP BY 1)
SELECT ran_at, cases, coverage, round(coverage - lag(coverage) OVER (ORDER BY ran_at), 3) AS change
FROM h ORDER BY ran_at DESC LIMIT 5""")
def _(t):
    return e.trend(history(t))


@check("eve_07_uncovered", over("run_verdict", """
SELECT case_id, 'fact ' || CAST(f AS VARCHAR) AS fact FROM run_verdict, unnest(generate_series(1, n_facts)) AS g(f)
WHERE f > n_covered"""))
def _(t):
    runs = t.run_verdict.withColumn(
        "missing",
        F.when(
            F.col("n_facts") > F.col("n_covered"),
            F.transform(
                F.sequence(F.col("n_covered") + 1, F.col("n_facts")),
                lambda i: F.concat(F.lit("fact "), i.cast("string")),
            ),
        ),
    )
    return e.uncovered(runs)


def result_rows(t):
    """Stored results: every order is a case, its lines the reference rows; the
    generated side has them in other letter case and number format, loses lines
    of quantity 50 and never ran for every seventh order."""
    line = t.lineitem.select(
        F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_returnflag", "l_quantity"
    )
    reference = line.select(
        "case_id", F.lit("reference").alias("side"),
        F.array(F.col("l_linenumber").cast("string"), F.col("l_returnflag"), F.col("l_quantity").cast("string")).alias("row"),
    )
    generated = line.where("l_quantity < 50 and case_id % 7 <> 0").select(
        "case_id", F.lit("generated").alias("side"),
        F.array(
            F.col("l_linenumber").cast("double").cast("string"),
            F.concat(F.lit(" "), F.lower("l_returnflag")),
            F.col("l_quantity").cast("decimal(12,4)").cast("string"),
        ).alias("row"),
    )
    return reference.unionByName(generated)


@check("eve_08_sql_correctness", """
WITH c AS (SELECT o_orderkey AS case_id, o_orderkey % 7 <> 0 AS ran FROM orders),
r AS (SELECT l_orderkey AS case_id, max(l_quantity) AS most FROM lineitem GROUP BY 1)
SELECT case_id, CASE WHEN NOT ran THEN NULL WHEN most >= 50 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS sql_correct
FROM c LEFT JOIN r USING (case_id)""")
def _(t):
    # orders without lines are cases whose two sides are empty
    cases = t.orders.select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 7 != 0).alias("ran"))
    return e.sql_correctness(cases, result_rows(t))
