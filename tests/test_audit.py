import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from wardlight.operators import adhoc, audit
from wardlight.operators.canon import canonicalise, near_misses, scope_dictionary

ENUMS = [
    ("incident", "status", "Parked"), ("incident", "status", "Done"),
    ("vulnerability", "status", "Parker"), ("vulnerability", "status", "Waived"),
    ("incident", "kind", "Tailgating"), ("incident", "severity", "Grave"),
    ("asset", "os", "Plan 9"),
]


@pytest.fixture
def enums(frame):
    return frame(ENUMS, "table string, column string, value string")


def verdict(frame, sql):
    return frame([(sql,)], "s string").select(audit.read_only_verdict(F.col("s"))).first()[0]


@pytest.mark.parametrize("sql", [
    "TRUNCATE TABLE asset", "WITH a AS (SELECT 1) SELECT * FROM a; SELECT 2", "EXPLAIN SELECT 1",
    "WITH gone AS (DELETE FROM asset RETURNING *) SELECT * FROM gone", "select * from glob('/etc/*')",
    "SELECT kind FROM incident UNION SELECT * FROM read_parquet('x')", "SHOW TABLES", "", "selection",
    "SELECT * FROM parquet.`/data/x`", "SELECT * FROM csv . `s3://b/x`", "SELECT n FROM `file:/etc/hosts`",
    "SELECT reflect('java.lang.Runtime', 'x')", "SELECT java_method('a', 'b')",
    "SELECT TRANSFORM(a, b) USING 'cat' AS c FROM incident",
])
def test_guard_blocks(frame, sql):
    assert verdict(frame, sql) != "ok"


def test_guard_accepts_and_orders_reasons(frame):
    assert verdict(frame, "SELECT COUNT(*) FROM incident;; ") == "ok"
    assert verdict(frame, "  with x as (select 1) select * from x  ") == "ok"
    assert verdict(frame, "DROP TABLE a; DROP TABLE b") == "not_select"
    assert verdict(frame, "SELECT 1; DROP TABLE b") == "several_statements"


def test_run_select(spark, frame):
    t = {"numbers": frame([(i,) for i in range(600)], "n int")}
    assert adhoc.run_select(spark, "SELECT n FROM numbers;", t).count() == 600
    assert adhoc.run_select(spark, "SELECT n FROM numbers", t, 500).count() == 500
    assert adhoc.run_select(spark, "WITH x AS (SELECT n FROM numbers) SELECT max(n) AS m FROM x", t).first()["m"] == 599
    with pytest.raises(adhoc.BlockedSQLError):
        adhoc.run_select(spark, "SELECT 1; SELECT 2", t)
    frame([(1,)], "n int").createOrReplaceTempView("not_given")
    with pytest.raises(adhoc.BlockedSQLError):
        adhoc.run_select(spark, "SELECT * FROM not_given", t)
    with pytest.raises(adhoc.BlockedSQLError):
        adhoc.run_select(spark, "SELECT * FROM numbers WHERE n IN (SELECT n FROM not_given)", t)
    with pytest.raises(adhoc.BlockedSQLError):
        adhoc.run_select(spark, "WITH x AS (SELECT * FROM not_given) SELECT (SELECT max(n) FROM x) AS m FROM numbers", t)


def test_run_select_leaves_the_callers_views(spark, frame):
    frame([(7,)], "n int").createOrReplaceTempView("numbers")
    t = {"numbers": frame([(1,)], "n int"), "letters": frame([("a",)], "c string")}
    found = adhoc.run_select(spark, "SELECT n, c FROM numbers, letters", t)
    assert found.collect() == [(1, "a")]
    assert spark.table("numbers").first()["n"] == 7
    assert not spark.catalog.tableExists("letters")
    spark.catalog.dropTempView("numbers")


def ratio_over(rows_counted):
    """Share of late night calls among ``rows_counted``."""
    return f"SELECT AVG(x), SUM(CASE WHEN night = 'y' AND late = 'y' THEN 1 ELSE 0 END) * 1.0 / {rows_counted} AS share FROM calls"


@pytest.mark.parametrize("question,sql,wide,no_division", [
    ("percentual de noite", ratio_over("COUNT(*)"), True, False),
    ("percentual de noite", ratio_over("COUNT( * )"), True, False),
    ("percentual de noite", ratio_over("COUNT(night)"), False, False),
    ("percentual de noite", ratio_over("COUNT(*)").replace(" AND late = 'y'", ""), False, False),
    ("a proporção de noite", "SELECT night, COUNT(*) FROM calls GROUP BY night", False, True),
    ("how many by night", "SELECT night, COUNT(*) FROM calls GROUP BY night", False, False),
])
def test_lints(frame, question, sql, wide, no_division):
    df = frame([(question, sql)], "question string, sql_text string")
    assert audit.lint_denominator(df).first()["wide_denominator"] is wide
    assert audit.lint_ratio(df).first()["no_division"] is no_division


def findings(frame, enums, sql):
    df = frame([(1, sql)], "query_id long, sql_text string")
    return {(r["literal"], r["finding"], r["suggestion"]) for r in audit.literal_findings(df, enums).collect()}


@pytest.mark.parametrize("sql,expected", [
    # the table is known through its alias: its own dictionary decides
    ("SELECT v.vuln_id FROM vulnerability AS v WHERE v.status = 'wAIVED'", {("wAIVED", "case", "Waived")}),
    ("SELECT v.vuln_id FROM vulnerability AS v WHERE v.status = 'Parked'", {("Parked", "near", "Parker")}),
    ("SELECT MAX(n) FROM incident x WHERE x.status = 'Parker' OR x.status = 'Done'", {("Parker", "near", "Parked")}),
    # two literals of one statement
    ("SELECT kind FROM incident WHERE severity = 'GRAVE' OR kind = 'tailgating'",
     {("GRAVE", "case", "Grave"), ("tailgating", "case", "Tailgating")}),
    # without a qualifier any table's values count, and a near miss is not claimed
    ("SELECT kind FROM incident WHERE status = 'waived'", {("waived", "case", "Waived")}),
    ("SELECT kind FROM incident WHERE status = 'Donne'", set()),
    # values as they should be, and columns without a dictionary
    ("SELECT kind FROM incident x WHERE x.status = 'Done' AND x.owner = 'done'", set()),
])
def test_literal_findings(frame, enums, sql, expected):
    assert findings(frame, enums, sql) == expected


def test_literals_are_found_in_one_search(frame, enums):
    sql = "SELECT 1 FROM incident i WHERE i.kind   =\t'tailgating' OR (severity='GRAVE') OR x.status = 'a = b' OR i.status='parkeR' OR i.kind = ''"
    found = audit.literal_findings(frame([(1, sql)], "query_id long, sql_text string"), enums)
    got = {(r["pos"], r["table"], r["column"], r["literal"], r["finding"], r["suggestion"]) for r in found.collect()}
    assert got == {
        (0, "incident", "kind", "tailgating", "case", "Tailgating"), (1, None, "severity", "GRAVE", "case", "Grave"),
        (3, "incident", "status", "parkeR", "near", "Parked"),
    }
    # the statement is searched for comparisons once; the other searches are for tables
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(sql_text") - plan.count(audit.SOURCE + ", ") == 1


def test_canonicalise_and_near_misses(frame, enums):
    df = frame([("done",), ("Done",), ("Dome",), ("unheard of",), (None,)], "status string")
    got = [r[0] for r in canonicalise(df, "incident", "status", enums).collect()]
    assert sorted(map(str, got)) == ["Dome", "Done", "Done", "None", "unheard of"]
    near = near_misses(df, "incident", "status", enums).collect()
    assert [(r["value"], r["suggestion"]) for r in near] == [("Dome", "Done")]


def test_scope_dictionary(enums):
    rows = {r["column"]: r for r in scope_dictionary(enums).collect()}
    assert rows["kind"]["only_table"] == "incident"
    assert rows["status"]["only_table"] is None
    assert rows["status"]["allowed"] == ["Done", "Parked", "Parker", "Waived"]


def test_extract_json(frame):
    schema = StructType().add("a", IntegerType()).add("b", StringType())
    rows = [('{"a": 1, "b": "x"}',), ('here {"a": 2,\n "b": "{y}"} end',), ("none",), ("{broken",), ('{"a": 1',), ("{bad}",)]
    got = audit.extract_json(frame(rows, "text string"), schema).collect()
    assert [r["has_json"] for r in got] == [True, True, False, False, False, False]
    assert got[1]["parsed"]["b"] == "{y}" and got[2]["parsed"] is None


def test_retry_summary(frame):
    rows = [
        (1, 1, True, None), (2, 1, False, "json"), (2, 2, True, None),
        (3, 1, False, "a"), (3, 2, False, "b"), (3, 3, False, "c"), (3, 4, True, None),
    ]
    got = {r["query_id"]: r for r in audit.retry_summary(frame(rows, "query_id long, attempt long, ok boolean, reason string")).collect()}
    assert (got[1]["attempts"], got[1]["self_corrected"], got[1]["failed"]) == (1, False, False)
    assert (got[2]["attempts"], got[2]["self_corrected"], got[2]["reasons"]) == (2, True, "json")
    assert (got[3]["failed"], got[3]["reasons"]) == (True, "a; b; c")
    assert [got[i]["logged"] for i in (1, 2, 3)] == [1, 2, 4]


def test_same_result(frame):
    a = frame([(1, "X", 2.0), (2, "y", 3.0), (2, "y", 3.0)], "a int, b string, c double")
    b = frame([("2.0", "Y ", "3"), ("1", "x", "2.001"), ("2", "y", "3.00")], "p string, q string, r string")
    once = frame([("2.0", "Y", "3"), ("1", "x", "2")], "p string, q string, r string")
    for left, right, same in ((a, b, True), (b, a, True), (a, once, False), (once, a, False), (a.limit(0), b.limit(0), True)):
        assert adhoc.same_result(left, right).first()["same"] is same


def test_derive_facts(frame):
    templates = frame([(1, "{n} incidents, {n} of {m}"), (1, "{gone} {n}"), (2, "{n}")], "case_id long, template string")
    values = frame([(1, "n", "356"), (1, "m", "400")], "case_id long, name string, value string")
    fixed = frame([(2, "7 days")], "case_id long, fact string")
    got = {(r[0], r[1]) for r in adhoc.derive_facts(templates, values, fixed).collect()}
    assert got == {(1, "356 incidents, 356 of 400"), (1, "{gone} {n}"), (2, "{n}"), (2, "7 days")}
