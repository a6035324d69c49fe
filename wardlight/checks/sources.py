"""SRC-1..8."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.views_sql import over
from wardlight.plans.session import scratch_path
from wardlight.plans.sizing import spread
from wardlight.sources import files, journal, kdd, tables


def _three(t):
    return {
        n: d.select(*[c.split()[0] for c in tables.SCHEMAS[n].split(", ")])
        for n, d in (("asset", t.asset), ("incident", t.incident), ("vulnerability", t.vulnerability))
    }


def _columns(name):
    return ", ".join(c.split()[0] for c in tables.SCHEMAS[name].split(", "))


def _register(name):
    """Both ways of loading, compared table by table."""

    @check(f"src_01_load_{name}", over(name, f"SELECT {_columns(name)} FROM {name}"))
    def _(t):
        path = scratch_path(t.spark, "csv")
        tables.save_tables(_three(t), path, "csv")
        return tables.load_tables(t.spark, path, "csv", views=False)[name]

    @check(f"src_02_refresh_{name}", over(name, f"SELECT {_columns(name)} FROM {name}"))
    def _(t):
        source, target = scratch_path(t.spark, "csv"), scratch_path(t.spark, "tables")
        tables.save_tables(_three(t), source, "csv")
        tables.refresh_tables(t.spark, source, target)
        return tables.refresh_tables(t.spark, source, target)[name]


for _name in ("asset", "incident", "vulnerability"):
    _register(_name)


@check("src_03_read_corpus", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text || chr(10)) AS text_md5 FROM documents")
def _(t):
    """Documents written as one file each, read back as a corpus."""
    docs = t.documents.select("doc_id", F.col("text").alias("value"))
    folders = files.write_corpus(spread(docs, "doc_id"), scratch_path(t.spark, "docs"))
    return files.read_corpus(t.spark, folders, "*.txt").select(
        F.regexp_extract("path", r"doc_id=(\d+)[/.]", 1).alias("doc_id"), F.md5("text").alias("text_md5")
    )


def connections(t):
    """Connection records in the KDD layout drawn from order lines."""
    return t.lineitem.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        *[_kdd_column(name, i) for i, name in enumerate(kdd.FEATURES)],
        F.when(
            (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.07), F.lit("neptune")
        ).otherwise("normal").alias("label"),
        (F.col("l_linenumber") % 22).cast("int").alias("difficulty"),
    )


def _kdd_column(name, i):
    if name == "protocol_type":
        return F.col("l_returnflag").alias(name)
    if name == "flag":
        return F.col("l_linestatus").alias(name)
    if name == "service":
        return F.concat(F.lit("svc-"), (F.col("l_partkey") % 20).cast("string")).alias(name)
    base = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i % 4]
    return (F.col(base) * (1 + i // 4)).cast("double").alias(name)


@check("src_04_read_kdd", """
SELECT l_returnflag AS protocol_type, l_linestatus AS flag, label, CASE WHEN label = 'normal' THEN 0 ELSE 1 END AS attack,
 count(*) AS n, round(sum(l_quantity), 2) AS duration FROM (SELECT *, CASE WHEN l_quantity > 30 AND l_discount < 0.07 THEN 'neptune' ELSE 'normal' END AS label FROM lineitem)
GROUP BY 1, 2, 3, 4""")
def _(t):
    path = scratch_path(t.spark, "kdd")
    connections(t).drop("row_id").write.csv(path, header=False)
    return (
        kdd.read_kdd(t.spark, path)
        .groupBy("protocol_type", "flag", "label", "attack")
        .agg(F.count("*").alias("n"), F.round(F.sum("duration"), 2).alias("duration"))
    )


@check("src_05_read_golden", """
SELECT CAST(item_id AS VARCHAR) AS id, text AS pergunta, CASE WHEN item_id % 2 = 0 THEN 'sql' ELSE 'rag' END AS tipo,
 CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS n_facts FROM benchmark""")
def _(t):
    """Golden sets of at most twenty cases each, written one object per line."""
    path = scratch_path(t.spark, "golden")
    case = F.struct(
        F.col("item_id").cast("string").alias("id"),
        F.col("text").alias("pergunta"),
        F.when(F.col("item_id") % 2 == 0, "sql").otherwise("rag").alias("tipo"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a fact"))).alias("fatos"),
    )
    sets = t.benchmark.groupBy(F.floor(F.col("item_id") / 20).alias("set")).agg(
        F.collect_list(case).alias("casos")
    )
    sets.select(F.to_json(F.struct("casos")).alias("value")).write.text(path)
    return files.read_golden(t.spark, path, one_object=False).select(
        "id", "pergunta", "tipo", F.coalesce(F.size("fatos"), F.lit(0)).alias("n_facts")
    ).withColumn("n_facts", F.greatest("n_facts", F.lit(0)))


@check("src_06_append_history", """
SELECT CAST(day(ts) AS INTEGER) AS runs, count(*) AS cases, round(avg(value), 3) AS coverage FROM events GROUP BY 1
UNION ALL SELECT CAST(day(ts) AS INTEGER), count(*), round(avg(value), 3) FROM events GROUP BY 1""")
def _(t):
    path = scratch_path(t.spark, "history")
    if files.read_history(t.spark, path).count():
        raise AssertionError("a missing history must be empty")
    rows = t.events.groupBy(F.dayofmonth("ts").alias("runs")).agg(
        F.count("*").alias("cases"), F.round(F.avg("value"), 3).alias("coverage")
    )
    files.append_history(rows, path)
    files.append_history(rows, path)
    return files.read_history(t.spark, path).select("runs", "cases", "coverage")


def raw_calls(t):
    """Journal rows as first reported: labels missing here and there."""
    c = t.llm_call
    return c.withColumns({
        "request_id": F.when(F.col("call_id") % 10 == 0, F.lit(None)).otherwise(F.col("request_id").cast("string")),
        "agent": F.when(F.col("call_id") % 7 == 0, "").otherwise(F.col("agent")),
        "stage": F.when(F.col("call_id") % 9 == 0, F.lit(None)).otherwise(F.col("stage")),
        "duration_ms": F.col("duration_ms") * 1.37,
        "succeeded": F.col("success") == 1,
        "error": F.repeat("error", 6),
    })


@check("src_07_normalise_calls", over("llm_call", """
SELECT call_id, CASE WHEN call_id % 10 = 0 THEN '—' ELSE CAST(request_id AS VARCHAR) END AS request_id,
 CASE WHEN call_id % 7 = 0 THEN 'sistema' ELSE agent END AS agent, CASE WHEN call_id % 9 = 0 THEN 'llm' ELSE stage END AS stage,
 round(duration_ms * 1.37, 1) AS duration_ms, success, prompt_tokens, completion_tokens, substr(repeat(error, 6), 1, 300) AS error FROM llm_call"""))
def _(t):
    return journal.normalise_calls(raw_calls(t)).drop("created_at", "model")


@check("src_08_metrics_matrix", over("llm_call", """
WITH m AS (SELECT model, CAST(count(*) AS VARCHAR) AS calls, CAST(max(duration_ms) AS VARCHAR) AS slowest,
 CASE WHEN model = 'model-1' THEN NULL ELSE CAST(min(call_id) AS VARCHAR) END AS first_id FROM llm_call GROUP BY 1),
l AS (SELECT model, 'calls' AS metric, calls AS v FROM m UNION ALL SELECT model, 'slowest', slowest FROM m UNION ALL SELECT model, 'first_id', first_id FROM m)
SELECT metric, coalesce(max(CASE WHEN model = 'model-0' THEN v END), '—') AS "model-0", coalesce(max(CASE WHEN model = 'model-1' THEN v END), '—') AS "model-1",
 coalesce(max(CASE WHEN model = 'model-2' THEN v END), '—') AS "model-2" FROM l GROUP BY 1"""))
def _(t):
    per_model = t.llm_call.groupBy("model").agg(
        F.count("*").alias("calls"), F.max("duration_ms").alias("slowest"), F.min("call_id").alias("first_id")
    ).withColumn("first_id", F.when(F.col("model") != "model-1", F.col("first_id")))
    return journal.metrics_matrix(per_model, ["model-0", "model-1", "model-2"])
