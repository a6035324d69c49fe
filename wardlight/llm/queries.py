"""Queries of the operators, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import (
    alignment, decontaminate, jaccard, language, lines, nearest, packing, periodic, pii, quality, simhash, suffix_array, suffix_trees,
)
from wardlight.llm.common import prepared, read, texts_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepared(spark)
            return fn(lambda table: read(spark, sf_dir, table))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op1_pii")
def op1(table):
    return pii.find_pii(table("documents"))


@query("op2_language_score")
def op2(table):
    return language.scored(table("documents"))


@query("op3_jaccard_join")
def op3(table):
    return jaccard.link_classes(table("documents"))


@query("op4_quality")
def op4(table):
    return quality.scored(table("documents"), table("labels"))


@query("op5_voronoi_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op5(table):
    return nearest.top_k(table("embeddings"), 20, 20)


@query("op6_decontamination")
def op6(table):
    return decontaminate.find_leaks(table("documents"), table("benchmark"))


@query("op7_packing")
def op7(table):
    return packing.packed(table("documents"))


@query("op8_suffix_trees")
def op8(table):
    found = suffix_trees.remove_repeats(table("documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_suffix_array")
def op10(table):
    found = suffix_array.remove_repeats(table("documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id <> b.last_doc AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op9(table):
    docs = texts_of(table("documents"))
    cleaned = lines.LineIndex.build(docs).clean(docs, counts=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op11_periodic_runs")
def op11(table):
    found = periodic.find_runs(table("documents"), periodic.planted_order)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_tokenizer_alignment")
def op12(table):
    return alignment.align(table("documents"), digests=True).withColumnRenamed("groups", "groups_sha256")


@query("op13_simhash_classes")
def op13(table):
    return simhash.near_classes(table("documents"))
