"""RET-5..14, EVR-1, EVR-2."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.checks import check
from wardlight.checks.corpus import _CHUNKS
from wardlight.functions.vectors import l2
from wardlight.operators import fusion, lexical, neighbours, relevance
from wardlight.operators.corpus import chunks
from wardlight.plans.session import materialise, scratch_path
from wardlight.plans.sizing import spread

K = 4

_BM25 = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tk FROM documents),
dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT CAST(sum(dl) AS DOUBLE) FROM dl) / (SELECT count(*) FROM documents) AS avgdl),
tf AS (SELECT doc_id, tk, count(*) AS tf FROM tok GROUP BY doc_id, tk),
df AS (SELECT tk, count(*) AS df FROM tf GROUP BY tk),
raw AS (SELECT tk, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf0 FROM df CROSS JOIN st),
av AS (SELECT avg(idf0) AS a FROM raw),
idf AS (SELECT tk, df, CASE WHEN idf0 < 0 THEN 0.25 * a ELSE idf0 END AS idf FROM raw CROSS JOIN av)"""
_SEARCH = _BM25 + """,
qt AS (SELECT item_id, tk, count(*) AS qn FROM
  (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS tk FROM benchmark) GROUP BY item_id, tk),
sc AS (SELECT q.item_id, f.doc_id, sum(q.qn * i.idf * (f.tf * 2.5) / (f.tf + 1.5 * (0.25 + 0.75 * d.dl / s.avgdl))) AS score
  FROM qt q JOIN tf f ON q.tk = f.tk JOIN idf i ON i.tk = f.tk JOIN dl d ON d.doc_id = f.doc_id CROSS JOIN st s
  GROUP BY q.item_id, f.doc_id),
lex AS (SELECT item_id, doc_id, round(score, 6) AS score, rk FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM sc WHERE score > 0) WHERE rk <= 12)"""
_LETTERS = ", ".join(
    f"CAST(length(lower(text)) - length(replace(lower(text), '{c}', '')) AS DOUBLE)"
    for c in "abcdefghijklmnopqrstuvwxyz"
)
_NEAR = f"""dv AS (SELECT doc_id, [{_LETTERS}] AS v FROM documents), qv AS (SELECT item_id, [{_LETTERS}] AS v FROM benchmark),
ds AS (SELECT item_id, doc_id, round(1 - coalesce(list_cosine_similarity(q.v, d.v), 0), 6) AS distance FROM qv q CROSS JOIN dv d),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS rk FROM ds) WHERE rk <= 4)"""
_FUSED = """fu AS (SELECT item_id, doc_id, min(vr) AS vr, min(lr) AS lr FROM (
  SELECT item_id, doc_id, rk AS vr, NULL AS lr FROM near UNION ALL SELECT item_id, doc_id, NULL, rk FROM lex) GROUP BY 1, 2),
sm AS (SELECT *, coalesce(1.0 / CAST(60 + vr AS DOUBLE), 0) + coalesce(1.0 / CAST(60 + lr AS DOUBLE), 0) AS rrf FROM fu),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, vr NULLS LAST, lr NULLS LAST, doc_id) AS rk
  FROM sm) WHERE rk <= 4),
hits AS (SELECT t.item_id AS query_id, CAST(t.rk AS INTEGER) AS rank, t.doc_id AS chunk_id, round(t.rrf, 9) AS rrf, d.text, d.source,
  '' AS section, coalesce(round(n.distance, 3), -1.0) AS distance
  FROM top t JOIN documents d USING (doc_id) LEFT JOIN near n ON n.item_id = t.item_id AND n.doc_id = t.doc_id)"""
_GOLD = "gold AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _units(t):
    """Whole documents as retrieval units."""
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").alias("chunk_id"), "text", "source", F.lit("").alias("section")
    )


def _asked(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _index(t):
    return lexical.bm25_index(_units(t))


def _vectors(t):
    units = neighbours.embed(_units(t), neighbours.letter_profile)
    return neighbours.embed(_asked(t), neighbours.letter_profile), units


def _hybrid(t, index):
    asked, units = _vectors(t)
    return fusion.hybrid_search(asked, units, index, K)


@check("ret_05_postings", f"""WITH {_BM25}
SELECT doc_id AS chunk_id, dl AS length, tk AS token, tf FROM tf JOIN dl USING (doc_id)""")
def _(t):
    return _index(t).postings


@check("ret_05_terms", f"WITH {_BM25} SELECT tk AS token, df, round(idf, 9) AS idf FROM idf")
def _(t):
    return _index(t).terms.withColumn("idf", F.round("idf", 9))


@check("ret_06_bm25_search", f"""WITH {_SEARCH}
SELECT item_id AS query_id, doc_id AS chunk_id, score, CAST(rk AS INTEGER) AS rank FROM lex""")
def _(t):
    return lexical.bm25_search(_index(t), _asked(t), K)


@check("ret_07_knn", """
WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
 round(1 - list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS distance FROM embeddings q CROSS JOIN embeddings c)
SELECT query_id, chunk_id, round(distance + 0, 3) AS distance, CAST(rk AS INTEGER) AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rk FROM d) WHERE rk <= 5""")
def _(t):
    vectors = t.embeddings
    found = neighbours.knn(
        vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
        5,
    )
    return found.withColumn("distance", F.round("distance", 3))


@check("ret_08_rrf", f"""WITH {_SEARCH}, {_NEAR}, {_FUSED}
SELECT item_id AS query_id, doc_id AS chunk_id, round(rrf, 9) AS rrf, CAST(rk AS INTEGER) AS rank FROM top""")
def _(t):
    units = neighbours.embed(_units(t), neighbours.letter_profile)
    near = neighbours.knn(neighbours.embed(_asked(t), neighbours.letter_profile), units, K)
    fused = fusion.rrf(near, lexical.bm25_search(_index(t), _asked(t), K), K)
    return fused.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "rank")


@check("ret_09_hydrate_vectors_only", f"""WITH {_NEAR.replace("rk <= 4", "rk <= 3")}
SELECT item_id AS query_id, CAST(rk AS INTEGER) AS rank, doc_id AS chunk_id, d.source, md5(d.text) AS text_md5, round(distance, 3) AS distance
FROM near JOIN documents d USING (doc_id)""")
def _(t):
    units = neighbours.embed(_units(t), neighbours.letter_profile)
    asked = neighbours.embed(_asked(t), neighbours.letter_profile)
    return fusion.hybrid_search(asked, units, None, 3).select(
        "query_id", "rank", "chunk_id", "source", F.md5("text").alias("text_md5"), "distance"
    )


@check("ret_10_hybrid_search", f"WITH {_SEARCH}, {_NEAR}, {_FUSED} SELECT * FROM hits")
def _(t):
    return _hybrid(t, _index(t)).withColumn("rrf", F.round("rrf", 9))


@check("ret_11_l2", """
SELECT vec_id, p, round(x / n, 6) AS unit FROM (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS p,
 CAST(unnest(embedding) AS DOUBLE) AS x, sqrt(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)))) AS n
 FROM embeddings)""")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode(l2(F.col("embedding"))).alias("p", "unit")).withColumn(
        "unit", F.round("unit", 6)
    )


@check("ret_12_embed_letters", f"""
WITH v AS (SELECT doc_id, [{_LETTERS}] AS v FROM documents)
SELECT doc_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS p,
 round(unnest(v) / CASE WHEN list_sum(list_transform(v, lambda e: e * e)) > 0 THEN sqrt(list_sum(list_transform(v, lambda e: e * e))) ELSE 1 END, 6) AS x FROM v""")
def _(t):
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    vectors = neighbours.embed(docs, neighbours.letter_profile)
    return vectors.select("doc_id", F.posexplode("vector").alias("p", "x")).withColumn("x", F.round("x", 6))


@check("ret_12_embed_tfidf", """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower('passage: ' || text), '[a-z0-9]+')) AS tk FROM documents),
tf AS (SELECT doc_id, CAST('0x' || substr(md5(tk), 1, 8) AS BIGINT) % 256 AS slot, count(*) AS n FROM tok GROUP BY 1, 2),
df AS (SELECT slot, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) AS idf FROM tf GROUP BY 1),
w AS (SELECT doc_id, slot, n * idf AS w FROM tf JOIN df USING (slot)),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM w GROUP BY 1)
SELECT doc_id, CAST(slot AS INTEGER) AS p, round(w / len, 6) AS x FROM w JOIN l USING (doc_id) WHERE w <> 0""")
def _(t):
    docs = spread(t.documents.select("doc_id", "text"), "doc_id")
    vectors = neighbours.embed(docs, prefix="passage: ")
    return vectors.select("doc_id", F.posexplode("vector").alias("p", "x")).where("x <> 0").withColumn(
        "x", F.round("x", 6)
    )


@check("ret_13_evidence", f"""WITH {_SEARCH}, {_NEAR}, {_FUSED}
SELECT query_id, string_agg('[Fonte: ' || source || ' | Secao: ]' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS evidence
FROM hits GROUP BY 1""")
def _(t):
    return fusion.evidence(_hybrid(t, _index(t)))


_CHUNK_TERMS = _BM25.replace("FROM documents)", "FROM ch)").replace("count(*) FROM documents", "count(*) FROM ch").replace("doc_id", "chunk_id")


@check("ret_14_reindex", f"WITH RECURSIVE {_CHUNKS}, {_CHUNK_TERMS} SELECT tk AS token, df, round(idf, 9) AS idf FROM idf")
def _(t):
    path = scratch_path(t.spark, "index")
    fusion.reindex(t.documents, path)
    fusion.reindex(t.documents, path)
    index = lexical.load_index(t.spark, path)
    return index.terms.withColumn("idf", F.round("idf", 9))


@check("ret_14_reindex_chunks", f"WITH RECURSIVE {_CHUNKS} SELECT chunk_id, doc_id, source, section, md5(text) AS text_md5 FROM ch")
def _(t):
    path = scratch_path(t.spark, "index")
    fusion.reindex(t.documents, path)
    saved = t.spark.read.parquet(f"{path}/chunks")
    return saved.select("chunk_id", "doc_id", "source", "section", F.md5("text").alias("text_md5"))


@check("ret_14_reindex_postings", f"""WITH RECURSIVE {_CHUNKS}, {_CHUNK_TERMS}
SELECT chunk_id, dl AS length, tk AS token, tf FROM tf JOIN dl USING (chunk_id)""")
def _(t):
    path = scratch_path(t.spark, "index")
    fusion.reindex(t.documents, path)
    return lexical.load_index(t.spark, path).postings


# the same searches over the chunks of the documents
def _over_chunks(sql):
    for old, new in (
        ("FROM documents", "FROM ch"), ("JOIN documents", "JOIN ch"), ("'' AS section", "d.section"),
        ("doc_id", "chunk_id"), ("| Secao: ]'", "| Secao: ' || section || ']'"),
    ):
        sql = sql.replace(old, new)
    return sql


_CHUNK_SEARCH, _CHUNK_NEAR, _CHUNK_FUSED = map(_over_chunks, (_SEARCH, _NEAR, _FUSED))


def _chunk_hits(t):
    units = materialise(chunks(t.documents))
    index = lexical.bm25_index(units)
    vectors = neighbours.embed(units, neighbours.letter_profile)
    asked = neighbours.embed(_asked(t), neighbours.letter_profile)
    return fusion.hybrid_search(asked, vectors, index, K)


@check("ret_06_chunk_search", f"""WITH RECURSIVE {_CHUNKS}, {_CHUNK_SEARCH}
SELECT item_id AS query_id, chunk_id, score, CAST(rk AS INTEGER) AS rank FROM lex""")
def _(t):
    return lexical.bm25_search(lexical.bm25_index(chunks(t.documents)), _asked(t), K)


@check("ret_10_chunk_hybrid", f"""WITH RECURSIVE {_CHUNKS}, {_CHUNK_SEARCH}, {_CHUNK_NEAR}, {_CHUNK_FUSED}
SELECT query_id, rank, chunk_id, source, section, md5(text) AS text_md5, distance FROM hits""")
def _(t):
    return _chunk_hits(t).select(
        "query_id", "rank", "chunk_id", "source", "section", F.md5("text").alias("text_md5"), "distance"
    )


@check("ret_13_chunk_evidence", f"""WITH RECURSIVE {_CHUNKS}, {_CHUNK_SEARCH}, {_CHUNK_NEAR}, {_CHUNK_FUSED}
SELECT query_id, string_agg('[Fonte: ' || source || ' | Secao: ' || section || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS evidence
FROM hits GROUP BY 1""")
def _(t):
    return fusion.evidence(_chunk_hits(t))


def _hits_as_docs(hits):
    return hits.select("query_id", F.col("chunk_id").alias("doc"), "rank", "distance")


_CASES = """first AS (SELECT query_id, chunk_id AS top1_doc, round(distance, 3) AS top1_distance FROM {hits} WHERE rank = 1),
ranked AS (SELECT g.item_id AS query_id, min(CASE WHEN h.chunk_id = g.doc_id THEN h.rank END) AS rank
 FROM gold g LEFT JOIN {hits} h ON h.query_id = g.item_id AND h.rank <= 3 GROUP BY 1),
cases AS (SELECT query_id, rank, top1_doc, top1_distance, coalesce(rank = 1, false) AS hit1, coalesce(rank <= 3, false) AS hit3,
 coalesce(round(1.0 / CAST(rank AS DOUBLE), 6), 0) AS reciprocal FROM ranked LEFT JOIN first USING (query_id))"""


def _golden(t):
    return relevance.containment_gold(t.benchmark, t.documents).select(
        F.col("item_id").alias("query_id"), F.col("doc_id").alias("doc")
    )


@check("evr_01_rank_cases", f"WITH {_SEARCH}, {_NEAR}, {_FUSED}, {_GOLD}, {_CASES.format(hits='hits')} SELECT * FROM cases")
def _(t):
    cases = relevance.rank_cases(_hits_as_docs(_hybrid(t, _index(t))), _golden(t))
    return cases.withColumn("reciprocal", F.round("reciprocal", 6))


@check("evr_02_retrieval_report", f"""WITH {_SEARCH}, {_NEAR}, {_FUSED}, {_GOLD},
vec AS (SELECT item_id AS query_id, doc_id AS chunk_id, CAST(rk AS INTEGER) AS rank, distance FROM near),
{_CASES.format(hits='hits')},
{_CASES.format(hits='vec').replace('first AS', 'vfirst AS').replace('JOIN first', 'JOIN vfirst').replace('ranked AS', 'vranked AS').replace('FROM ranked', 'FROM vranked').replace('cases AS', 'vcases AS')},
al AS (SELECT 'hybrid' AS model, * FROM cases UNION ALL SELECT 'vectors', * FROM vcases)
SELECT model, (SELECT count(*) FROM documents) AS chunks, count(*) AS cases, round(avg(CASE WHEN hit1 THEN 1 ELSE 0 END), 4) AS hit1, round(avg(CASE WHEN hit3 THEN 1 ELSE 0 END), 4) AS hit3,
 round(avg(reciprocal), 4) AS mrr, round(avg(top1_distance), 3) AS mean_top1_distance FROM al GROUP BY 1""")
def _(t):
    gold = materialise(_golden(t))
    asked, units = _vectors(t)
    near = materialise(neighbours.knn(asked, units, K))
    both = [
        relevance.rank_cases(_hits_as_docs(fusion.fused(asked, near, index, K)), gold).withColumn("model", F.lit(model))
        for model, index in (("hybrid", _index(t)), ("vectors", None))
    ]
    return relevance.retrieval_report(both[0].unionByName(both[1]), t.documents.count())
