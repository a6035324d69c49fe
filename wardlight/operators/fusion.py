"""Rank fusion, hybrid search, hydration and evidence text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.corpus import chunks as make_chunks
from wardlight.operators.lexical import LexicalIndex, bm25_index, bm25_search, save_index
from wardlight.operators.neighbours import knn
from wardlight.plans.ordering import top_per_group
from wardlight.plans.session import materialise
from wardlight.plans.sizing import broadcast_if_small

RANK_OFFSET = 60
DEFAULT_K = 4


def rrf(vector_hits: DataFrame, lexical_hits: DataFrame | None, k: int) -> DataFrame:
    """Best ``k`` chunks per query by the sum of 1 / (60 + rank) over the lists;
    ties go to the better vector rank, then the better lexical rank."""
    lists = vector_hits.select(
        "query_id", "chunk_id", F.col("rank").alias("vector_rank"),
        F.lit(None).cast("int").alias("lexical_rank"),
    )
    if lexical_hits is not None:
        lists = lists.unionByName(
            lexical_hits.select(
                "query_id", "chunk_id", F.lit(None).cast("int").alias("vector_rank"),
                F.col("rank").alias("lexical_rank"),
            )
        )

    def part(name):
        return F.coalesce(1.0 / (RANK_OFFSET + F.col(name)), F.lit(0.0))

    fused = (
        lists.groupBy("query_id", "chunk_id")
        .agg(F.min("vector_rank").alias("vector_rank"), F.min("lexical_rank").alias("lexical_rank"))
        .withColumn("rrf", part("vector_rank") + part("lexical_rank"))
    )
    order = [
        F.desc("rrf"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("lexical_rank"), "chunk_id",
    ]
    return top_per_group(fused, ["query_id"], order, k, "rank")


def hydrate(hits: DataFrame, distances: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with text, source and section; distance to 3 decimals, -1 for hits
    that only the lexical list found.

    The hits are few against the chunks: their ids pick the chunks first, so
    only texts that were hit are moved.
    """
    hits = materialise(hits.drop("distance"))
    wanted = broadcast_if_small(hits.select("chunk_id").distinct())
    near = distances.select("query_id", "chunk_id", "distance")
    about = chunks.select("chunk_id", "text", "source", "section").join(
        wanted, "chunk_id", "left_semi"
    )
    return (
        hits.join(near, ["query_id", "chunk_id"], "left")
        .join(about, "chunk_id", "left")
        .select(
            "query_id", "rank", "chunk_id", "rrf",
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("source", F.lit("desconhecida")).alias("source"),
            F.coalesce("section", F.lit("")).alias("section"),
            F.coalesce(F.round("distance", 3), F.lit(-1.0)).alias("distance"),
        )
    )


def hybrid_search(
    queries: DataFrame, chunks: DataFrame, index: LexicalIndex | None, k: int = DEFAULT_K
) -> DataFrame:
    """Vector and lexical search fused. ``queries`` is (query_id, text, vector),
    ``chunks`` (chunk_id, text, source, section, vector); without a lexical
    index the vector list decides alone."""
    near = materialise(knn(queries, chunks, k))  # read by the fusion and for distances
    return hydrate(fused(queries, near, index, k), near, chunks)


def fused(queries: DataFrame, near: DataFrame, index: LexicalIndex | None, k: int) -> DataFrame:
    """The best ``k`` chunks of a vector search (``near``) and a lexical one, with the
    vector distance to 3 decimals (-1 where only the lexical list found it), without texts."""
    lexical = None if index is None else bm25_search(index, queries, k)
    hits = rrf(near, lexical, k)
    distances = near.select("query_id", "chunk_id", "distance")
    return hits.join(distances, ["query_id", "chunk_id"], "left").withColumn(
        "distance", F.coalesce(F.round("distance", 3), F.lit(-1.0))
    )


def evidence(hits: DataFrame) -> DataFrame:
    """One text per query: its hits in rank order under a source header. A query
    has at most k hits."""
    block = F.concat(
        F.lit("[Fonte: "), "source", F.lit(" | Secao: "), "section", F.lit("]\n"), "text"
    )
    return hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))),
                lambda h: h["block"],
            ),
            "\n\n",
        ).alias("evidence")
    )


def reindex(docs: DataFrame, path: str, **options) -> int:
    """Rebuild chunks and lexical index under ``path``; returns the number of
    chunks. Running it again gives the same tables."""
    spark = docs.sparkSession
    make_chunks(docs, **options).write.mode("overwrite").parquet(f"{path}/chunks")
    saved = spark.read.parquet(f"{path}/chunks")
    save_index(bm25_index(saved), path)
    return saved.count()
