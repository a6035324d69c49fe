"""Retrieval scoring against expected documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.functions.text import tokens
from wardlight.plans.session import materialise
from wardlight.plans import automaton
from wardlight.plans.sizing import broadcast_if_small, spread

GRAM = 4


def rank_cases(hits: DataFrame, golden: DataFrame, k: int = 3) -> DataFrame:
    """Per case: best rank of an expected document in the top ``k``, hit@1,
    hit@3, reciprocal rank and distance of the top hit. ``hits`` is (query_id,
    doc, rank, distance), ``golden`` (query_id, doc)."""
    top = hits.where(F.col("rank") <= k)
    found = top.join(golden, ["query_id", "doc"]).groupBy("query_id").agg(
        F.min("rank").alias("rank")
    )
    first = top.where(F.col("rank") == 1).select(
        "query_id", F.col("doc").alias("top1_doc"), F.round("distance", 3).alias("top1_distance")
    )
    return (
        golden.select("query_id").distinct()
        .join(found, "query_id", "left")
        .join(first, "query_id", "left")
        .withColumn("hit1", F.coalesce(F.col("rank") == 1, F.lit(False)))
        .withColumn("hit3", F.coalesce(F.col("rank") <= 3, F.lit(False)))
        .withColumn("reciprocal", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))
    )


def retrieval_report(cases: DataFrame, n_chunks: int) -> DataFrame:
    """Per model: chunks searched, cases, hit@1, hit@3, mean reciprocal rank,
    mean top-1 distance. ``cases`` are ranked cases with a column ``model``."""
    return cases.groupBy("model").agg(
        F.lit(n_chunks).cast("long").alias("chunks"),
        F.count("*").alias("cases"),
        F.round(F.avg(F.col("hit1").cast("int")), 4).alias("hit1"),
        F.round(F.avg(F.col("hit3").cast("int")), 4).alias("hit3"),
        F.round(F.avg("reciprocal"), 4).alias("mrr"),
        F.round(F.avg("top1_distance"), 3).alias("mean_top1_distance"),
    )


def _grams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))


def containment_gold(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) whose document text contains the passage text.

    Equal passages are looked up once. Up to ``automaton.SHARDS`` shards of passages are
    looked for by automata that scan each document where it lies. With more passages than
    that, scanning for all of them would cost more than preparing the documents: the inner
    words of a passage (all but the first and last, which may be cut in the document) stand
    next to each other in any document that contains it, so each passage looks up its rarest
    run of inner words and only those documents are searched; passages without inner words
    still go to the automata.
    """
    texts = passages.where(F.col("text").isNotNull()).groupBy(F.col("text").alias("passage")).agg(
        F.min("item_id").alias("text_id")
    )
    texts = materialise(texts)
    shards = automaton.shards_of(texts, "passage")
    if shards <= automaton.SHARDS:
        found = _scanned(texts, docs, shards)
    else:
        found = _anchored(texts, docs)
    again = broadcast_if_small(
        passages.join(texts, passages.text == texts.passage).select("item_id", "text_id")
    )
    return found.join(again, "text_id").select("item_id", "doc_id")


def _scanned(texts: DataFrame, docs: DataFrame, shards: int) -> DataFrame:
    """(text_id, doc_id) by automata."""
    held = spread(docs.select("doc_id", "text"), "doc_id")
    return automaton.find_strings(texts.select("text_id", F.col("passage").alias("string")), held, shards)


def _anchored(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(text_id, doc_id) by the rarest run of inner words."""
    worded = texts.withColumn("_w", tokens(F.col("passage"))).withColumn(
        "_inner",
        F.when(F.size("_w") > 2, F.slice("_w", F.lit(2), F.size("_w") - 2)),
    )
    size = F.when(F.size("_inner") >= GRAM, GRAM).otherwise(1)
    anchors = materialise(
        worded.where(F.col("_inner").isNotNull())
        .select(
            "text_id",
            "passage",
            size.alias("size"),
            F.explode(
                F.when(size == GRAM, _grams(F.col("_inner"), GRAM)).otherwise(
                    _grams(F.col("_inner"), 1)
                )
            ).alias("gram"),
        )
    )
    asked = broadcast_if_small(anchors.select("size", "gram").distinct())
    # the words must be a column: inside a lambda an expression runs per element
    worded_docs = spread(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", tokens(F.col("text")).alias("_w")
    )
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]  # 1 and GRAM at most
    runs = [
        worded_docs.select("doc_id", F.lit(n).alias("size"), F.explode(_grams(F.col("_w"), n)).alias("gram"))
        for n in sizes
    ]
    held = materialise(
        reduce(DataFrame.unionByName, runs).join(asked, ["size", "gram"], "left_semi")
        if runs
        else anchors.select(F.lit(0).cast("long").alias("doc_id"), "size", "gram").limit(0)
    )
    holders = held.groupBy("size", "gram").agg(F.count("*").alias("n_docs"))
    # a run no document holds has no row here: its passage is in no document
    rated = anchors.join(holders, ["size", "gram"], "left")
    rarest = rated.groupBy("text_id", "passage").agg(
        F.min_by(
            F.struct("size", "gram"), F.struct(F.coalesce("n_docs", F.lit(0)), "gram")
        ).alias("_a")
    ).select("text_id", "passage", "_a.size", "_a.gram")
    # few against the documents: their texts then need not be shuffled
    candidates = broadcast_if_small(
        materialise(held.join(rarest, ["size", "gram"]).select("doc_id", "text_id", "passage"))
    )
    found = (
        candidates.join(docs.select("doc_id", "text"), "doc_id")
        .where(F.contains("text", "passage"))
        .select("text_id", "doc_id")
    )
    brief = materialise(worded.where(F.col("_inner").isNull()).select("text_id", "passage"))
    if brief.limit(1).count():
        found = found.unionByName(_scanned(brief, docs, automaton.shards_of(brief, "passage")))
    return found
