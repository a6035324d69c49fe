"""BM25 index and search over chunks.

A search deals the postings of the asked tokens into shards of bounded size by a hash of the
chunk. Within a shard the postings of a token stand in the order of their *impact* (the part of
the score that the query does not change), cut into blocks of doubling length whose first impact
bounds all that follow. The lists are read block by block, only until no chunk outside the ones in
sight can be among the best. So a task hands on at most n chunks per query, and the postings of a
frequent token are spread over all shards.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from wardlight.functions.text import token_list, tokens
from wardlight.plans.ordering import top_per_group
from wardlight.plans.session import stored as materialise
from wardlight.plans.sizing import BROADCAST_ROWS

# fixed values: BM25 parameters
K1, B, NEGATIVE_IDF_SHARE = 1.5, 0.75, 0.25
SHARD_CHUNKS = 8_192  # chunks of a shard
LEAST_CHUNKS = 256  # of a shard in a small corpus, which still gives each core one
FIRST_BLOCK = 64  # postings in the first block of a list; each next one is twice as long
DIGITS = 6


@dataclass
class LexicalIndex:
    """Tokens of each chunk (chunk_id, length, counts: an array of token and tf), terms
    (token, df, idf) and the corpus figures the score needs."""

    counted: DataFrame
    terms: DataFrame
    n_chunks: int
    mean_length: float

    @property
    def postings(self) -> DataFrame:
        """One row per chunk and token: chunk_id, length, token, tf."""
        return self.counted.select("chunk_id", "length", F.explode("counts").alias("_c")).select(
            "chunk_id", "length", "_c.token", "_c.tf"
        )


def token_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.explode(tokens(F.col(text))).alias("token"))


COUNTED = T.StructType([
    T.StructField("length", T.LongType()),
    T.StructField("counts", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())]))),
])


def token_counts(text: Column) -> Column:
    """Per text its number of tokens (``length``) and a (token, tf) per distinct token (``counts``);
    a null text counts as an empty one."""

    def count(texts: pa.Array) -> pa.Array:
        length, ends, token, tf = [], [0], [], []
        for x in texts.to_pylist():
            found = token_list(x or "")
            held = Counter(found)
            length.append(len(found))
            token.extend(held)
            tf.extend(held.values())
            ends.append(len(token))
        pairs = pa.StructArray.from_arrays([pa.array(token, pa.string()), pa.array(tf, pa.int64())], ["token", "tf"])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
        return pa.StructArray.from_arrays([pa.array(length, pa.int64()), lists], ["length", "counts"])

    # so declared, it is not computed a second time in a filter that Spark moves below it
    return F.arrow_udf(count, COUNTED).asNondeterministic()(text)


def bm25_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> LexicalIndex:
    """Count tokens per chunk (ids are unique), chunks per token and the corpus figures.

    Tokens are counted inside the row of their chunk, so neither texts nor tokens move. The
    counts are written once, a row per chunk, and all figures come from that copy.
    """
    listed = materialise(
        chunks.select(F.col(key).alias("chunk_id"), token_counts(F.col(text)).alias("_t")).select("chunk_id", "_t.*")
    )
    figures = listed.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    n, mean = figures["n"], (figures["total"] or 0) / figures["n"] if figures["n"] else 0.0
    counted = materialise(
        listed.select(F.explode("counts.token").alias("token")).groupBy("token").agg(F.count("*").alias("df")).withColumn(
            "_idf", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
        )
    )
    floor = NEGATIVE_IDF_SHARE * (counted.agg(F.avg("_idf")).first()[0] or 0.0)
    terms = counted.select(
        "token", "df", F.when(F.col("_idf") < 0, F.lit(floor)).otherwise(F.col("_idf")).alias("idf")
    )
    return LexicalIndex(listed, terms, n, mean)


def save_index(index: LexicalIndex, path: str) -> None:
    spark = index.counted.sparkSession
    index.counted.write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame(
        [(index.n_chunks, index.mean_length)], "n_chunks long, mean_length double"
    ).write.mode("overwrite").parquet(f"{path}/figures")


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    figures = spark.read.parquet(f"{path}/figures").first()
    return LexicalIndex(
        spark.read.parquet(f"{path}/postings"),
        spark.read.parquet(f"{path}/terms"),
        figures["n_chunks"],
        figures["mean_length"],
    )


def query_weights(index: LexicalIndex, queries: DataFrame, key: str, text: str) -> DataFrame:
    """idf times repeats of every known token of every query."""
    asked = token_rows(queries, key, text).groupBy(F.col(key).alias("query_id"), "token").agg(
        F.count("*").alias("repeats")
    )
    return asked.join(index.terms, "token").select(
        "query_id", "token", (F.col("repeats") * F.col("idf")).alias("weight")
    )


class Lists:
    """A shard's postings (token, chunk_id, impact) as lists: chunks as places in ``ids`` (sorted), in
    the order of impact and, for look-ups, in the order of places."""

    def __init__(self, shard: pa.Table):
        token = shard.column("token").combine_chunks().dictionary_encode()
        which = token.indices.to_numpy()
        self.term = {t: i for i, t in enumerate(token.dictionary.to_pylist())}
        chunk = shard.column("chunk_id")
        held = np.array(chunk.to_pylist(), str) if pa.types.is_string(chunk.type) else chunk.to_numpy()
        self.ids, places = np.unique(held, return_inverse=True)
        impact = shard.column("impact").to_numpy()
        self.at = np.searchsorted(np.sort(which), np.arange(len(self.term) + 1))
        by = np.lexsort((-impact, which))
        self.places, self.impact = places[by], impact[by]
        by = np.lexsort((places, which))
        self.sorted_places, self.sorted_impact = places[by], impact[by]

    def best(self, terms: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the ``n`` best chunks by rounded score (positive), ties to the
        lower id, and the postings read."""
        first, last = self.at[terms], self.at[terms + 1]
        rising = weights > 0  # others can only lower a score: they are looked up at the end
        upto, close, read = np.zeros(len(self.ids)), 10.0**-DIGITS, 0
        size = FIRST_BLOCK
        while True:
            stop = np.minimum(first + size, last)
            take = stop - first
            take[~rising] = 0
            own = np.repeat(first - np.concatenate(([0], np.cumsum(take)[:-1])), take) + np.arange(int(take.sum()))
            np.add.at(upto, self.places[own], np.repeat(weights, take) * self.impact[own])
            read += len(own)
            first = np.where(rising, stop, first)
            left = rising & (first < last)
            # what a chunk can still gain: the next impact of every list
            rest = float((weights[left] * self.impact[first[left]]).sum())
            if not left.any():
                chosen = np.flatnonzero(upto > 0)
                break
            if rising.all():
                seen = np.flatnonzero(upto > 0)
                if len(seen) > n:
                    least = np.partition(upto[seen], len(seen) - n)[len(seen) - n]
                    if rest + close < least:  # no unseen chunk can be among the best
                        chosen = seen[upto[seen] + rest + close >= least]
                        if len(chosen) <= max(4 * n, size):
                            break
            size *= 2
        scores = np.zeros(len(chosen))
        for t, w in zip(terms.tolist(), weights.tolist()):
            a, b = self.at[t], self.at[t + 1]
            at = np.minimum(np.searchsorted(self.sorted_places[a:b], chosen), b - a - 1) + a
            scores += np.where(self.sorted_places[at] == chosen, w * self.sorted_impact[at], 0.0)
        scores = np.round(scores, DIGITS)
        keep = np.flatnonzero(scores > 0)
        keep = keep[np.lexsort((chosen[keep], -scores[keep]))[:n]]
        return chosen[keep], scores[keep], read


def shard_best(
    index: LexicalIndex, queries: DataFrame, n: int, key: str = "query_id", text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Each shard's best ``n`` chunks per query: query_id, chunk_id, score (positive).

    The query weights are sent to the tasks in blocks of at most about ``broadcast_rows`` rows,
    each block a visit of the shards.
    """
    weights = materialise(query_weights(index, queries, key, text))
    blocks = max(1, -(-weights.count() // broadcast_rows))
    cores = weights.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-index.n_chunks // SHARD_CHUNKS), min(cores, -(-index.n_chunks // LEAST_CHUNKS)))
    length = F.col("length") / F.lit(index.mean_length or 1.0)
    postings = index.postings.select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), "token", "chunk_id",
        ((F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * length))).alias("impact"),
    )
    schema = StructType([
        StructField("query_id", weights.schema["query_id"].dataType), postings.schema["chunk_id"], StructField("score", DoubleType()),
    ])
    parts = [
        _visited(postings, weights.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else weights, n, schema)
        for i in range(blocks)
    ]
    return reduce(DataFrame.unionByName, parts)


def _visited(postings: DataFrame, weights: DataFrame, n: int, schema: StructType) -> DataFrame:
    rows = weights.orderBy("query_id").toArrow()  # one block
    sent = weights.sparkSession.sparkContext.broadcast(rows)
    held = postings.join(F.broadcast(weights.select("token").distinct()), "token", "left_semi")

    def visit(shard: pa.Table) -> pa.Table:
        asked, own = sent.value, Lists(shard)
        query = asked.column("query_id").combine_chunks().dictionary_encode()
        which = query.indices.to_numpy()
        terms = np.array([own.term.get(t, -1) for t in asked.column("token").to_pylist()], np.int64)
        weight = asked.column("weight").to_numpy()
        known = np.flatnonzero(terms >= 0)
        found_q, found_c, found_s = [which[:0]], [known[:0]], [weight[:0]]
        cut = np.flatnonzero(np.diff(which[known])) + 1
        for at in np.split(known, cut) if len(known) else []:
            places, scores, _ = own.best(terms[at], weight[at], n)
            found_q.append(np.full(len(places), which[at[0]]))
            found_c.append(places)
            found_s.append(scores)
        return pa.table({
            "query_id": query.dictionary.take(pa.array(np.concatenate(found_q))),
            "chunk_id": pa.array(own.ids[np.concatenate(found_c)].tolist(), to_arrow_type(schema["chunk_id"].dataType)),
            "score": np.concatenate(found_s),
        })

    return held.groupBy("shard").applyInArrow(visit, schema)


def bm25_search(
    index: LexicalIndex, queries: DataFrame, k: int, key: str = "query_id", text: str = "text",
    **options,
) -> DataFrame:
    """Best ``3k`` chunks per query: query_id, chunk_id, score, rank."""
    scores = shard_best(index, queries, 3 * k, key, text, **options)
    return top_per_group(scores, ["query_id"], [F.desc("score"), "chunk_id"], 3 * k, "rank")
