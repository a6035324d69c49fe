"""Exact cosine neighbours and text encoders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from wardlight.functions.text import token_list
from wardlight.functions.vectors import l2
from wardlight.plans.ordering import top_per_group
from wardlight.plans.session import materialise

BLOCK_BYTES = 32 << 20  # query vectors sent to the tasks at once
BLOCK_QUERIES = 20_000
PIVOTS = 16
CELL = 1 << 22  # distances computed at once
DIGITS = 6
SLOTS = 256  # of the hashed encoder


def _vectors(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column, one per row; a zero vector stays zero."""
    width = len(column[0]) if len(column) else 0
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _names(column: pa.Array) -> np.ndarray:
    """Ids as an array that sorts like Spark does."""
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def spread_out(units: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the vectors, each the farthest from the ones before."""
    held = units[np.abs(units).sum(1) > 0]
    if not len(held):
        return held
    picked, near = [held[0]], held @ held[0]
    while len(picked) < min(n, len(held)):
        at = int(np.argmin(near))
        if near[at] >= 1 - 1e-9:
            break
        picked.append(held[at])
        near = np.maximum(near, held @ held[at])
    return np.array(picked)


class NearestHeap:
    """The ``k`` nearest rows seen so far for each query of a block, by rounded distance, ties
    to the lower id.

    Queries stand in groups by their nearest pivot, and so do the rows of a batch. By the triangle inequality of
    angles a query and a row are at least as far apart as their angles to any pivot differ; where that
    exceeds what all queries of a group still look for, the cell is skipped.
    """

    def __init__(self, units: np.ndarray, k: int):
        self.k, self.n, self.skipped = k, len(units), 0
        self.pivots = spread_out(units[:: max(1, len(units) // 2048)], PIVOTS)
        self.units, self.groups = units, self._grouped(units)
        self.distance = np.full((self.n, k), np.inf)
        self.place = np.full((self.n, k), -1, np.int64)
        self.ids: np.ndarray | None = None

    def _grouped(self, units: np.ndarray):
        """Rows of each group with the least and greatest angle to every pivot."""
        if not len(self.pivots):
            return [(np.arange(len(units)), np.zeros(0), np.zeros(0))]
        angle = _angles(units, self.pivots)
        # vectors without a direction have no angle: a group of their own that is never skipped
        nearest = np.where(units.any(axis=1), angle.argmin(axis=1), -1)
        groups = []
        for g in np.unique(nearest):
            own = np.flatnonzero(nearest == g)
            low, high = (angle[own].min(0), angle[own].max(0)) if g >= 0 else (np.zeros(len(self.pivots)), np.full(len(self.pivots), np.pi))
            groups.append((own, low, high))
        return groups

    def add(self, ids: np.ndarray, units: np.ndarray) -> None:
        base = 0 if self.ids is None else len(self.ids)
        self.ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        cells = self._grouped(units)
        for own, low, high in self.groups:
            for rows, near, far in cells:
                gap = np.maximum(near - high, low - far).max(initial=0.0)
                if gap > 0 and 1 - np.cos(gap) > self.distance[own, -1].max() + 10.0**-DIGITS:
                    self.skipped += len(own) * len(rows)
                    continue
                step = max(1, CELL // len(rows))
                for i in range(0, len(own), step):
                    self._compare(own[i : i + step], rows, units[rows], base)
        self._forget()

    def _compare(self, own: np.ndarray, rows: np.ndarray, units: np.ndarray, base: int) -> None:
        away = np.round(1.0 - self.units[own] @ units.T, DIGITS) + 0.0
        limit = self.distance[own, -1]
        if away.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(away, self.k - 1, axis=1)[:, self.k - 1])
        q, c = np.nonzero(away <= limit[:, None])
        if not len(q):
            return
        changed = np.unique(q)
        held_q, held_c = np.nonzero(self.place[own[changed]] >= 0)
        query = np.concatenate([changed[held_q], q])
        distance = np.concatenate([self.distance[own[changed]][held_q, held_c], away[q, c]])
        place = np.concatenate([self.place[own[changed]][held_q, held_c], rows[c] + base])
        order = np.lexsort((self.ids[place], distance, query))
        query, distance, place = query[order], distance[order], place[order]
        first = np.searchsorted(query, changed)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        best = rank < self.k
        self.distance[own[changed]], self.place[own[changed]] = np.inf, -1
        self.distance[own[query[best]], rank[best]] = distance[best]
        self.place[own[query[best]], rank[best]] = place[best]

    def _forget(self) -> None:
        """Keep the ids of rows in the heap only."""
        held = self.place >= 0
        kept, at = np.unique(self.place[held], return_inverse=True)
        self.ids, self.place[held] = self.ids[kept], at

    def found(self):
        """Query places, ids and distances."""
        q, c = np.nonzero(self.place >= 0)
        return q, self.ids[self.place[q, c]] if len(q) else None, self.distance[q, c]


def knn(
    queries: DataFrame, corpus: DataFrame, k: int, block_queries: int = BLOCK_QUERIES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Nearest ``k`` corpus vectors per query by cosine distance, exactly.

    ``queries`` is (query_id, vector), ``corpus`` (chunk_id, vector), vectors of one length; null
    vectors take no part. Queries are sent to the tasks in blocks of bounded size; each task
    scans its part of the corpus where it lies and keeps a heap of k per query, and only the heaps are shuffled.
    Ties go to the lower id.
    """
    queries = materialise(queries.select("query_id", "vector")).where("vector IS NOT NULL")
    corpus = corpus.select("chunk_id", "vector")
    size = queries.agg(F.count("*").alias("n"), F.sum(8 * F.size("vector").cast("long")).alias("b")).first()
    blocks = max(1, -(-size["n"] // block_queries), -(-(size["b"] or 0) // block_bytes))
    schema = StructType([
        queries.schema["query_id"], corpus.schema["chunk_id"], StructField("distance", DoubleType()),
    ])
    parts = [
        _scanned(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries, corpus, k, schema)
        for i in range(blocks)
    ]
    return top_per_group(reduce(DataFrame.unionByName, parts), ["query_id"], ["distance", "chunk_id"], k, "rank")


def _scanned(block: DataFrame, corpus: DataFrame, k: int, schema: StructType) -> DataFrame:
    rows = block.toArrow()  # at most a block
    sent = corpus.sparkSession.sparkContext.broadcast(rows)
    kind = to_arrow_type(schema["chunk_id"].dataType)

    def scan(batches):
        asked = sent.value.combine_chunks()
        if not len(asked):
            return
        heap = NearestHeap(_vectors(asked.column("vector").combine_chunks()), k)
        for batch in batches:
            # left out here: a filter in the plan would compute the vectors a second time
            batch = batch.filter(batch.column(1).is_valid())
            if len(batch):
                heap.add(_names(batch.column(0)), _vectors(batch.column(1)))
        q, ids, distance = heap.found()
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [asked.column("query_id").combine_chunks().take(pa.array(q)), pa.array(ids.tolist(), kind), pa.array(distance)],
                schema.names,
            )

    return corpus.mapInArrow(scan, schema)


def embed(
    df: DataFrame,
    encoder: Callable[[Column], Column] | None = None,
    prefix: str = "",
    text: str = "text",
    model=None,
) -> DataFrame:
    """Adds a unit-length ``vector`` for a text column.

    ``encoder`` maps the text column to an array column: a built-in expression
    or a pandas UDF that loads its model once per worker. Models that want it
    get ``prefix`` in front of the text. Without an encoder a hashed TF-IDF
    ``model`` (see :func:`fit_tfidf`) is applied.
    """
    prefixed = F.concat(F.lit(prefix), F.col(text))
    if encoder is not None:
        return (
            df.withColumn("_raw", encoder(prefixed))
            .withColumn("vector", l2(F.col("_raw")))
            .drop("_raw")
        )
    fitted = model if model is not None else fit_tfidf(df, prefix, text)
    ready = df.withColumn("_tokens", token_slots(prefixed, len(fitted.stages[0].vocabulary)))
    return (
        fitted.transform(ready)
        .withColumn("vector", vector_to_array("_unit"))
        .drop("_tokens", "_tf", "_tfidf", "_unit")
    )


def _once(of, kind):
    """An Arrow function over columns. Declared as it is, it is not computed a second time in a
    filter that Spark moves below it."""
    return F.arrow_udf(of, kind).asNondeterministic()


def token_slots(text: Column, size: int) -> Column:
    """The slot of each token: the first 32 bits of its MD5, modulo ``size``, which any
    engine can compute. A batch hashes each of its tokens once."""

    def slots(texts: pa.Array) -> pa.Array:
        at: dict[str, int] = {}
        ends, found, none = [0], [], []
        for x in texts.to_pylist():
            none.append(x is None)
            found.extend(at.setdefault(t, len(at)) for t in token_list(x or ""))
            ends.append(len(found))
        names = [str(int(md5(t.encode()).hexdigest()[:8], 16) % size) for t in at]
        values = pa.array(names, pa.string()).take(pa.array(found, pa.int32()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(none, pa.bool_()))

    return _once(slots, ArrayType(StringType()))(text)


def fit_tfidf(df: DataFrame, prefix: str = "", text: str = "text", size: int = SLOTS):
    """Hashed TF-IDF encoder fitted on a corpus, to be used for its queries too: tokens
    counted by slot, times ln((n + 1) / (texts with the slot + 1)), at unit length."""
    ready = df.withColumn("_tokens", token_slots(F.concat(F.lit(prefix), F.col(text)), size))
    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(size)], "_tokens", "_tf")
    stages = [
        counts,
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(ready)


def letter_profile(text: Column) -> Column:
    """Counts of the letters a..z in any case: a small built-in encoder. Null texts have null counts."""

    def counts(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        out = np.zeros((len(rows), 26))
        for i, x in enumerate(rows):
            if x:
                out[i] = np.bincount(np.frombuffer(x.lower().encode(), np.uint8), minlength=128)[97:123]
        none = np.repeat([x is None for x in rows], 26).astype(bool)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 26), pa.array(out.ravel(), mask=none))

    return _once(counts, ArrayType(DoubleType()))(text)
