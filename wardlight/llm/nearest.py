"""Exact top-k by inner product: a Voronoi join of query and data groups.

Vectors are grouped by their nearest pivot. From each group's summary (pivot,
radius, size) come bounds on any inner product between a query group and a data
group. A query group's k-th best score is at least the lower bound reached once
the best data groups hold k vectors; data groups whose upper bound stays below
are not sent. Each cell of a query group and a slice of a data group is solved
by one matrix product, and the k best per query and cell meet in a last top-k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import parts_for, written
from wardlight.plans.ordering import top_per_group
from wardlight.plans.sizing import broadcast_if_small

SCALE = 64
MOST_PIVOTS = 64  # pivots and group summaries on the driver, whatever the table's size
GROUP_QUERIES = 2_000
SLICE_ROWS = 20_000


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id, v``: each component x as floor(scale * x). Vectors that are null or
    hold null or non-finite components are left out, rows without an id too."""
    v = F.col(vec_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    return vectors.where(good).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
    )


def _matrix(column, width: int) -> np.ndarray:
    """Rows as int64; shorter vectors count as filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats are used while they are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, b: np.ndarray, radius_a: np.ndarray, radius_b: np.ndarray):
    """Lowest and highest inner product between query group i and data group j."""
    dot = a @ b.T
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    slack = norm_a[:, None] * radius_b[None, :] + norm_b[None, :] * radius_a[:, None] + np.outer(radius_a, radius_b)
    return dot - slack, dot + slack


def needed(q_pivots, q_radius, q_size, pivots, radius, size, k: int, own: int = 1) -> list[tuple[int, int]]:
    """Pairs of a query group and a data group that may hold one of the k best; up to ``own``
    vectors may have the query's id, and do not count."""
    low, high = bounds(q_pivots, pivots, q_radius, radius)
    pairs = []
    for a in np.flatnonzero(q_size):
        best = np.argsort(-low[a], kind="stable")
        best = best[size[best] > 0]
        enough = np.cumsum(size[best]) >= k + own
        floor = low[a][best[int(enough.argmax())]] if enough.any() else -np.inf
        # bounds are floats, products integers: half a unit and a relative margin are on the safe side
        margin = 0.5 + 1e-9 * (np.abs(low[a]).max() + np.abs(high[a]).max())
        pairs += [(int(a), int(b)) for b in np.flatnonzero((size > 0) & (high[a] + margin >= floor))]
    return pairs


def _meant(plan: DataFrame, side: str, group: str, slice_: str) -> DataFrame:
    """Cells a slice goes to; one row per slice, its cells in a list. The plan has a
    row per pair of groups and slices, so it is broadcast below a row limit only."""
    return broadcast_if_small(
        plan.groupBy(F.col(side).alias(group), slice_).agg(F.collect_list("cell").alias("cells"))
    )


def top_k(vectors: DataFrame, k: int, every: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every`` the ``k`` other rows with the highest inner product of the scaled
    vectors, ties to the smaller id. Rows of one query id are one query (the
    smallest vector); candidates are all rows of other ids, repeated ones too.
    Vectors that are shorter than the longest count as filled with zeros. Components and products are 64-bit
    integers: a component beyond them is held at their end, and inner products must stay within."""
    spark = vectors.sparkSession
    rows = written(scaled(vectors, id_col, vec_col), "nearest-rows")
    shape = rows.agg(F.count("*"), F.max(F.size("v")), F.count(F.when(F.col("id") % every == 0, 1))).first()
    n, width, n_queries = shape[0], int(shape[1] or 0), shape[2]
    if not n or not n_queries or not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    count = int(min(MOST_PIVOTS, max(1, round(n**0.5 / 4))))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()
    pivots = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        pivots[i, : len(r.v)] = r.v

    # queries need fewer groups than data: each group of queries is met by copies of the data it needs
    q_pivots = pivots[: parts_for(n_queries, GROUP_QUERIES)]

    def assign(batches):
        def nearest(x, points):
            near = ((points**2).sum(axis=1)[None, :] - 2 * x @ points.T).argmin(axis=1)
            return pa.array(near, pa.int32()), pa.array(np.linalg.norm(x - points[near], axis=1))

        for batch in batches:
            x = _matrix(batch.column(1), width).astype(float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *nearest(x, pivots), *nearest(x, q_pivots)], ["id", "v", "g", "far", "qg", "q_far"]
            )

    grouped = written(
        rows.mapInArrow(assign, "id long, v array<long>, g int, far double, qg int, q_far double"), "nearest-groups"
    )
    query = F.col("id") % every == 0

    def summary(rows_: DataFrame, group: str, far: str, points: np.ndarray):
        size, radius = np.zeros(len(points)), np.zeros(len(points))
        for r in rows_.groupBy(group).agg(F.count("*").alias("n"), F.max(far).alias("r")).collect():
            size[r[group]], radius[r[group]] = r.n, r.r
        return size, radius

    size, radius = summary(grouped, "g", "far", pivots)
    query_n, query_r = summary(grouped.where(query), "qg", "q_far", q_pivots)
    own = grouped.where(query).groupBy("id").count().agg(F.max("count")).first()[0]
    pairs = needed(q_pivots, query_r, query_n, pivots, radius, size, k, own)
    # groups are cut into slices of bounded size, so that a group with a third of all rows fills many cells; the
    # driver has a row per pair of groups, slices are made from these in Spark
    cut, base = [], 0
    for a, b in pairs:
        n_s, n_t = parts_for(int(query_n[a]), GROUP_QUERIES), parts_for(int(size[b]), SLICE_ROWS)
        cut.append((a, b, n_s, n_t, base))
        base += n_s * n_t
    plan = (
        spark.createDataFrame(cut, "a int, b int, n_s int, n_t int, base long")
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_s") - 1)))
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1)))
        .select((F.col("base") + F.col("s").cast("long") * F.col("n_t") + F.col("t")).alias("cell"), "a", "s", "b", "t")
    )
    q_slices = F.lit([parts_for(int(x), GROUP_QUERIES) for x in query_n])[F.col("qg")]
    d_slices = F.lit([parts_for(int(x), SLICE_ROWS) for x in size])[F.col("g")]
    spot = F.xxhash64("id", F.lit(3))
    queries = (
        grouped.where(query).groupBy("id").agg(F.min(F.struct("v", "qg")).alias("m")).select("id", "m.*")
        .withColumn("s", F.pmod(spot, q_slices).cast("int"))
    )
    data = grouped.withColumn("t", F.pmod(spot, d_slices).cast("int"))
    left = queries.join(_meant(plan, "a", "qg", "s"), ["qg", "s"]).select(
        F.explode("cells").alias("q_cell"), F.col("id").alias("q_id"), F.col("v").alias("q_v")
    )
    right = data.join(_meant(plan, "b", "g", "t"), ["g", "t"]).select(F.explode("cells").alias("cell"), "id", "v")

    def solve(qs: pa.Table, ds: pa.Table) -> pa.Table:
        q_id, d_id = qs.column("q_id").to_numpy(), ds.column("id").to_numpy()
        order = np.argsort(d_id, kind="stable")
        d_id = d_id[order]
        x = _matrix(ds.column("v"), width)[order]
        y = _matrix(qs.column("q_v"), width)
        found: list = [[], [], []]
        for i in range(0, len(q_id), 256):
            score = _products(y[i : i + 256], x)
            for j in range(len(score)):
                own = d_id != q_id[i + j]
                s, ids = score[j][own], d_id[own]
                if len(s) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    above = np.flatnonzero(s > edge)
                    keep = np.concatenate((above, np.flatnonzero(s == edge)[: k - len(above)]))
                    s, ids = s[keep], ids[keep]
                found[0].append(np.full(len(s), q_id[i + j]))
                found[1].append(ids)
                found[2].append(s)
        cat = [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]
        return pa.table({"query_id": cat[0], "vec_id": cat[1], "score": cat[2]})

    best = left.groupBy("q_cell").cogroup(right.groupBy("cell")).applyInArrow(
        solve, "query_id long, vec_id long, score long"
    )
    ranked = top_per_group(best, ["query_id"], [F.desc("score"), F.asc("vec_id")], k, "rank")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
