"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
COUNTERS = 65_536  # a task's counters, a few megabytes
MOST_HOT = 8_000  # keys listed at most; below COUNTERS / 8, so the summary misses none of them


def frequent_keys(df: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Keys with more than ``min_rows`` rows and their exact ``count``.

    Each task keeps a summary of heavy hitters in ``COUNTERS`` counters; the summaries are merged
    into one row, so nothing is shuffled by key. A summary of n rows misses no key with more than
    ``8 n / COUNTERS`` of them, and never counts a key too low. Its few candidates are then counted
    exactly. In a table so large that ``min_rows`` is less than that, keys with fewer rows than that are
    left out: each of them is less than an eight-thousandth of the table.
    """
    hashed = F.xxhash64(*keys)
    summary = df.select(hashed.alias("_h")).agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k(_h, {MOST_HOT}, {COUNTERS})").alias("top")
    ).first()
    limit = max(min_rows, 8 * summary["n"] // COUNTERS)
    hot = [(r["item"],) for r in summary["top"] or [] if r["count"] > limit] if summary["n"] > limit else []
    if not hot:
        return df.select(*keys, F.lit(0).cast("long").alias("count")).limit(0)
    listed = F.broadcast(df.sparkSession.createDataFrame(hot, "_h long"))  # MOST_HOT at most
    counted = df.select(*keys, hashed.alias("_h")).join(listed, "_h", "left_semi").groupBy(*keys).count()
    return counted.where(F.col("count") > limit)


def hot_keys(df: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Keys with more than ``min_rows`` rows (see :func:`frequent_keys`)."""
    return frequent_keys(df, keys, min_rows).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join whose hot keys are spread over as many tasks as their rows need.

    A mergeable summary finds the keys with more than ``hot_rows`` rows (default
    ``HOT_ROWS``) on the left, without a shuffle by key; a key left out has no more rows than
    that, or less than an eight-thousandth of the table. Without any, this is a plain join. Else a
    hot key gets one salt per ``hot_rows`` of its rows (or ``salts``), its rows a salt hashed from the whole row,
    and the matching rows on the right are repeated once per salt. ``how`` may be
    inner, left, left_semi or left_anti.
    """
    spark = left.sparkSession
    limit = HOT_ROWS if hot_rows is None else hot_rows
    # null keys match nothing, so they may go anywhere
    loose = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    counted = frequent_keys(left.where(~loose), on, limit)
    found = counted.collect()  # MOST_HOT at most
    if not found:
        return left.join(right, on, how)
    keys = spark.createDataFrame(found, counted.schema).select(
        *on, (F.lit(salts) if salts else F.ceil(F.col("count") / limit)).cast("int").alias("_salts")
    )
    hot = F.broadcast(keys)  # at most MOST_HOT rows
    # hashed, not counted: a rerun task must send each row to the same place
    spread = lambda n: F.pmod(F.xxhash64(*left.columns), n).cast("int")
    salted_left = left.join(hot, on, "left").withColumn(
        "_salt",
        F.when(loose, spread(F.lit(1 << 20))).when(F.col("_salts").isNotNull(), spread(F.col("_salts"))).otherwise(0),
    )
    salted_right = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    )
    return (
        salted_left.drop("_salts")
        .join(salted_right.drop("_salts"), [*on, "_salt"], how)
        .drop("_salt")
    )
