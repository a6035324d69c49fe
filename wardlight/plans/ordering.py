"""Row numbers and running sums over groups of any size.

A window keeps each group in one task. That is right for groups of bounded size
and wrong when one group may hold a third of the table, so groups above a row
limit are numbered from a range-partitioned, materialised copy instead: each
task numbers its own stretch, and the stretches are shifted by the totals of the
ones before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.plans.session import materialise
from wardlight.plans.sizing import at_most
from wardlight.plans.skew import hot_keys

GROUP_ROWS = 1_000_000


def numbered(
    df: DataFrame,
    group: list[str],
    order: list[str],
    number: str,
    running: dict[str, str] | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``number`` (1-based position inside the group) and, for every
    ``{new column: value column}`` in ``running``, a running sum.

    ``order`` must be unique inside a group.
    """
    running = running or {}
    group_rows = GROUP_ROWS if group_rows is None else group_rows
    if at_most(hot_keys(df, group, group_rows), 0):
        return _by_window(df, group, order, number, running)
    return _by_range(df, group, order, number, running)


def _by_window(df, group, order, number, running):
    w = Window.partitionBy(*group).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn(number, F.row_number().over(w).cast("long"))
    for name, value in running.items():
        out = out.withColumn(name, F.sum(value).over(upto))
    return out


def _by_range(df, group, order, number, running):
    # the range bounds come from a sample, so the sorted copy is written once
    # and every later pass reads that copy
    rows = materialise(
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_slice", F.spark_partition_id())
    )
    sums = [F.sum(value).alias(name) for name, value in running.items()]
    totals = rows.groupBy(*group, "_slice").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), *sums
    )
    # at most one row per group and slice: bounded by groups + slices per group
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # a sum before stays null while no earlier slice has a value, as a window's would
    shift = totals.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_slice").alias("_s"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        *[F.sum(n).over(before).alias(f"_b_{n}") for n in running],
    )
    inside = Window.partitionBy("_slice", *group).orderBy("_at").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    for name, value in running.items():
        rows = rows.withColumn(f"_r_{name}", F.sum(value).over(inside))
    # groups may be null: the join must be null-safe
    same = reduce(
        lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col("_slice") == F.col("_s")
    )
    out = rows.join(shift, same).withColumn(
        number, F.col("_before") + F.col("_at") - F.col("_first") + 1
    )
    for name in running:
        earlier, here = F.col(f"_b_{name}"), F.col(f"_r_{name}")
        out = out.withColumn(name, F.coalesce(earlier + here, here, earlier))
    return out.select(*df.columns, number, *running)


def top_per_group(df: DataFrame, group: list[str], order: list, n: int, rank: str) -> DataFrame:
    """First ``n`` rows of each group with their rank. The rank filter becomes a
    per-task group limit in the plan, so only n rows per group and task shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
