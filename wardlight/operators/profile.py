"""Profiling and integrity of a set of tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardlight.plans.skew import salted_join

ENUM_VALUES = 10
TRACKED = 20  # values a task keeps of a column, for each value allowed


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(
        [
            df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
            for name, df in tables.items()
        ]
    )


def detect_enums(tables: dict[str, DataFrame], max_values: int = ENUM_VALUES) -> DataFrame:
    """String columns with 1..``max_values`` distinct values, one row per value:
    (table, column, value).

    One scan per table. For each text column a task keeps a bounded set of values with their
    counts, and these merge into one row per table. A set that had to let values go is
    recognised: its counts no longer add up to the rows of the column, and the column's
    distinct count, estimated in the same pass, is far above the limit. The result is bounded by the
    schema (``max_values`` per column), so it becomes a literal table that later joins
    broadcast by its known size.
    """
    spark = next(iter(tables.values())).sparkSession
    scans = []
    for name, df in tables.items():
        columns = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
        sets = [
            F.struct(
                F.lit(c).alias("column"),
                F.count(c).alias("n"),
                F.approx_count_distinct(c).alias("about"),
                F.expr(f"approx_top_k(`{c}`, {max_values + 2}, {TRACKED * max_values})").alias("held"),
            )
            for c in columns
        ]
        if sets:
            scans.append(df.agg(F.array(*sets).alias("sets")).select(F.lit(name).alias("table"), "sets"))
    listed = []
    for table, sets in _stack(scans).collect() if scans else []:
        for column, n, about, held in sets:
            values = [(x["item"], x["count"]) for x in held or [] if x["item"] is not None]
            whole = sum(count for _, count in values) == n and about <= 2 * max_values
            if whole and 0 < len(values) <= max_values:
                listed += [(table, column, value) for value, _ in values]
    return spark.createDataFrame(listed, "table string, column string, value string")


def enum_lists(enums: DataFrame) -> DataFrame:
    """One row per enumeration with its sorted values; each list has at most as
    many values as the detection allowed."""
    return enums.groupBy("table", "column").agg(
        F.count("*").alias("n_values"),
        F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"),
    )


def key_relations(tables: dict[str, DataFrame], suffix: str = "_id") -> DataFrame:
    """Columns named ``*suffix`` present in two or more tables, measured pair by
    pair: distinct keys on both sides, shared ones, and whether each side is
    unique. Keys are counted per table before they meet, so repeats are gone."""
    holders: dict[str, list[str]] = {}
    for name in sorted(tables):
        for column in tables[name].columns:
            if column.endswith(suffix):
                holders.setdefault(column, []).append(name)
    pairs = []
    for column, names in sorted(holders.items()):
        for left, right in combinations(names, 2):
            a = _key_counts(tables[left], column, "n_left")
            b = _key_counts(tables[right], column, "n_right")
            both = a.join(b, "key", "full")
            pairs.append(
                both.agg(
                    F.count("n_left").alias("left_keys"),
                    F.count("n_right").alias("right_keys"),
                    F.count_if(F.col("n_left").isNotNull() & F.col("n_right").isNotNull()).alias(
                        "shared_keys"
                    ),
                    (F.max("n_left") == 1).alias("left_unique"),
                    (F.max("n_right") == 1).alias("right_unique"),
                ).select(
                    F.lit(column).alias("key_column"),
                    F.lit(left).alias("left_table"),
                    F.lit(right).alias("right_table"),
                    "left_keys",
                    "right_keys",
                    "shared_keys",
                    F.round(F.try_divide(F.col("shared_keys"), F.col("left_keys")), 4).alias(
                        "left_found"
                    ),
                    F.round(F.try_divide(F.col("shared_keys"), F.col("right_keys")), 4).alias(
                        "right_found"
                    ),
                    "left_unique",
                    "right_unique",
                )
            )
    if not pairs:
        raise ValueError(f"no column ending in {suffix} is shared by two tables")
    return _stack(pairs)


def _key_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("key"))
        .agg(F.count("*").alias(name))
    )


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is not in the parent table."""
    return salted_join(child, parent.select(key).distinct(), [key], "left_anti")


def orphan_summary(child: DataFrame, parent: DataFrame, key: str, row_id: str) -> DataFrame:
    """Per missing key: number of child rows and the lowest row id as a sample."""
    counted = child.groupBy(key).agg(
        F.count("*").alias("n_rows"), F.min(row_id).alias("sample_id")
    )
    return counted.join(parent.select(key).distinct(), key, "left_anti")
