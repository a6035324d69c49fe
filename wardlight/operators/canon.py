"""Value canonicalisation against dictionaries of allowed values.

A dictionary is a table (table, column, value) as found by ``detect_enums``: at
most ten values per column. Lookups carry the column's short value list beside
each row, so values are compared inside the row and never crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


MAX_VALUES = 10  # ``detect_enums`` lists no column with more


def value_lists(enums: DataFrame) -> DataFrame:
    """One row per (table, column) with its sorted values."""
    return enums.groupBy("table", "column").agg(
        F.array_sort(F.collect_set("value")).alias("allowed")
    )


def same_ignoring_case(allowed: Column, value: Column) -> Column:
    """First allowed value equal to ``value`` but for case, else null."""
    return F.try_element_at(
        F.filter(allowed, lambda v: F.lower(v) == F.lower(value)), F.lit(1)
    )


def one_edit_away(allowed: Column, value: Column) -> Column:
    """First allowed value within one edit of ``value``, ignoring case; null
    when the value itself is allowed."""
    near = F.filter(
        allowed, lambda v: F.levenshtein(F.lower(v), F.lower(value), 1) >= 0
    )
    return F.when(
        same_ignoring_case(allowed, value).isNull(), F.try_element_at(near, F.lit(1))
    )


def _allowed(enums: DataFrame, table: str, column: str) -> Column | None:
    """Values of one column as a literal: a dictionary has at most ten of them."""
    found = (
        enums.where((F.col("table") == table) & (F.col("column") == column))
        .select("value").distinct().orderBy("value").limit(MAX_VALUES).collect()
    )
    return F.array(*[F.lit(r["value"]) for r in found]) if found else None


def canonicalise(df: DataFrame, table: str, column: str, enums: DataFrame) -> DataFrame:
    """Replace values by the dictionary value equal ignoring case. Unknown and
    already right values stay."""
    allowed = _allowed(enums, table, column)
    if allowed is None:
        return df
    return df.withColumn(
        column, F.coalesce(same_ignoring_case(allowed, F.col(column)), F.col(column))
    )


def near_misses(df: DataFrame, table: str, column: str, enums: DataFrame) -> DataFrame:
    """Values outside the dictionary but one edit from an allowed one, with the
    suggestion and the number of rows. Values are made distinct first."""
    allowed = _allowed(enums, table, column)
    if allowed is None:
        allowed = F.array().cast("array<string>")
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count("*").alias("n_rows"))
        .withColumn("column", F.lit(column))
        .withColumn("suggestion", one_edit_away(allowed, F.col("value")))
        .where(F.col("suggestion").isNotNull())
        .select("column", "value", "suggestion", "n_rows")
    )


def scope_dictionary(enums: DataFrame) -> DataFrame:
    """Values to use for a column when its table is unknown: those of the only
    table that has it, else the union over all tables."""
    return enums.groupBy("column").agg(
        F.when(F.count_distinct("table") == 1, F.min("table")).alias("only_table"),
        F.count_distinct("table").cast("long").alias("n_tables"),
        F.array_sort(F.collect_set("value")).alias("allowed"),
    )


def dictionary_beside(df: DataFrame, lists: DataFrame, on: list[str], name: str) -> DataFrame:
    """Left join of a dictionary list under a new name: a row per enumerated column,
    with at most ten values each, so it is always broadcast."""
    return df.join(F.broadcast(lists.withColumnRenamed("allowed", name)), on, "left")
