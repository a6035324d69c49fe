"""Size checks made before a side is broadcast or collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; reads at most one more."""
    return df.limit(rows + 1).count() <= rows


def small_values(df: DataFrame, rows: int) -> list | None:
    """All rows on the driver when there are at most ``rows``, else None."""
    got = df.limit(rows + 1).collect()
    return got if len(got) <= rows else None


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a count of rows and of the bytes in texts and arrays;
    beyond either the join shuffles and AQE splits the skewed partitions."""
    wide = [
        F.coalesce(F.octet_length(f.name) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else 8 * F.size(f.name), F.lit(0))
        for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType))
    ]
    size = reduce(lambda x, y: x + y, wide, F.lit(0)).cast("long")
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and found["size"] <= most else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give work that is heavy per row at least one task per core. Only a scan
    with fewer splits than cores is shuffled; a large table never is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
