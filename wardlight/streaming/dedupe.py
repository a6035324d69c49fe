"""Duplicate alerts on a stream.

The exact gap rule needs the days on which every key was seen lately. That state, one row per
key and day within reach, lies in one folder per day, each with the version of the last
batch that changed the day. A batch joins it after its own alerts are folded to one row per key
and day, so no key's alerts meet in one task; it writes new versions of the days it touches, as far as
later batches can reach them, and nothing else. Days out of reach and versions that have been replaced are removed by a
later batch, when the one that replaced them can no longer run again. A batch run again
reads the same versions and overwrites its own output.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wardlight.plans.session import folders, materialise, remove
from wardlight.plans.skew import salted_join


def flag_batch(
    alerts: DataFrame, seen: DataFrame | None, days: int, keys: tuple[str, ...]
) -> tuple[DataFrame, DataFrame]:
    """Alerts with ``previous_on`` and ``duplicate``, and the days on which each key
    has been seen. ``seen`` is (keys, last_on), those days from earlier batches."""
    by_day = alerts.groupBy(*keys, "opened_on").agg(F.min("incident_id").alias("_first"))
    if seen is not None:
        past = seen.select(*keys, F.col("last_on").alias("opened_on"))
        by_day = by_day.unionByName(
            past.withColumn("_first", F.lit(None).cast("long"))
        ).groupBy(*keys, "opened_on").agg(
            F.min("_first").alias("_first"),
            F.bool_or(F.col("_first").isNull()).alias("_seen"),
        )
    else:
        by_day = by_day.withColumn("_seen", F.lit(False))
    w = Window.partitionBy(*keys).orderBy("opened_on")
    by_day = materialise(by_day.withColumn("_before", F.lag("opened_on").over(w)))
    opens_day = (F.col("incident_id") == F.col("_first")) & ~F.col("_seen")
    flagged = (
        salted_join(alerts, by_day, [*keys, "opened_on"])
        .withColumn(
            "previous_on", F.when(opens_day, F.col("_before")).otherwise(F.col("opened_on"))
        )
        .withColumn(
            "duplicate",
            F.coalesce(F.datediff("opened_on", "previous_on") <= days, F.lit(False)),
        )
        .select(*alerts.columns, "previous_on", "duplicate")
    )
    return flagged, by_day.select(*keys, F.col("opened_on").alias("last_on"))


def _versions(spark: SparkSession, state: str, batch_id: int) -> dict[dt.date, list[int]]:
    """Days of the state and their versions from batches before this one, oldest first."""
    found = {}
    for folder in folders(spark, state):  # a day each, bounded by the horizon
        if not folder.startswith("day="):
            continue
        day = dt.date.fromisoformat(folder.partition("=")[2])
        own = sorted(int(v.partition("=")[2]) for v in folders(spark, f"{state}/{folder}"))
        if before := [v for v in own if v < batch_id]:
            found[day] = before
    return found


def days_seen(spark: SparkSession, state: str, batch_id: int, horizon: int, keys: T.StructType) -> DataFrame | None:
    """(keys, last_on) of the days that a batch can reach, as the batches before it left them."""
    versions = _versions(spark, state, batch_id)
    if not versions:
        return None
    first = max(versions) - dt.timedelta(days=horizon)
    parts = [f"{state}/day={day}/batch={own[-1]}" for day, own in sorted(versions.items()) if day >= first]
    schema = T.StructType([*keys.fields, T.StructField("last_on", T.DateType())])
    return spark.read.schema(schema).parquet(*parts)


def _tidy(spark: SparkSession, state: str, batch_id: int, horizon: int) -> None:
    """Remove what no batch from this one on reads."""
    versions = _versions(spark, state, batch_id)
    if not versions:
        return
    first = max(versions) - dt.timedelta(days=horizon)
    for day, own in versions.items():
        for version in own if day < first else own[:-1]:
            remove(spark, f"{state}/day={day}/batch={version}")
        if day < first and not folders(spark, f"{state}/day={day}"):
            remove(spark, f"{state}/day={day}")


def stream_dedupe(
    alerts: DataFrame,
    out: str,
    state: str,
    checkpoint: str,
    days: int,
    keys: tuple[str, ...] = ("asset_id", "kind"),
    late_days: int = 0,
) -> StreamingQuery:
    """Flag every arriving alert; inside a batch, alerts are ordered by day and id.
    An alert may arrive up to ``late_days`` after a newer one and still finds its
    predecessor; alerts flagged before it arrived stay as they were written. Days
    further back than that can no longer match and leave the state."""
    horizon = days + late_days

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialise(batch)  # read by every step below
        # this batch runs, so the one before it is done: what that one replaced may go
        _tidy(spark, state, batch_id, horizon)
        known = T.StructType([batch.schema[k] for k in keys])
        seen = days_seen(spark, state, batch_id, horizon, known)
        flagged, newest = flag_batch(batch, seen, days, keys)
        flagged.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        # what later batches can still reach, of the days this one touches: at most the horizon's days
        latest = newest.agg(F.max("last_on")).first()[0]
        if latest is None:
            return
        reached = batch.where(F.col("opened_on") >= F.date_sub(F.lit(latest), horizon))
        touched = [r[0] for r in reached.select("opened_on").distinct().collect()]
        changed = newest.where(F.col("last_on").isin(touched))
        (
            changed.withColumns({"day": F.col("last_on"), "batch": F.lit(batch_id)}).hint("rebalance", "day")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(state)
        )

    return (
        alerts.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
