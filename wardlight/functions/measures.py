"""Numeric measures used in aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(condition: Column, digits: int | None = None) -> Column:
    """Share of rows meeting ``condition``, in percent; null on no rows."""
    share = F.try_divide(100.0 * F.count_if(condition).cast("double"), F.count("*"))
    return share if digits is None else F.round(share, digits)


def clamp01(value: Column) -> Column:
    """Clamped to [0, 1]; null stays null, which greatest and least alone skip."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
