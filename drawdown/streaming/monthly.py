"""Incremental roll-up: records arrive, a day leaves once the watermark passes it, and days add up to months."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import month_index


def daily_stream(daily: DataFrame, *, entity: str = "entity_id", time: str = "ts", oil: str = "oil", water: str = "water", on: str = "hours_on",
                   lateness: str = "35 days") -> DataFrame:
    """One row per entity and day, with the month it belongs to. A day closes when no record of it can arrive any more; :func:`merge_days` gives the months."""
    m = F.date_trunc("month", F.col(time)).alias("month_start")
    return (daily.withWatermark(time, lateness).groupBy(F.col(entity), F.window(time, "1 day"), m)
            .agg(F.sum(oil).alias("oil"), F.sum(water).alias("water"), F.max((F.col(on) > 0).cast("int")).alias("on")))


def merge_days(days: DataFrame, *, entity: str = "entity_id") -> DataFrame:
    """Monthly rows from the emitted (entity, day) rows, e.g. inside foreachBatch on the accumulated day table."""
    return days.groupBy(entity, month_index("month_start").alias("mi")).agg(
        F.sum("oil").alias("oil"), F.sum("water").alias("water"), F.sum("on").alias("days_on"), F.count(F.lit(1)).alias("days"))
