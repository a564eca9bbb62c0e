"""Additive measures shared by every indicator.

An indicator accepts single events (``review_stars``) or rows already reduced to ``event_count`` and ``stars_sum``.
Both measures are sums, so any split of the input, by task, micro-batch or pane, merges to the same totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.functions import pane_start


def measured(events: DataFrame) -> DataFrame:
    """Give single events a count of one; reduced rows pass unchanged."""
    if "event_count" in events.columns:
        return events
    return events.withColumns({"event_count": F.lit(1).cast("bigint"), "stars_sum": F.col("review_stars")})


def latest_time(events: DataFrame) -> Column:
    """Newest event time of a row, single or reduced."""
    return F.col("max_event_time" if "max_event_time" in events.columns else "review_date")


def paned(events: DataFrame, width: int) -> DataFrame:
    """Measured rows with a ``pane_start`` column."""
    if "pane_start" in events.columns:
        return measured(events)
    return measured(events).withColumn("pane_start", pane_start("review_date", width))


def total(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.sum("event_count").alias("event_count"), F.sum("stars_sum").alias("stars_sum")
    )


def mean_stars() -> Column:
    return F.col("stars_sum") / F.col("event_count")


def rated(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finish totals: ``review_count`` and ``avg_stars`` after the keys."""
    return totals.select(*keys, F.col("event_count").alias("review_count"), mean_stars().alias("avg_stars"))
