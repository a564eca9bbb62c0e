"""Joining events to places, event by event or after reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.functions import pane_start
from placebeat.schemas import ENRICHED_SCHEMA


def enrich(cleaned: DataFrame, located: DataFrame) -> DataFrame:
    """One row per event and matching place; events without a place are dropped, duplicate places multiply events.

    The join carries no hint. Spark broadcasts the places only when their measured size is under
    ``spark.sql.autoBroadcastJoinThreshold``, else it sorts and merges, and adaptive execution cuts the partition of
    a place holding a large share of the events into pieces. Indicators avoid this join: see :func:`place_activity`.
    """
    return cleaned.join(located, "business_id", "inner").select(*ENRICHED_SCHEMA.fieldNames())


def reduced_activity(cleaned: DataFrame, pane: int | None = None, recent_from: Column | None = None) -> DataFrame:
    """Events reduced per business (and pane): ``event_count``, ``stars_sum``, ``max_event_time`` and, with ``recent_from``,
    ``recent_count``."""
    # One projection for all inputs, so that a subquery behind recent_from is evaluated outside the aggregation.
    events = cleaned.select(
        "business_id",
        "review_stars",
        "review_date",
        *([pane_start("review_date", pane).alias("pane_start")] if pane else []),
        *([(F.col("review_date") >= recent_from).alias("is_recent")] if recent_from is not None else []),
    )
    keys = ["business_id", *(["pane_start"] if pane else [])]
    return events.groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        F.sum("review_stars").alias("stars_sum"),
        F.max("review_date").alias("max_event_time"),
        *([F.count_if("is_recent").alias("recent_count")] if recent_from is not None else []),
    )


def place_activity(
    cleaned: DataFrame, located: DataFrame, pane: int | None = None, recent_from: Column | None = None
) -> DataFrame:
    """Events reduced per business (and pane) before they meet the places.

    After the reduction a business has one row, or one per pane, however many events it has, so a business holding a
    third of all events cannot skew the join. Columns: those of the places, ``event_count``, ``stars_sum``,
    ``max_event_time``; ``pane_start`` if ``pane`` (microseconds) is given; ``recent_count``, the events at or after
    ``recent_from``, if that is given.
    """
    return reduced_activity(cleaned, pane, recent_from).join(located, "business_id", "inner")
