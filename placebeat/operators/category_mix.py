"""Current against usual category shares per area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebeat.functions import duration_micros, grid_cell, interval
from placebeat.operators.areas import AREA_COLUMNS, GRID, NEIGHBORHOOD, with_neighborhood
from placebeat.operators.measures import latest_time, measured
from placebeat.params import Params
from placebeat.schemas import table_columns

_BUSINESS = ["business_id", "city", "state", "latitude", "longitude", "categories"]


def with_categories(events: DataFrame) -> DataFrame:
    return events.filter(F.size("categories") > 0)


def newest_time(events: DataFrame) -> DataFrame:
    """One row: the newest time of an event that has a category, over all areas."""
    tagged = with_categories(events)
    return tagged.agg(F.max(latest_time(tagged)).alias("latest"))


def recent_start(latest: Column, params: Params) -> Column:
    return latest - interval(duration_micros(params.window_duration))


def in_areas(
    tagged: DataFrame, cell_size_km: float, neighborhoods: DataFrame | None, columns: Sequence[str] = ()
) -> DataFrame:
    """Rows of places placed in their cell and, if assignments are given, again in their neighborhood."""
    cell = grid_cell(F.col("latitude"), F.col("longitude"), cell_size_km)
    grid = tagged.select(
        "business_id",
        F.lit(GRID).alias("area_type"),
        cell.grid_id.alias("area_id"),
        "city",
        "state",
        cell.latitude.alias("latitude"),
        cell.longitude.alias("longitude"),
        "categories",
        *columns,
    )
    if neighborhoods is None:
        return grid
    joined = with_neighborhood(tagged.drop("latitude", "longitude"), neighborhoods)
    return grid.unionByName(
        joined.select(
            "business_id",
            F.lit(NEIGHBORHOOD).alias("area_type"),
            F.col("neighborhood_id").alias("area_id"),
            "city",
            "state",
            F.col("center_lat").alias("latitude"),
            F.col("center_lon").alias("longitude"),
            "categories",
            *columns,
        )
    )


def exploded(placed: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """One row per area row and category."""
    return placed.select(*AREA_COLUMNS, F.explode("categories").alias("category"), *columns)


def category_event_frame(enriched: DataFrame, cell_size_km: float, neighborhoods: DataFrame | None = None) -> DataFrame:
    """Single events per area and category."""
    timed = with_categories(enriched).withColumn("event_time", F.col("review_date"))
    placed = in_areas(timed, cell_size_km, neighborhoods, ["event_time"])
    return placed.select("business_id", *AREA_COLUMNS, F.explode("categories").alias("category"), "event_time")


def shares(counts: DataFrame, latest: Column) -> DataFrame:
    """The published table from ``current_count`` and ``baseline_count`` per area, city, state and category.

    Shares are of the area's total, which cities sharing a cell have in common. An area without a current event has
    a current total of zero: its rows carry no current count and are dropped after the totals.
    """
    area = Window.partitionBy("area_type", "area_id")

    def share(column: str) -> Column:
        return F.try_divide(F.col(column), F.sum(column).over(area))

    return (
        counts.withColumns({"current_share": share("current_count"), "baseline_share": share("baseline_count")})
        .filter(F.col("current_count") > 0)
        .withColumn("anomaly_score", F.col("current_share") - F.col("baseline_share"))
        .withColumn("window_end", latest)
        .select(*table_columns("category_mix"))
    )


def category_mix(events: DataFrame, params: Params, neighborhoods: DataFrame | None = None) -> DataFrame:
    """Share of each category now and over all time, per area, city and state.

    "Now" is the window ending at the newest event of all areas, end included. One conditional aggregation gives both
    counts. Events are reduced per business first, so categories are exploded per business and not per event. Rows
    reduced by ``place_activity(..., recent_from=...)`` bring their recent count along.
    """
    latest = newest_time(events)
    tagged = measured(with_categories(events))
    if "recent_count" not in tagged.columns:
        since = latest.select(recent_start(F.col("latest"), params)).scalar()
        tagged = tagged.withColumn("recent_count", F.when(latest_time(tagged) >= since, F.lit(1)).otherwise(F.lit(0)))
    per_business = tagged.groupBy(*_BUSINESS).agg(
        F.sum("event_count").alias("baseline_count"), F.sum("recent_count").alias("current_count")
    )
    counted = ["baseline_count", "current_count"]
    placed = in_areas(per_business, params.cell_size_km, neighborhoods, counted)
    counts = (
        exploded(placed, counted)
        .groupBy(*AREA_COLUMNS, "category")
        .agg(*(F.sum(name).alias(name) for name in counted))
    )
    return shares(counts, latest.scalar())
