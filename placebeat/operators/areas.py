"""Areas: grid cells and neighborhoods as one shape (area_type, area_id, city, state, latitude, longitude)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebeat.functions import grid_cell
from placebeat.functions.geo import cell_at, cell_index
from placebeat.operators.measures import measured, paned, total

AREA_KEY = ["area_type", "area_id", "city", "state"]
AREA_COLUMNS = [*AREA_KEY, "latitude", "longitude"]  # the center follows from the key
GRID, NEIGHBORHOOD = "grid", "neighborhood"


def event_frame(enriched: DataFrame) -> DataFrame:
    """The seven columns the indicators need; review text is pruned from the scan on."""
    return enriched.select(
        "business_id", "city", "state", "latitude", "longitude", "review_stars", F.col("review_date").alias("event_time")
    )


def grid_event_frame(enriched: DataFrame, cell_size_km: float = 2.0) -> DataFrame:
    """:func:`event_frame` with the cell identifier, and the cell center in place of the coordinates."""
    cell = grid_cell(F.col("latitude"), F.col("longitude"), cell_size_km)
    return event_frame(enriched).select(
        "business_id",
        "city",
        "state",
        cell.grid_id.alias("grid_id"),
        cell.latitude.alias("latitude"),
        cell.longitude.alias("longitude"),
        "review_stars",
        "event_time",
    )


def grid_totals(events: DataFrame, cell_size_km: float, keys: Sequence[str] = ()) -> DataFrame:
    """Count and sum per city, state, cell and further keys.

    A cell crossing a city border has a row per city. Rows are grouped by the two cell numbers; identifier and center
    are written out once per group.
    """
    indexed = measured(events).withColumns(
        {
            "lat_index": cell_index(F.col("latitude"), cell_size_km),
            "lon_index": cell_index(F.col("longitude"), cell_size_km),
        }
    )
    grouped = total(indexed, ["city", "state", "lat_index", "lon_index", *keys])
    cell = cell_at(F.col("lat_index"), F.col("lon_index"), cell_size_km)
    return grouped.select(
        F.lit(GRID).alias("area_type"),
        cell.grid_id.alias("area_id"),
        "city",
        "state",
        cell.latitude.alias("latitude"),
        cell.longitude.alias("longitude"),
        *keys,
        "event_count",
        "stars_sum",
    )


def with_neighborhood(rows: DataFrame, neighborhoods: DataFrame) -> DataFrame:
    """Rows of places joined to the neighborhood of their business, where city and state agree.

    Only the business is a join key, so that both sides are read as they lie if they are kept by business.
    """
    city, state = (F.col(c) == F.col(f"{c}_of") for c in ("city", "state"))
    named = neighborhoods.select(
        F.col("business_id").alias("business_of"), F.col("city").alias("city_of"), F.col("state").alias("state_of"),
        "neighborhood_id", "center_lat", "center_lon",
    )
    agree = F.coalesce(city & state, F.lit(False))
    return rows.join(named, (F.col("business_id") == F.col("business_of")) & agree).drop("business_of", "city_of", "state_of")


def neighborhood_totals(events: DataFrame, neighborhoods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count and sum per neighborhood and further keys; places without a neighborhood drop out.

    Events are reduced per business before the join with the assignments, so a busy business cannot skew it.
    """
    per_business = total(measured(events), ["business_id", "city", "state", *keys])
    joined = with_neighborhood(per_business, neighborhoods).select(
        F.lit(NEIGHBORHOOD).alias("area_type"),
        F.col("neighborhood_id").alias("area_id"),
        "city",
        "state",
        F.col("center_lat").alias("latitude"),
        F.col("center_lon").alias("longitude"),
        *keys,
        "event_count",
        "stars_sum",
    )
    return total(joined, [*AREA_COLUMNS, *keys])


def area_panes(
    events: DataFrame, pane: int, cell_size_km: float, neighborhoods: DataFrame | None = None
) -> DataFrame:
    """Count and sum per area and pane: the additive base of all time and area indicators."""
    timed = paned(events, pane)
    panes = grid_totals(timed, cell_size_km, ["pane_start"])
    if neighborhoods is None:
        return panes
    return panes.unionByName(neighborhood_totals(timed, neighborhoods, ["pane_start"]))
