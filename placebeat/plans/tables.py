"""The nine published tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from placebeat.operators.category_mix import category_mix
from placebeat.operators.hotspots import city_activity_windows, emerging_areas, window_hotspots
from placebeat.operators.kpis import (
    category_leaders,
    city_metrics,
    grid_hotspots,
    latest_reviews,
    neighborhood_hotspots,
)
from placebeat.params import Params
from placebeat.schemas import NEIGHBORHOOD_SCHEMA


def build_tables(
    enriched: DataFrame, params: Params, neighborhoods: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All tables from one joined event frame, each a lazy plan of its own.

    Empty input gives empty tables with their full schema; no job looks at the data first. Callers that write all
    tables may persist ``enriched`` without ``review_text`` columns they do not need, or use the static job, which
    reduces the events once for all tables.
    """
    assigned = neighborhoods
    if assigned is None:
        assigned = enriched.sparkSession.createDataFrame([], NEIGHBORHOOD_SCHEMA)
    windows = window_hotspots(enriched, params, neighborhoods)
    return {
        "city_metrics": city_metrics(enriched),
        "grid_hotspots": grid_hotspots(enriched, params.cell_size_km),
        "neighborhood_hotspots": neighborhood_hotspots(enriched, assigned),
        "window_hotspots": windows,
        "emerging_areas": emerging_areas(windows, params),
        "category_mix": category_mix(enriched, params, neighborhoods),
        "city_activity_windows": city_activity_windows(enriched, params),
        "category_leaders": category_leaders(enriched),
        "latest_reviews": latest_reviews(enriched, params.latest_limit),
    }
