"""City, area and category totals and the latest-event feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.functions import iso_timestamp, preview
from placebeat.operators.areas import AREA_COLUMNS, grid_totals, neighborhood_totals
from placebeat.operators.enrich import enrich
from placebeat.operators.measures import measured, rated, total
from placebeat.schemas import table_columns

NEWEST_FIRST = ("review_date", "review_id", "business_id")


def city_metrics(events: DataFrame) -> DataFrame:
    keys = ["city", "state"]
    return rated(total(measured(events), keys), keys)


def _area_table(totals: DataFrame, id_column: str) -> DataFrame:
    named = totals.withColumnRenamed("area_id", id_column)
    return rated(named, ["city", "state", id_column, "latitude", "longitude"])


def grid_hotspots(events: DataFrame, cell_size_km: float = 2.0) -> DataFrame:
    return _area_table(grid_totals(events, cell_size_km), "grid_id")


def neighborhood_hotspots(events: DataFrame, neighborhoods: DataFrame) -> DataFrame:
    return _area_table(neighborhood_totals(events, neighborhoods), "neighborhood_id")


def area_hotspots(panes: DataFrame, area_type: str, id_column: str) -> DataFrame:
    """The table of one area kind from area panes."""
    return _area_table(total(panes.filter(F.col("area_type") == area_type), AREA_COLUMNS), id_column)


def event_categories(enriched: DataFrame) -> DataFrame:
    """One row per event and category."""
    return enriched.select("review_id", "city", "review_stars", F.explode("categories").alias("category"))


def category_leaders(events: DataFrame) -> DataFrame:
    """Count and mean stars per city and category; a category listed twice by a place counts twice.

    Equal lists within a city are added up before they are exploded, so only distinct lists are copied.
    """
    per_list = total(measured(events).filter(F.size("categories") > 0), ["city", "categories"])
    exploded = per_list.select("city", F.explode("categories").alias("category"), "event_count", "stars_sum")
    keys = ["city", "category"]
    return rated(total(exploded, keys), keys)


def _newest(column: str) -> Column:
    return F.desc(column) if column == "review_date" else F.asc(column)


def newest(enriched: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest events, ties by review_id and business_id; each task keeps only its own best."""
    return enriched.orderBy(*map(_newest, NEWEST_FIRST)).limit(limit)


def feed(events: DataFrame) -> DataFrame:
    """Event rows in the shape of the feed."""
    return events.select(
        "review_id",
        "business_id",
        "business_name",
        "city",
        "state",
        F.col("review_stars").alias("stars"),
        iso_timestamp(F.col("review_date")).alias("review_date"),
        preview(F.col("review_text")).alias("summary"),
    ).select(*table_columns("latest_reviews"))


def latest_reviews(enriched: DataFrame, limit: int = 200) -> DataFrame:
    return feed(newest(enriched, limit))


def newest_of(cleaned: DataFrame, located: DataFrame, limit: int, narrow: DataFrame | None = None) -> DataFrame:
    """:func:`newest` from its two inputs, without shuffling all texts when the places are not broadcast.

    A first look at keys and times finds the time of the last row of the feed; only reviews from then on are read
    with their text and joined. ``narrow`` is a copy of the reviews without text to take the first look at.
    """
    known = (cleaned if narrow is None else narrow).select("business_id", "review_date").join(located.select("business_id"), "business_id")
    last = known.select("review_date").orderBy(F.desc("review_date")).limit(limit).agg(F.min("review_date"))
    return newest(enrich(cleaned.filter(F.col("review_date") >= last.scalar()), located), limit)


def latest_reviews_of(cleaned: DataFrame, located: DataFrame, limit: int = 200) -> DataFrame:
    return feed(newest_of(cleaned, located, limit))
