"""Queries on the published tables: filters, rankings, pick lists and time series.

Filters are plain comparisons on stored columns, so they reach the Parquet scan. City filters use the name alone, as
cities are picked by name. Every ranking has a total order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Defaults of the filters and lengths of the lists.
MIN_REVIEWS = 5
SCORE_THRESHOLD = 1.2
TOP_CATEGORIES_OF_AREA = 10
LEADERBOARD_LENGTH = 20
FEED_LENGTH = 50
MAX_POINTS = 300

# Columns of the views.
_EMERGING_COLUMNS = (
    "area_type", "area_id", "event_count", "hotspot_score", "avg_stars", "rating_change", "window_start",
)
_SERIES_COLUMNS = (
    "area_type", "area_id", "window_start", "event_count", "hotspot_score", "avg_stars", "rating_change",
)
_MIX_COLUMNS = ("category", "current_count", "current_share", "baseline_share", "anomaly_score")


def _of_city(table: DataFrame, city: str) -> DataFrame:
    return table.filter(F.col("city") == city)


def city_options(city_metrics: DataFrame) -> DataFrame:
    return city_metrics.select("city").distinct().orderBy("city")


def default_city(city_metrics: DataFrame, preferred: str) -> DataFrame:
    """One row: the preferred city if it has data, else the first by name."""
    present = F.max(F.when(F.col("city") == preferred, F.col("city")))
    return city_metrics.agg(F.coalesce(present, F.min("city")).alias("city"))


def dense_city_options(neighborhood_hotspots: DataFrame) -> DataFrame:
    """Cities that have neighborhoods."""
    return city_options(neighborhood_hotspots)


def category_options(category_mix: DataFrame, city: str) -> DataFrame:
    return _of_city(category_mix, city).select("category").distinct().orderBy("category")


def area_type_options(table: DataFrame, city: str) -> DataFrame:
    return _of_city(table, city).select("area_type").distinct().orderBy("area_type")


def area_options(table: DataFrame, city: str, area_type: str) -> DataFrame:
    chosen = _of_city(table, city).filter(F.col("area_type") == area_type)
    return chosen.select("area_id").distinct().orderBy("area_id")


def city_hotspots(hotspots: DataFrame, city: str, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Grid or neighborhood hotspots of a city with at least ``min_reviews`` events."""
    return _of_city(hotspots, city).filter(F.col("review_count") >= min_reviews)


def map_midpoint(hotspots: DataFrame) -> DataFrame:
    """One row: plain mean of the coordinates of the given hotspots."""
    return hotspots.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def city_emerging(emerging_areas: DataFrame, city: str) -> DataFrame:
    """Emerging areas of a city, highest score first."""
    ranked = _of_city(emerging_areas, city).orderBy(F.desc("hotspot_score"), "area_type", "area_id", "state")
    return ranked.select(*_EMERGING_COLUMNS)


def city_window_hotspots(
    window_hotspots: DataFrame,
    city: str,
    min_events: int = MIN_REVIEWS,
    min_score: float = SCORE_THRESHOLD,
    first_day: date | str | None = None,
    last_day: date | str | None = None,
) -> DataFrame:
    """Windows of a city over both thresholds whose start day lies between the given days, ends included."""
    found = _of_city(window_hotspots, city).filter(
        (F.col("event_count") >= min_events)
        & (F.col("hotspot_score") >= min_score)
        & F.col("window_start").isNotNull()
    )

    def midnight(day: date | str) -> Column:
        return F.lit(str(day)).cast("date").cast("timestamp_ntz")

    # Compared as times, not as to_date(window_start), so the bounds can be used by the scan.
    if first_day is not None:
        found = found.filter(F.col("window_start") >= midnight(first_day))
    if last_day is not None:
        found = found.filter(F.col("window_start") < midnight(last_day) + F.expr("INTERVAL '1' DAY"))
    return found


def window_date_bounds(windows: DataFrame) -> DataFrame:
    """One row: first and last start day; windows without a start are ignored."""
    return windows.agg(
        F.to_date(F.min("window_start")).alias("first_day"), F.to_date(F.max("window_start")).alias("last_day")
    )


def areas_with_category(category_mix: DataFrame, category: str, city: str | None = None) -> DataFrame:
    """Areas in which a category currently occurs."""
    mix = category_mix if city is None else _of_city(category_mix, city)
    return mix.filter(F.col("category") == category).select("area_type", "area_id").distinct()


def area_choice(windows: DataFrame, category_mix: DataFrame, city: str, category: str | None = None) -> DataFrame:
    """Areas of a city that have windows, only those holding ``category`` if one is given."""
    areas = _of_city(windows, city).select("area_type", "area_id").distinct()
    if category is not None:
        areas = areas.join(areas_with_category(category_mix, category, city), ["area_type", "area_id"], "left_semi")
    return areas.orderBy("area_type", "area_id")


def area_series(windows: DataFrame, city: str, area_type: str, area_id: str, newest_first: bool = False) -> DataFrame:
    """Windows of one area in time order, or newest first."""
    chosen = _of_city(windows, city).filter((F.col("area_type") == area_type) & (F.col("area_id") == area_id))
    time = F.desc("window_start") if newest_first else F.asc("window_start")
    return chosen.orderBy(time, "state").select(*_SERIES_COLUMNS)


def area_top_categories(
    category_mix: DataFrame,
    city: str,
    area_type: str,
    area_id: str,
    limit: int = TOP_CATEGORIES_OF_AREA,
    category: str | None = None,
) -> DataFrame:
    """Categories of one area by current share, or the chosen category alone."""
    chosen = _of_city(category_mix, city).filter((F.col("area_type") == area_type) & (F.col("area_id") == area_id))
    if category is not None:
        chosen = chosen.filter(F.col("category") == category)
    return chosen.orderBy(F.desc("current_share"), "category", "state").limit(limit).select(*_MIX_COLUMNS)


def top_categories_by_area(category_mix: DataFrame, limit: int = TOP_CATEGORIES_OF_AREA) -> DataFrame:
    """The same for every area of every city at once; the rank limit is applied before and after the shuffle."""
    best = Window.partitionBy("city", "area_type", "area_id").orderBy(F.desc("current_share"), "category", "state")
    ranked = category_mix.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    return ranked.select("city", "area_type", "area_id", "rank", *_MIX_COLUMNS)


def activity_series(city_activity_windows: DataFrame, max_points: int = MAX_POINTS) -> DataFrame:
    """Activity of every city in time order, thinned to at most ``max_points`` rows per city for a chart.

    With n rows every ceil(n / max_points)-th is kept, the first included. Ranks run per city, whose rows are bounded
    by the calendar.
    """
    city = Window.partitionBy("city")
    position = F.row_number().over(city.orderBy("window_start", "state")) - 1
    step = F.ceil(F.count("*").over(city) / max_points)
    numbered = city_activity_windows.withColumns({"position": position, "step": step})
    return numbered.filter(F.col("position") % F.col("step") == 0).select(*city_activity_windows.columns)


def city_activity_series(city_activity_windows: DataFrame, city: str, max_points: int = MAX_POINTS) -> DataFrame:
    return activity_series(_of_city(city_activity_windows, city), max_points).orderBy("window_start", "state")


def city_leaderboard(city_metrics: DataFrame, limit: int = LEADERBOARD_LENGTH) -> DataFrame:
    return city_metrics.orderBy(F.desc("review_count"), "city", "state").limit(limit)


def top_city_categories(category_leaders: DataFrame, city: str, limit: int = LEADERBOARD_LENGTH) -> DataFrame:
    return _of_city(category_leaders, city).orderBy(F.desc("review_count"), "category").limit(limit)


def recent_feed(latest_reviews: DataFrame, limit: int = FEED_LENGTH) -> DataFrame:
    """Newest rows of the feed; stored files have no order, so it is stated."""
    return latest_reviews.orderBy(F.desc("review_date"), "review_id", "business_id").limit(limit)
