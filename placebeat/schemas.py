"""Column contracts of the inputs, the joined event frame and the published tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Nullable columns from ``"name type, name type"``, readable before any session exists."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Names and types of the inputs, of the joined events and of the published tables.
# Streams and batch share this schema, so malformed JSON becomes nulls instead of a failed job.
REVIEW_SCHEMA = _schema("review_id string, business_id string, user_id string, stars double, date string, text string")

# The line itself where it isn't a whole JSON object of that schema.
RAW_REVIEW_SCHEMA = T.StructType([*REVIEW_SCHEMA.fields, T.StructField("malformed", T.StringType())])
REVIEW_COUNT_SCHEMA = _schema("outcome string, rows bigint")

# Numbers are read as text and converted with try_cast: quoted numbers survive, broken ones become null.
BUSINESS_SCHEMA = _schema(
    "business_id string, name string, city string, state string, "
    "latitude string, longitude string, categories string, stars string"
)

PLACE_SCHEMA = _schema(
    "business_id string, business_name string, city string, state string, "
    "latitude double, longitude double, business_stars double, categories array<string>"
)

ENRICHED_SCHEMA = _schema(
    "review_id string, business_id string, user_id string, review_stars double, review_date timestamp, "
    "review_text string, business_name string, city string, state string, latitude double, longitude double, "
    "business_stars double, categories array<string>"
)

NEIGHBORHOOD_SCHEMA = _schema(
    "business_id string, city string, state string, neighborhood_id string, center_lat double, center_lon double"
)

_WINDOW_COLUMNS = (
    "area_type string, area_id string, city string, state string, latitude double, longitude double, "
    "window_start timestamp, window_end timestamp, event_count bigint, avg_stars double, "
    "baseline_count double, baseline_stars double, hotspot_score double, rating_change double"
)

TABLE_SCHEMAS: dict[str, T.StructType] = {
    "city_metrics": _schema("city string, state string, review_count bigint, avg_stars double"),
    "grid_hotspots": _schema(
        "city string, state string, grid_id string, latitude double, longitude double, "
        "review_count bigint, avg_stars double"
    ),
    "neighborhood_hotspots": _schema(
        "city string, state string, neighborhood_id string, latitude double, longitude double, "
        "review_count bigint, avg_stars double"
    ),
    "window_hotspots": _schema(_WINDOW_COLUMNS),
    "emerging_areas": _schema(_WINDOW_COLUMNS),
    "category_mix": _schema(
        "area_type string, area_id string, city string, state string, latitude double, longitude double, "
        "category string, current_count bigint, current_share double, baseline_share double, "
        "anomaly_score double, window_end timestamp"
    ),
    "city_activity_windows": _schema(
        "city string, state string, window_start timestamp, window_end timestamp, event_count bigint, avg_stars double"
    ),
    "category_leaders": _schema("city string, category string, review_count bigint, avg_stars double"),
    "latest_reviews": _schema(
        "review_id string, business_id string, business_name string, city string, state string, "
        "stars double, review_date string, summary string"
    ),
}

# Additive partial results, from which all tables can be finished; kept per micro-batch by the streaming jobs.
_AREA = "area_type string, area_id string, city string, state string, latitude double, longitude double"
PARTIAL_SCHEMAS: dict[str, T.StructType] = {
    "area_panes": _schema(f"{_AREA}, pane_start timestamp, event_count bigint, stars_sum double"),
    "area_categories": _schema(
        f"{_AREA}, category string, event_count bigint, stars_sum double, max_event_time timestamp"
    ),
    "recent_categories": _schema(f"{_AREA}, category string, event_time timestamp, event_count bigint"),
    "newest_events": _schema(
        "review_id string, business_id string, business_name string, city string, state string, "
        "review_stars double, review_date timestamp, review_text string"
    ),
}

# Totals of closed windows, one row per area and window, as a watermarked stream appends them.
CLOSED_SCHEMA = _schema(f"{_AREA}, window_start timestamp, window_end timestamp, event_count bigint, stars_sum double")


def table_columns(name: str) -> list[str]:
    return TABLE_SCHEMAS[name].fieldNames()
