"""Cleaning of raw reviews and businesses."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebeat.functions import parse_categories, parse_date
from placebeat.operators.ranking import first_rows
from placebeat.plans.stage import Stage
from placebeat.schemas import REVIEW_COUNT_SCHEMA

REVIEW_KEYS = ("review_id", "business_id", "date")
BUSINESS_KEYS = ("business_id", "city", "state")
COORDINATES = ("latitude", "longitude")

# Replacements for missing attributes.
UNKNOWN_USER = "unknown_user"
UNKNOWN_NAME = "Unknown Business"
UNKNOWN_CITY = "Unknown City"
UNKNOWN_STATE = "NA"


def _filled(column: str, default: str) -> Column:
    """The column, or the default where it is null or empty."""
    return F.when(F.col(column) != "", F.col(column)).otherwise(default)


def _number(column: str) -> Column:
    return F.expr(f"try_cast(`{column}` AS double)")


def _event_time(reviews: DataFrame) -> Column:
    """Dates given as text are parsed; typed dates are taken as they are."""
    kind = reviews.schema["date"].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.col("date")
    if isinstance(kind, T.DateType):
        return F.col("date").cast("timestamp")
    return parse_date(F.col("date"))


def _with_event_time(reviews: DataFrame) -> DataFrame:
    required = reviews.select("review_id", "business_id", "user_id", "stars", "date", "text").dropna(subset=REVIEW_KEYS)
    return required.withColumn("review_date", _event_time(reviews))


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Typed reviews with defaults.

    Rows without review_id, business_id or date are dropped, as are rows whose date cannot be read (see
    :func:`rejected_reviews`). Missing stars count as 0.0, also in averages.
    """
    return (
        _with_event_time(reviews)
        .filter(F.col("review_date").isNotNull())
        .select(
            "review_id",
            "business_id",
            _filled("user_id", UNKNOWN_USER).alias("user_id"),
            F.coalesce(_number("stars"), F.lit(0.0)).alias("review_stars"),
            "review_date",
            F.coalesce("text", F.lit("")).alias("review_text"),
        )
    )


def rejected_reviews(reviews: DataFrame) -> DataFrame:
    """The rows :func:`clean_reviews` drops because their date is no date."""
    return _with_event_time(reviews).filter(F.col("review_date").isNull()).drop("review_date")


# What becomes of a raw row; every row has one of them.
KEPT, MALFORMED, WITHOUT_KEY, UNDATED = OUTCOMES = ("kept", "malformed", "without_key", "undated")


def with_outcome(reviews: DataFrame) -> DataFrame:
    """The raw rows with ``review_date_`` (the parsed date) and ``outcome``.

    A row without a key is malformed if its line could not be read as a whole, which the column ``malformed`` of the sources
    tells by holding the line; a broken optional field alone loses no row.
    """
    keyless = reduce(Column.__or__, (F.col(key).isNull() for key in REVIEW_KEYS))
    broken = F.col("malformed").isNotNull() if "malformed" in reviews.columns else F.lit(False)
    dated = reviews.withColumn("review_date_", _event_time(reviews))
    outcome = F.when(keyless & broken, MALFORMED).when(keyless, WITHOUT_KEY).when(F.col("review_date_").isNull(), UNDATED).otherwise(KEPT)
    return dated.withColumn("outcome", outcome)


def outcome_counts(found: Mapping[str, int], spark: SparkSession) -> DataFrame:
    """One row per outcome with the number of rows, none left out."""
    return spark.createDataFrame([(name, int(found.get(name) or 0)) for name in OUTCOMES], REVIEW_COUNT_SCHEMA)


def counted_by_outcome(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows with their ``outcome`` counted while they pass by; the counts are there once an action on them has ended."""
    seen = Observation(name)
    return rows.observe(seen, *(F.count_if(F.col("outcome") == x).alias(x) for x in OUTCOMES)), seen


def clean_businesses(businesses: DataFrame) -> DataFrame:
    """The eight used columns, rows without identifier, city or state dropped, numbers as doubles (null if broken)."""
    return (
        businesses.select("business_id", "name", "city", "state", "latitude", "longitude", "categories", "stars")
        .dropna(subset=BUSINESS_KEYS)
        .withColumns({name: _number(name) for name in (*COORDINATES, "stars")})
    )


def places(businesses: DataFrame) -> DataFrame:
    """Cleaned businesses with usable coordinates, defaults filled in and categories as an array.

    A missing coordinate is null or NaN. Categories are parsed here, once per business, and never once per event.
    """
    return (
        clean_businesses(businesses)
        .dropna(subset=COORDINATES)
        .select(
            "business_id",
            _filled("name", UNKNOWN_NAME).alias("business_name"),
            _filled("city", UNKNOWN_CITY).alias("city"),
            _filled("state", UNKNOWN_STATE).alias("state"),
            "latitude",
            "longitude",
            F.coalesce("stars", F.lit(0.0)).alias("business_stars"),
            parse_categories(F.col("categories")).alias("categories"),
        )
    )


def _reached(rows: DataFrame, bucket: Column, limit: int, stage: Stage, name: str) -> tuple[Column, int] | None:
    """The bucket of time in which the oldest ``limit`` rows end, as a scalar subquery, and the number of rows before it."""
    counts = stage.write(name, rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = counts.select("bucket", earlier.alias("earlier")).filter(F.col("earlier") < limit)
    before = reached.agg(F.max("earlier").alias("earlier")).first()["earlier"]
    return None if before is None else (reached.agg(F.max("bucket")).scalar(), before)


def oldest_reviews(reviews: DataFrame, limit: int | None, stage: Stage | None = None) -> DataFrame:
    """Cleaned reviews, or only the ``limit`` oldest in time order (ties by review_id, then business_id); no limit or 0 means all.

    Without a limit no order is imposed: no indicator needs one, and a global sort would move every review. With one, rows
    are counted per day, then per second of the day in which the limit is reached (a row per bucket is all that meets in a
    task); whole days and seconds before are kept as they are, and only the keys of one second are ranked, in ranges of about
    equal size, as all rows may share that second. The counts and that ranking are jobs of their own; ``stage`` keeps the keys.
    """
    cleaned = clean_reviews(reviews)
    if not limit:
        return cleaned
    day, second = F.to_date("review_date"), F.date_trunc("second", "review_date")
    store = stage or Stage(reviews.sparkSession)
    found = _reached(cleaned, day, limit, store, "days")
    if found is None:
        return cleaned
    last_day, before_day = found
    in_day = cleaned.filter(day == last_day)
    last_second, before_second = _reached(in_day, second, limit - before_day, store, "seconds")
    whole = cleaned.filter((day < last_day) | (day == last_day) & (second < last_second))
    order = ("review_date", "review_id", "business_id")
    return whole.unionByName(first_rows(in_day.filter(second == last_second), order, limit - before_day - before_second, store))
