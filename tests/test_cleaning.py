from datetime import datetime

from placebeat.operators.cleaning import clean_businesses, clean_reviews, oldest_reviews, places, rejected_reviews
from placebeat.operators.enrich import enrich, place_activity
from placebeat.operators.kpis import city_metrics
from placebeat.schemas import BUSINESS_SCHEMA, ENRICHED_SCHEMA, PLACE_SCHEMA, REVIEW_SCHEMA
from tests.helpers import rows


def businesses(spark, *items):
    return spark.createDataFrame(items, BUSINESS_SCHEMA)


def reviews(spark, *items):
    return spark.createDataFrame(items, REVIEW_SCHEMA)


def business(key, name="N", city="C", state="S", lat="1.0", lon="2.0", categories="a, b", stars="3.5"):
    return (key, name, city, state, lat, lon, categories, stars)


def test_business_defaults_and_drops(spark):
    raw = businesses(
        spark,
        business("full"),
        business("empty", name="", city="", state="", categories=None, stars=None),
        business("noname", name=None, stars="bad"),
        business(None), business("nocity", city=None), business("nostate", state=None),
        business("nolat", lat=None), business("nan", lon="NaN"), business("badlat", lat="north"),
    )
    found = places(raw)
    assert [f.name for f in found.schema] == PLACE_SCHEMA.fieldNames()
    assert rows(found) == [
        ("empty", "Unknown Business", "Unknown City", "NA", 1.0, 2.0, 0.0, []),
        ("full", "N", "C", "S", 1.0, 2.0, 3.5, ["a", "b"]),
        ("noname", "Unknown Business", "C", "S", 1.0, 2.0, 0.0, ["a", "b"]),
    ]
    assert clean_businesses(raw).count() == 6


def test_review_defaults_drops_and_rejects(spark):
    raw = reviews(
        spark,
        ("1", "b", "u", 5.0, "2020-01-02", "hi"),
        ("2", "b", "", None, "", None),
        ("3", "b", None, 1.0, "junk", "x"),
        (None, "b", "u", 1.0, "2020-01-01", "x"), ("5", None, "u", 1.0, "2020-01-01", "x"),
        ("6", "b", "u", 1.0, None, "x"),
    )
    assert rows(clean_reviews(raw)) == [
        ("1", "b", "u", 5.0, datetime(2020, 1, 2), "hi"),
        ("2", "b", "unknown_user", 0.0, datetime(1970, 1, 1), ""),
    ]
    assert rows(rejected_reviews(raw), "review_id", "date") == [("3", "junk")]


def test_typed_dates_pass(spark):
    raw = spark.sql(
        "SELECT '1' review_id, 'b' business_id, 'u' user_id, '4' stars, TIMESTAMP_NTZ '2020-01-01 01:02:03' date, '' text"
    )
    cleaned = clean_reviews(raw)
    assert cleaned.schema["review_date"].dataType.simpleString() == "timestamp_ntz"
    assert rows(cleaned, "review_date", "review_stars") == [(datetime(2020, 1, 1, 1, 2, 3), 4.0)]


def test_oldest_reviews_breaks_ties_by_id(spark):
    raw = reviews(spark, *((str(i), "b", "u", 1.0, f"2020-01-0{1 + i % 3}", "") for i in range(9)))
    assert rows(oldest_reviews(raw, 4), "review_id") == [("0",), ("1",), ("3",), ("6",)]
    assert oldest_reviews(raw, 0).count() == oldest_reviews(raw, None).count() == 9


def test_join_drops_unknown_and_multiplies_duplicates(spark):
    located = places(businesses(spark, business("b"), business("b", city="D"), business("other")))
    cleaned = clean_reviews(
        reviews(spark, ("1", "b", "u", 2.0, "2020-01-01", ""), ("1", "b", "u", 2.0, "2020-01-01", ""),
                ("2", "nowhere", "u", 1.0, "2020-01-01", ""))
    )
    joined = enrich(cleaned, located)
    assert joined.columns == ENRICHED_SCHEMA.fieldNames()
    assert rows(joined, "review_id", "city") == [("1", "C"), ("1", "C"), ("1", "D"), ("1", "D")]
    wanted = [("C", "S", 2, 2.0), ("D", "S", 2, 2.0)]
    assert rows(city_metrics(joined)) == wanted
    assert rows(city_metrics(place_activity(cleaned, located))) == wanted


def test_missing_stars_count_as_zero(spark):
    located = places(businesses(spark, business("b")))
    cleaned = clean_reviews(
        reviews(spark, ("1", "b", "u", 4.0, "2020-01-01", ""), ("2", "b", "u", None, "2020-01-01", ""))
    )
    assert rows(city_metrics(place_activity(cleaned, located))) == [("C", "S", 2, 2.0)]


def test_oldest_reviews_within_a_day_and_a_second(spark):
    times = ["2020-01-02 00:00:05", "2020-01-01 10:00:00", "2020-01-02 00:00:05", "2020-01-02 00:00:04", "2020-01-03 00:00:00", "2020-01-02 00:00:05"]
    found = reviews(spark, *((f"r{i}", "b", "u", 1.0, when, "") for i, when in enumerate(times)))
    order = sorted(range(len(times)), key=lambda i: (times[i], i))
    for n in range(1, 8):
        assert [r[0] for r in rows(oldest_reviews(found, n), "review_id")] == sorted(f"r{i}" for i in order[:n])
    assert oldest_reviews(found, None).count() == oldest_reviews(found, 0).count() == len(times)
