from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placebeat.functions import (
    cluster_count, duration_micros, grid_cell, interval, iso_timestamp, last_start, pane_start, pane_width, parse_categories,
    parse_date, preview, start_before, strip,
)
from tests.helpers import values


def cells(spark, points, km):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, o double")
    return [tuple(r) for r in frame.orderBy("i").select(*grid_cell(F.col("a"), F.col("o"), km)).collect()]


def test_near_points_share_a_cell(spark):
    first, second = cells(spark, [(36.1699, -115.1398), (36.1701, -115.1402)], 1.0)
    assert first == second == ("4014_-12781", 36.166667, -115.13964)


def test_cell_without_coordinate_is_null(spark):
    assert cells(spark, [(None, 1.0), (1.0, None)], 2.0) == [(None,) * 3] * 2


def test_cell_size_has_a_minimum(spark):
    assert cells(spark, [(36.0, -115.0)], 0.001) == cells(spark, [(36.0, -115.0)], 0.1)


def test_cells_against_arithmetic(spark):
    from math import floor

    points = [(-0.001, 0.001), (89.9, -179.9), (0.0, 0.0), (-33.86, 151.21), (51.5, -0.12)]
    size = 2.0 / 111.0
    wanted = [
        (f"{floor(a / size)}_{floor(o / size)}", round((floor(a / size) + 0.5) * size, 6),
         round((floor(o / size) + 0.5) * size, 6))
        for a, o in points
    ]
    assert cells(spark, points, 2.0) == wanted


@pytest.mark.parametrize(
    "raw, names",
    [
        (None, []), ("", []), ("  ", []), ("Mexican,  Food , Nightlife", ["Mexican", "Food", "Nightlife"]),
        ("a,,b", ["a", "b"]), ("a,a", ["a", "a"]), ("\ta , b\n", ["a", "b"]), (" , a , ", ["a"]),
        ("Bars & Pubs, Coffee  Tea", ["Bars & Pubs", "Coffee  Tea"]), ("\x1ca\x1f,b", ["a", "b"]),
    ],
)
def test_parse_categories(spark, raw, names):
    assert values(spark, parse_categories, [raw]) == [names]


def test_parse_categories_like_python(spark):
    alphabet = st.sampled_from(list("ab ,,\t 　\n-"))

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(alphabet, max_size=12), min_size=30, max_size=60))
    def check(raws):
        wanted = [[c.strip() for c in raw.split(",") if c.strip()] for raw in raws]
        assert values(spark, parse_categories, raws) == wanted

    check()


def test_strip_and_preview(spark):
    assert values(spark, strip, ["\t x y  ", ""]) == ["x y", ""]
    long = "\U0001f600" * 300
    assert values(spark, preview, [None, "short", long]) == ["", "short", long[:280]]


def test_iso_timestamp(spark):
    times = [datetime(2020, 1, 1), datetime(2020, 1, 1, 10, 11, 12), datetime(2020, 1, 1, 0, 0, 0, 500000),
             datetime(2020, 1, 1, 0, 0, 0, 7)]
    for kind in ("timestamp", "timestamp_ntz"):
        assert values(spark, iso_timestamp, times, kind) == [t.isoformat() for t in times]


def test_parse_date(spark):
    cases = {
        "": datetime(1970, 1, 1),
        "2020-01-01": datetime(2020, 1, 1),
        "2020-1-5": datetime(2020, 1, 5),
        "2020-01-01 10:11:12": datetime(2020, 1, 1, 10, 11, 12),
        "2020-01-01T10:11:12": datetime(2020, 1, 1, 10, 11, 12),
        "2020-01-01 10:11": datetime(2020, 1, 1, 10, 11),
        "2020-01-01 10:11:12.25": datetime(2020, 1, 1, 10, 11, 12, 250000),
        "2020-01-01T10:11:12+02:00": datetime(2020, 1, 1, 8, 11, 12),
        "2020-01-01T10:11:12Z": datetime(2020, 1, 1, 10, 11, 12),
        "20200101": datetime(2020, 1, 1),
        "20200101T101112": datetime(2020, 1, 1, 10, 11, 12),
        "2020-01-01 junk": datetime(2020, 1, 1),
        "2020-01-01 1:2:3": datetime(2020, 1, 1),
        "2020-01-01 ": datetime(2020, 1, 1),
        "2020-01-01 99:99": datetime(2020, 1, 1),
        "junk": None,
        "2020-01-01junk": None,
        " 2020-01-01": None,
        "2020-02-30": None,
        "10:11:12": None,
        "99999": None,
        "2020": None,
        None: None,
    }
    assert dict(zip(cases, values(spark, parse_date, list(cases)))) == cases


@pytest.mark.parametrize(
    "text, minutes",
    [("30 minutes", 30), ("1 hour", 60), ("1 day", 1440), ("90 seconds", 1.5), ("1 day 12 hours", 2160),
     ("2 weeks", 20160), ("INTERVAL 5 minute", 5), ("15 min", 15)],
)
def test_duration(text, minutes):
    assert duration_micros(text) == minutes * 60_000_000


@pytest.mark.parametrize("text", ["1 month", "1 year", "soon", "", "0 minutes", "-5 minutes", "5", "5 minutes ago"])
def test_bad_duration(text):
    with pytest.raises(ValueError):
        duration_micros(text)


def test_cluster_count(spark):
    wanted = {0: 1, 1: 1, 2: 2, 4: 2, 8: 2, 9: 3, 143: 11, 144: 12, 100000: 12}
    assert dict(zip(wanted, values(spark, cluster_count, list(wanted), "bigint"))) == wanted


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize(
    "duration, slide", [("30 minutes", "10 minutes"), ("20 minutes", "20 minutes"), ("50 minutes", "20 minutes"),
                        ("1 day", "7 hours"), ("90 seconds", "60 seconds")]
)
def test_panes_cover_the_windows_of_spark(spark, duration, slide, kind):
    start = datetime(1969, 12, 31, 23, 0)
    times = [start + timedelta(minutes=7 * i, microseconds=i) for i in range(40)]
    frame = spark.createDataFrame([(t,) for t in times], f"t {kind}")
    width = pane_width(duration, slide)
    panes = frame.select("t", pane_start("t", width).alias("p"))
    placed = panes.withColumn("last", last_start(F.col("p"), duration, slide))
    placed = placed.withColumn("first", start_before(F.col("p"), F.col("last"), duration, slide) + interval(duration_micros(slide)))
    ours = placed.filter("first <= last").select("t", F.explode(F.sequence("first", "last", interval(duration_micros(slide)))).alias("s"))
    theirs = frame.select("t", F.window("t", duration, slide).start.alias("s"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_windows_with_gaps_are_refused():
    with pytest.raises(ValueError, match="longer"):
        pane_width("20 minutes", "30 minutes")
