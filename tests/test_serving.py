from datetime import date, datetime, timedelta

import pytest

from placebeat.operators import serving
from placebeat.schemas import TABLE_SCHEMAS
from tests.helpers import DAY, rows


def table(spark, name, items):
    return spark.createDataFrame(items, TABLE_SCHEMAS[name])


@pytest.fixture(scope="module")
def windows(spark):
    def window(city, area, day, count, score, change=0.0, kind="grid"):
        start = None if day is None else datetime(2020, 1, day, 12)
        end = start and start + timedelta(hours=1)
        return (kind, area, city, "S", 1.0, 2.0, start, end, count, 4.0, 1.0, 4.0, score, change)

    return table(
        spark, "window_hotspots",
        [window("A", "a1", 1, 9, 2.0), window("A", "a1", 3, 5, 1.2), window("A", "a1", 2, 9, 1.1),
         window("A", "a2", 2, 4, 3.0), window("A", "a2", None, 9, 9.0), window("A", "n1", 4, 9, 2.0, kind="neighborhood"),
         window("B", "b1", 1, 9, 2.0)],
    )


@pytest.fixture(scope="module")
def mix(spark):
    def share(city, area, category, current, kind="grid"):
        return (kind, area, city, "S", 1.0, 2.0, category, int(current * 100), current, 0.1, current - 0.1, DAY)

    return table(
        spark, "category_mix",
        [share("A", "a1", f"c{i:02}", 0.01 * (i % 7)) for i in range(15)]
        + [share("A", "n1", "c00", 0.5, "neighborhood"), share("A", "a2", "zz", 1.0), share("B", "b1", "c00", 1.0)],
    )


def test_cities(spark):
    metrics = table(spark, "city_metrics", [("C", "S", 1, 1.0), ("A", "S", 5, 1.0), ("A", "T", 5, 2.0)])
    assert [r.city for r in serving.city_options(metrics).collect()] == ["A", "C"]
    assert rows(serving.default_city(metrics, "C")) == [("C",)]
    assert rows(serving.default_city(metrics, "Z")) == [("A",)]
    assert [tuple(r)[:3] for r in serving.city_leaderboard(metrics, 2).collect()] == [("A", "S", 5), ("A", "T", 5)]


def test_city_hotspots_and_midpoint(spark):
    cells = table(
        spark, "grid_hotspots",
        [("A", "S", "1", 1.0, 2.0, 5, 4.0), ("A", "S", "2", 3.0, 4.0, 9, 4.0), ("A", "S", "3", 9.0, 9.0, 4, 4.0),
         ("B", "S", "4", 9.0, 9.0, 9, 4.0)],
    )
    chosen = serving.city_hotspots(cells, "A")
    assert rows(chosen, "grid_id") == [("1",), ("2",)]
    assert rows(serving.map_midpoint(chosen)) == [(2.0, 3.0)]


def test_city_windows(windows):
    found = serving.city_window_hotspots(windows, "A")
    assert rows(found, "area_id", "event_count", "hotspot_score") == [("a1", 5, 1.2), ("a1", 9, 2.0), ("n1", 9, 2.0)]
    assert rows(serving.window_date_bounds(found)) == [(date(2020, 1, 1), date(2020, 1, 4))]
    for first, last in ((date(2020, 1, 1), date(2020, 1, 3)), ("2020-01-01", "2020-01-03")):
        assert serving.city_window_hotspots(windows, "A", first_day=first, last_day=last).count() == 2
    assert serving.city_window_hotspots(windows, "A", min_events=1, min_score=0.0).count() == 5


def test_emerging_order(windows):
    found = serving.city_emerging(windows, "A").collect()
    assert [r.hotspot_score for r in found] == [9.0, 3.0, 2.0, 2.0, 1.2, 1.1]
    assert found[0].asDict().keys() == {
        "area_type", "area_id", "event_count", "hotspot_score", "avg_stars", "rating_change", "window_start",
    }


def test_area_series(windows):
    assert [r.window_start.day for r in serving.area_series(windows, "A", "grid", "a1").collect()] == [1, 2, 3]
    newest = serving.area_series(windows, "A", "grid", "a1", newest_first=True)
    assert [r.window_start.day for r in newest.collect()] == [3, 2, 1]


def test_area_choice(windows, mix):
    assert rows(serving.area_choice(windows, mix, "A")) == [("grid", "a1"), ("grid", "a2"), ("neighborhood", "n1")]
    assert rows(serving.area_choice(windows, mix, "A", "c00")) == [("grid", "a1"), ("neighborhood", "n1")]
    assert rows(serving.areas_with_category(mix, "c00")) == [("grid", "a1"), ("grid", "b1"), ("neighborhood", "n1")]
    assert rows(serving.area_type_options(windows, "A")) == [("grid",), ("neighborhood",)]
    assert rows(serving.area_options(windows, "A", "grid")) == [("a1",), ("a2",)]


def test_top_categories(mix):
    top = [r.category for r in serving.area_top_categories(mix, "A", "grid", "a1").collect()]
    assert top == ["c06", "c13", "c05", "c12", "c04", "c11", "c03", "c10", "c02", "c09"]
    all_areas = serving.top_categories_by_area(mix)
    assert [r.category for r in all_areas.filter("area_id = 'a1'").orderBy("rank").collect()] == top
    assert all_areas.count() == 13
    assert rows(serving.category_options(mix, "B")) == [("c00",)]


@pytest.mark.parametrize("n, kept", [(5, 5), (300, 300), (301, 151), (900, 300), (901, 226)])
def test_thinning(spark, n, kept):
    series = table(
        spark, "city_activity_windows",
        [("A", "S", DAY + timedelta(minutes=m), DAY + timedelta(minutes=m + 1), m, 1.0) for m in range(n)]
        + [("B", "S", DAY, DAY, 1, 1.0)],
    )
    step = -(-n // 300)
    found = serving.city_activity_series(series, "A").collect()
    assert [r.event_count for r in found] == list(range(0, n, step)) and len(found) == kept
    assert serving.activity_series(series).count() == kept + 1


def test_category_leaders_and_feed(spark):
    leaders = table(spark, "category_leaders", [("A", f"c{i}", i % 3, 1.0) for i in range(6)] + [("B", "x", 9, 1.0)])
    assert [r.category for r in serving.top_city_categories(leaders, "A", 3).collect()] == ["c2", "c5", "c1"]
    feed = table(spark, "latest_reviews", [(str(i), "b", "n", "c", "s", 1.0, f"2020-01-0{i}T00:00:00", "") for i in range(1, 6)])
    assert [r.review_id for r in serving.recent_feed(feed, 2).collect()] == ["5", "4"]


def test_dense_city_options(spark):
    found = table(spark, "neighborhood_hotspots", [("B", "S", "B-0", 1.0, 1.0, 1, 1.0), ("A", "S", "A-0", 1.0, 1.0, 1, 1.0)])
    assert [r.city for r in serving.dense_city_options(found).collect()] == ["A", "B"]
