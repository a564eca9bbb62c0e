"""Plans: what is read, how often rows are moved, and that nothing leaves the JVM."""

import re

import pytest
from pyspark.sql import functions as F

from placebeat.checks.queries import QUERIES
from placebeat.operators import serving
from placebeat.operators.enrich import enrich, place_activity
from placebeat.operators.hotspots import emerging_areas, window_hotspots
from placebeat.params import Params
from placebeat.plans.stage import Stage
from placebeat.plans.static_job import static_tables
from placebeat.plans.tables import build_tables
from placebeat.schemas import PARTIAL_SCHEMAS, PLACE_SCHEMA, TABLE_SCHEMAS
from placebeat.sources import testtables
from tests.helpers import plan, rows


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def large_dimension(spark):
    """Plan as if no side were small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("neighborhood")))
def test_no_cross_join_and_no_python(spark, small, name):
    text = planned(QUERIES[name](spark, small))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "ArrowEval", "Scan ExistingRDD"):
        assert node not in text


def test_no_join_is_hinted(spark, small, large_dimension):
    for name in ("window_hotspots", "category_mix", "latest_reviews", "enriched_events"):
        assert "BroadcastHashJoin" not in planned(QUERIES[name](spark, small))


def test_only_needed_columns_are_read(spark, small):
    text = planned(QUERIES["window_hotspots"](spark, small))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert "event_id:bigint,ts:timestamp_ntz,user_id:bigint" in read
    assert not any(column in text for column in ("props#", "event_type#", "c_acctbal#", "c_name#"))


def test_windows_move_panes_once_after_the_join(spark, small, large_dimension):
    text = planned(QUERIES["emerging_areas"](spark, small))
    above_join = text[: text.index("SortMergeJoin")]
    # pane totals per cell, and their distribution by area; copies, baseline and ranking stay in place
    assert above_join.count("Exchange hashpartitioning") == 2
    assert above_join.index("Generate explode") < above_join.index("Exchange hashpartitioning")
    assert "Expand" not in text


def test_events_are_reduced_before_the_join(spark, small, large_dimension):
    text = planned(QUERIES["city_metrics"](spark, small))
    below_join = text[text.index("SortMergeJoin [business_id"):]
    assert below_join.index("HashAggregate(keys=[business_id") < below_join.index("FileScan")
    assert "partial_count(1)" in below_join


def test_category_mix_scans_events_once_per_pass(spark, small):
    text = planned(QUERIES["category_mix"](spark, small))
    assert "SortMergeJoin" not in text.split("Generate explode")[0]


def test_feed_is_a_top_k(spark, small):
    text = planned(QUERIES["latest_reviews"](spark, small))
    assert text.count("TakeOrderedAndProject") >= 2
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,ScalarSubquery", text)


def test_serving_filters_reach_the_files(spark, tmp_path):
    spark.createDataFrame([], TABLE_SCHEMAS["window_hotspots"]).write.parquet(str(tmp_path / "w"))
    windows = spark.read.schema(TABLE_SCHEMAS["window_hotspots"]).parquet(str(tmp_path / "w"))
    text = planned(serving.city_window_hotspots(windows, "A", first_day="2020-01-01", last_day="2020-01-02"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text)[1]
    for part in ("EqualTo(city,A)", "GreaterThanOrEqual(event_count,5)", "GreaterThanOrEqual(hotspot_score,1.2)",
                 "GreaterThanOrEqual(window_start", "LessThan(window_start"):
        assert part in pushed


def test_rank_limits_apply_before_the_shuffle(spark, small):
    text = planned(QUERIES["top_categories_by_area"](spark, small))
    assert "WindowGroupLimit" in text


def test_building_tables_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    enriched = spark.range(3).selectExpr(
        "string(id) review_id", "'b' business_id", "'u' user_id", "4.0D review_stars", "timestamp '2020-01-01' review_date",
        "'' review_text", "'n' business_name", "'c' city", "'s' state", "1.0D latitude", "2.0D longitude",
        "1.0D business_stars", "array('x') categories",
    )
    assert len(build_tables(enriched, Params())) == 9
    assert list(tracker.getJobIdsForGroup("lazy")) == []
    spark.sparkContext.setJobGroup("other", "other")


def test_hot_business(spark):
    """A business with a third of all events: adaptive execution cuts its partition, results stay whole."""
    n = 60_000
    events = spark.range(n).selectExpr(
        "string(id) AS review_id", "if(id % 3 = 0, 'hot', concat('b', id % 997)) AS business_id", "'u' AS user_id",
        "double(1 + id % 5) AS review_stars", "timestamp_seconds(1577836800 + id * 7 % 86400) AS review_date",
        "repeat(string(id), 20) AS review_text",
    ).repartition(16, "review_id")
    places = spark.createDataFrame(
        [(b, b, "c", "s", 1.0, 2.0, 1.0, ["x"]) for b in ["hot", *(f"b{i}" for i in range(997))]], PLACE_SCHEMA
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "20",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = enrich(events, places)
        assert "skew=true" in plan(joined)
        assert joined.count() == n
        # Reduced before the join, the hot business is one row and nothing is left to cut.
        activity = place_activity(events, places)
        assert "skew=true" not in plan(activity)
        assert activity.agg(F.sum("event_count"), F.max("event_count")).first() == (n, n // 3)
        params = Params(window_duration="1 hour", slide_duration="30 minutes", min_events_for_hotspot=1)
        windows = window_hotspots(joined, params)
        assert windows.agg(F.sum("event_count")).first()[0] == 2 * n
        assert emerging_areas(windows, params).columns == windows.columns
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_staged_tables_are_joined_as_they_lie(spark, large_dimension, monkeypatch):
    """Without broadcasts, no join by business in the static job moves rows that a stage has written."""
    events = spark.range(3000).selectExpr(
        "string(id) AS review_id", "concat('b', id % 97) AS business_id", "'u' AS user_id", "double(1 + id % 5) AS review_stars",
        "timestamp_seconds(1577836800 + id * 61) AS review_date", "'t' AS review_text",
    )
    places = spark.createDataFrame([(f"b{i}", "n", f"c{i % 3}", "s", 1.0 + i % 7, 2.0 + i % 5, 1.0, ["x", "y"]) for i in range(97)], PLACE_SCHEMA)
    params = Params(window_duration="2 hours", slide_duration="1 hour", min_events_for_hotspot=1, dense_city_threshold=5)
    plans, real = [], Stage.write

    def write(self, name, frame, partition_by=None):
        plans.append((name, planned(frame)))
        return real(self, name, frame, partition_by)

    monkeypatch.setattr(Stage, "write", write)
    with Stage(spark) as stage:
        tables = static_tables(events, places, params, stage)
        joins = 0
        for name, text in plans:
            if name not in PARTIAL_SCHEMAS and name != "pane_newest":
                continue
            lines = text.split("\n")
            for k, line in enumerate(lines):
                if "SortMergeJoin [business_id" not in line:
                    continue
                joins += 1
                depth = len(line) - len(line.lstrip(" :+-"))
                below = [x for x in lines[k + 1 :]]
                end = next((i for i, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))
                assert not any("Exchange hashpartitioning(business_id" in x for x in below[:end]), name  # subqueries below it have their own
        assert joins >= 5
        wanted = build_tables(enrich(events, places), params)
        for name in ("city_metrics", "window_hotspots", "category_leaders", "latest_reviews"):
            assert rows(tables[name].filter("area_type = 'grid'") if name == "window_hotspots" else tables[name]) == rows(wanted[name]), name
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stage_")]
