"""Static and streaming jobs over JSON files; every way of feeding the same events must give the same tables."""

import json
import os
import random
import re
import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from placebeat.operators.category_mix import with_categories
from placebeat.operators.cleaning import clean_reviews, with_outcome
from placebeat.params import Params
from placebeat.plans.partials import batch_partials
from placebeat.plans.static_job import run_static
from placebeat.plans.stage import Stage, shared_folder
from placebeat.plans.tables import build_tables
from placebeat.schemas import PARTIAL_SCHEMAS, REVIEW_SCHEMA, TABLE_SCHEMAS
from placebeat.sources.files import (
    load_businesses, load_enriched, load_places, load_reviews, read_counts, read_rejects, read_reviews, read_table, write_batch,
)
from placebeat.sources.streams import parse_review_messages, review_file_stream
from placebeat.operators.neighborhoods import distinct_businesses, with_new_places
from placebeat.streaming.jobs import batch_processor, neighborhood_dimension, run, start_file_stream, start_kafka_stream
from placebeat.streaming.store import PartialStore
from placebeat.streaming.watermark import LateRows, start_watermarked, watermarked_windows
from tests.helpers import rows


def write_lines(path, items):
    path.write_text("".join((item if isinstance(item, str) else json.dumps(item)) + "\n" for item in items))


@pytest.fixture(scope="module")
def reviews():
    random.seed(3)
    start = datetime(2020, 1, 1)
    found = []
    for i in range(400):
        when = start + timedelta(minutes=random.randrange(0, 600), microseconds=random.randrange(10**6))
        business = "hot" if i % 3 == 0 else f"b{random.randrange(25)}"
        found.append({
            "review_id": f"r{i:03}", "business_id": business, "user_id": "u", "stars": float(1 + i % 5),
            "date": str(when), "text": f"text {i}",
        })
    found.sort(key=lambda r: r["date"])
    found[5]["business_id"] = "nowhere"
    return found


@pytest.fixture(scope="module")
def base(tmp_path_factory, reviews):
    folder = tmp_path_factory.mktemp("inputs")
    places = [
        {"business_id": key, "name": key, "city": "East" if i % 2 else "West", "state": "S",
         "latitude": 36.0 + (i % 5) * 0.02, "longitude": -115.0 + (i % 4) * 0.02,
         "categories": ["Food, Pizza", "Bars", None, "Food"][i % 4], "stars": 4.0}
        for i, key in enumerate(["hot", *(f"b{i}" for i in range(25))])
    ]
    places[3]["latitude"] = "36.06"
    write_lines(folder / "business.json", places)
    broken = ["{not json", json.dumps({"review_id": "x", "business_id": "hot"}), json.dumps({"review_id": "y", "business_id": "hot", "date": "junk"})]
    write_lines(folder / "review.json", [*reviews, *broken])
    return folder


def settings(base, out, **changes):
    fixed = dict(
        business_path=str(base / "business.json"), review_path=str(base / "review.json"), output_path=str(out),
        window_duration="60 minutes", slide_duration="20 minutes", min_events_for_hotspot=2,
        emerging_score_threshold=1.1, rating_spike_threshold=0.1, dense_city_threshold=5, latest_limit=30,
    )
    return Params(**{**fixed, **changes})


@pytest.fixture(scope="module")
def static(spark, base, tmp_path_factory):
    params = settings(base, tmp_path_factory.mktemp("static"))
    return {name: rows(frame) for name, frame in run_static(spark, params).items()}


def test_static_tables(spark, base, static):
    assert set(static) == set(TABLE_SCHEMAS) and all(static.values())
    assert sum(r[2] for r in static["city_metrics"]) == 399
    assert len(static["latest_reviews"]) == 30
    assert sum(r[5] for r in static["neighborhood_hotspots"]) == 399


def test_static_equals_tables_from_single_events(spark, base, static):
    params = settings(base, "unused", dense_city_threshold=0)
    enriched = load_enriched(spark, params.review_path, params.business_path)
    for name, frame in build_tables(enriched, params).items():
        wanted = static[name]
        if name in ("window_hotspots", "emerging_areas", "category_mix"):
            wanted = [r for r in wanted if r[0] == "grid"]
        if name != "neighborhood_hotspots":
            assert rows(frame) == wanted, name


def test_every_readable_row_is_counted_or_rejected(spark, base, static, tmp_path):
    params = settings(base, tmp_path, dense_city_threshold=0)
    run_static(spark, params)
    assert rows(read_rejects(spark, str(tmp_path)), "review_id", "date") == [("y", "junk")]
    stream = params.with_(stream_path=str(base), output_path=str(tmp_path / "s"), checkpoint_path=str(tmp_path / "c"))
    process = batch_processor(lambda: load_places(spark, params.business_path), stream)
    process(read_reviews(spark, params.review_path), 0)
    process(read_reviews(spark, params.review_path), 0)
    assert rows(read_rejects(spark, stream.output_path), "review_id", "date") == [("y", "junk")]


def test_static_limit_takes_the_oldest(spark, base, reviews, tmp_path):
    tables = run_static(spark, settings(base, tmp_path, limit=50, dense_city_threshold=0))
    known = [r for r in reviews[:50] if r["business_id"] != "nowhere"]
    assert tables["city_metrics"].agg(F.sum("review_count")).first()[0] == len(known)


def test_static_run_replaces_old_tables(spark, base, static, tmp_path):
    old = spark.createDataFrame([("c", "s", 1, 1.0)], TABLE_SCHEMAS["city_metrics"])
    write_batch({"city_metrics": old}, str(tmp_path), 0)
    tables = run(spark, settings(base, tmp_path, source_type="static", dense_city_threshold=0))
    for name in ("city_metrics", "grid_hotspots", "category_leaders", "latest_reviews"):
        assert rows(tables[name]) == static[name]
    assert tables["neighborhood_hotspots"].count() == 0


def test_static_without_events_fails(spark, base, tmp_path):
    write_lines(tmp_path / "none.json", [])
    params = settings(base, tmp_path / "out", review_path=str(tmp_path / "none.json"), dense_city_threshold=0)
    with pytest.raises(RuntimeError):
        run_static(spark, params)


def test_missing_table_is_empty(spark, tmp_path):
    for name, schema in TABLE_SCHEMAS.items():
        found = read_table(spark, str(tmp_path), name)
        assert found.count() == 0 and found.schema == schema


def test_quoted_numbers_are_read(spark, base):
    found = load_businesses(spark, str(base / "business.json")).filter("business_id = 'b2'")
    assert rows(found, "latitude", "stars") == [(36.06, 4.0)]


def file_stream(spark, base, tmp_path, reviews, pieces, dense=5, **options):
    folder = tmp_path / "incoming"
    folder.mkdir()
    size = -(-len(reviews) // pieces)
    for i in range(pieces):
        write_lines(folder / f"{i:03}.json", ["{broken", *reviews[i * size:(i + 1) * size]])
        os.utime(folder / f"{i:03}.json", (time.time() - 100 + i,) * 2)  # batches come in the order of these times
    params = settings(
        base, tmp_path / "out", source_type="file_stream", stream_path=str(folder),
        checkpoint_path=str(tmp_path / "checkpoint"), dense_city_threshold=dense,
    )
    query = start_file_stream(spark, params, available_now=True, max_files_per_trigger=1, **options)
    query.awaitTermination(240)
    assert query.exception() is None
    return params


def all_tables(store, params):
    return {name: rows(frame) for name, frame in store.tables(params).items()}


def test_stream_equals_static(spark, base, tmp_path, reviews, static):
    """Batches of shuffled events, a replayed batch and compaction all leave the tables of the static job."""
    pieces = 3
    params = file_stream(spark, base, tmp_path, random.Random(1).sample(reviews, len(reviews)), pieces)
    store = PartialStore(spark, params.output_path)
    assert all_tables(store, params) == static

    # A batch that runs again replaces its first result.
    incoming = read_reviews(spark, f"{params.stream_path}/000.json")
    assigned = spark.read.parquet(f"{params.output_path}/neighborhoods")
    batch_processor(lambda: load_places(spark, params.business_path), params, assigned)(incoming, 0)

    # Compaction changes nothing, with or without the batches it contains.
    assert store.compact(params) == pieces - 2
    assert store.compact(params, pieces - 1) == pieces - 1
    store.drop_compacted()
    store.publish(params)
    assert rows(read_table(spark, params.output_path, "category_mix")) == static["category_mix"]
    assert not (tmp_path / "out" / "partials" / "area_panes" / "batch_id=0").exists()
    assert all_tables(store, params) == static


def test_other_settings_are_refused(spark, base, tmp_path, reviews):
    params = file_stream(spark, base, tmp_path, reviews, 1, dense=0)
    store = PartialStore(spark, params.output_path)
    for change in ({"slide_duration": "15 minutes"}, {"window_duration": "80 minutes"}, {"cell_size_km": 1.0}, {"dense_city_threshold": 3}, {"latest_limit": 31}):
        with pytest.raises(ValueError, match="other settings"):
            store.tables(params.with_(**change))
    assert store.tables(params.with_(latest_limit=10))["latest_reviews"].count() == 10


def test_half_a_batch_is_not_seen(spark, base, tmp_path, reviews):
    params = file_stream(spark, base, tmp_path, reviews, 2, dense=0)
    store = PartialStore(spark, params.output_path)
    before = all_tables(store, params)
    batch_processor(lambda: load_places(spark, params.business_path), params)(read_reviews(spark, f"{params.stream_path}/000.json"), 2)
    assert all_tables(store, params) != before
    for path in (tmp_path / "out" / "commits" / "batch_id=2").iterdir():
        path.unlink()
    assert all_tables(store, params) == before


def test_a_stream_takes_over_the_neighborhoods_of_a_static_job(spark, base, tmp_path):
    """Places without events make no city dense, in batch and in a stream that follows it."""
    idle = [{"business_id": f"idle{k}", "name": "n", "city": "South" if k < 8 else "East", "state": "S", "latitude": 36.0 + k / 90, "longitude": -115.0, "stars": 4.0} for k in range(12)]
    (tmp_path / "business.json").write_text((base / "business.json").read_text())
    with (tmp_path / "business.json").open("a") as out:
        out.writelines(json.dumps(x) + "\n" for x in idle)
    params = settings(base, tmp_path / "static", business_path=str(tmp_path / "business.json"))
    wanted = {name: rows(frame) for name, frame in run_static(spark, params).items()}
    located = load_places(spark, params.business_path)
    alone = neighborhood_dimension(spark, params.with_(output_path=str(tmp_path / "alone")), located)
    assert {r[0] for r in rows(alone, "city")} == {"East", "South", "West"}

    params = params.with_(output_path=str(tmp_path / "stream"), neighborhoods_path=str(tmp_path / "static"))
    assigned = neighborhood_dimension(spark, params, located)
    assert {r[0] for r in rows(assigned, "city")} == {"East", "West"}
    batch_processor(lambda: located, params, assigned)(read_reviews(spark, params.review_path), 0)
    assert all_tables(PartialStore(spark, params.output_path), params) == wanted
    with pytest.raises(AnalysisException):
        neighborhood_dimension(spark, params.with_(output_path=str(tmp_path / "other"), neighborhoods_path=str(tmp_path / "none")), located)


def test_a_restart_keeps_the_neighborhoods(spark, base, tmp_path):
    params = settings(base, tmp_path / "out", dense_city_threshold=5)
    located = load_places(spark, params.business_path)
    first = rows(neighborhood_dimension(spark, params, located))
    moved = located.withColumn("latitude", F.col("latitude") + 0.0005)
    again = neighborhood_dimension(spark, params, moved)
    assert rows(again) == first
    new = distinct_businesses(moved.limit(1).withColumn("business_id", F.lit("new")).unionByName(moved))
    found = with_new_places(again, new, params)
    assert found.count() == len(first) + 1
    assert rows(found.filter("business_id = 'new'"), "neighborhood_id", "center_lat")[0] in set(rows(again, "neighborhood_id", "center_lat"))
    assert again.select("neighborhood_id", "center_lat").distinct().count() == again.select("neighborhood_id").distinct().count()


def test_streams_compact_on_the_way(spark, base, tmp_path, reviews, static):
    params = file_stream(spark, base, tmp_path, reviews, 4, dense=0, compact_every=2)
    assert [x.name for x in sorted((tmp_path / "out" / "compacted" / "area_panes").iterdir())] == ["through=2"]
    found = all_tables(PartialStore(spark, params.output_path), params)
    assert found["city_metrics"] == static["city_metrics"] and found["latest_reviews"] == static["latest_reviews"]


def test_append_mode_adds_each_batch_alone(spark, base, tmp_path, reviews):
    params = file_stream(spark, base, tmp_path, reviews, 2, dense=0, mode="append")
    stored = spark.read.parquet(f"{params.output_path}/city_metrics")
    assert sorted(r[0] for r in stored.select("batch_id").distinct().collect()) == [0, 1]
    assert stored.agg(F.sum("review_count")).first()[0] == 399
    assert stored.count() == 4
    write_batch({"city_metrics": spark.createDataFrame([("c", "s", 1, 1.0)], TABLE_SCHEMAS["city_metrics"])}, params.output_path, 1)
    found = read_table(spark, params.output_path, "city_metrics")
    assert found.count() == 3 and found.columns == TABLE_SCHEMAS["city_metrics"].fieldNames()


def test_empty_batch_writes_nothing(spark, base, tmp_path):
    params = settings(base, tmp_path / "out")
    empty = spark.createDataFrame([], REVIEW_SCHEMA)
    batch_processor(lambda: None, params)(empty, 0)
    assert not (tmp_path / "out").exists()
    assert all(frame.count() == 0 for frame in PartialStore(spark, params.output_path).tables(params).values())


def test_messages(spark):
    good = {"review_id": "1", "business_id": "b", "user_id": "u", "stars": 4.0, "date": "2020-01-01", "text": "hi"}
    bodies = [json.dumps(good), "{broken", json.dumps({**good, "date": None}), json.dumps({**good, "stars": "many"}), None]
    frame = spark.createDataFrame([(b and bytearray(b.encode()),) for b in bodies], "value binary")
    parsed = parse_review_messages(frame)
    assert rows(clean_reviews(parsed), "review_id", "review_stars", "review_text") == [("1", 0.0, "hi"), ("1", 4.0, "hi")]
    assert rows(with_outcome(parsed).groupBy("outcome").count()) == [("kept", 2), ("malformed", 2), ("without_key", 1)]
    assert rows(parsed.filter("review_id is null"), "malformed") == [("",), ("{broken",)]


def test_settings_are_checked_first(spark, base, tmp_path):
    with pytest.raises(ValueError, match="stream_path"):
        start_file_stream(spark, settings(base, tmp_path))
    with pytest.raises(ValueError, match="kafka_bootstrap_servers"):
        start_kafka_stream(spark, settings(base, tmp_path))
    with pytest.raises(ValueError, match="unknown source"):
        run(spark, settings(base, tmp_path, source_type="carrier pigeon"))


def watermarked(spark, base, tmp_path, pieces, delay, dense=0):
    folder = tmp_path / "incoming"
    folder.mkdir()
    for i, piece in enumerate(pieces):
        write_lines(folder / f"{i:03}.json", piece)
        os.utime(folder / f"{i:03}.json", (time.time() - 100 + i,) * 2)
    params = settings(
        base, tmp_path / "out", checkpoint_path=str(tmp_path / "checkpoint"), dense_city_threshold=dense,
        stream_path=str(folder),
    )
    late = LateRows()
    spark.streams.addListener(late)
    query = start_watermarked(spark, review_file_stream(spark, str(folder), 1), params, delay, available_now=True)
    query.awaitTermination(240)
    assert query.exception() is None
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for _ in range(50):  # the listener is told in a thread of its own
        if str(query.id) in late.dropped and late.of(query) == sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]):
            break
        time.sleep(0.2)
    spark.streams.removeListener(late)
    return params, late.of(query)


def test_watermark_with_ordered_input_is_exact(spark, base, tmp_path, reviews, static):
    params, late = watermarked(spark, base, tmp_path, [reviews[:200], reviews[200:]], "1 hour", dense=4)
    found = rows(watermarked_windows(spark, params))
    # These neighborhoods are fitted over all places: the stream follows no static job.
    assert {r[0] for r in found} == {"grid", "neighborhood"}
    assert [r for r in found if r[0] == "grid"] == [r for r in static["window_hotspots"] if r[0] == "grid"]
    assert late == 0


def test_watermark_drops_and_reports_late_events(spark, base, tmp_path, reviews):
    params, late = watermarked(spark, base, tmp_path, [reviews[200:], reviews[:200], reviews[:10]], "1 minute")
    assert late > 0


def test_stage_uses_the_named_folder(spark):
    folder = shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir")
    with Stage(spark) as stage:
        assert stage.path.startswith(folder)
        assert stage.write("t", spark.range(3)).count() == 3
        path = stage.path
    assert not Path(path).exists()


def test_partial_columns(spark, base):
    params = settings(base, "unused", dense_city_threshold=0)
    cleaned = load_reviews(spark, params.review_path)
    located = load_places(spark, params.business_path)
    assert with_categories(located).count() < located.count()
    for name, frame in batch_partials(cleaned, located, params).items():
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in PARTIAL_SCHEMAS[name]]


def lines_of(path):
    return sum(1 for x in path.read_text().splitlines() if x.strip())


@pytest.mark.parametrize("limit", [None, 100])
def test_counts_add_up_to_the_lines_read(spark, base, reviews, tmp_path, limit):
    run_static(spark, settings(base, tmp_path, dense_city_threshold=0, limit=limit))
    counts = dict(rows(read_counts(spark, str(tmp_path)), "outcome", "rows"))
    assert counts == {"kept": len(reviews), "malformed": 1, "without_key": 1, "undated": 1}
    assert sum(counts.values()) == lines_of(base / "review.json")


def test_stream_counts_add_up_too(spark, base, reviews, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    lines = (base / "review.json").read_text().splitlines()
    for k in range(3):
        write_lines(incoming / f"{k}.json", lines[k::3])
    write_lines(incoming / "3.json", ["{only", "[broken"])  # a batch without a kept row
    params = settings(base, tmp_path / "out", dense_city_threshold=0, stream_path=str(incoming), checkpoint_path=str(tmp_path / "c"))
    query = start_file_stream(spark, params, available_now=True, max_files_per_trigger=1)
    query.awaitTermination()
    assert query.exception() is None
    counts = dict(rows(read_counts(spark, params.output_path), "outcome", "rows"))
    assert counts == {"kept": len(reviews), "malformed": 3, "without_key": 1, "undated": 1}


def test_counts_of_a_retried_batch_count_once(spark, base, tmp_path):
    params = settings(base, tmp_path, dense_city_threshold=0)
    process = batch_processor(lambda: load_places(spark, params.business_path), params)
    for _ in range(2):
        process(read_reviews(spark, params.review_path), 0)
    assert sum(n for _, n in rows(read_counts(spark, str(tmp_path)), "outcome", "rows")) == lines_of(base / "review.json")
    assert read_counts(spark, str(tmp_path / "nowhere")).count() == 0


@pytest.mark.parametrize("limit, parses", [(None, 2), (100, 1)])
def test_the_static_job_parses_the_reviews_twice_at_most(spark, base, tmp_path, monkeypatch, limit, parses):
    """Plans of all that is written: scans of the raw reviews, and of the copy without text."""
    plans = []
    for name in ("parquet", "saveAsTable"):

        def write(self, target, *args, real=getattr(DataFrameWriter, name), **options):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
            return real(self, target, *args, **options)

        monkeypatch.setattr(DataFrameWriter, name, write)
    run_static(spark, settings(base, tmp_path, limit=limit))
    raw = [len(re.findall(r"FileScan json [^\n]*stars:double", text)) for text in plans]
    assert sum(raw) == parses
    sorted_scans = [text for text in plans if re.search(r"FileScan parquet [^\n]*/sorted[,\]]", text) and "partial_count" in text and "pane" in text.lower()]
    assert len(sorted_scans) <= 1 + (2 if limit else 0)  # the reduction to panes; with a limit, the counts per day and second too
