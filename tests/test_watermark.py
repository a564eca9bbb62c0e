"""Closed windows of a watermarked stream: each comes out once, late events are dropped and counted, restarts add no copies."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from placebeat.params import Params
from placebeat.schemas import ENRICHED_SCHEMA, PARTIAL_SCHEMAS
from placebeat.streaming.watermark import LateRows, closed_window_totals, closed_windows, start_closed_windows
from tests.helpers import enriched, event, rows

START = datetime(2020, 1, 1)


def arrive(spark, folder, minutes):
    """One file of events at these minutes."""
    events = [event(f"r{m}", when=START + timedelta(minutes=m), stars=1 + m % 5) for m in minutes]
    enriched(spark, events).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, params):
    stream = spark.readStream.schema(ENRICHED_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = start_closed_windows(closed_window_totals(stream, params, "30 minutes"), params, available_now=True)
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_windows_close_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    params = Params(
        output_path=str(tmp_path / "out"), checkpoint_path=str(tmp_path / "c"), window_duration="60 minutes", slide_duration="20 minutes",
        min_events_for_hotspot=1,
    )
    late = LateRows()
    spark.streams.addListener(late)
    try:
        arrive(spark, folder, range(0, 200, 5))
        arrive(spark, folder, range(200, 400, 5))
        arrive(spark, folder, [1, 2, 398])  # two far behind the watermark, one in time
        query = run(spark, folder, params)
        first = closed_windows(spark, params).select("window_start", "event_count").collect()
        starts = [r[0] for r in first]
        assert len(starts) == len(set(starts))
        # the newest event is at 398 minutes, so windows that end by 368 have closed
        assert max(starts) == START + timedelta(minutes=300) and min(starts) == START - timedelta(minutes=40)
        assert {r["event_count"] for r in first if START <= r[0]} == {12}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        assert late.of(query) > 0
        arrive(spark, folder, range(400, 600, 5))
        run(spark, folder, params)
        again = closed_windows(spark, params).select("window_start", "event_count").collect()
        assert len(again) == len({r[0] for r in again}) and {tuple(r) for r in first} < {tuple(r) for r in again}
        assert {r["event_count"] for r in again if r[0] == START + timedelta(minutes=340)} == {13}
    finally:
        spark.streams.removeListener(late)


def test_state_is_bounded(spark, tmp_path):
    """A long stream keeps no more than the open panes and windows."""
    folder = str(tmp_path / "in")
    params = Params(output_path=str(tmp_path / "out"), checkpoint_path=str(tmp_path / "c"), window_duration="60 minutes", slide_duration="20 minutes")
    for k in range(6):
        arrive(spark, folder, range(k * 500, k * 500 + 500, 10))
    query = run(spark, folder, params)
    kept = [[op.numRowsTotal for op in p.stateOperators] for p in query.recentProgress if p.stateOperators]
    assert max(map(max, kept)) <= 500 // 20 + 10 and max(kept[-1]) <= 8
