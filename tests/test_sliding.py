"""Sliding totals as differences of running sums, against totals of events copied to their windows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placebeat.functions import duration_micros
from placebeat.operators.hotspots import params_pane, window_totals
from placebeat.operators.measures import paned, total
from placebeat.params import Params

EPOCH = datetime(1970, 1, 1)


def brute(events, duration, slide):
    """(key, start) -> (count, stars) by copying every event to every window."""
    length, step = duration_micros(duration), duration_micros(slide)
    out = defaultdict(lambda: [0, 0.0])
    for key, when, stars in events:
        at = (when - EPOCH) // timedelta(microseconds=1)
        start = at // step * step
        while start + length > at:
            out[key, EPOCH + timedelta(microseconds=start)][0] += 1
            out[key, EPOCH + timedelta(microseconds=start)][1] += stars
            start -= step
    return out


def windows_of(spark, events, params, kind):
    frame = spark.createDataFrame([(k, t, s) for k, t, s in events], f"city string, review_date {kind}, review_stars double").repartition(4)
    panes = total(paned(frame, params_pane(params)), ["city", "pane_start"])
    return window_totals(panes, ["city"], params, ["city"])


def made_rows(frame):
    """Rows that all generators of the executed plan have made."""
    frame.collect()
    found, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if node.nodeName() == "Generate":
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return found


def with_gaps(rng, n, minutes):
    start = datetime(2019, 12, 30, 23, 17)
    busy = [(rng.choice("ab"), start + timedelta(minutes=rng.randrange(minutes), microseconds=rng.randrange(10**6)), rng.choice((1.0, 2.5, 5.0))) for _ in range(n)]
    return busy + [("far", start + timedelta(days=40), 3.0), ("far", start - timedelta(days=3), 4.0), ("a", start + timedelta(days=5), 1.0)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize(
    "duration, slide", [("24 hours", "1 minute"), ("1 day", "12 hours"), ("1 hour", "1 hour"), ("50 minutes", "20 minutes"), ("1 day", "7 hours")]
)
def test_equals_copied_events(spark, duration, slide, kind):
    events = with_gaps(random.Random(5), 300, 900)
    params = Params(window_duration=duration, slide_duration=slide)
    found = windows_of(spark, events, params, kind).select("city", F.col("window_start").cast("timestamp_ntz"), "event_count", "stars_sum", F.col("window_end").cast("timestamp_ntz"), "avg_stars").collect()
    wanted = brute(events, duration, slide)
    assert len(found) == len(wanted)
    for city, start, n, stars, end, mean in found:
        assert [n, stars] == wanted[city, start] and mean == stars / n and end - start == timedelta(microseconds=duration_micros(duration))


def test_each_window_is_made_once(spark):
    """A day of minutes, every one active: 24 hours by a minute cover each pane 1,440 times, and that many rows aren't made."""
    start = datetime(2020, 1, 1)
    events = [("a", start + timedelta(minutes=k), 1.0) for k in range(1440)]
    params = Params(window_duration="24 hours", slide_duration="1 minute")
    found = windows_of(spark, events, params, "timestamp")
    windows = 2 * 1440 - 1
    assert found.count() == windows and made_rows(found) == windows + 1440
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(city") <= 2 * text.count("== Final Plan ==") + 2


def test_split_panes_of_one_start_count_together(spark):
    start = datetime(2020, 1, 1, 10)
    panes = spark.createDataFrame([("a", start, 1, 2.0), ("a", start, 3, 4.0), ("a", start + timedelta(minutes=10), 1, 1.0)], "city string, pane_start timestamp_ntz, event_count long, stars_sum double")
    found = window_totals(panes, ["city"], Params(window_duration="20 minutes", slide_duration="10 minutes"), ["city"])
    assert sorted((r["window_start"].minute, r["event_count"], r["stars_sum"]) for r in found.collect()) == [(0, 5, 7.0), (10, 1, 1.0), (50, 4, 6.0)]
