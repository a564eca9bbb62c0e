"""Additive partial results of a set of events, and the nine tables finished from them.

The partials of disjoint event sets merge by addition (counts, sums), maximum (times) and top-k (newest events), so the
tables do not depend on how the events were cut into batches. They are far smaller than the events.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebeat.operators import kpis
from placebeat.operators.areas import AREA_COLUMNS, GRID, NEIGHBORHOOD, area_panes
from placebeat.operators.category_mix import (
    exploded,
    in_areas,
    recent_start,
    shares,
    with_categories,
)
from placebeat.operators.enrich import enrich, reduced_activity
from placebeat.operators.hotspots import city_activity_windows, emerging_areas, params_pane, scored_windows
from placebeat.operators.measures import rated, total
from placebeat.params import Params
from placebeat.plans.stage import Stage
from placebeat.schemas import PARTIAL_SCHEMAS

_TAGGED_AREA = [*AREA_COLUMNS, "category"]


def pane_activity(cleaned: DataFrame, params: Params) -> DataFrame:
    """The one reduction over all events: a row per business and pane, from which everything but the newest events follows."""
    return reduced_activity(cleaned, params_pane(params))


def merged_in(dimension: DataFrame | None) -> DataFrame | None:
    """A dimension that grows with the places, to be sorted and merged in every join.

    Spark takes a written table for as large as its files; a few compressed columns of a million places are under its threshold
    for broadcasting and hundreds of megabytes once the driver has gathered them, in each join of each batch.
    """
    return None if dimension is None else dimension.hint("merge")


def pane_newest(activity: DataFrame, located: DataFrame) -> DataFrame:
    """Per pane: ``n``, the events that have a place, and ``latest``, the newest time of one with a category."""
    placed = activity.join(located.select("business_id", F.size("categories").alias("tags")), "business_id")
    return placed.groupBy("pane_start").agg(
        F.sum("event_count").alias("n"), F.max(F.when(F.col("tags") > 0, F.col("max_event_time"))).alias("latest")
    )


def recent_bounds(panes: DataFrame, params: Params) -> tuple[Column, Column]:
    """(since, feed_from) as scalar subqueries over :func:`pane_newest`.

    The last window begins at ``since``; the newest events that fill the feed are in the panes from ``feed_from`` on, as each
    of the newest panes has one event at least, so that no more panes than the feed has rows are looked at.
    """
    newest = panes.orderBy(F.desc("pane_start")).limit(params.latest_limit)
    running = newest.withColumn("running", F.sum("n").over(Window.orderBy(F.desc("pane_start"))))
    enough = F.max(F.when(F.col("running") >= params.latest_limit, F.col("pane_start")))
    since = panes.agg(F.max("latest").alias("latest")).select(recent_start(F.col("latest"), params)).scalar()
    return since, running.agg(F.coalesce(enough, F.min("pane_start"))).scalar()


def recent_events(cleaned: DataFrame, panes: DataFrame, params: Params) -> DataFrame:
    """The events of the last window and of the feed; only those that the feed may show keep their text."""
    since, feed_from = recent_bounds(panes, params)
    text = F.when(F.col("review_date") >= feed_from, F.col("review_text"))
    return cleaned.filter(F.col("review_date") >= F.least(since, feed_from)).withColumn("review_text", text)


def staged_partials(
    cleaned: DataFrame, located: DataFrame, params: Params, neighborhoods: DataFrame | None, stage: Stage
) -> dict[str, DataFrame]:
    """:func:`batch_partials` of a micro-batch, its reduction and the counts per pane written once in ``stage``.

    They are written in as many files as their size asks for: a kept plan has as many partitions as a shuffle, however small.
    """
    activity = stage.write("activity", pane_activity(cleaned, params))
    panes = stage.write("pane_newest", pane_newest(activity, merged_in(located)))
    return batch_partials(cleaned, located, params, neighborhoods, activity=activity, panes=panes)


def batch_partials(
    cleaned: DataFrame,
    located: DataFrame,
    params: Params,
    neighborhoods: DataFrame | None = None,
    stage: Stage | None = None,
    activity: DataFrame | None = None,
    panes: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The partials of one batch of cleaned reviews.

    The events are read twice: once to be reduced to panes of businesses, once for the few newest ones. With a ``stage`` both
    results, in buckets of businesses, and the counts per pane between them are written and read back; ``activity`` and ``panes``
    (:func:`pane_newest`) are the first and these counts if they are there already. With places in such buckets too, no join moves
    rows that have been written. Places and neighborhoods are sorted and merged, see :func:`merged_in`.

    ``recent_categories`` keeps exact times of the events in the last window of the batch. The window ending at the
    newest event of all batches starts no earlier than that of any batch, so nothing it needs is lost.
    """
    in_buckets = (lambda name, frame: frame) if stage is None else (lambda name, frame: stage.write_bucketed(name, frame, "business_id"))
    located, neighborhoods = merged_in(located), merged_in(neighborhoods)
    if activity is None:
        activity = in_buckets("activity", pane_activity(cleaned, params))
    if panes is None:
        panes = pane_newest(activity, located) if stage is None else stage.write("pane_newest", pane_newest(activity, located))
    newest = in_buckets("recent_events", recent_events(cleaned, panes, params))
    tagged = with_categories(located)
    measures = ["event_count", "stars_sum", "max_event_time"]
    sums = (F.sum("event_count").alias("event_count"), F.sum("stars_sum").alias("stars_sum"), F.max("max_event_time").alias("max_event_time"))
    per_business = activity.groupBy("business_id").agg(*sums).join(tagged, "business_id")
    categories = exploded(in_areas(per_business, params.cell_size_km, neighborhoods, measures), measures).groupBy(*_TAGGED_AREA).agg(*sums)
    since, _ = recent_bounds(panes, params)
    recent = (
        newest.select("business_id", F.col("review_date").alias("event_time"))
        .filter(F.col("event_time") >= since)
        .groupBy("business_id", "event_time")
        .agg(F.count("*").alias("event_count"))
        .join(tagged, "business_id")
    )
    timed = ["event_time", "event_count"]
    recent_categories = (
        exploded(in_areas(recent, params.cell_size_km, neighborhoods, timed), timed)
        .groupBy(*_TAGGED_AREA, "event_time")
        .agg(F.sum("event_count").alias("event_count"))
    )
    partials = {
        "area_panes": area_panes(activity.join(located, "business_id"), params_pane(params), params.cell_size_km, neighborhoods),
        "area_categories": categories,
        "recent_categories": recent_categories,
        "newest_events": kpis.newest(enrich(newest, located), params.latest_limit),
    }
    return {name: frame.select(*PARTIAL_SCHEMAS[name].fieldNames()) for name, frame in partials.items()}


def newest_partial_time(categories: DataFrame) -> DataFrame:
    return categories.agg(F.max("max_event_time").alias("latest"))


def merge(partials: Mapping[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """One row per key from the partials of many batches; recent events that can no longer matter are left out."""
    since = newest_partial_time(partials["area_categories"]).select(recent_start(F.col("latest"), params)).scalar()
    recent = partials["recent_categories"].filter(F.col("event_time") >= since)
    merged = {
        "area_panes": total(partials["area_panes"], [*AREA_COLUMNS, "pane_start"]),
        "area_categories": partials["area_categories"]
        .groupBy(*_TAGGED_AREA)
        .agg(
            F.sum("event_count").alias("event_count"),
            F.sum("stars_sum").alias("stars_sum"),
            F.max("max_event_time").alias("max_event_time"),
        ),
        "recent_categories": recent.groupBy(*_TAGGED_AREA, "event_time").agg(F.sum("event_count").alias("event_count")),
        "newest_events": kpis.newest(partials["newest_events"], params.latest_limit),
    }
    return {name: frame.select(*PARTIAL_SCHEMAS[name].fieldNames()) for name, frame in merged.items()}


def finish(partials: Mapping[str, DataFrame], params: Params) -> dict[str, DataFrame]:
    """The nine tables from merged partials."""
    panes, categories = partials["area_panes"], partials["area_categories"]
    cells = panes.filter(F.col("area_type") == GRID)
    windows = scored_windows(panes, params)
    in_cells = categories.filter(F.col("area_type") == GRID)
    return {
        "city_metrics": kpis.city_metrics(cells),
        "grid_hotspots": kpis.area_hotspots(panes, GRID, "grid_id"),
        "neighborhood_hotspots": kpis.area_hotspots(panes, NEIGHBORHOOD, "neighborhood_id"),
        "window_hotspots": windows,
        "emerging_areas": emerging_areas(windows, params),
        "category_mix": _category_mix(categories, partials["recent_categories"], params),
        "city_activity_windows": city_activity_windows(cells, params),
        "category_leaders": rated(total(in_cells, ["city", "category"]), ["city", "category"]),
        "latest_reviews": kpis.feed(kpis.newest(partials["newest_events"], params.latest_limit)),
    }


def _category_mix(categories: DataFrame, recent: DataFrame, params: Params) -> DataFrame:
    """Both counts in one aggregation over stacked rows: no join between current and usual."""
    latest = newest_partial_time(categories)
    since = latest.select(recent_start(F.col("latest"), params)).scalar()
    none = F.lit(0).cast("bigint")
    stacked = categories.select(
        *_TAGGED_AREA, none.alias("current_count"), F.col("event_count").alias("baseline_count")
    ).unionByName(
        recent.filter(F.col("event_time") >= since).select(
            *_TAGGED_AREA, F.col("event_count").alias("current_count"), none.alias("baseline_count")
        )
    )
    counts = stacked.groupBy(*_TAGGED_AREA).agg(
        F.sum("current_count").alias("current_count"), F.sum("baseline_count").alias("baseline_count")
    )
    return shares(counts, latest.scalar())
