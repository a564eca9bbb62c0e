"""Every operator as a query on the test tables.

Indicators read events reduced per business (and pane) before the join with places, the plan meant for large data.
Derived doubles are rounded to six places, as their last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.functions import parse_date
from placebeat.operators import category_mix as mix
from placebeat.operators import cleaning, hotspots, kpis, serving
from placebeat.operators.areas import area_panes, grid_event_frame
from placebeat.operators.enrich import enrich, place_activity
from placebeat.operators.neighborhoods import dense_cities, distinct_businesses, fit_checks, fit_neighborhoods, fit_quality
from placebeat.params import Params
from placebeat.plans.stage import Stage
from placebeat.plans.static_job import run_static
from placebeat.sources import testtables as tables
from placebeat.sources.files import read_counts, read_table
from placebeat.streaming.jobs import batch_processor, start_batches, start_file_stream
from placebeat.streaming.store import PartialStore
from placebeat.streaming.watermark import (
    closed_window_totals, closed_windows, start_closed_windows, watermarked_panes, watermarked_windows, write_panes,
)

DECIMALS = 6
CITY, CATEGORY = "NATION_7", "ECONOMY"
AREA = ("grid", "1859_-6189")

DAILY = Params(
    window_duration="1 day", slide_duration="12 hours", min_events_for_hotspot=3, dense_city_threshold=6,
    default_city=CITY,
)
TUMBLING = DAILY.with_(slide_duration="1 day")
MONTHLY = Params(window_duration="30 days", slide_duration="10 days", min_events_for_hotspot=3)
RECENT = DAILY.with_(window_duration="3 days", slide_duration="1 day")


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.round(name, DECIMALS) for name in names})


_SCORES = ("avg_stars", "baseline_count", "baseline_stars", "hotspot_score", "rating_change")
_SHARES = ("current_share", "baseline_share", "anomaly_score")


def _reviews(spark: SparkSession, folder: str) -> DataFrame:
    return tables.event_reviews(spark, folder)


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return tables.customer_places(spark, folder)


def _activity(spark: SparkSession, folder: str, params: Params | None = None) -> DataFrame:
    pane = hotspots.params_pane(params) if params else None
    return place_activity(_reviews(spark, folder), _places(spark, folder), pane)


def _volume_activity(spark: SparkSession, folder: str, params: Params | None = None) -> DataFrame:
    pane = hotspots.params_pane(params) if params else None
    return place_activity(tables.lineitem_reviews(spark, folder), tables.supplier_places(spark, folder), pane)


_fitted: dict[tuple[str, str], DataFrame] = {}


def _neighborhoods(spark: SparkSession, folder: str) -> DataFrame:
    """Fitted once for a session and folder, and kept as one written table; the rounds' tables are removed."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _fitted:
        active = distinct_businesses(_activity(spark, folder))
        with Stage(spark) as stage:
            _fitted[key] = Stage(spark).write("neighborhoods", fit_neighborhoods(active, DAILY, stage))
    return _fitted[key]


def forget_neighborhoods() -> None:
    """The next query that needs neighborhoods fits them anew."""
    _fitted.clear()


# -- cleaning, join, projection -------------------------------------------------------------------------------------


def enriched_events(spark, folder):
    joined = tables.enriched_events(spark, folder)
    return joined.withColumn("categories", F.array_join("categories", "|"))


def cleaned_reviews(spark, folder):
    raw = tables.raw_event_reviews(spark, folder).withColumn("date", F.col("date").cast("string"))
    return cleaning.clean_reviews(raw).withColumn("review_date", F.col("review_date").cast("timestamp_ntz"))


def parsed_dates(spark, folder):
    orders = tables.table(spark, folder, "orders")
    return orders.select("o_orderkey", parse_date(_written_date()).cast("timestamp_ntz").alias("parsed"))


def _written_date() -> Column:
    """Order times as text in several forms, by key: the last of five can't be read."""
    time, kind = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_orderkey") % 5
    return (
        F.when(kind == 0, time)
        .when(kind == 1, F.replace(time, F.lit(" "), F.lit("T")))
        .when(kind == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" about noon")))
        .when(kind == 3, F.date_format("o_orderdate", "yyyyMMdd"))
        .otherwise(F.concat(F.lit("on "), time))
    )


def _order_reviews(spark, folder) -> DataFrame:
    orders = tables.table(spark, folder, "orders")
    text = {"review_id": "o_orderkey", "business_id": "o_custkey", "user_id": "o_custkey", "text": "o_orderpriority"}
    named = [F.col(column).cast("string").alias(name) for name, column in text.items()]
    return orders.select(*named, F.lit(3.0).alias("stars"), _written_date().alias("date"))


def order_dates_kept(spark, folder):
    kept = cleaning.clean_reviews(_order_reviews(spark, folder))
    return kept.select("review_id", "business_id", F.col("review_date").cast("timestamp_ntz").alias("review_date"))


def order_dates_rejected(spark, folder):
    return cleaning.rejected_reviews(_order_reviews(spark, folder)).select("review_id", "business_id", "date")


def oldest_reviews(spark, folder):
    oldest = cleaning.oldest_reviews(tables.raw_event_reviews(spark, folder), 1000)
    return oldest.select("review_id", "business_id", "review_stars", "review_date")


def oldest_reviews_by_day(spark, folder):
    """All rows of a day share one second, so the limit ends among many rows of equal time."""
    oldest = cleaning.oldest_reviews(tables.raw_lineitem_reviews(spark, folder), 3333)
    return oldest.select("review_id", "business_id", "review_stars", "review_date")


def located_places(spark, folder):
    """Places whose coordinates are all there: some customers are given a null, some a NaN, some a broken number."""
    raw, key = tables.raw_customer_businesses(spark, folder), F.col("business_id").cast("bigint")
    latitude = F.when(key % 7 == 0, None).when(key % 11 == 0, "NaN").when(key % 13 == 0, "north").otherwise(F.col("latitude").cast("string"))
    longitude = F.when(key % 17 == 0, "nan").otherwise(F.col("longitude").cast("string"))
    found = cleaning.places(raw.withColumns({"latitude": latitude, "longitude": longitude}))
    return _rounded(found.select("business_id", "city", "latitude", "longitude"), "latitude", "longitude")


def event_categories(spark, folder):
    return kpis.event_categories(tables.enriched_events(spark, folder))


def event_grid_cells(spark, folder):
    return grid_event_frame(tables.enriched_events(spark, folder), DAILY.cell_size_km)


def category_events(spark, folder):
    return mix.category_event_frame(tables.enriched_events(spark, folder), DAILY.cell_size_km)


# -- totals ---------------------------------------------------------------------------------------------------------


def city_metrics(spark, folder):
    return _rounded(kpis.city_metrics(_activity(spark, folder)), "avg_stars")


def city_metrics_volume(spark, folder):
    return _rounded(kpis.city_metrics(_volume_activity(spark, folder)), "avg_stars")


def grid_hotspots(spark, folder):
    return _rounded(kpis.grid_hotspots(_activity(spark, folder), DAILY.cell_size_km), "avg_stars")


def grid_hotspots_volume(spark, folder):
    return _rounded(kpis.grid_hotspots(_volume_activity(spark, folder), MONTHLY.cell_size_km), "avg_stars")


def category_leaders(spark, folder):
    return _rounded(kpis.category_leaders(_activity(spark, folder)), "avg_stars")


def latest_reviews(spark, folder):
    return kpis.latest_reviews_of(_reviews(spark, folder), _places(spark, folder), DAILY.latest_limit)


def business_projection(spark, folder):
    return _rounded(distinct_businesses(_activity(spark, folder)), "latitude", "longitude")


def dense_city_counts(spark, folder):
    active = distinct_businesses(_activity(spark, folder))
    return dense_cities(active, DAILY.dense_city_threshold).drop("cluster_count")


def cluster_counts(spark, folder):
    return dense_cities(distinct_businesses(_activity(spark, folder)), 1)


# -- neighborhoods (iterative, no SQL) ------------------------------------------------------------------------------


def neighborhood_assignments(spark, folder):
    return _neighborhoods(spark, folder)


def neighborhood_fit_checks(spark, folder):
    return fit_checks(distinct_businesses(_activity(spark, folder)), _neighborhoods(spark, folder), DAILY)


def neighborhood_fit_quality(spark, folder):
    """Each city's squares, and whether its neighborhoods leave at most 1.5 times the k-th part of them, as k even parts would."""
    found = fit_quality(distinct_businesses(_activity(spark, folder)), _neighborhoods(spark, folder), DAILY)
    near = F.col("left_squares") * F.col("cluster_count") <= 1.5 * F.col("total_squares")
    return found.select("city", "business_count", "cluster_count", F.round("total_squares", 9).alias("total_squares"), near.alias("near_even_parts"))


def neighborhood_hotspots(spark, folder):
    found = kpis.neighborhood_hotspots(_activity(spark, folder), _neighborhoods(spark, folder))
    return _rounded(found, "latitude", "longitude", "avg_stars")


def neighborhood_windows(spark, folder):
    activity = _activity(spark, folder, DAILY)
    found = hotspots.window_hotspots(activity, DAILY, _neighborhoods(spark, folder))
    return _rounded(found, "latitude", "longitude", *_SCORES)


def neighborhood_category_mix(spark, folder):
    found = mix.category_mix(_recent_activity(spark, folder), RECENT, _neighborhoods(spark, folder))
    return _rounded(found, "latitude", "longitude", *_SHARES)


def neighborhood_cities(spark, folder):
    found = kpis.neighborhood_hotspots(_activity(spark, folder), _neighborhoods(spark, folder))
    return serving.dense_city_options(found)


# Sums over the neighborhoods of a city must equal the city's own numbers, which SQL can state.


def neighborhood_city_totals(spark, folder):
    found = kpis.neighborhood_hotspots(_activity(spark, folder), _neighborhoods(spark, folder))
    stars = F.sum(F.col("review_count") * F.col("avg_stars")) / F.sum("review_count")
    totals = found.groupBy("city", "state").agg(F.sum("review_count").alias("review_count"), stars.alias("avg_stars"))
    return _rounded(totals, "avg_stars")


def neighborhood_window_totals(spark, folder):
    every = DAILY.with_(min_events_for_hotspot=1)
    found = hotspots.window_hotspots(_activity(spark, folder, every), every, _neighborhoods(spark, folder))
    inside = found.filter(F.col("area_type") == "neighborhood")
    return inside.groupBy("city", "state", "window_start", "window_end").agg(F.sum("event_count").alias("event_count"))


def neighborhood_category_totals(spark, folder):
    found = mix.category_mix(_recent_activity(spark, folder), RECENT, _neighborhoods(spark, folder))
    inside = found.filter(F.col("area_type") == "neighborhood")
    return inside.groupBy("city", "state", "category").agg(F.sum("current_count").alias("current_count"))


# -- windows --------------------------------------------------------------------------------------------------------


def _windows(spark, folder, params=DAILY):
    return hotspots.window_hotspots(_activity(spark, folder, params), params)


def window_hotspots(spark, folder):
    return _rounded(_windows(spark, folder), *_SCORES)


def window_hotspots_tumbling(spark, folder):
    return _rounded(_windows(spark, folder, TUMBLING), *_SCORES)


def window_hotspots_volume(spark, folder):
    return _rounded(hotspots.window_hotspots(_volume_activity(spark, folder, MONTHLY), MONTHLY), *_SCORES)


def emerging_areas(spark, folder):
    return _rounded(hotspots.emerging_areas(_windows(spark, folder), DAILY), *_SCORES)


def city_activity_windows(spark, folder):
    found = hotspots.city_activity_windows(_activity(spark, folder, DAILY), DAILY)
    return _rounded(found, "avg_stars")


def city_activity_minutely(spark, folder):
    """Windows of 24 hours every minute, summed up by city and day: 1,440 windows hold each event."""
    params = DAILY.with_(window_duration="24 hours", slide_duration="1 minute")
    found = hotspots.city_activity_windows(_activity(spark, folder, params), params)
    counts = {"windows": F.count("*"), "events": F.sum("event_count"), "most_events": F.max("event_count"), "stars": F.sum(F.col("avg_stars") * F.col("event_count"))}
    daily = found.groupBy("city", "state", F.to_date("window_start").cast("string").alias("day")).agg(*(x.alias(name) for name, x in counts.items()))
    return _rounded(daily, "stars")


def area_pane_totals(spark, folder):
    width = hotspots.params_pane(DAILY)
    return area_panes(_activity(spark, folder, DAILY), width, DAILY.cell_size_km)


# -- category mix ---------------------------------------------------------------------------------------------------


def _recent_activity(spark, folder):
    reviews, located = _reviews(spark, folder), mix.with_categories(_places(spark, folder))
    latest = mix.newest_time(place_activity(reviews, located))
    since = latest.select(mix.recent_start(F.col("latest"), RECENT)).scalar()
    return place_activity(reviews, located, recent_from=since)


def _mix(spark, folder):
    return mix.category_mix(_recent_activity(spark, folder), RECENT)


def category_mix(spark, folder):
    return _rounded(_mix(spark, folder), *_SHARES)


# -- serving --------------------------------------------------------------------------------------------------------


def city_options(spark, folder):
    return serving.city_options(kpis.city_metrics(_activity(spark, folder)))


def default_city(spark, folder):
    return serving.default_city(kpis.city_metrics(_activity(spark, folder)), DAILY.default_city)


def category_options(spark, folder):
    return serving.category_options(_mix(spark, folder), CITY)


def area_options(spark, folder):
    return serving.area_options(_windows(spark, folder), CITY, AREA[0])


def area_type_options(spark, folder):
    return serving.area_type_options(_windows(spark, folder), CITY)


def _cells(spark, folder):
    return kpis.grid_hotspots(_activity(spark, folder), DAILY.cell_size_km)


def city_hotspots(spark, folder):
    return _rounded(serving.city_hotspots(_cells(spark, folder), CITY), "avg_stars")


def map_midpoint(spark, folder):
    found = serving.map_midpoint(serving.city_hotspots(_cells(spark, folder), CITY))
    return _rounded(found, "latitude", "longitude")


def city_emerging(spark, folder):
    found = serving.city_emerging(hotspots.emerging_areas(_windows(spark, folder), DAILY), CITY)
    return _rounded(found, "hotspot_score", "avg_stars", "rating_change")


def city_window_hotspots(spark, folder):
    found = serving.city_window_hotspots(
        _windows(spark, folder), CITY, first_day="2024-01-03", last_day="2024-01-27"
    )
    return _rounded(found, *_SCORES)


def window_date_bounds(spark, folder):
    found = serving.window_date_bounds(serving.city_window_hotspots(_windows(spark, folder), CITY))
    return found.select(F.col("first_day").cast("string"), F.col("last_day").cast("string"))


def area_series(spark, folder):
    found = serving.area_series(_windows(spark, folder), CITY, *AREA)
    return _rounded(found, "hotspot_score", "avg_stars", "rating_change")


def areas_with_category(spark, folder):
    return serving.areas_with_category(_mix(spark, folder), CATEGORY)


def area_choice(spark, folder):
    return serving.area_choice(_windows(spark, folder), _mix(spark, folder), CITY, CATEGORY)


def area_top_categories(spark, folder):
    return _rounded(serving.area_top_categories(_mix(spark, folder), CITY, *AREA), *_SHARES)


def area_chosen_category(spark, folder):
    return _rounded(serving.area_top_categories(_mix(spark, folder), CITY, *AREA, category=CATEGORY), *_SHARES)


def top_categories_by_area(spark, folder):
    return _rounded(serving.top_categories_by_area(_mix(spark, folder)), *_SHARES)


def activity_series_thinned(spark, folder):
    windows = hotspots.city_activity_windows(_volume_activity(spark, folder, MONTHLY), MONTHLY)
    return _rounded(serving.activity_series(windows, 50), "avg_stars")


def city_activity_series(spark, folder):
    windows = hotspots.city_activity_windows(_activity(spark, folder, DAILY), DAILY)
    return _rounded(serving.city_activity_series(windows, CITY), "avg_stars")


def city_leaderboard(spark, folder):
    return _rounded(serving.city_leaderboard(kpis.city_metrics(_activity(spark, folder))), "avg_stars")


def top_city_categories(spark, folder):
    found = serving.top_city_categories(kpis.category_leaders(_activity(spark, folder)), CITY)
    return _rounded(found, "avg_stars")


def recent_feed(spark, folder):
    return serving.recent_feed(latest_reviews(spark, folder))


# -- streams --------------------------------------------------------------------------------------------------------

# Streams keep instants, the tables zone-less times; both conversions take the clock time as UTC.
_TO_INSTANT = "timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date))"


def _event_stream(spark, folder):
    """The events file as an unbounded source of raw reviews, its rows in as many batches as it has files."""
    stream = spark.readStream.schema(tables.table(spark, folder, "events").schema).parquet(f"{folder}/events*.parquet")
    return tables.as_reviews(stream).withColumn("date", F.expr(_TO_INSTANT))


def _zoneless(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns(
        {n: F.expr(f"timestampadd(MICROSECOND, unix_micros({n}), TIMESTAMP_NTZ '1970-01-01 00:00:00')") for n in names}
    )


def _run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _stream_settings(spark, params):
    folder = Stage(spark).path
    return params.with_(output_path=f"{folder}/tables", checkpoint_path=f"{folder}/checkpoint")


_pieces: dict[tuple[str, str], str] = {}


def _events_in_pieces(spark, folder) -> str:
    """The events written once as several files with rows of all times in each, so a stream takes several batches."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _pieces:
        stage = Stage(spark)
        stage.write("events", tables.table(spark, folder, "events").repartition(3, "event_id"))
        _pieces[key] = f"{stage.path}/events"
    return _pieces[key]


def _streamed(spark, folder, params):
    """The nine tables read back from the partials a stream has written in several batches, compacted on the way."""
    params = _stream_settings(spark, params)
    located = Stage(spark).write("places", _places(spark, folder))
    process = batch_processor(lambda: located, params, compact_every=2)
    schema = tables.table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(_events_in_pieces(spark, folder))
    reviews = tables.as_reviews(stream).withColumn("date", F.expr(_TO_INSTANT))
    _run_to_end(start_batches(reviews, process, params, available_now=True))
    return PartialStore(spark, params.output_path).tables(params)


def streamed_city_metrics(spark, folder):
    return _rounded(_streamed(spark, folder, DAILY)["city_metrics"], "avg_stars")


def streamed_window_hotspots(spark, folder):
    return _zoneless(
        _rounded(_streamed(spark, folder, DAILY)["window_hotspots"], *_SCORES), "window_start", "window_end"
    )


def streamed_category_mix(spark, folder):
    return _zoneless(_rounded(_streamed(spark, folder, RECENT)["category_mix"], *_SHARES), "window_end")


def appended_city_metrics(spark, folder):
    """A stream of three batches in append mode: every batch adds its own rows to the tables."""
    params, stage = _stream_settings(spark, DAILY), Stage(spark)
    events, located = tables.table(spark, folder, "events"), stage.write("places", _places(spark, folder))
    process = batch_processor(lambda: located, params, mode="append")
    for k in range(3):  # a batch is all that has arrived since the stream last ran, in however many files
        events.filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{stage.path}/arriving")
        stream = spark.readStream.schema(events.schema).parquet(f"{stage.path}/arriving")
        reviews = tables.as_reviews(stream).withColumn("date", F.expr(_TO_INSTANT))
        _run_to_end(start_batches(reviews, process, params, available_now=True))
    return _rounded(read_table(spark, params.output_path, "city_metrics"), "avg_stars")


def watermarked_window_hotspots(spark, folder):
    params = _stream_settings(spark, DAILY)
    joined = enrich(cleaning.clean_reviews(_event_stream(spark, folder)), _places(spark, folder))
    _run_to_end(write_panes(watermarked_panes(joined, params, "1 day"), params, available_now=True))
    return _zoneless(_rounded(watermarked_windows(spark, params), *_SCORES), "window_start", "window_end")


def watermarked_closed_windows(spark, folder):
    """A stream of three batches, the last with events far behind the watermark: windows come out once they have closed.

    Every tenth event before the 11th arrives when the watermark has passed the 18th, and is dropped; some of the last day come as
    late but are in time.
    """
    params, stage = _stream_settings(spark, DAILY), Stage(spark)
    events = tables.table(spark, folder, "events")
    late, last = F.expr("event_id % 10 = 0 AND ts < '2024-01-11'"), F.expr("event_id % 10 = 1 AND ts >= '2024-01-29'")
    first = F.expr("ts < '2024-01-20'")
    for batch in (first & ~late, ~first & ~last, late | last):  # in this order: a file stream goes by time of writing
        events.filter(batch).coalesce(1).write.mode("append").parquet(f"{stage.path}/arriving")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{stage.path}/arriving")
    reviews = tables.as_reviews(stream).withColumn("date", F.expr(_TO_INSTANT))
    joined = enrich(cleaning.clean_reviews(reviews), _places(spark, folder))
    _run_to_end(start_closed_windows(closed_window_totals(joined, params, "1 day"), params, available_now=True))
    return _zoneless(_rounded(closed_windows(spark, params), *_SCORES), "window_start", "window_end")


# -- jobs over JSON files -------------------------------------------------------------------------------------------


@contextmanager
def _in_utc(spark):
    """JSON texts hold clock times, which the jobs are meant to read as UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


_json: dict[tuple[str, str], Params] = {}


def _review_files(spark) -> int:
    """Files of dated reviews: at least three, and as many as there are cores to write them."""
    return max(3, spark.sparkContext.defaultParallelism)


def _json_settings(spark, folder) -> Params:
    """The test tables as JSON files, written once: businesses, and reviews in several files with a broken line, some
    without a business and some with a text for a date."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _json:
        path = Stage(spark).path
        tables.raw_customer_businesses(spark, folder).write.json(f"{path}/businesses")
        dates = F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        reviews = tables.raw_event_reviews(spark, folder).withColumn("date", dates)
        reviews.repartition(_review_files(spark), "review_id").write.json(f"{path}/reviews")
        spark.sql("SELECT '{broken' AS line").coalesce(1).write.mode("append").text(f"{path}/reviews")
        keyless = reviews.filter("review_id % 97 = 0").select("review_id", "text")
        undated = reviews.filter("review_id % 89 = 0").withColumn("date", F.concat(F.lit("soon after "), "date"))
        for more in (keyless, undated):
            more.repartition(1).write.mode("append").json(f"{path}/reviews")  # read by all tasks, unlike with coalesce
        _json[key] = DAILY.with_(
            business_path=f"{path}/businesses", review_path=f"{path}/reviews", stream_path=f"{path}/reviews", dense_city_threshold=0
        )
    return _json[key]


_static: dict[tuple[str, str], dict[str, DataFrame]] = {}
_static_path: dict[tuple[str, str], str] = {}


def _static_tables(spark, folder) -> dict[str, DataFrame]:
    """The tables the batch job publishes from the JSON files; it runs once for all its queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _static:
        params = _json_settings(spark, folder).with_(output_path=f"{Stage(spark).path}/static")
        with _in_utc(spark):
            _static[key], _static_path[key] = run_static(spark, params), params.output_path
    return _static[key]


def static_job_city_metrics(spark, folder):
    return _rounded(_static_tables(spark, folder)["city_metrics"], "avg_stars")


def static_job_grid_hotspots(spark, folder):
    return _rounded(_static_tables(spark, folder)["grid_hotspots"], "avg_stars")


def static_job_category_leaders(spark, folder):
    return _rounded(_static_tables(spark, folder)["category_leaders"], "avg_stars")


def static_job_latest_reviews(spark, folder):
    return _static_tables(spark, folder)["latest_reviews"]


def static_job_window_hotspots(spark, folder):
    return _zoneless(_rounded(_static_tables(spark, folder)["window_hotspots"], *_SCORES), "window_start", "window_end")


def static_job_review_counts(spark, folder):
    """What became of the rows of the JSON files: kept, malformed, without a key, without a readable date."""
    _static_tables(spark, folder)
    return read_counts(spark, _static_path[spark.sparkContext.applicationId, folder])


_file_streamed: dict[tuple[str, str], str] = {}


def _file_stream(spark, folder) -> str:
    """The file-stream job over the JSON files, a third of the dated reviews at a time, its tables published; it runs once for all
    its queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _file_streamed:
        stage = Stage(spark).path
        params = _json_settings(spark, folder).with_(output_path=f"{stage}/tables", checkpoint_path=f"{stage}/checkpoint")
        with _in_utc(spark):
            third = -(-_review_files(spark) // 3)
            _run_to_end(start_file_stream(spark, params, available_now=True, max_files_per_trigger=third))
            PartialStore(spark, params.output_path).publish(params)
        _file_streamed[key] = params.output_path
    return _file_streamed[key]


def file_stream_window_hotspots(spark, folder):
    found = read_table(spark, _file_stream(spark, folder), "window_hotspots")
    return _zoneless(_rounded(found, *_SCORES), "window_start", "window_end")


def file_stream_review_counts(spark, folder):
    return read_counts(spark, _file_stream(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        enriched_events, cleaned_reviews, parsed_dates, order_dates_kept, order_dates_rejected, oldest_reviews, oldest_reviews_by_day, located_places, event_categories, event_grid_cells,
        category_events, city_metrics, city_metrics_volume, grid_hotspots, grid_hotspots_volume, category_leaders,
        latest_reviews, business_projection, dense_city_counts, cluster_counts, neighborhood_assignments, neighborhood_fit_checks, neighborhood_fit_quality,
        neighborhood_hotspots, neighborhood_windows, neighborhood_category_mix, neighborhood_cities, neighborhood_city_totals,
        neighborhood_window_totals, neighborhood_category_totals, window_hotspots,
        window_hotspots_tumbling, window_hotspots_volume, emerging_areas, city_activity_windows, city_activity_minutely, area_pane_totals,
        category_mix, city_options, default_city, category_options, area_options, area_type_options, city_hotspots,
        map_midpoint, city_emerging, city_window_hotspots, window_date_bounds, area_series, areas_with_category,
        area_choice, area_top_categories, area_chosen_category, top_categories_by_area, activity_series_thinned, city_activity_series,
        city_leaderboard, top_city_categories, recent_feed, streamed_city_metrics, streamed_window_hotspots,
        streamed_category_mix, appended_city_metrics, watermarked_window_hotspots, watermarked_closed_windows, static_job_city_metrics, static_job_grid_hotspots,
        static_job_category_leaders, static_job_latest_reviews, static_job_window_hotspots, static_job_review_counts,
        file_stream_window_hotspots, file_stream_review_counts,
    )
}
