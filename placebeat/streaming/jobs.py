"""Streaming jobs: micro-batches of reviews against the place dimension."""

from __future__ import annotations

from collections.abc import Callable
from typing import Literal

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placebeat.operators.cleaning import KEPT, UNDATED, clean_reviews, outcome_counts, with_outcome
from placebeat.operators.neighborhoods import distinct_businesses, fit_neighborhoods, with_new_places
from placebeat.params import Params
from placebeat.plans.partials import finish, staged_partials
from placebeat.plans.stage import Stage
from placebeat.plans.static_job import run_static
from placebeat.schemas import NEIGHBORHOOD_SCHEMA, REVIEW_SCHEMA
from placebeat.sources.files import load_places, read_fitted, write_batch, write_counts, write_rejects
from placebeat.sources.streams import review_file_stream, review_kafka_stream
from placebeat.streaming.store import PartialStore

Mode = Literal["merged", "append"]
COMPACT_EVERY = 100  # batches


def neighborhood_dimension(spark: SparkSession, params: Params, located: DataFrame) -> DataFrame | None:
    """The neighborhoods under the output path; if they aren't there yet, those of the static job at
    ``params.neighborhoods_path``, or without one a fit over the place dimension.

    The static job counts and fits places with events, so a stream that follows it has the same dense cities and areas.
    A restart goes on with those that older partials were made with; a new fit needs a new output path.
    """
    if params.dense_city_threshold <= 0:
        return None
    path = f"{params.output_path.rstrip('/')}/neighborhoods"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        with Stage(spark) as stage:
            if params.neighborhoods_path:
                fitted = read_fitted(spark, params.neighborhoods_path)
            else:
                fitted = fit_neighborhoods(distinct_businesses(located), params, stage)
            fitted.write.mode("overwrite").parquet(path)
    return spark.read.schema(NEIGHBORHOOD_SCHEMA).parquet(path)


def batch_processor(
    places_of: Callable[[], DataFrame],
    params: Params,
    neighborhoods: DataFrame | Callable[[], DataFrame | None] | None = None,
    mode: Mode = "merged",
    compact_every: int = 0,
) -> Callable[[DataFrame, int], None]:
    """The function run on every micro-batch.

    ``merged`` writes additive partials, from which :class:`PartialStore` gives tables over the whole stream;
    ``append`` finishes the nine tables of the batch alone from its partials and adds them as a batch directory. What a batch
    writes in between lies in a folder under the output path, removed when the batch ends.
    ``places_of``, and ``neighborhoods`` if it is a function, are called once per batch, so they decide whether places are
    read anew. Every ``compact_every`` batches (0: never) the finished partials are compacted.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        # Parsed once: counted by outcome, rejected and used from the same kept rows.
        found = with_outcome(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = {r["outcome"]: r["n"] for r in found.groupBy("outcome").agg(F.count("*").alias("n")).collect()}  # four at most
            if not counts:
                return
            spark = batch.sparkSession
            write_counts(outcome_counts(counts, spark), params.output_path, batch_id)
            write_rejects(found.filter(F.col("outcome") == UNDATED).select(*REVIEW_SCHEMA.fieldNames()), params.output_path, batch_id)
            if not counts.get(KEPT):
                return
            cleaned = clean_reviews(found.filter(F.col("outcome") == KEPT).select(*batch.columns))
            assigned = neighborhoods() if callable(neighborhoods) else neighborhoods
            with Stage(spark, params.output_path) as stage:
                partials = staged_partials(cleaned, places_of(), params, assigned, stage)
                if mode == "append":
                    staged = {name: stage.write(name, frame) for name, frame in partials.items()}
                    write_batch(finish(staged, params), params.output_path, batch_id)
                else:
                    store = PartialStore(spark, params.output_path)
                    store.write(partials, batch_id, params)
            if mode == "merged":
                if compact_every and (batch_id + 1) % compact_every == 0:
                    store.compact(params)
                    store.drop_compacted()
        finally:
            found.unpersist()

    return process


def start_stream(
    spark: SparkSession,
    reviews: DataFrame,
    params: Params,
    mode: Mode = "merged",
    refresh_places: bool = False,
    available_now: bool = False,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Start processing a review stream.

    Places are read once and written to a table of the output path, or read for every batch with ``refresh_places``; new
    ones then join the nearest neighborhood of their city. ``available_now`` works off what is there and stops, instead
    of polling every ``trigger_seconds``. Partials are compacted every ``compact_every`` batches.
    """
    if mode not in ("merged", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    located = load_places(spark, params.business_path)
    neighborhoods = neighborhood_dimension(spark, params, located)
    if refresh_places:
        places_of = lambda: load_places(spark, params.business_path)
    else:
        path = f"{params.output_path.rstrip('/')}/places"
        located.write.mode("overwrite").parquet(path)
        kept = spark.read.schema(located.schema).parquet(path)
        places_of = lambda: kept
    assigned = neighborhoods
    if refresh_places and neighborhoods is not None:
        assigned = lambda: with_new_places(neighborhoods, distinct_businesses(places_of()), params)
    process = batch_processor(places_of, params, assigned, mode, compact_every)
    return start_batches(reviews, process, params, available_now)


def start_batches(
    stream: DataFrame,
    process: Callable[[DataFrame, int], None],
    params: Params,
    available_now: bool = False,
    output_mode: str = "append",
) -> StreamingQuery:
    """Run ``process`` on every micro-batch, every ``trigger_seconds`` or until all that is there is worked off."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{params.trigger_seconds} seconds"}
    return (
        stream.writeStream.foreachBatch(process)
        .outputMode(output_mode)
        .option("checkpointLocation", params.checkpoint_path)
        .trigger(**trigger)
        .start()
    )


def start_file_stream(spark: SparkSession, params: Params, **options) -> StreamingQuery:
    """Tail a folder of review files; ``options`` as for :func:`start_stream`, and ``max_files_per_trigger``."""
    params = params.with_(source_type="file_stream")
    params.check_source()
    max_files = options.pop("max_files_per_trigger", None)
    return start_stream(spark, review_file_stream(spark, params.stream_path, max_files), params, **options)


def start_kafka_stream(spark: SparkSession, params: Params, **options) -> StreamingQuery:
    params = params.with_(source_type="kafka")
    params.check_source()
    return start_stream(spark, review_kafka_stream(spark, params), params, **options)


def run(spark: SparkSession, params: Params):
    """Run the job ``params.source_type`` names: tables for the static source, a running query for a stream."""
    params.check_source()
    jobs = {"static": run_static, "file_stream": start_file_stream, "kafka": start_kafka_stream}
    return jobs[params.source_type](spark, params)
