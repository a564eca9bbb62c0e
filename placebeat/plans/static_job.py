"""The batch job: two JSON inputs to nine Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.operators.cleaning import KEPT, REVIEW_KEYS, UNDATED, clean_reviews, counted_by_outcome, oldest_reviews, outcome_counts, with_outcome
from placebeat.operators.neighborhoods import distinct_businesses, fit_neighborhoods
from placebeat.params import Params
from placebeat.plans.partials import batch_partials, finish, pane_activity
from placebeat.plans.stage import Stage
from placebeat.schemas import REVIEW_SCHEMA, TABLE_SCHEMAS
from placebeat.sources.files import load_places, read_businesses, read_reviews, read_table, write_counts, write_fitted, write_rejects, write_tables


def static_tables(
    cleaned: DataFrame, located: DataFrame, params: Params, stage: Stage, narrow: DataFrame | None = None, fitted_path: str | None = None
) -> dict[str, DataFrame]:
    """The nine tables of all events, finished from staged partials.

    One pass over the events reduces them to panes of businesses, a second reads the newest ones; the rest works on what those two
    have left. Staged tables with a business are in buckets of it, so that only the first reduction moves rows by business.
    ``narrow`` is a copy of the events without text to make the first pass over. The neighborhoods are also
    kept under ``fitted_path``, if given. Raises when no event has a place.
    """
    places = stage.write_bucketed("places", located, "business_id")
    activity = stage.write_bucketed("activity", pane_activity(cleaned if narrow is None else narrow, params), "business_id")
    neighborhoods = None
    if params.dense_city_threshold > 0:
        active = distinct_businesses(activity.select("business_id").distinct().join(places, "business_id"))
        neighborhoods = stage.write_bucketed("neighborhoods", fit_neighborhoods(active, params, stage), "business_id")
        if fitted_path:
            write_fitted(neighborhoods, fitted_path)
    partials = batch_partials(cleaned, places, params, neighborhoods, stage, activity)
    staged = {name: stage.write(name, frame) for name, frame in partials.items()}
    if staged["area_panes"].isEmpty():
        raise RuntimeError("no event has a place: check the input paths")
    return finish(staged, params)


def sorted_reviews(raw: DataFrame, stage: Stage, with_text: bool) -> tuple[DataFrame, dict[str, int]]:
    """The raw rows parsed once and written by outcome, and how many there are of each.

    Kept rows are written with the columns that the counts need and their parsed date as ``review_date_``, the others as they were
    read; ``with_text`` keeps the other texts of all of them. The numbers are counted while the rows are written.
    """
    sorted_rows, seen = counted_by_outcome(with_outcome(raw), "reviews")
    other = F.col("outcome") != KEPT
    whole = {"business_id", "stars", *REVIEW_KEYS, *(REVIEW_SCHEMA.fieldNames() if with_text else ())} - {"date"}
    columns = [F.col(c) if c in whole else F.when(other, F.col(c)).alias(c) for c in REVIEW_SCHEMA.fieldNames()]
    written = stage.write("sorted", sorted_rows.select(*columns, "review_date_", "outcome"), partition_by="outcome")
    return written, seen.get


def kept_reviews(rows: DataFrame) -> DataFrame:
    """The kept rows of :func:`sorted_reviews`, as raw reviews whose date is parsed."""
    dated = [F.col("review_date_" if c == "date" else c).alias(c) for c in REVIEW_SCHEMA.fieldNames()]
    return rows.filter(F.col("outcome") == KEPT).select(*dated)


def run_static(spark: SparkSession, params: Params) -> dict[str, DataFrame]:
    """Read, compute and replace all tables under ``params.output_path``; returns frames reading them.

    Reviews whose date can't be read are written to ``rejected_reviews`` beside the tables, and to ``review_counts`` how many
    rows were kept, malformed, without a key or without a readable date; the neighborhoods go to ``fitted_neighborhoods``, for
    streams to take over. The raw reviews are parsed twice, once with a limit: to
    be sorted by outcome, and for the newest events with their text.
    """
    params.check_source()
    located = load_places(spark, params.business_path)
    with Stage(spark) as stage:
        raw = read_reviews(spark, params.review_path)
        rows, counts = sorted_reviews(raw, stage, with_text=bool(params.limit))
        write_counts(outcome_counts(counts, spark), params.output_path)
        write_rejects(rows.filter(F.col("outcome") == UNDATED).select(*REVIEW_SCHEMA.fieldNames()), params.output_path)
        kept = kept_reviews(rows)
        # Counting the businesses' lines parses none of them.
        events = min(counts[KEPT], params.limit or counts[KEPT])
        stage.size_buckets(max(events, read_businesses(spark, params.business_path).count()))
        if params.limit:
            cleaned = stage.write("oldest", oldest_reviews(kept, params.limit, stage))
            tables = static_tables(cleaned, located, params, stage, fitted_path=params.output_path)
        else:
            tables = static_tables(clean_reviews(raw), located, params, stage, narrow=clean_reviews(kept), fitted_path=params.output_path)
        write_tables(tables, params.output_path)
    return {name: read_table(spark, params.output_path, name) for name in TABLE_SCHEMAS}
