"""JSON inputs and Parquet tables on any file system Spark can reach."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.functions.geo import cell_order
from placebeat.operators.cleaning import clean_businesses, oldest_reviews, places
from placebeat.operators.enrich import enrich
from placebeat.plans.stage import Stage
from placebeat.schemas import BUSINESS_SCHEMA, NEIGHBORHOOD_SCHEMA, RAW_REVIEW_SCHEMA, REVIEW_COUNT_SCHEMA, REVIEW_SCHEMA, TABLE_SCHEMAS


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    """Raw business objects, one JSON object per line; the declared schema saves an inference pass."""
    return spark.read.schema(BUSINESS_SCHEMA).json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Raw review objects, one JSON object per line; ``malformed`` holds lines that aren't."""
    return spark.read.schema(RAW_REVIEW_SCHEMA).option("columnNameOfCorruptRecord", "malformed").json(path)


def load_businesses(spark: SparkSession, path: str) -> DataFrame:
    return clean_businesses(read_businesses(spark, path))


def load_places(spark: SparkSession, path: str) -> DataFrame:
    return places(read_businesses(spark, path))


def load_reviews(spark: SparkSession, path: str, limit: int | None = None, stage: Stage | None = None) -> DataFrame:
    """Cleaned reviews; with a limit, the oldest that many, picked before the join with places."""
    return oldest_reviews(read_reviews(spark, path), limit, stage)


def write_rejects(rejected: DataFrame, base_path: str, batch_id: int | None = None) -> None:
    """Reviews whose date can't be read, as table ``rejected_reviews`` or as a batch of it."""
    part = "" if batch_id is None else f"/batch_id={batch_id}"
    rejected.write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/rejected_reviews{part}")


def read_rejects(spark: SparkSession, base_path: str) -> DataFrame:
    """All rejected reviews; empty when no job has written any."""
    try:
        return spark.read.schema(REVIEW_SCHEMA).parquet(f"{base_path.rstrip('/')}/rejected_reviews").select(*REVIEW_SCHEMA.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REVIEW_SCHEMA)


def write_counts(counts: DataFrame, base_path: str, batch_id: int | None = None) -> None:
    """What became of the rows read, as table ``review_counts`` or as a batch of it."""
    part = "" if batch_id is None else f"/batch_id={batch_id}"
    counts.coalesce(1).write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/review_counts{part}")


def read_counts(spark: SparkSession, base_path: str) -> DataFrame:
    """Rows read so far by outcome; empty when no job has written any."""
    try:
        found = spark.read.schema(REVIEW_COUNT_SCHEMA).parquet(f"{base_path.rstrip('/')}/review_counts")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REVIEW_COUNT_SCHEMA)
    return found.groupBy("outcome").agg(F.sum("rows").alias("rows"))


def load_enriched(spark: SparkSession, review_path: str, business_path: str, limit: int | None = None) -> DataFrame:
    """The static source: joined events from two JSON files."""
    return enrich(load_reviews(spark, review_path, limit), load_places(spark, business_path))


def read_table(spark: SparkSession, base_path: str, name: str) -> DataFrame:
    """A published table with its declared schema; empty when it has not been written yet."""
    schema = TABLE_SCHEMAS[name]
    try:
        found = spark.read.schema(schema).parquet(f"{base_path.rstrip('/')}/{name}")
        return found.select(*schema.fieldNames())  # without the batch_id of appended batches
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_fitted(neighborhoods: DataFrame, base_path: str) -> None:
    """Keep the neighborhoods that a job has fitted, beside its tables."""
    neighborhoods.write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/fitted_neighborhoods")


def read_fitted(spark: SparkSession, base_path: str) -> DataFrame:
    """The neighborhoods of the static job that wrote to ``base_path``; fails when it has fitted none."""
    return spark.read.schema(NEIGHBORHOOD_SCHEMA).parquet(f"{base_path.rstrip('/')}/fitted_neighborhoods")


def laid_out(frame: DataFrame) -> DataFrame:
    """Rows in ranges of city, place and time, each range a file sorted in that order.

    Readers ask for one city, often for some of its areas or days: their filters then leave out most files' row groups by the
    smallest and largest value in them. Ranges are cut at sampled splitters, so a large city takes several.
    """
    if "city" not in frame.columns:
        return frame
    order = ["city"]
    if "latitude" in frame.columns:
        frame = frame.withColumn("cell_order_", cell_order(F.col("latitude"), F.col("longitude")))
        order.append("cell_order_")
    order += [c for c in ("window_start", "category") if c in frame.columns]
    return frame.repartitionByRange(*order).sortWithinPartitions(*order).drop("cell_order_")


def write_tables(tables: Mapping[str, DataFrame], base_path: str) -> None:
    """Replace every table by its new content, laid out for readers of single cities."""
    for name, frame in tables.items():
        laid_out(frame).write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/{name}")


def write_batch(tables: Mapping[str, DataFrame], base_path: str, batch_id: int) -> None:
    """Add one micro-batch to every table as directory ``batch_id=N``; a retried batch replaces its first attempt."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{base_path.rstrip('/')}/{name}/batch_id={batch_id}")
