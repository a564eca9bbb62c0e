"""Unbounded review sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.params import Params
from placebeat.schemas import RAW_REVIEW_SCHEMA


def review_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder of JSON lines; malformed lines are rows without keys that hold the line in ``malformed``."""
    reader = spark.readStream.schema(RAW_REVIEW_SCHEMA).option("columnNameOfCorruptRecord", "malformed")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def parse_review_messages(messages: DataFrame) -> DataFrame:
    """Reviews from the binary ``value`` column of messages, one JSON object each; malformed ones as in a file stream."""
    options = {"columnNameOfCorruptRecord": "malformed"}
    text = F.coalesce(F.col("value").cast("string"), F.lit(""))
    parsed = messages.select(text.alias("text_"), F.from_json(text, RAW_REVIEW_SCHEMA, options).alias("review"))
    whole = F.when(F.col("review").isNull(), F.col("text_")).otherwise(F.col("review.malformed"))
    return parsed.select("review.*", whole.alias("whole")).drop("malformed").withColumnRenamed("whole", "malformed")


def review_kafka_stream(spark: SparkSession, params: Params) -> DataFrame:
    """Reviews of a Kafka topic. Needs Spark's Kafka connector on the class path."""
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", params.kafka_bootstrap_servers)
        .option("subscribe", params.kafka_topic)
        .option("startingOffsets", params.kafka_starting_offsets)
        .load()
    )
    return parse_review_messages(messages)
