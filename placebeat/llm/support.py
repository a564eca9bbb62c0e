"""What the operators share on the driver: shipping the package to tasks, fresh column names, staged tables."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.plans.stage import Stage

ROOT = str(Path(__file__).resolve().parents[2])
WORD = r"[^\x20\x09-\x0D]+"


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python tasks import this package also where it is used from its source folder, and get batches of a few megabytes.

    A size of batches that the session sets itself stays.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, "4m")
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


def stage(spark: SparkSession) -> Stage:
    return Stage(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so other columns of the input can't clash."""
    return frame.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def fresh(frame: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    return f"{stem}_{uuid.uuid4().hex[:8]}" if stem in frame.columns else stem


def row_key(frame: DataFrame, id_column: str, text_column: str) -> Column:
    """A 64-bit number of id and text, null or not: rows that share an id and differ in text differ in it."""
    known = [F.col(f"`{x}`") for x in (id_column, text_column)]
    return F.xxhash64(*(x.isNull() for x in known), *known)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0).cast("long")).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+")).cast("long"))
