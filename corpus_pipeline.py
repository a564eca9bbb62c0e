"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The
stages hold no SQL equivalent as a whole (tokenisers, latent retrieval), so ORACLE_SQL is None and the tests compare them
with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.llm.decontamination import decontamination
from placebeat.llm.mixing import mix_sources
from placebeat.llm.near_duplicates import near_duplicates
from placebeat.llm.quality_rules import passing
from placebeat.llm.secret_scans import redact_secrets
from placebeat.llm.support import fresh, row_key, stage

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return passing(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id, and one of rows equal in id and text.

    Rows go by a key of id and text, so texts that share an id, or have none, are judged on their own. The groups are
    reduced to the keys that stay; the operator's own tables are removed then.
    """
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs, "doc_id", "text"))
    with stage(spark) as tables:
        groups = near_duplicates(keyed, id_column=key, store=tables).select(F.col(key).alias("k"), "component_id").distinct()
        ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").isNull().alias("nameless"), "doc_id").distinct()
        kept = groups.join(ids, "k").groupBy("component_id").agg(F.min(F.struct("nameless", "doc_id", "k"))["k"].alias("stays")).select("stays")
        kept = stage(spark).write("kept", kept)
    return keyed.join(kept, F.col(key) == F.col("stays"), "left_semi").dropDuplicates([key]).drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; rows go by a key of id and text, as above."""
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs, "doc_id", "text"))
    with stage(spark) as tables:
        leaks = decontamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=key, store=tables)
        leaks = stage(spark).write("leaks", leaks.select(F.col(key).alias("leaks")).distinct())
    return keyed.join(leaks, F.col(key) == F.col("leaks"), "left_anti").drop(key)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; the document stays, and its number of characters follows."""
    return redact_secrets(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("source mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read by the next."""
    store = stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES[:-1]):
        docs = store.write(f"stage-{k}", function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
