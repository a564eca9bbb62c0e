"""Mixing sources to target weights by capped water-filling.

A source's target is its share, by weight, of the words to take, at most ``max_epochs`` times its size; what the cap
cuts off is shared again by weight among the others until no target is above its cap. Each round is one aggregation over
the table of sources, and two numbers reach the driver. A source's documents are taken as often, whole, as the target
goes into its size; for the rest, documents are taken once more in a seeded order of buckets, and those of the bucket in
which the target is reached are taken in part. The order is a histogram of words by source and bucket, so no task ever
holds a source's documents. DataFrame operations only.

Null texts have size 0, null is a source of its own and the last one, documents of size 0 are taken 0 times, equal ids
fall into the same bucket; an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placebeat.llm.support import narrow, stage, table, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUCKETS = 4096


def drawn(id_column: str, seed: int, first: int, digits: int) -> Column:
    """A number of so many hexadecimal digits from the hash of seed and id."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return F.conv(F.substring(text, first, digits), 16, 10).cast("long")


def with_rank(keys: DataFrame, column: str, store) -> DataFrame:
    """Ranks from 0 of distinct keys in ascending order, null last, without one task that sees all of them."""
    ordered = keys.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    ordered = store.write("ordered", ordered.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = sizes.withColumn("before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).select("part", F.coalesce("before", F.lit(0)).alias("before"))
    return ordered.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "before", "place")


def water_fill(sources: DataFrame, total_share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to the columns source, source_size and weight."""
    cap = max_epochs * F.col("source_size")
    whole = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.count_if(above).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or not row["weights"]:
            break
        level, clamped = (total_share * whole - row["taken"]) / row["weights"], row["clamped"]
    return sources.withColumn("target", F.least(cap, F.lit(level or 0.0) * F.col("weight")) if level is not None else cap)


def mix_sources(
    frame: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    total_share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """id, size, source_size, target and taken (all in words) of every document.

    weights: of the sources in ascending order, repeating. total_share: words to take, as a share of all words.
    """
    store = stage(frame.sparkSession)
    sized = narrow(frame, id=id_column, text=text_column, source=source_column)
    sized = sized.select("id", "source", word_count(F.col("text")).alias("size"), drawn("id", seed, 1, 3).alias("bucket"), drawn("id", seed, 4, 8).alias("draw"))
    sized = store.write("sized", sized)
    histogram = store.write("histogram", sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = histogram.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = with_rank(sources, "source", store)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = store.write("sources", ranked.withColumn("weight", weight).drop("rank"))
    filled = water_fill(ranked, total_share, max_epochs).withColumn("size_of", F.greatest("source_size", F.lit(1)))
    whole = F.floor(F.col("target") / F.col("size_of"))
    filled = filled.withColumn("whole", whole).withColumn("rest", F.col("target") - whole * F.col("source_size")).drop("size_of", "weight")
    # how much of a source's buckets the rest covers: 1 below the bucket in which it ends, 0 behind it
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = histogram.withColumn("before", before).withColumnRenamed("source", "of")
    covered = covered.join(filled, F.col("of").eqNullSafe(F.col("source"))).withColumn(
        "part", F.when(F.col("words") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("rest") - F.col("before")) / F.col("words")))).otherwise(0.0)
    )
    plan = covered.select("of", F.col("bucket").alias("in_bucket"), "source_size", "target", "whole", "part")
    taken = F.col("whole") * F.col("size") + F.floor(F.col("part") * F.col("size") + F.col("draw") / float(16**8))
    mixed = sized.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in_bucket")))
    return mixed.select(F.col("id").alias(id_column), "size", "source_size", "target", F.least(taken, F.lit(int(max_epochs)) * F.col("size")).cast("long").alias("taken"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def mixing_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the query's rows; documents names a table or view."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {documents}),
e AS (SELECT doc_id, source, size, CAST('0x' || h[1:3] AS BIGINT) AS bucket, CAST('0x' || h[4:11] AS BIGINT) AS draw FROM d),
hist AS (SELECT source, bucket, CAST(sum(size) AS BIGINT) AS words FROM e GROUP BY ALL),
s AS (SELECT source, CAST(sum(words) AS BIGINT) AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM hist GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS b,
    coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS k,
    sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM s),
l AS (SELECT arg_min((b - c) / w, k) AS level FROM o WHERE (b - c) / w <= cap / weight),
t AS (SELECT source, source_size, least(cap, level * weight) AS target,
    floor(least(cap, level * weight) / greatest(source_size, 1)) AS whole FROM o, l),
p AS (SELECT h.source, h.bucket, t.source_size, t.target, t.whole,
    CASE WHEN h.words > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (t.target - t.whole * t.source_size - coalesce(sum(h.words) OVER (
      PARTITION BY h.source ORDER BY h.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / h.words)) ELSE 0 END AS part
  FROM hist h JOIN t ON h.source IS NOT DISTINCT FROM t.source)
SELECT e.doc_id, e.size, p.source_size, p.target,
  CAST(least(p.whole * e.size + floor(p.part * e.size + e.draw / 4294967296.0::DOUBLE), 2 * e.size) AS BIGINT) AS taken
FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.bucket = p.bucket
"""
