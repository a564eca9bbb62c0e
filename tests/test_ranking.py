import random

import pytest
from pyspark.sql import functions as F

from placebeat.operators.cleaning import oldest_reviews
from placebeat.operators.ranking import first_rows, ranked
from placebeat.plans.stage import Stage
from tests.helpers import rows


@pytest.mark.parametrize("n", [0, 1, 7, 99, 100, 137, 300, 1000])
def test_first_rows_with_nulls_and_ties(spark, n):
    rng = random.Random(3)
    table = [(rng.choice((None, 1, 2, 3)), rng.choice((None, "a", "b")), rng.choice(("x", None, "y"))) for _ in range(180)] + [(2, "b", "z")] * 120
    frame = spark.createDataFrame(table, "k int, t string, v string").repartition(6)
    with Stage(spark) as stage:
        found = [tuple(r) for r in first_rows(frame, ["k", "t"], n, stage).collect()]
    low = lambda x: (x is not None, x)
    wanted = sorted(((r[0], r[1]) for r in table), key=lambda r: (low(r[0]), low(r[1])))[:n]
    assert sorted(((r[0], r[1]) for r in found), key=repr) == sorted(wanted, key=repr)
    left = list(table)
    for r in found:  # never more copies than there are
        left.remove(r)


def test_ranks_are_a_count_from_zero(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    with Stage(spark) as stage:
        found = ranked(frame, ["k"], stage).collect()
    assert [r["k"] for r in sorted(found, key=lambda r: r["rank"])] == sorted(k * 7919 % 5003 for k in range(5000))
    assert sorted(r["rank"] for r in found) == list(range(5000))


def test_all_rows_in_one_second_are_ranked_in_even_ranges(spark):
    n = 40_000
    raw = spark.range(n).selectExpr(
        "concat('r', lpad(string(id * 7919 % 40009), 6, '0')) AS review_id", "'b' AS business_id", "'u' AS user_id", "4.0D AS stars", "'2020-01-01 00:00:00' AS date", "repeat('x', 50) AS text"
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with Stage(spark) as stage:
            found = oldest_reviews(raw, n // 3, stage)
            assert sorted(r[0] for r in rows(found, "review_id")) == sorted(f"r{k * 7919 % 40009:06d}" for k in range(n))[: n // 3]
            keys = spark.read.parquet(f"{stage.path}/ranked-keys")
            shares = [r["n"] for r in keys.groupBy(F.shiftright("place", 33)).agg(F.count("*").alias("n")).collect()]
        assert len(shares) == 8 and max(shares) < 2 * n / 8 and "review_text" not in keys.columns
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
