"""Published tables: filters on city, area and time read a fraction of the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placebeat.functions.geo import cell_order
from placebeat.operators import serving
from placebeat.schemas import TABLE_SCHEMAS
from placebeat.sources.files import read_table, write_tables


def scanned(frame):
    """Rows that the scans of the executed plan have read, after row groups were left out."""
    frame.collect()
    found, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """20,000 windows of 40 cities, one of which has a third of them, in 16 ranges."""
    rng, start, found = random.Random(2), datetime(2020, 1, 1), []
    for k in range(20_000):
        city = rng.choice(["big", *(f"c{x:02}" for x in range(40))]) if k % 3 else "big"
        lat, lon = rng.randrange(40) * 0.02, rng.randrange(40) * 0.02
        begin = start + timedelta(hours=rng.randrange(720))
        found.append(("grid", f"{lat}_{lon}", city, "S", lat, lon, begin, begin + timedelta(hours=1), rng.randrange(3, 50), 4.0, 2.0, 4.0, rng.random() * 3, 0.0))
    path = str(tmp_path_factory.mktemp("published"))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        write_tables({"window_hotspots": spark.createDataFrame(found, TABLE_SCHEMAS["window_hotspots"]).repartition(5)}, path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return path, found


def test_a_city_reads_a_fraction_of_the_rows(spark, published):
    path, found = published
    table = read_table(spark, path, "window_hotspots")
    assert table.count() == len(found) and table.columns == TABLE_SCHEMAS["window_hotspots"].fieldNames()
    files = {r["f"]: r["n"] for r in table.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert len(files) == 16 and max(files.values()) < 2 * len(found) / 16  # the large city takes several ranges
    few = serving.city_window_hotspots(table, "c17")
    assert scanned(few) <= 3 * max(files.values()) < 0.3 * len(found)
    assert few.count() == sum(1 for r in found if r[2] == "c17" and r[8] >= 5 and r[12] >= 1.2)


def test_a_part_of_a_large_city_reads_a_fraction_of_it(spark, published):
    path, found = published
    big = sum(1 for r in found if r[2] == "big")
    corner = read_table(spark, path, "window_hotspots").filter("city = 'big' AND latitude < 0.1 AND longitude < 0.1")
    assert scanned(corner) < 0.6 * big
    assert corner.count() == sum(1 for r in found if r[2] == "big" and r[4] < 0.1 and r[5] < 0.1)


def test_cell_order_takes_bits_in_turn(spark):
    frame = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (90.0, -180.0), (-90.0, 180.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in frame.select(cell_order(F.col("a"), F.col("b"))).collect()]
    assert got[:5] == [0, 2**32 - 1, 0x55555555, 0xAAAAAAAA, 0x3FFFFFFF] and got[5] & 0x55555555 == 0  # a missing one is the lowest
