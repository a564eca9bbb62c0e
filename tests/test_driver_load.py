"""What grows with the places is never gathered on the driver, however small its files are."""

import json
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter

from placebeat.operators.cleaning import clean_reviews
from placebeat.params import Params
from placebeat.plans.partials import batch_partials
from placebeat.schemas import NEIGHBORHOOD_SCHEMA, PLACE_SCHEMA
from placebeat.sources import testtables as tables
from placebeat.sources.files import read_reviews, read_table
from placebeat.streaming.jobs import batch_processor
from tests.helpers import rows


@pytest.fixture()
def few(spark, tmp_path):
    """Reviews and places so small that Spark would broadcast them."""
    items = [{"review_id": f"r{i}", "business_id": f"b{i % 3}", "user_id": "u", "stars": float(i % 5), "date": f"2020-01-0{1 + i % 4} 10:00:00", "text": "t"} for i in range(12)]
    (tmp_path / "reviews.json").write_text("".join(json.dumps(item) + "\n" for item in items))
    places = [(f"b{i}", f"b{i}", "c", "s", 36.0, -115.0 + i, 1.0, ["x", "y"]) for i in range(3)]
    spark.createDataFrame(places, PLACE_SCHEMA).write.parquet(f"{tmp_path}/places")
    located = spark.read.schema(PLACE_SCHEMA).parquet(f"{tmp_path}/places")
    params = Params(window_duration="1 day", slide_duration="12 hours", min_events_for_hotspot=1, output_path=f"{tmp_path}/out")
    return read_reviews(spark, f"{tmp_path}/reviews.json"), located, params


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_partials_merge_places_and_neighborhoods(spark, few, tmp_path):
    raw, located, params = few
    spark.createDataFrame([], NEIGHBORHOOD_SCHEMA).write.parquet(f"{tmp_path}/neighborhoods")
    neighborhoods = spark.read.schema(NEIGHBORHOOD_SCHEMA).parquet(f"{tmp_path}/neighborhoods")
    for name, frame in batch_partials(clean_reviews(raw), located, params, neighborhoods).items():
        text = physical(frame)
        assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text, name


@pytest.mark.parametrize("mode", ["merged", "append"])
def test_batches_broadcast_no_places(spark, few, monkeypatch, mode):
    raw, located, params = few
    plans, real = {}, DataFrameWriter.parquet

    def write(self, target, *args, **options):
        plans[target] = physical(self._df)
        return real(self, target, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    batch_processor(lambda: located, params, mode=mode)(raw, 0)
    assert not [target for target, text in plans.items() if "BroadcastHashJoin" in text]
    assert not list(Path(params.output_path).glob("stage-*"))
    if mode == "append":  # the tables are finished from the partials, not from single events
        assert not [target for target, text in plans.items() if "/window_hotspots/" in target and "review_stars" in text]
        assert rows(read_table(spark, params.output_path, "city_metrics")) == [("c", "s", 12, 1.75)]


def test_parts_are_merged_with_customers(spark, tmp_path):
    made = {
        "customer": "BIGINT(1) c_custkey, 'n' c_name, 2 c_nationkey, 0D c_acctbal, 'm' c_mktsegment",
        "part": "BIGINT(1) p_partkey, 'red tin' p_name, 'b' p_brand, 'STEEL' p_type, 1 p_size, 1D p_retailprice",
        "nation": "2 n_nationkey, 'N' n_name, 3 n_regionkey",
        "region": "3 r_regionkey, 'R' r_name",
    }
    for name, columns in made.items():
        spark.sql(f"SELECT {columns}").write.parquet(f"{tmp_path}/{name}.parquet")
    found = tables.raw_customer_businesses(spark, str(tmp_path))
    assert "SortMergeJoin [c_custkey" in physical(found)
    assert rows(found, "business_id", "city", "state", "categories") == [("1", "N", "R", "red, tin, STEEL")]
