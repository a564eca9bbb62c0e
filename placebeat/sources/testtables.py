"""Star-schema test tables seen as reviews and businesses.

``events`` with ``customer`` gives a minute-level stream over a month, ``lineitem`` with ``supplier`` volume over
years. Everything is derived from the tables by expressions; nothing is generated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebeat.operators.cleaning import clean_reviews, places
from placebeat.operators.enrich import enrich


# Columns of the tables in use. A declared schema saves reading file footers before planning.
_COLUMNS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_COLUMNS[name]).parquet(f"{folder}/{name}.parquet")


def _coordinates(nation: str, key: str) -> list[str]:
    return [
        f"30.0D + {nation} * 0.5D + ({key} % 7) * 0.004D AS latitude",
        f"-115.0D + {nation} * 0.5D + ({key} % 5) * 0.004D AS longitude",
    ]


def _with_city(spark: SparkSession, folder: str, holders: DataFrame, nation_key: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return holders.join(nation, F.expr(f"{nation_key} = n_nationkey")).join(region, F.expr("n_regionkey = r_regionkey"))


def raw_event_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return as_reviews(table(spark, folder, "events"))


def as_reviews(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "string(event_id) AS review_id",
        "string(user_id) AS business_id",
        "event_type AS user_id",
        "double(1 + (event_id * 7 + user_id * 3) % 5) AS stars",
        "ts AS date",
        "concat_ws(' ', event_type, props) AS text",
    )


def raw_customer_businesses(spark: SparkSession, folder: str) -> DataFrame:
    customers = _with_city(spark, folder, table(spark, folder, "customer"), "c_nationkey")
    # As many parts as customers: Spark would broadcast two compressed columns of them, many times their size on the driver.
    return customers.join(table(spark, folder, "part").hint("merge"), F.expr("c_custkey = p_partkey"), "left").selectExpr(
        "string(c_custkey) AS business_id",
        "c_name AS name",
        "n_name AS city",
        "r_name AS state",
        *_coordinates("c_nationkey", "c_custkey"),
        "concat(replace(p_name, ' ', ', '), ', ', p_type) AS categories",
        "double(1 + c_custkey % 5) AS stars",
    )


def raw_lineitem_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS review_id",
        "string(l_suppkey) AS business_id",
        "l_returnflag AS user_id",
        "double(1 + (l_orderkey * 7 + l_suppkey * 3 + l_linenumber) % 5) AS stars",
        "l_shipdate AS date",
        "l_linestatus AS text",
    )


def raw_supplier_businesses(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = _with_city(spark, folder, table(spark, folder, "supplier"), "s_nationkey")
    return suppliers.selectExpr(
        "string(s_suppkey) AS business_id",
        "s_name AS name",
        "n_name AS city",
        "r_name AS state",
        *_coordinates("s_nationkey", "s_suppkey"),
        "string(NULL) AS categories",
        "double(NULL) AS stars",
    )


def event_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return clean_reviews(raw_event_reviews(spark, folder))


def customer_places(spark: SparkSession, folder: str) -> DataFrame:
    return places(raw_customer_businesses(spark, folder))


def lineitem_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return clean_reviews(raw_lineitem_reviews(spark, folder))


def supplier_places(spark: SparkSession, folder: str) -> DataFrame:
    return places(raw_supplier_businesses(spark, folder))


def enriched_events(spark: SparkSession, folder: str) -> DataFrame:
    return enrich(event_reviews(spark, folder), customer_places(spark, folder))
