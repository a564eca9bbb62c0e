"""Every registered query against SQL over the same tables; those without SQL against what must hold."""

import pytest

import __spark_entry__ as entry_points
from placebeat.checks.oracles import ORACLES
from placebeat.checks.queries import QUERIES
from placebeat.operators.kpis import latest_reviews, newest
from placebeat.sources import testtables
from tests.comparing import difference, oracle
from tests.helpers import rows

WITHOUT_SQL = {
    "neighborhood_assignments", "neighborhood_hotspots", "neighborhood_windows", "neighborhood_category_mix",
}


@pytest.fixture(scope="module")
def database(small):
    return oracle(small)


def test_only_iterative_queries_lack_sql():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, database, name):
    assert difference(QUERIES[name](spark, small), ORACLES[name], database) is None


def test_the_comparison_notices_differences(spark, small, database):
    wrong = {
        "values": "SELECT city, state, review_count + 1 AS review_count, avg_stars FROM ({})",
        "rows": "SELECT * FROM ({}) WHERE city <> 'NATION_7'",
        "columns": "SELECT city, state, review_count FROM ({})",
        "types": "SELECT city, state, review_count, CAST(avg_stars AS VARCHAR) AS avg_stars FROM ({})",
    }
    for sql in wrong.values():
        found = QUERIES["city_metrics"](spark, small)
        assert difference(found, sql.format(ORACLES["city_metrics"]), database) is not None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_feed_in_two_looks_equals_feed_in_one(spark, small):
    enriched = testtables.enriched_events(spark, small)
    assert rows(QUERIES["latest_reviews"](spark, small)) == rows(latest_reviews(enriched, 200))
    assert newest(enriched, 3).count() == 3
