"""Verdicts of hosts that no rule fits, on tables of any size."""

import pytest
from pyspark.sql import functions as F

from placebeat.llm import url_filters
from placebeat.llm.support import stage
from tests.llm import brute

SCHEMA = "page_id long, url string, html string"
CHAIN = [
    (1, "http://spam.com/de/1", ""), (2, "http://links.net/a", '<a href="http://spam.com/x">x</a>'), (3, "http://far.net/a", '<a href="http://links.net/a">x</a>'),
    (4, "http://good.com/fr/1", '<a href="http://fine.net/">x</a>'), (5, "http://fine.net/a", '<a href="http://spam.com/x">x</a>'), (6, "http://apart.net/", ""),
]


@pytest.mark.parametrize("more", [0, 2_000_000])
def test_verdicts_dont_depend_on_the_number_of_blocked_pages(spark, more):
    """Pages of other blocked and trusted hosts leave a chain of hosts as it is."""
    url = F.when(F.col("id") % 2 == 0, "http://other.com/de/x").otherwise("http://kind.com/fr/x")
    others = spark.range(more).select((F.col("id") + 100).alias("page_id"), url.alias("url"), F.lit("").alias("html"))
    pages = spark.createDataFrame(CHAIN, SCHEMA).union(others)
    found = url_filters.url_filters(pages, rounds=8).filter("page_id < 100").collect()
    assert {r["page_id"]: r["verdict"] for r in found} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_rounds_go_on_until_scores_stand(spark):
    """A ring of hosts passes its seed's score on for as many rounds as the tolerance asks for."""
    ring = [f"h{k}.net" for k in range(30)]
    edges = [("trust", a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    frame = spark.createDataFrame(edges, "kind string, a string, b string")
    seeds = spark.createDataFrame([("trust", ring[0], 5.0)], "kind string, host string, seed double")
    scores = {r["host"]: r["score"] for r in url_filters.propagate(frame, seeds, 0.5, 1e-4, None, stage(spark)).collect()}
    wanted = brute.ranks({x[1:] for x in edges}, {ring[0]: 5}, damping=0.5)
    assert len(scores) > 10 and all(scores.get(k, 0) == pytest.approx(v, abs=1e-4 / 5) for k, v in wanted.items())
