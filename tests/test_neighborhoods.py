import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebeat.operators import kpis
from placebeat.operators.category_mix import category_mix
from placebeat.operators.hotspots import window_hotspots
from placebeat.operators.neighborhoods import (
    _raced, dense_cities, distinct_businesses, fit_checks, fit_neighborhoods,
)
from placebeat.params import Params
from placebeat.plans.stage import Stage
from placebeat.plans.tables import build_tables
from placebeat.schemas import NEIGHBORHOOD_SCHEMA
from tests.helpers import enriched, event, rows


def spread(city, n, state="NV"):
    return [
        event(f"{city}-{state}-{i}", city, state=state, lat=36.0 + i * 0.01, lon=-115.0 + i * 0.01) for i in range(n)
    ]


def businesses(spark, points):
    return spark.createDataFrame(
        points, "business_id string, city string, state string, latitude double, longitude double"
    )


def grouped(assigned):
    centers, members = {}, defaultdict(list)
    for row in assigned:
        centers[row.city, row.neighborhood_id] = (row.center_lat, row.center_lon)
        members[row.city, row.neighborhood_id].append(row.business_id)
    return centers, members


def test_only_dense_cities(spark):
    events = enriched(spark, spread("Dense City", 6) + spread("Sparse City", 2))
    params = Params(dense_city_threshold=5)
    with Stage(spark) as stage:
        assigned = fit_neighborhoods(distinct_businesses(events), params, stage)
        found = rows(kpis.neighborhood_hotspots(events, assigned), "city", "review_count", "avg_stars")
        assert {city for city, *_ in found} == {"Dense City"}
        assert sum(n for _, n, _ in found) == 6 and len(found) == 2
        assert {s for *_, s in found} == {4.0}


def test_switched_off(spark):
    events = enriched(spark, spread("Dense City", 6))
    with Stage(spark) as stage:
        assert fit_neighborhoods(distinct_businesses(events), Params(), stage) is None
    assert build_tables(events, Params())["neighborhood_hotspots"].count() == 0


def test_same_name_in_two_states(spark):
    active = distinct_businesses(enriched(spark, spread("Twin", 3, "A") + spread("Twin", 3, "B")))
    assert rows(dense_cities(active, 5)) == [("Twin", 6, 2)]
    assert rows(dense_cities(active, 5, ("city", "state"))) == []
    assert rows(dense_cities(active, 3, ("city", "state")), "state", "business_count") == [("A", 3), ("B", 3)]
    assert rows(dense_cities(active, 0)) == []


def test_distinct_businesses_picks_one_version(spark):
    events = enriched(
        spark, [event("1", "B", business="x"), event("2", "A", business="x"), event("3", "A", business="y")]
    )
    assert rows(distinct_businesses(events), "business_id", "city") == [("x", "A"), ("y", "A")]


@pytest.fixture(scope="module")
def clustered(spark):
    points = []
    for c, (lat, lon) in enumerate([(10.0, 10.0), (10.0, 11.0), (11.0, 10.0)]):
        for i in range(4):
            points.append((f"blob{c}-{i}", "Blobs", "S", lat + i * 1e-3, lon - i * 1e-3))
    for i in range(40):
        points.append((f"mess-{i}", "Mess", "S", 20 + (i * 37 % 40) / 40, 20 + (i * 53 % 40) / 40))
    points += [(f"same-{i}", "Same", "S", 5.0, 5.0) for i in range(9)]
    points += [(f"two-{i}", "Two", "S", 6.0 + i % 2, 6.0) for i in range(16)]
    return points


@pytest.fixture(scope="module")
def fitted(spark, clustered):
    with Stage(spark) as stage:
        assigned = fit_neighborhoods(businesses(spark, clustered), Params(dense_city_threshold=5), stage)
        return assigned.withColumns({c: F.round(c, 6) for c in ("center_lat", "center_lon")}).collect()


def test_invariants(clustered, fitted):
    where = {b: (lat, lon) for b, _, _, lat, lon in clustered}
    centers, members = grouped(fitted)
    assert sum(map(len, members.values())) == len(clustered)
    sizes = Counter(city for city, _ in centers)
    assert sizes == {"Blobs": 3, "Mess": 6, "Same": 1, "Two": 2}
    for (city, label), ids in members.items():
        assert label.startswith(f"{city}-")
        lat, lon = centers[city, label]
        mean = [sum(where[b][axis] for b in ids) / len(ids) for axis in (0, 1)]
        assert math.dist((lat, lon), mean) < 2e-4
        for b in ids:
            own = math.dist(where[b], (lat, lon))
            assert all(own <= math.dist(where[b], at) + 2e-6 for (c, _), at in centers.items() if c == city)
    blobs = sorted(sorted(ids) for (city, _), ids in members.items() if city == "Blobs")
    assert blobs == [[f"blob{c}-{i}" for i in range(4)] for c in range(3)]


def test_result_depends_neither_on_distribution_nor_on_other_cities(spark, clustered, fitted):
    alone = [p for p in clustered[::-1] if p[1] == "Mess"]
    with Stage(spark) as stage:
        again = fit_neighborhoods(businesses(spark, alone).repartition(7), Params(dense_city_threshold=5), stage)
        assert rows(again) == sorted((r for r in map(tuple, fitted) if r[1] == "Mess"), key=repr)


def test_many_cities_are_joined_without_broadcast(spark, clustered, fitted):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with Stage(spark) as stage:
            again = fit_neighborhoods(businesses(spark, clustered), Params(dense_city_threshold=5), stage)
            text = again._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin [city" in text and "salt" in text and "Broadcast" not in text
            assert rows(again) == sorted(map(tuple, fitted), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("parts", [1, 5])
def test_small_groups_far_from_a_large_one_are_found(spark, parts):
    points = [(f"big-{i}", "City", "S", 10 + (i * 37 % 5000) * 1e-6, 10 + (i * 53 % 5000) * 1e-6) for i in range(5000)]
    points += [(f"far{g}-{i}", "City", "S", 20.0 + g + i * 1e-5, 30.0 - g) for g in range(11) for i in range(20)]
    with Stage(spark) as stage:
        found = fit_neighborhoods(businesses(spark, points).repartition(parts), Params(dense_city_threshold=5), stage).collect()
    _, members = grouped(found)
    groups = {frozenset(x.split("-")[0] for x in ids) for ids in members.values()}
    assert groups == {frozenset(["big"]), *(frozenset([f"far{g}"]) for g in range(11))}


def test_equal_city_names_of_two_states_stay_apart(spark):
    events = [event(f"{s}{i}", "Springfield", state=s, lat=36.0, lon=-115.0 - (s == "B"), categories=(c,)) for s, c in (("A", "Pizza"), ("B", "Taco")) for i in range(4)]
    params = Params(dense_city_threshold=3, cluster_by=("city", "state"))
    with Stage(spark) as stage:
        joined = enriched(spark, events)
        assigned = stage.write("assigned", fit_neighborhoods(distinct_businesses(joined), params, stage))
        mix = category_mix(joined, params, assigned).filter("area_type = 'neighborhood'").collect()
        assert len({r.area_id for r in mix}) == 2 and {r.current_share for r in mix} == {1.0}
        checks = fit_checks(distinct_businesses(joined), assigned, params).collect()
        assert [(r.business_count, r.assigned, r.with_a_nearer_center, r.centers_off_their_mean, r.clusters_beyond_the_bound) for r in checks] == [(4, 4, 0, 0, 0)] * 2


def test_checks_notice_wrong_neighborhoods(spark):
    points = [(f"p{i}", "City", "S", 1.0 + i // 5, 1.0) for i in range(10)]
    wrong = [(f"p{i}", "City", "S", f"City-{i % 2}", 1.0 + i % 2, 1.0) for i in range(10)]
    found = fit_checks(businesses(spark, points), spark.createDataFrame(wrong, NEIGHBORHOOD_SCHEMA), Params(dense_city_threshold=5)).first()
    assert found.with_a_nearer_center == 4 and found.centers_off_their_mean == 2


def test_windows_and_mix_of_both_area_kinds(spark):
    events = enriched(spark, spread("Dense City", 6) + spread("Sparse City", 2))
    params = Params(dense_city_threshold=5, min_events_for_hotspot=1)
    with Stage(spark) as stage:
        assigned = fit_neighborhoods(distinct_businesses(events), params, stage)
        windows = window_hotspots(events, params, assigned)
        counts = {
            r.area_type: (r.n, r.cities)
            for r in windows.groupBy("area_type").agg(
                F.sum("event_count").alias("n"), F.sort_array(F.collect_set("city")).alias("cities")
            ).collect()
        }
        assert counts == {"grid": (24, ["Dense City", "Sparse City"]), "neighborhood": (18, ["Dense City"])}
        mix = category_mix(events, params, assigned)
        totals = {r[0]: r[1] for r in mix.groupBy("area_type").agg(F.sum("current_count")).collect()}
        assert totals == {"grid": 8, "neighborhood": 6}
        per_area = mix.groupBy("area_type", "area_id").agg(F.sum("current_share").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in per_area)


def blobs_and_strays():
    """Eight blobs of 2,500 points and eight strays far from them and from each other."""
    rng = random.Random(8)
    middles = [(10 + 0.2 * (k % 4), 10 + 0.2 * (k // 4)) for k in range(8)]
    points = [(f"b{k}-{i}", "City", "S", rng.gauss(lat, 0.01), rng.gauss(lon, 0.01)) for k, (lat, lon) in enumerate(middles) for i in range(2500)]
    return points + [(f"s{k}", "City", "S", 10 + 1.3 * math.cos(k), 10 + 1.3 * math.sin(k)) for k in range(8)]


def sum_of_squares(points, centers):
    lat, lon = (np.array([p[axis] for p in points]) for axis in (3, 4))
    return np.min([(lat - a) ** 2 + (lon - b) ** 2 for a, b in centers], axis=0).sum()


def lloyd_from_sampled_starts(points, k, rounds, seed):
    """k-means++ starts and Lloyd's rounds in numpy, with nothing of the library."""
    rng = np.random.default_rng(seed)
    at = np.array([p[3:] for p in points])
    centers = [at[rng.integers(len(at))]]
    while len(centers) < k:
        gap = np.min([((at - c) ** 2).sum(1) for c in centers], axis=0)
        centers.append(at[rng.choice(len(at), p=gap / gap.sum())])
    centers = np.array(centers)
    for _ in range(rounds):
        own = np.argmin([((at - c) ** 2).sum(1) for c in centers], axis=0)
        centers = np.array([at[own == c].mean(0) if (own == c).any() else centers[c] for c in range(k)])
    return [tuple(c) for c in centers]


@pytest.mark.parametrize("parts", [1, 7])
def test_strays_take_no_blob_its_center(spark, parts):
    points = blobs_and_strays()
    best = min(sum_of_squares(points, lloyd_from_sampled_starts(points, 12, 20, seed)) for seed in range(10))
    with Stage(spark) as stage:
        found = fit_neighborhoods(businesses(spark, points).repartition(parts), Params(dense_city_threshold=5), stage).collect()
    centers, members = grouped(found)
    assert sum_of_squares(points, centers.values()) <= 1.5 * best
    serving_blobs = {label for label, ids in members.items() if any(x[0] == "b" for x in ids)}
    assert len(serving_blobs) >= 8 and len({(r.neighborhood_id, r.center_lat) for r in found}) == len(centers) <= 12


def test_draws_follow_the_weight(spark):
    """Over many seeds, a point is drawn first in proportion to its number."""
    points = spark.range(2000).selectExpr("id", "stack(2, 1.0D, 1.0D, 30, 2.0D, 2.0D, 10) AS (lat, lon, n)")
    raced = points.withColumn("weight", F.col("n").cast("double")).withColumn("turn", _raced("7", "id", "lat", "lon"))
    first = raced.groupBy("id").agg(F.min_by("n", "turn").alias("n")).filter("n = 30").count()
    assert 1400 < first < 1600


def test_other_seeds_reach_as_good_a_result(spark):
    points = blobs_and_strays()[::5]
    best = min(sum_of_squares(points, lloyd_from_sampled_starts(points, 12, 20, seed)) for seed in range(10))
    for seed in (1, 2, 3):
        with Stage(spark) as stage:
            found = fit_neighborhoods(businesses(spark, points), Params(dense_city_threshold=5, cluster_seed=seed), stage).collect()
        assert sum_of_squares(points, grouped(found)[0].values()) <= 1.5 * best
