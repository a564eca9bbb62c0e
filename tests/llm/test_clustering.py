"""Centroid clustering against plain Python integers and SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from placebeat.llm import centroid_clustering as cc
from tests.comparing import difference, oracle


def brute(rows, dims=64, count=8, rounds=10):
    """Sorted (id, cluster, distance) and the centroids, in Python integers."""
    limit = 1 << 27
    kept = [
        (i, [math.floor(max(-limit, min(limit, 1024 * x))) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    turn = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1])
    centroids = [v for _, v in sorted(kept, key=turn)[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda v: min((far(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), k in zip(kept, own) if k == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    return sorted(((i, *place(v)[::-1]) for i, v in kept), key=repr), centroids


def check(spark, rows, **settings):
    found, centroids = cc.centroid_clustering(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), **settings)
    wanted, points = brute(rows, **{k: v for k, v in settings.items() if k != "sample"})
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == wanted and centroids == points


def test_blobs_ties_and_copies(spark):
    rng = random.Random(1)
    blob = lambda: [rng.choice((-1, 0, 1)) + rng.gauss(0, 0.05) for _ in range(64)]
    rows = [(k, blob()) for k in range(150)]
    rows += [(1000 + k, [float(k % 3), *[0.0] * 63]) for k in range(60)]  # many ties
    rows += [(7, rows[7][1])] * 5 + [(None, blob()), (None, blob())]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] + [0.0] * 63), (2005, []), (2006, [1e30] + [-1e30] + [0.0] * 62)]
    rng.shuffle(rows)
    check(spark, rows)


def test_pivots_do_not_change_the_result(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)]) for k in range(120)]
    check(spark, rows, sample=8)
    check(spark, rows, sample=100)


@pytest.mark.parametrize("n", [1, 5, 8])
def test_few_vectors(spark, n):
    check(spark, [(k, [float(k)] * 64) for k in range(n)])


def test_empty_cluster_stays(spark):
    """Equal first centroids: all go to the smaller number, the others keep their place."""
    check(spark, [(k, [0.5] * 64) for k in range(20)])


def test_nothing_kept(spark):
    found, centroids = cc.centroid_clustering(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"))
    assert found.count() == 0 and centroids == [] and found.columns == ["vec_id", "cluster", "distance"]


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 100, (8, 64))
    vectors = np.floor(centers[rng.integers(0, 8, 5000)] + rng.normal(0, 30, (5000, 64))).astype(np.int64)
    pivots = cc.chosen_pivots(vectors[:500], vectors[:8], 10)
    points = np.floor(centers).astype(np.int64)
    cluster, best, made = cc.nearest(vectors, cc.distances(vectors, pivots), points, cc.distances(points, pivots))
    every = ((vectors[:, None] - points[None]) ** 2).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert made < 2 * len(vectors)


def test_equals_sql(spark, small):
    assert difference(cc.op13_centroid_clustering(spark, small), cc.clustering_sql(), oracle(small)) is None


def test_query_on_nothing(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert cc.op13_centroid_clustering(spark, str(tmp_path)).count() == 0
