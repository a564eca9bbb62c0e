"""Clustering of integer vectors around centroids, with a LAESA pivot table.

Every vector's distances to a fixed set of pivots are stored once, beside the vector. Pivots are the first centroids and
what Lloyd's rounds over a sample of bounded size make of them: points near which centroids will lie, as in many dimensions a
bound is only of use where the pivot is near the centroid. The result doesn't depend on the pivots. In a round, the distances of the
centroids to the same pivots bound a vector's distance to each centroid from below (triangle inequality:
``|d(v, p) - d(c, p)| <= d(v, c)``); the centroid with the least bound is tried first, and only centroids whose bound isn't
above the best distance so far get an exact distance, in whole numbers. Bounds are lowered by more than their rounding
error, and one equal to the best distance survives, so ties go to the smaller number as without bounds.

Each round is one pass over the written table: a task adds up its vectors by centroid and hands on one row a centroid, so
what is shuffled, collected and sent out again depends on the numbers of tasks, centroids and components only.

Kept are vectors with exactly ``dims`` components, none null, NaN or infinite; other rows give no result. Components beyond
2**27 in either direction after scaling count as that bound, so squared distances fit 64 bits. Repeated rows count as often
as they are found and each get their row; rows with a null id are clustered and start no centroid while other rows are left;
with fewer kept vectors than centroids there are so many centroids; an empty table gives no rows; columns other than those
named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebeat.llm.support import narrow, ship, stage, table

DIMS, CENTROIDS, ROUNDS = 64, 8, 10
SAMPLE = 4096  # vectors that pivots are chosen from
SCALE, LIMIT = 1024.0, float(1 << 27)
ROWS = 4096  # vectors at a time in a task
#: Bounds are lowered by these, relatively and absolutely; double rounding is far below both.
SLACK, STEP = 1e-9, 1e-6


def whole_vectors(frame: DataFrame, id_column: str, vector_column: str, dims: int, scale: float) -> DataFrame:
    """id and vector (whole numbers) of the rows that are kept."""
    named = narrow(frame, id=id_column, vector=vector_column)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("vector", lambda x: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), x.cast("double") * scale))).cast("int"))
    return named.filter((F.size("vector") == dims) & finite).select("id", scaled.alias("vector"))


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = vectors - point
    return np.einsum("ij,ij->i", gap, gap)


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many exact distances that took.

    to_pivots, own: distances of vectors and centroids to the pivots.
    """
    bound = np.zeros((len(vectors), len(centroids)))
    for k in range(own.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, k, None] - own[None, :, k]), out=bound)
    bound = np.square(np.maximum(bound * (1 - SLACK) - STEP, 0))
    cluster = bound.argmin(axis=1)
    best = np.empty(len(vectors), np.int64)
    for c in range(len(centroids)):
        at = np.flatnonzero(cluster == c)
        best[at] = squared(vectors[at], centroids[c])
    first, made = cluster.copy(), len(vectors)
    for c in range(len(centroids)):
        at = np.flatnonzero((first != c) & (bound[:, c] <= best))
        found = squared(vectors[at], centroids[c])
        made += len(at)
        better = (found < best[at]) | (found == best[at]) & (c < cluster[at])
        best[at[better]], cluster[at[better]] = found[better], c
    return cluster, best, made


def pieces(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray | None]]:
    """ids, vectors and distances to pivots of bounded slices."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            measured = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if part.num_columns > 2 else None
            yield part.column(0), vectors, measured


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of each vector to each point."""
    return np.sqrt(np.stack([squared(vectors, p) for p in points], axis=1).astype(np.float64))


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pivot table: id, vector and the vector's distances to the pivots."""
    dims = pivots.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, _ in pieces(batches, dims):
            ends = np.arange(len(found) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.ListArray.from_arrays(ends * dims, pa.array(found.astype(np.int32).reshape(-1))),
                    pa.ListArray.from_arrays(ends * len(pivots), pa.array(distances(found, pivots).reshape(-1))),
                ],
                ["id", "vector", "to_pivots"],
            )

    return vectors.mapInArrow(measure, "id long, vector array<int>, to_pivots array<double>")


def partial_sums(measured: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """cluster, members and component sums, a row for each task and centroid with members."""
    own, (count, dims) = distances(centroids, pivots), centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, sums = np.zeros(count, np.int64), np.zeros((count, dims), np.int64)
        for _, vectors, to_pivots in pieces(batches, dims):
            cluster, _, _ = nearest(vectors, to_pivots, centroids, own)
            members += np.bincount(cluster, minlength=count)
            for c in range(count):
                sums[c] += vectors[cluster == c].sum(axis=0)
        filled = np.flatnonzero(members)
        ends = np.arange(len(filled) + 1, dtype=np.int32) * dims
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(members[filled]), pa.ListArray.from_arrays(ends, pa.array(sums[filled].reshape(-1)))], ["cluster", "members", "sums"])

    return measured.mapInArrow(add, "cluster int, members long, sums array<bigint>")


def assigned(measured: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """id, cluster and squared distance of each vector."""
    own, dims = distances(centroids, pivots), centroids.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors, to_pivots in pieces(batches, dims):
            cluster, best, _ = nearest(vectors, to_pivots, centroids, own)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(best)], ["id", "cluster", "distance"])

    return measured.mapInArrow(place, "id long, cluster int, distance long")


def chosen_pivots(sample: np.ndarray, first: np.ndarray, rounds: int) -> np.ndarray:
    """The first centroids and those of Lloyd's rounds over the sample."""
    points = first
    for _ in range(rounds):
        cluster = distances(sample, points).argmin(axis=1)
        moved = np.array([sample[cluster == c].mean(axis=0) if (cluster == c).any() else points[c] for c in range(len(points))]).astype(np.int64)
        if np.array_equal(moved, points):
            break
        points = moved
    return np.concatenate((first, points))


def centroid_clustering(
    frame: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    dims: int = DIMS,
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    sample: int = SAMPLE,
    seed: int = 3,
    scale: float = SCALE,
) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every kept vector, and the final centroids.

    The first centroids are the vectors with the smallest SHA-256 of ``seed:id``; ``sample`` vectors in the same order are what
    pivots are chosen from. Centroids become the floors of their members' means; a centroid without members stays. Rounds end early
    once no centroid moves, which no further round would change.
    """
    spark = frame.sparkSession
    ship(spark)
    store = stage(spark)
    vectors = whole_vectors(frame, id_column, vector_column, dims, scale).withColumn("id", F.col("id").cast("long"))
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    drawn = vectors.orderBy(turn.asc_nulls_last(), "id", "vector").limit(max(count, sample)).collect()  # a fixed number of rows
    if not drawn:
        return vectors.select(F.col("id").alias(id_column), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    near = np.array([r["vector"] for r in drawn], np.int64)
    centroids = near[:count]
    pivots = chosen_pivots(near, centroids, rounds)
    measured = store.write("pivots", with_pivots(vectors, pivots))
    for _ in range(rounds):
        sums = partial_sums(measured, pivots, centroids).groupBy("cluster").agg(F.sum("members").alias("members"), F.array(*(F.sum(F.col("sums")[k]) for k in range(dims))).alias("sums"))
        moved = centroids.copy()
        for r in sums.collect():  # a row a centroid
            moved[r["cluster"]] = [s // r["members"] for s in r["sums"]]
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    placed = store.write("assigned", assigned(measured, pivots, centroids))
    return placed.withColumnRenamed("id", id_column), centroids.tolist()


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    placed, centroids = centroid_clustering(table(spark, sf_dir, "embeddings"))
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = placed.agg(F.sum("distance").alias("n")).first()["n"]
    marks = [(c, hashlib.sha256(",".join(map(str, at)).encode()).hexdigest()) for c, at in enumerate(centroids)]
    marked = sums.join(spark.createDataFrame(marks, "cluster int, centroid_sha256 string"), "cluster")
    return placed.join(marked, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


def clustering_sql(dims: int = DIMS, count: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the query's rows, all distances made."""
    gaps = " + ".join(f"(v.x[{k}] - c.x[{k}]) * (v.x[{k}] - c.x[{k}])" for k in range(1, dims + 1))
    nearest_of = lambda n: f"SELECT v.r, v.vec_id, v.x, arg_min(c.c, (g, c.c)) AS c, min(g) AS distance FROM (SELECT v.r, v.vec_id, v.x, c.c, {gaps} AS g FROM v, c{n} c) AS z, LATERAL (SELECT z.r, z.vec_id, z.x) AS v, LATERAL (SELECT z.c) AS c GROUP BY ALL"
    floors = ", ".join(f"CAST((sum(x[{k}]) - ((sum(x[{k}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for k in range(1, dims + 1))
    steps = "".join(
        f",\na{n} AS MATERIALIZED ({nearest_of(n)}),\nc{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (SELECT c, [{floors}] AS x FROM a{n} GROUP BY c) m USING (c))"
        for n in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {count}){steps},
f AS MATERIALIZED ({nearest_of(rounds)})
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON f.c = c{rounds}.c
"""
