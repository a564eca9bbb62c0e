"""Neighborhoods of dense cities: k-means over business coordinates, all cities at once.

Each round of Lloyd's algorithm is a join of points with the centers of their city and an aggregation, whatever the
number of cities; the driver learns only how many cities are still moving. Starting centers are drawn over all points in a few
such rounds (distance-squared sampling) and chosen by weight among the drawn. A city is never gathered in one task: counts,
sums and drawn points are all reduced before they are shuffled, and the lists kept per city are bounded by the number of
clusters. Coordinates are added up as whole numbers of
1e-7 degrees, so the result does not depend on how the rows are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebeat.functions import cluster_count
from placebeat.functions.geo import MAX_CLUSTERS
from placebeat.params import Params
from placebeat.plans.stage import Stage
from placebeat.schemas import NEIGHBORHOOD_SCHEMA

UNITS_PER_DEGREE = 10_000_000  # about one centimetre
SALTS = 16  # tasks that a city's points are spread over where the centers are too many to broadcast
# The default stopping rule (degrees, rounds).
TOLERANCE, MAX_ROUNDS = 1e-4, 20
DRAWS, DRAW_ROUNDS = 2 * MAX_CLUSTERS, 3  # candidates for starting centers per round, and rounds

_CENTERS = "array<struct<cluster_id:int,lat:double,lon:double>>"


def distinct_businesses(events: DataFrame) -> DataFrame:
    """One row per business that has events; of several versions, the smallest by (city, state, coordinates).

    Versions are reduced to distinct rows first, so the pick runs over businesses and not over events.
    """
    columns = ["city", "state", "latitude", "longitude"]
    versions = events.select("business_id", *columns).dropna(subset=("latitude", "longitude")).distinct()
    picked = versions.groupBy("business_id").agg(F.min(F.struct(*columns)).alias("version"))
    return picked.select("business_id", "version.*")


def dense_cities(businesses: DataFrame, threshold: int, cluster_by: Sequence[str] = ("city",)) -> DataFrame:
    """Cities with at least ``threshold`` businesses and their cluster count; a threshold of 0 or less finds none."""
    counted = businesses.groupBy(*cluster_by).agg(F.count("*").alias("business_count"))
    enabled = F.lit(threshold > 0)
    return counted.filter(enabled & (F.col("business_count") >= threshold)).withColumn(
        "cluster_count", cluster_count(F.col("business_count"))
    )


def _squared(a: str, b: str) -> str:
    """SQL text of the squared distance in degrees of two points with fields lat and lon."""
    return f"(({a}.lat - {b}.lat) * ({a}.lat - {b}.lat) + ({a}.lon - {b}.lon) * ({a}.lon - {b}.lon))"


def _points(businesses: DataFrame, cities: DataFrame, city: list[str]) -> DataFrame:
    """Businesses of dense cities reduced to distinct coordinates with their number.

    Reduced before they are matched with the cities: the match ends the plan, so adaptive execution may cut a city
    holding a large share of the points.
    """
    located = businesses.groupBy(*city, F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).agg(
        F.count("*").alias("n")
    )
    return located.join(cities.select(*city), city, "left_semi")


def _with_centers(rows: DataFrame, centers: DataFrame, city: list[str], spread_by: list[str]) -> DataFrame:
    """Rows joined to the centers of their city.

    Without a hint: Spark broadcasts the centers while their table is small and else shuffles both sides, every city
    spread over several tasks so that a large one fills none.
    """
    spread = centers.select(*city, "centers").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    return salted.join(spread, [*city, "salt"]).drop("salt")


def _raced(name: str, *columns: str) -> Column:
    """A key that is smallest for a row with a probability in proportion to its weight: an exponential waiting time.

    The random number is a hash of seed, name and columns, so it doesn't depend on where the row is.
    """
    uniform = f"(shiftrightunsigned(xxhash64({', '.join((name, *columns))}), 11) + 0.5D) / {2**53}D"
    return F.expr(f"-ln({uniform}) / weight")


def _candidates(points: DataFrame, cities: DataFrame, stage: Stage, city: list[str], seed: int) -> DataFrame:
    """Candidates for starting centers, one row per city with an array of them.

    The first is a point drawn by its weight. In each round, every one of a city's DRAWS parts (by hash) draws one more point with
    a probability in proportion to its number times its squared distance to the nearest candidate so far: one aggregation for all
    cities, reduced before it is shuffled. Points that many times are drawn where many points are far from all candidates.
    """
    named = "CAST(NULL AS int) AS cluster_id, at.lat AS lat, at.lon AS lon"
    first = points.withColumn("weight", F.col("n").cast("double")).groupBy(*city).agg(
        F.min(F.struct(_raced(f"{seed}, 'first'", "lat", "lon").alias("turn"), "lat", "lon")).alias("at")
    )
    drawn = first.join(cities.select(*city), city, "left_semi").select(*city, F.expr(f"array(struct({named}))").cast(_CENTERS).alias("centers"))
    drawn = stage.write("drawn-0", drawn)
    for turn in range(1, DRAW_ROUNDS + 1):
        gaps = _with_centers(points, drawn, city, ["lat", "lon"]).withColumn("weight", F.col("n") * _nearest("lat", "lon")["gap"])
        part = F.expr(f"pmod(xxhash64({seed}, {turn}, lat, lon), {DRAWS})").alias("part")
        race = F.min(F.struct(_raced(f"{seed}, {turn}, 'turn'", "lat", "lon").alias("turn"), "lat", "lon"))
        more = gaps.filter("weight > 0").groupBy(*city, part).agg(race.alias("at"))
        more = more.groupBy(*city).agg(F.array_sort(F.collect_list(F.expr(f"struct({named})"))).cast(_CENTERS).alias("more"))  # DRAWS at most
        grown = drawn.join(more, city, "left").select(*city, F.concat("centers", F.coalesce("more", F.array().cast(_CENTERS))).alias("grown"))
        drawn = stage.write(f"drawn-{turn}", grown.withColumnRenamed("grown", "centers"))
    numbered = "transform(centers, (c, i) -> struct(i AS cluster_id, c.lat AS lat, c.lon AS lon))"
    return drawn.select(*city, F.expr(numbered).cast(_CENTERS).alias("numbered")).withColumnRenamed("numbered", "centers")


def _first_centers(points: DataFrame, cities: DataFrame, stage: Stage, city: list[str], seed: int) -> DataFrame:
    """Starting centers: distance-squared sampling in rounds, then a weighted choice among the candidates.

    A candidate weighs as many points as are nearest to it. Centers are taken from the candidates one after another, each time
    the one that leaves the smallest weighted sum of squared distances: a stray point is a likely candidate, but has
    a weight of one. All of it is one row of bounded size per city.
    """
    drawn = _candidates(points, cities, stage, city, seed)
    near = _with_centers(points, drawn, city, ["lat", "lon"]).select(*city, "n", _nearest("lat", "lon")["center"].alias("c"))
    weighed = near.groupBy(*city, "c").agg(F.sum("n").alias("w"))
    rows = weighed.groupBy(*city).agg(F.array_sort(F.collect_list(F.expr("struct(c.lat AS lat, c.lon AS lon, w, 1e9D AS gap)"))).alias("rest"))  # gap: above any distance
    chosen = F.expr(
        f"""aggregate(sequence(0, cluster_count - 1), struct(rest, CAST(array() AS {_CENTERS}) AS centers, double('infinity') AS cost),
          (s, i) -> transform(
            array(array_min(transform(s.rest, c -> struct(aggregate(s.rest, 0D, (t, x) -> t + x.w * least(x.gap, {_squared('x', 'c')})) AS cost, c.lat AS lat, c.lon AS lon)))),
            p -> CASE WHEN p.cost < s.cost THEN struct(
              transform(s.rest, x -> struct(x.lat AS lat, x.lon AS lon, x.w AS w, least(x.gap, {_squared('x', 'p')}) AS gap)) AS rest,
              concat(s.centers, array(struct(i AS cluster_id, p.lat AS lat, p.lon AS lon))) AS centers, p.cost AS cost) ELSE s END)[0],
          s -> s.centers)"""
    )
    return rows.join(cities.select(*city, "cluster_count"), city).select(*city, chosen.cast(_CENTERS).alias("centers"))


def _nearest(lat: str, lon: str) -> Column:
    """Squared distance, number and position of the nearest of ``centers``; the lower number wins a tie."""
    return F.expr(
        f"array_min(transform(centers, c -> struct({_squared(f'struct({lat} AS lat, {lon} AS lon)', 'c')} AS gap, "
        "c.cluster_id AS cluster_id, c AS center)))"
    )


def _round(points: DataFrame, centers: DataFrame, city: list[str]) -> DataFrame:
    """Move every city's centers to the means of their points; clusters that lost all points go.

    The number of clusters is bounded, so one aggregation with a sum per cluster gives a city's whole result in one
    row: a single small shuffle per round.
    """
    assigned = _with_centers(points, centers, city, ["lat", "lon"]).select(
        *city,
        "n",
        _nearest("lat", "lon")["cluster_id"].alias("cluster_id"),
        *((F.col("n") * F.round(F.col(axis) * UNITS_PER_DEGREE).cast("bigint")).alias(axis) for axis in ("lat", "lon")),
    )

    clusters = range(MAX_CLUSTERS)
    sums = assigned.groupBy(*city).agg(
        *(
            F.expr(f"sum(CASE WHEN cluster_id = {c} THEN {column} END) AS {column}{c}")
            for c in clusters
            for column in ("n", "lat", "lon")
        )
    )
    means = ", ".join(
        f"CASE WHEN n{c} IS NOT NULL THEN struct({c} AS cluster_id, lat{c} / n{c} / {UNITS_PER_DEGREE} AS lat, "
        f"lon{c} / n{c} / {UNITS_PER_DEGREE} AS lon) END"
        for c in clusters
    )
    found = sums.select(*city, F.expr(f"array_compact(array({means}))").cast(_CENTERS).alias("means"))

    # A column named inside a lambda would resolve to an equally named alias of the same select, so the new centers
    # are renamed last.
    moved = (
        "array_max(transform(means, new -> sqrt(array_max(transform("
        f"filter(centers, old -> old.cluster_id = new.cluster_id), old -> {_squared('new', 'old')})))))"
    )
    return (
        found.join(centers.select(*city, "centers"), city)
        .select(*city, "means", F.expr(moved).alias("moved"))
        .withColumnRenamed("means", "centers")
    )


def city_centers(
    businesses: DataFrame,
    cities: DataFrame,
    stage: Stage,
    city: list[str],
    seed: int,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Converged centers, one row per city.

    A city stops when none of its centers moves by more than ``tolerance`` degrees, or after ``max_rounds``. Every round is
    staged, so its plan stays small; cities that have stopped, and with them their points, take no part in the next.
    """
    points = stage.write("points", _points(businesses, cities, city))
    centers = stage.write("centers-0", _first_centers(points, cities, stage, city, seed))
    stopped = []
    for done in range(1, max_rounds + 1):
        moved = stage.write(f"centers-{done}", _round(points, centers, city))
        going = F.col("moved") > tolerance
        stopped.append(moved.filter(~going).select(*city, "centers"))
        centers = moved.filter(going).select(*city, "centers")
        if centers.isEmpty():
            break
    return reduce(DataFrame.unionByName, stopped, centers)


def _labelled(assigned: DataFrame, city: list[str]) -> DataFrame:
    """Neighborhoods are named by all columns that tell cities apart, so equal names in two states stay apart."""
    return assigned.select(
        "business_id",
        "city",
        "state",
        F.concat_ws("-", *city, F.col("cluster_id").cast("string")).alias("neighborhood_id"),
        "center_lat",
        "center_lon",
    ).select(*NEIGHBORHOOD_SCHEMA.fieldNames())


def fit_neighborhoods(businesses: DataFrame, params: Params, stage: Stage) -> DataFrame | None:
    """Assign every business of a dense city to a neighborhood; None when neighborhoods are switched off.

    ``businesses`` has business_id, city, state, latitude, longitude, one row per business. The result
    (business_id, city, state, neighborhood_id, center_lat, center_lon) reads tables of the stage; callers that use it
    more than once or longer write it down as a dimension.
    """
    if params.dense_city_threshold <= 0:
        return None
    city = list(params.cluster_by)
    base = stage.write("businesses", businesses.select("business_id", "city", "state", "latitude", "longitude"))
    cities = dense_cities(base, params.dense_city_threshold, city)
    centers = city_centers(base, cities, stage, city, params.cluster_seed)
    joined = _with_centers(base, centers, city, ["business_id"])
    assigned = joined.withColumn("nearest", _nearest("latitude", "longitude"))
    return _labelled(
        assigned.select(
            "business_id",
            "city",
            "state",
            F.col("nearest.cluster_id").alias("cluster_id"),
            F.col("nearest.center.lat").alias("center_lat"),
            F.col("nearest.center.lon").alias("center_lon"),
        ),
        city,
    )


def with_new_places(assigned: DataFrame, businesses: DataFrame, params: Params) -> DataFrame:
    """The assignments and, for businesses that have none, the nearest neighborhood of their city, if it has any."""
    city = list(params.cluster_by)
    center = F.struct(F.col("neighborhood_id").alias("cluster_id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    centers = assigned.groupBy(*city).agg(F.collect_set(center).alias("centers"))  # at most twelve
    new = businesses.join(assigned.select("business_id"), "business_id", "left_anti")
    placed = _with_centers(new, centers, city, ["business_id"]).withColumn("nearest", _nearest("latitude", "longitude"))
    columns = {"neighborhood_id": "nearest.cluster_id", "center_lat": "nearest.center.lat", "center_lon": "nearest.center.lon"}
    found = placed.select("business_id", "city", "state", *(F.col(at).alias(name) for name, at in columns.items()))
    return assigned.unionByName(found.select(*NEIGHBORHOOD_SCHEMA.fieldNames()))


def fit_checks(businesses: DataFrame, assigned: DataFrame, params: Params) -> DataFrame:
    """What must hold of the neighborhoods of every dense city, as numbers.

    businesses of the city and those assigned; members that have a nearer center in their city; clusters whose center is
    not the mean of its members, by more than the stopping rule allows; clusters beyond the city's bound.
    """
    city = list(params.cluster_by)
    dense = dense_cities(businesses, params.dense_city_threshold, city)
    located = assigned.join(businesses.select("business_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "business_id")
    center = F.struct(F.col("neighborhood_id").alias("id"), F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))
    centers = located.groupBy(*city).agg(F.collect_set(center).alias("centers"))  # at most twelve
    own, point = "struct(center_lat AS lat, center_lon AS lon)", "struct(lat AS lat, lon AS lon)"
    nearer = F.expr(f"exists(centers, c -> {_squared(point, 'c')} < {_squared(point, own)} - 1e-12)")
    members = located.join(centers, city).groupBy(*city, "neighborhood_id", "center_lat", "center_lon").agg(
        F.count("*").alias("n"), F.count_if(nearer).alias("nearer"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon")
    )
    off = F.greatest(F.abs(F.col("mean_lat") - F.col("center_lat")), F.abs(F.col("mean_lon") - F.col("center_lon"))) > TOLERANCE
    found = members.groupBy(*city).agg(
        F.sum("n").alias("assigned"), F.sum("nearer").alias("with_a_nearer_center"), F.count_if(off).alias("centers_off_their_mean"), F.count("*").alias("clusters")
    )
    joined = dense.join(found, city, "left")
    beyond = F.greatest(F.lit(0), F.coalesce("clusters", F.lit(0)) - F.col("cluster_count")).cast("bigint")
    counts = [F.coalesce(x, F.lit(0)).alias(x) for x in ("assigned", "with_a_nearer_center", "centers_off_their_mean")]
    return joined.select(*city, "business_count", *counts, beyond.alias("clusters_beyond_the_bound"))


def fit_quality(businesses: DataFrame, assigned: DataFrame, params: Params) -> DataFrame:
    """Per dense city: businesses, clusters allowed, ``total_squares`` (squared distances of the businesses to the city's mean) and
    ``left_squares`` (to their neighborhoods' centers)."""
    city = list(params.cluster_by)
    dense = dense_cities(businesses, params.dense_city_threshold, city)
    at = businesses.select("business_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    gap = F.expr(_squared("struct(lat AS lat, lon AS lon)", "struct(center_lat AS lat, center_lon AS lon)"))
    squares = (F.var_pop("lat") + F.var_pop("lon")) * F.count("*")
    found = assigned.join(at, "business_id").groupBy(*city).agg(squares.alias("total_squares"), F.sum(gap).alias("left_squares"))
    return dense.join(found, city)
