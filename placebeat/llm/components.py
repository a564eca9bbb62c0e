"""Connected components of a table of links, in rounds of joins over written tables.

Each round points every node to its smallest neighbour, follows the pointers twice and contracts the links to the nodes
pointed to, so the links shrink by a factor each round. Nothing but a count of links is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebeat.plans.stage import Stage


def follow(pairs: DataFrame, key: str, pointers: DataFrame, name: str) -> DataFrame:
    """pairs with ``name``: where ``key`` points to, or itself."""
    moved = pointers.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    joined = pairs.join(moved, F.col(key) == F.col("_from"), "left")
    return joined.withColumn(name, F.coalesce("_to", key)).drop("_from", "_to")


def components(links: DataFrame, store: Stage, name: str) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    links: columns a and b, long, not null; loops and repeated links are allowed.
    """
    live = store.write(f"{name}-links-0", links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots, turn = None, 0
    while not live.isEmpty():
        turn += 1
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        near = store.write(f"{name}-near-{turn}", near)
        jumped = follow(follow(near, "root", near, "next"), "next", near, "last")
        jumped = store.write(f"{name}-jumped-{turn}", jumped.select("node", F.col("last").alias("root")))
        if roots is None:
            roots = jumped
        else:
            moved = follow(roots.withColumnRenamed("root", "old"), "old", jumped, "root").select("node", "root")
            roots = store.write(f"{name}-roots-{turn}", moved)
        ends = follow(follow(live, "a", jumped, "x"), "b", jumped, "y").filter("x <> y")
        live = store.write(f"{name}-links-{turn}", ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
