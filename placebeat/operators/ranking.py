"""The first rows of a table in a given order, exactly, without one task that sees them all.

Ranks come from Spark's own range partitioning: keys are cut at sampled splitters into ranges of about equal size, each range
is sorted, and a range's rows count from the number of rows in the ranges before it. Only keys are moved, and only a
number reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebeat.plans.stage import Stage

_PLACE_BITS = 33  # of a row's place within its range, as monotonically_increasing_id gives it


def ranked(keys: DataFrame, order: Sequence[str], stage: Stage, name: str = "ranked") -> DataFrame:
    """The rows with ``rank`` from 0 in the order of the columns, nulls first; equal rows follow each other.

    Ranges are written before they are counted, so ranks don't change when a task is run again.
    """
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = stage.write(name, placed).withColumn("range", F.shiftright("place", _PLACE_BITS))
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # one row for each range
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.col("place").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.join(sizes.select("range", earlier.alias("earlier")), "range").withColumn("rank", F.col("earlier") + within).drop("range", "place", "earlier")


def _before(order: Sequence[str], last: Mapping[str, Column]) -> Column:
    """Whether a row comes before the given values, column by column, so that comparisons of the first column can be pushed down."""
    before, equal = [], F.lit(True)
    for name in order:
        smaller = (F.col(name) < last[name]) | (F.col(name).isNull() & last[name].isNotNull())
        before.append(equal & smaller)
        equal = equal & F.col(name).eqNullSafe(last[name])
    return reduce(Column.__or__, before)


def first_rows(rows: DataFrame, order: Sequence[str], n: int, stage: Stage) -> DataFrame:
    """The first ``n`` rows in the order of the columns; rows equal in them are ordered by a hash of the others.

    Only rows equal in all columns are interchangeable, so it doesn't matter which of them stay.
    """
    if n <= 0:
        return rows.limit(0)
    others = [c for c in rows.columns if c not in order]
    turn = F.xxhash64(*others) if others else F.lit(0).cast("bigint")
    keyed = rows.withColumn("turn", turn)
    key = [*order, "turn"]
    found = stage.write("ranks", ranked(keyed.select(*key), key, stage, "ranked-keys"))
    at = found.filter(F.col("rank") == n - 1)
    if at.isEmpty():
        return rows
    last = {c: at.select(c).scalar() for c in key}
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(last[c]) for c in key))
    first_equal = found.filter(same).agg(F.min("rank").alias("rank")).first()["rank"]
    # However many rows equal the last one, they are one row of the shuffle, repeated as often as there is room.
    one = keyed.filter(same).groupBy(*key).agg(*(F.any_value(c).alias(c) for c in others))
    repeated = one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n - first_equal))))
    return keyed.filter(_before(key, last)).select(*rows.columns).unionByName(repeated.select(*rows.columns))
