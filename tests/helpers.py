"""Small inputs and result access for tests."""

from datetime import datetime

from pyspark.sql import functions as F

from placebeat.schemas import ENRICHED_SCHEMA

DAY = datetime(2020, 1, 1)


def event(review_id, city="Vegas", stars=4.0, when=DAY, categories=("Diner",), business=None, state="NV",
          lat=36.1699, lon=-115.1398, text=""):
    return (review_id, business or f"b-{review_id}", "u", float(stars), when, text, "Sample", city, state, lat, lon,
            4.0, list(categories))


def enriched(spark, events):
    return spark.createDataFrame(events, ENRICHED_SCHEMA)


def rows(frame, *columns):
    """Rows as sorted plain tuples, doubles rounded."""
    frame = frame.select(*columns) if columns else frame
    return sorted(
        (tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in frame.collect()), key=repr
    )


def values(spark, column, inputs, kind="string"):
    """Results of a column function over single inputs, in order."""
    frame = spark.createDataFrame(list(enumerate(inputs)), f"i int, v {kind}")
    return [row[0] for row in frame.orderBy("i").select(column(F.col("v"))).collect()]


def plan(frame):
    """Final physical plan after running it."""
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()
