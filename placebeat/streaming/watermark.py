"""Windows with bounded state: an event-time watermark instead of partials kept for ever.

Pane totals are the state; a pane leaves it once the watermark has passed its end, and events of such panes are
dropped, which the query's progress reports. Two ways on from there:

- Closed windows: a second aggregation adds closed panes up to windows, and a window comes out once, when the watermark has
  passed its end. Its rows are appended to a plain Parquet table by Spark's own file sink; readers read each window once.
- Early panes: each batch writes the panes it changed, and readers take the newest version of every pane, for results
  before their windows have closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from placebeat.functions import grid_cell
from placebeat.operators.areas import AREA_COLUMNS, GRID, NEIGHBORHOOD
from placebeat.operators.cleaning import clean_reviews
from placebeat.operators.enrich import enrich
from placebeat.operators.hotspots import params_pane, scored, scored_windows
from placebeat.operators.measures import mean_stars
from placebeat.params import Params
from placebeat.schemas import CLOSED_SCHEMA, PARTIAL_SCHEMAS, PLACE_SCHEMA
from placebeat.sources.files import load_places
from placebeat.streaming.jobs import neighborhood_dimension, start_batches
from placebeat.streaming.store import read_batches

_KEYS = [*AREA_COLUMNS, "pane_start"]
_FOLDER, _CLOSED = "watermarked_panes", "closed_windows"


def _pane_totals(enriched: DataFrame, params: Params, delay: str, neighborhoods: DataFrame | None) -> DataFrame:
    """Streaming totals per area and pane; ``window`` is the pane."""
    events = enriched.withWatermark("review_date", delay)
    cell = grid_cell(F.col("latitude"), F.col("longitude"), params.cell_size_km)
    areas = [
        F.struct(
            F.lit(GRID).alias("area_type"),
            cell.grid_id.alias("area_id"),
            cell.latitude.alias("latitude"),
            cell.longitude.alias("longitude"),
        )
    ]
    if neighborhoods is not None:
        # One pass for both kinds: a union would read the source twice.
        events = events.join(neighborhoods, ["business_id", "city", "state"], "left")
        assigned = F.struct(
            F.lit(NEIGHBORHOOD).alias("area_type"),
            F.col("neighborhood_id").alias("area_id"),
            F.col("center_lat").alias("latitude"),
            F.col("center_lon").alias("longitude"),
        )
        areas.append(F.when(F.col("neighborhood_id").isNotNull(), assigned))
    placed = events.select(
        "city", "state", "review_stars", "review_date", F.explode(F.array_compact(F.array(*areas))).alias("area")
    ).select("area.*", "city", "state", "review_stars", "review_date")
    return placed.groupBy(*AREA_COLUMNS, F.window("review_date", f"{params_pane(params)} microseconds")).agg(
        F.count("*").alias("event_count"), F.sum("review_stars").alias("stars_sum")
    )


def watermarked_panes(
    enriched: DataFrame, params: Params, delay: str, neighborhoods: DataFrame | None = None
) -> DataFrame:
    """Streaming totals per area and pane, for update mode. Events later than ``delay`` may be dropped."""
    totals = _pane_totals(enriched, params, delay, neighborhoods)
    return totals.select(*AREA_COLUMNS, F.col("window.start").alias("pane_start"), "event_count", "stars_sum")


def closed_window_totals(
    enriched: DataFrame, params: Params, delay: str, neighborhoods: DataFrame | None = None
) -> DataFrame:
    """Streaming totals per area and window, for append mode: two aggregations in a chain.

    The first keeps the open panes of each area, the second the open windows; each holds the areas active within ``delay`` and
    a window's length, however long the stream runs.
    """
    panes = _pane_totals(enriched, params, delay, neighborhoods)
    timed = panes.select(*AREA_COLUMNS, F.window_time("window").alias("pane_time"), "event_count", "stars_sum")
    windows = timed.groupBy(*AREA_COLUMNS, F.window("pane_time", params.window_duration, params.slide_duration)).agg(
        F.sum("event_count").alias("event_count"), F.sum("stars_sum").alias("stars_sum")
    )
    return windows.select(*AREA_COLUMNS, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_count", "stars_sum")


def start_closed_windows(totals: DataFrame, params: Params, available_now: bool = False) -> StreamingQuery:
    """Append closed windows to a Parquet table under the output path, by Spark's file sink."""
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{params.trigger_seconds} seconds"}
    writer = totals.writeStream.format("parquet").outputMode("append").option("checkpointLocation", params.checkpoint_path)
    return writer.trigger(**trigger).start(f"{params.output_path.rstrip('/')}/{_CLOSED}")


def closed_windows(spark: SparkSession, params: Params) -> DataFrame:
    """Scored windows over all that have closed so far; every window is one row of the table that is read."""
    totals = spark.read.schema(CLOSED_SCHEMA).parquet(f"{params.output_path.rstrip('/')}/{_CLOSED}")
    return scored(totals.withColumn("avg_stars", mean_stars()), params)


def start_watermarked(
    spark: SparkSession, reviews: DataFrame, params: Params, delay: str, available_now: bool = False
) -> StreamingQuery:
    path = f"{params.output_path.rstrip('/')}/places"
    load_places(spark, params.business_path).write.mode("overwrite").parquet(path)
    located = spark.read.schema(PLACE_SCHEMA).parquet(path)
    neighborhoods = neighborhood_dimension(spark, params, located)
    panes = watermarked_panes(enrich(clean_reviews(reviews), located), params, delay, neighborhoods)
    return write_panes(panes, params, available_now)


def write_panes(panes: DataFrame, params: Params, available_now: bool = False) -> StreamingQuery:
    """Write the panes each batch changed to a directory of that batch."""
    path = f"{params.output_path.rstrip('/')}/{_FOLDER}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return start_batches(panes, write, params, available_now, output_mode="update")


def newest_panes(spark: SparkSession, base_path: str) -> DataFrame:
    """The newest version of every pane."""
    versions = read_batches(spark, f"{base_path.rstrip('/')}/{_FOLDER}", PARTIAL_SCHEMAS["area_panes"])
    return versions.groupBy(*_KEYS).agg(
        F.max_by("event_count", "batch_id").alias("event_count"), F.max_by("stars_sum", "batch_id").alias("stars_sum")
    )


def watermarked_windows(spark: SparkSession, params: Params) -> DataFrame:
    """Scored windows over the panes a watermarked stream has written."""
    return scored_windows(newest_panes(spark, params.output_path), params)


class LateRows(StreamingQueryListener):
    """Counts rows (pane totals within a task, not single events) dropped as too late, over a query's whole life.

    Add it with ``spark.streams.addListener`` before the query starts; a query's own progress keeps only its last batches.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(state.numRowsDroppedByWatermark for state in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query: StreamingQuery) -> int:
        return self.dropped.get(str(query.id), 0)
