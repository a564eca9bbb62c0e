"""Column functions. All are built from Spark's own expressions, so they stay in the JVM."""

from placebeat.functions.geo import GridCell, cluster_count, grid_cell
from placebeat.functions.text import iso_timestamp, parse_categories, preview, strip
from placebeat.functions.times import duration_micros, interval, last_start, pane_start, pane_width, parse_date, start_before

__all__ = [
    "GridCell", "cluster_count", "duration_micros", "grid_cell", "interval", "iso_timestamp", "last_start", "pane_start",
    "pane_width", "parse_categories", "parse_date", "preview", "start_before", "strip",
]
