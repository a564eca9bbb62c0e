"""Place-activity analytics on PySpark.

Timestamped, rated events are joined to the places they belong to and turned into city, area and category
indicators, sliding-window hotspot scores, category-mix anomalies and latest-event feeds, in batch or as a stream.
"""

from placebeat.params import Params

__all__ = ["Params"]
