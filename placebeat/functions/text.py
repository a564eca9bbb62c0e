"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: whitespace as Python's str.strip sees it (Unicode White_Space plus the four separator controls).
_SPACE = r"[\s\x1c-\x1f]"
PREVIEW_LENGTH = 280


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends; Spark's ``trim`` removes only blanks."""
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def parse_categories(raw: Column) -> Column:
    """Comma-separated names as an array: stripped, blanks dropped, duplicates and order kept; null gives ``[]``."""
    names = F.split(strip(raw), rf"(?U){_SPACE}*,{_SPACE}*")
    return F.coalesce(F.array_remove(names, ""), F.array().cast("array<string>"))


def preview(text: Column, length: int = PREVIEW_LENGTH) -> Column:
    """First ``length`` characters (code points); null gives the empty string."""
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text: ``2020-01-01T10:11:12``, with six fraction digits only when the fraction is not zero.

    Casting to string rather than ``date_format`` keeps zone-less timestamps free of the session time zone.
    """
    text = F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
