"""Durations, date parsing and event-time panes.

Windows of length ``duration`` every ``slide`` are unions of *panes*: tumbling intervals of gcd(duration, slide).
Counts and sums per pane are additive, so events are reduced to panes before the shuffle, and a window's totals are the
difference of two running sums over panes.

Results follow ``spark.sql.session.timeZone`` the way Spark's casts do; the jobs are meant to run under UTC.
Zone-less timestamps (``timestamp_ntz``) are accepted everywhere and stay zone-less.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit.
_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
_PART = re.compile(r"(\d+)\s*([a-z]+?)s?(?=\s|\d|$)")
# Short unit spellings.
_SHORT_UNITS = {"min": "minute", "sec": "second", "hr": "hour"}

# Accepted shapes of a date text.
_ISO_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
_COMPACT_DAY = r"^\d{8}$"
_COMPACT_TIMESTAMP = r"^\d{8}T\d{6}$"


def duration_micros(duration: str) -> int:
    """Length of an interval text such as ``"30 minutes"``, ``"1 day 12 hours"`` or ``"90 seconds"``.

    Months and years have no fixed length and are refused, as is anything unreadable.
    """
    text = duration.strip().lower()
    text = text.removeprefix("interval").strip()
    total, at = 0, 0
    while at < len(text):
        part = _PART.match(text, at)
        unit = part and _SHORT_UNITS.get(part[2], part[2])
        if unit not in _UNIT_MICROS:
            raise ValueError(f"not a fixed-length duration: {duration!r}")
        total += int(part[1]) * _UNIT_MICROS[unit]
        at = part.end()
        while at < len(text) and text[at].isspace():
            at += 1
    if total <= 0:
        raise ValueError(f"not a positive duration: {duration!r}")
    return total


def interval(micros: int) -> Column:
    return F.expr(f"INTERVAL '{micros // 1_000_000}.{micros % 1_000_000:06d}' SECOND")


def pane_width(duration: str, slide: str) -> int:
    """Microseconds of the widest tumbling interval that tiles every window; windows must not leave gaps."""
    if duration_micros(slide) > duration_micros(duration):
        raise ValueError(f"a slide of {slide!r} is longer than the window of {duration!r}")
    return math.gcd(duration_micros(duration), duration_micros(slide))


def pane_start(ts: Column | str, width: int) -> Column:
    """Start of the epoch-aligned tumbling interval of ``width`` microseconds holding ``ts``."""
    return F.window(ts, f"{width} microseconds").start


def last_start(pane: Column, duration: str, slide: str) -> Column:
    """Start of the last window that covers the pane starting at ``pane``."""
    step = duration_micros(slide)
    return pane if pane_width(duration, slide) == step else F.window(pane, f"{step} microseconds").start


def start_before(pane: Column, last: Column, duration: str, slide: str) -> Column:
    """Start of the last window that ends before the pane does, ``last`` being that of the last that covers it."""
    length, step = duration_micros(duration), duration_micros(slide)
    whole, rest = divmod(length, step)
    if not rest:
        return last - interval(length)
    return F.when(pane < last + interval(rest), last - interval((whole + 1) * step)).otherwise(last - interval(whole * step))


def parse_date(text: Column) -> Column:
    """Timestamp of a date text, null when it is none.

    Empty text is the epoch. ISO dates and timestamps are read as such, compact ``yyyyMMdd`` forms too; otherwise the
    part before the first space counts if it is a date. The shape is checked first because Spark's own conversion
    also accepts bare times and years.
    """
    first = F.split_part(text, F.lit(" "), F.lit(1))
    first_day = F.when(first.rlike(_DAY), F.try_to_timestamp(first))
    return (
        F.when(text == "", F.timestamp_seconds(F.lit(0)))
        .when(text.rlike(_ISO_TIMESTAMP), F.coalesce(F.try_to_timestamp(text), first_day))
        .when(text.rlike(_COMPACT_DAY), F.try_to_timestamp(text, F.lit("yyyyMMdd")))
        .when(text.rlike(_COMPACT_TIMESTAMP), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")))
        .otherwise(first_day)
    )
