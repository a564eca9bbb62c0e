"""Job and analysis settings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

from placebeat.functions.times import duration_micros

SOURCE_TYPES = ("static", "file_stream", "kafka")

# Where each setting lives in a nested configuration mapping (section, key).
_CONFIG_KEYS = {
    "business_path": ("dataset", "business_path"),
    "review_path": ("dataset", "review_path"),
    "limit": ("dataset", "limit"),
    "source_type": ("source", "type"),
    "stream_path": ("source", "stream_path"),
    "kafka_bootstrap_servers": ("source", "kafka_bootstrap_servers"),
    "kafka_topic": ("source", "kafka_topic"),
    "kafka_starting_offsets": ("source", "kafka_starting_offsets"),
    "checkpoint_path": ("source", "checkpoint_path"),
    "trigger_seconds": ("source", "trigger_seconds"),
    "output_path": ("output", "base_path"),
    "neighborhoods_path": ("output", "neighborhoods_path"),
    "cell_size_km": ("geo", "cell_size_km"),
    "dense_city_threshold": ("geo", "dense_city_threshold"),
    "window_duration": ("analytics", "window_duration"),
    "slide_duration": ("analytics", "slide_duration"),
    "emerging_score_threshold": ("analytics", "emerging_score_threshold"),
    "rating_spike_threshold": ("analytics", "rating_spike_threshold"),
    "min_events_for_hotspot": ("analytics", "min_events_for_hotspot"),
    "default_city": ("dashboard", "default_city"),
}


@dataclass(frozen=True)
class Params:
    """Every setting of the static and streaming jobs; the analysis settings alone are enough for the operators."""

    # Defaults.
    business_path: str | None = None
    review_path: str | None = None
    limit: int | None = None
    source_type: str = "static"
    stream_path: str | None = None
    kafka_bootstrap_servers: str | None = None
    kafka_topic: str | None = None
    kafka_starting_offsets: str = "latest"
    checkpoint_path: str | None = None
    trigger_seconds: int = 5
    output_path: str = "./data/output"
    neighborhoods_path: str | None = None  # output path of a static job whose neighborhoods a stream takes over
    cell_size_km: float = 2.0
    dense_city_threshold: int = 0
    cluster_by: tuple[str, ...] = ("city",)
    cluster_seed: int = 7
    window_duration: str = "30 minutes"
    slide_duration: str = "10 minutes"
    emerging_score_threshold: float = 1.5
    rating_spike_threshold: float = 0.5
    min_events_for_hotspot: int = 5
    latest_limit: int = 200
    default_city: str = "Philadelphia"

    def __post_init__(self) -> None:
        duration, slide = duration_micros(self.window_duration), duration_micros(self.slide_duration)
        if slide > duration:
            raise ValueError(f"slide {self.slide_duration!r} is longer than the window {self.window_duration!r}")
        if not set(self.cluster_by) <= {"city", "state"} or "city" not in self.cluster_by:
            raise ValueError(f"cluster_by must be ('city',) or ('city', 'state'), not {self.cluster_by!r}")

    @property
    def min_events(self) -> int:
        return max(int(self.min_events_for_hotspot), 1)

    @classmethod
    def from_mapping(cls, config: Mapping[str, Mapping[str, Any] | None]) -> Params:
        """Build from a nested mapping (sections dataset, source, output, geo, analytics, dashboard).

        Missing and null entries keep their defaults; values are converted to the type of the default.
        """
        plain = {f.name: f.default for f in fields(cls)}
        found = {}
        for name, (section, key) in _CONFIG_KEYS.items():
            value = (config.get(section) or {}).get(key)
            if value is not None:
                default = plain[name]
                found[name] = value if default is None else type(default)(value)
        return cls(**found)

    def with_(self, **changes: Any) -> Params:
        return replace(self, **changes)

    def check_source(self) -> None:
        """Fail before any job starts when the chosen source is unknown or lacks a setting."""
        needed = {
            "static": ("business_path", "review_path"),
            "file_stream": ("business_path", "stream_path", "checkpoint_path"),
            "kafka": ("business_path", "kafka_bootstrap_servers", "kafka_topic", "checkpoint_path"),
        }
        if self.source_type not in needed:
            raise ValueError(f"unknown source type {self.source_type!r}; expected one of {SOURCE_TYPES}")
        missing = [name for name in needed[self.source_type] if not getattr(self, name)]
        if missing:
            raise ValueError(f"{self.source_type} needs {', '.join(missing)}")
