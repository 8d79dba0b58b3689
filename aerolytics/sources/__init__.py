"""Sources: recording text files and the adapters over tabular data."""

from aerolytics.sources.recordings import lines_from_text, read_recordings
from aerolytics.sources.tables import (events_samples, lineitem_samples, events_lines,
                                       hourly_counts_samples)

__all__ = ["read_recordings", "lines_from_text", "events_samples", "lineitem_samples", "events_lines",
           "hourly_counts_samples"]
