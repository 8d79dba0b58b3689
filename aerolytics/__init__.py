"""aerolytics: flight-test telemetry analytics as Spark DataFrame operators.

Recordings are text files with two header lines (names, units) and one
timestamped sample per line. They are ingested into a long-form ``samples``
table keyed by ``(flight_id, row_no, parameter)`` and analysed with
operators that group by flight, so one call covers one flight or thousands.
"""

from aerolytics.session import build_session, checkpoint_dir, materialize, join_small

__all__ = ["build_session", "checkpoint_dir", "materialize", "join_small"]
