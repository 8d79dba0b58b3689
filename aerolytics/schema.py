"""Canonical tables and the long <-> wide reshapes.

``samples`` is long: one row per (flight, row, parameter). A numeric parameter
has ``value`` (NULL = missing) and ``text`` NULL; a text parameter has ``text``
(never NULL, may be '') and ``value`` NULL. The elapsed time is stored as the
parameter ``Elapsed Time (s)`` on every row as well as in ``elapsed_s``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN, TIMESTAMP_COLUMN

SAMPLES = ("flight_id STRING, row_no BIGINT, ts TIMESTAMP_NTZ, elapsed_s DOUBLE, "
           "parameter STRING, text STRING, value DOUBLE")
PARAMETERS = ("flight_id STRING, position INT, parameter STRING, name STRING, unit STRING, "
              "is_numeric BOOLEAN, n_rows BIGINT, n_valid BIGINT")
FLIGHTS = ("flight_id STRING, n_rows BIGINT, n_parameters INT, duration_s DOUBLE, "
           "median_interval_s DOUBLE, sampling_rate_hz DOUBLE, ts_format STRING")
LIMITS = "parameter STRING, min DOUBLE, max DOUBLE"
ISSUES = "flight_id STRING, line_no BIGINT, column STRING, code STRING, count BIGINT"
LINES = "flight_id STRING, line_no BIGINT, line STRING"

SAMPLE_COLUMNS = ["flight_id", "row_no", "ts", "elapsed_s", "parameter", "text", "value"]

__all__ = ["SAMPLES", "PARAMETERS", "FLIGHTS", "LIMITS", "ISSUES", "LINES", "SAMPLE_COLUMNS",
           "ELAPSED_COLUMN", "TIMESTAMP_COLUMN", "unpivot", "pivot", "numeric", "rows_of",
           "with_elapsed_parameter"]


def unpivot(wide: DataFrame, params: Mapping[str, Column | str], flight_id: Column | str,
            row_no: Column | str, ts: Column | str, elapsed_s: Column | str) -> DataFrame:
    """Wide rows -> long samples; every value column becomes a numeric parameter.

    ``params`` maps parameter name -> column. The elapsed parameter is added
    from ``elapsed_s``.
    """
    def col(c):
        return F.col(c) if isinstance(c, str) else c

    base = wide.select(col(flight_id).alias("flight_id"), col(row_no).cast("long").alias("row_no"),
                       col(ts).alias("ts"), col(elapsed_s).cast("double").alias("elapsed_s"),
                       *[col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(params.values())])
    cells = [F.struct(F.lit(name).alias("parameter"), F.col(f"_p{i}").alias("value"))
             for i, name in enumerate(params)]
    cells.append(F.struct(F.lit(ELAPSED_COLUMN).alias("parameter"), F.col("elapsed_s").alias("value")))
    return (base.select("flight_id", "row_no", "ts", "elapsed_s", F.explode(F.array(*cells)).alias("c"))
            .select("flight_id", "row_no", "ts", "elapsed_s", F.col("c.parameter").alias("parameter"),
                    F.lit(None).cast("string").alias("text"), F.col("c.value").alias("value")))


def numeric(samples: DataFrame, include_elapsed: bool = True) -> DataFrame:
    """Rows of numeric parameters (the elapsed one optional)."""
    s = samples.filter(F.col("text").isNull())
    return s if include_elapsed else s.filter(F.col("parameter") != ELAPSED_COLUMN)


def rows_of(samples: DataFrame) -> DataFrame:
    """One row per recorded sample row: (flight_id, row_no, ts, elapsed_s).

    Read from the elapsed parameter, which every row carries: a filter, not a shuffle.
    """
    return (samples.filter(F.col("parameter") == ELAPSED_COLUMN)
            .select("flight_id", "row_no", "ts", "elapsed_s"))


def with_elapsed_parameter(samples: DataFrame) -> DataFrame:
    """Add the elapsed parameter rows to samples that lack them (built elsewhere)."""
    have = samples.filter(F.col("parameter") != ELAPSED_COLUMN)
    first = have.groupBy("flight_id", "row_no").agg(F.first("ts").alias("ts"),
                                                     F.first("elapsed_s").alias("elapsed_s"))
    el = first.select("flight_id", "row_no", "ts", "elapsed_s", F.lit(ELAPSED_COLUMN).alias("parameter"),
                      F.lit(None).cast("string").alias("text"), F.col("elapsed_s").alias("value"))
    return have.unionByName(el)


def pivot(samples: DataFrame, parameters: Sequence[str],
          text_parameters: Sequence[str] = ()) -> DataFrame:
    """Long -> wide over an explicit parameter list (one column per parameter).

    The row key is (flight_id, row_no); grouping by it spreads a large flight
    over all tasks. Numeric parameters give their value, those listed in
    ``text_parameters`` their text, or their value as text where a flight holds numbers.
    """
    s = samples.filter(F.col("parameter").isin(list(parameters)))
    cols = [F.first(F.when(F.col("parameter") == p,
                           F.coalesce("text", F.col("value").cast("string")) if p in text_parameters
                           else F.col("value")),
                    ignorenulls=True).alias(p)
            for p in parameters]
    return s.groupBy("flight_id", "row_no").agg(F.first("ts").alias(TIMESTAMP_COLUMN), *cols)
