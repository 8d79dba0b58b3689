"""Report contents (D13, D14) as named DataFrames, and a long form of them.

The HTML pages are not built. One aggregate per (flight, parameter) is computed
and stored when a report is asked for; its sections are read from there, but for
the quartiles, which take a second scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN, TIMESTAMP_COLUMN
from aerolytics.operators.export import chart_table
from aerolytics.operators.limits import limit_check
from aerolytics.operators.stats import describe, parameter_summary


def _sections(summary: DataFrame) -> dict[str, DataFrame]:
    """Overview, statistics, missing note and constants of a parameter summary."""
    elapsed = F.col("parameter") == ELAPSED_COLUMN
    per_flight = summary.groupBy("flight_id").agg(
        F.coalesce(F.sum(F.when(elapsed, F.col("n_rows"))), F.lit(0)).alias("n_points"),
        F.count_if(~elapsed).alias("n_parameters"), F.max(F.when(elapsed, F.col("max"))).alias("_last"),
        F.bool_or(F.col("missing") > 0).alias("any_missing"),
        F.count_if(F.col("missing") > 0).alias("n_columns_with_missing"))
    numbers = summary.filter(~elapsed & (F.col("n_numeric") > 0))
    return {
        "overview": per_flight.select("flight_id", "n_points", "n_parameters",
                                      (F.col("n_parameters") + 2).alias("n_columns"),
                                      F.coalesce(F.col("_last") / 60.0, F.lit(0.0)).alias("duration_min")),
        "statistics": numbers.select("flight_id", "parameter", "min", "max", "mean", "std",
                                     (F.col("max") - F.col("min")).alias("range")),
        "missing": per_flight.select("flight_id", "any_missing", "n_columns_with_missing"),
        "constants": (numbers.filter((F.col("n_valid") > 0) & (F.col("min") == F.col("max")))
                      .select("flight_id", "parameter", "first_value")),
    }


def describe_timestamp(summary: DataFrame) -> DataFrame:
    """The ``Timestamp`` row of the automatic report's describe: count, first and last per flight."""
    return (summary.filter(F.col("parameter") == ELAPSED_COLUMN)
            .select("flight_id", F.lit(TIMESTAMP_COLUMN).alias("parameter"), F.col("n_rows").alias("count"),
                    F.col("first_ts").alias("first"), F.col("last_ts").alias("last")))


def auto_report_tables(samples: DataFrame, limits: DataFrame | None = None,
                       charts: Sequence[dict] = ()) -> dict[str, DataFrame]:
    """Automatic report: overview, describe (numbers and the timestamp), missing
    note, limit findings, chart list (D13)."""
    summary = parameter_summary(samples)
    parts = _sections(summary.table)
    out = {"overview": parts["overview"], "describe": describe(samples, summary=summary),
           "describe_timestamp": describe_timestamp(summary.table), "missing": parts["missing"]}
    if limits is not None:
        out["limits"] = limit_check(samples, limits, summary)
    if charts:
        out["charts"] = chart_table(samples.sparkSession, charts)
    return out


def flight_report_tables(samples: DataFrame, charts: Sequence[dict] = ()) -> dict[str, DataFrame]:
    """Flight report: overview, statistics, missing note, constants, chart list."""
    out = _sections(parameter_summary(samples).table)
    if charts:
        out["charts"] = chart_table(samples.sparkSession, charts)
    return out


def _with_charts(sections: DataFrame, flights: DataFrame, charts: Sequence[dict]) -> DataFrame:
    """``sections`` and the chart list of every flight: key is type and title, value the number of parameters."""
    if not charts:
        return sections
    entries = F.array(*[F.struct(F.lit(f"{c.get('type', '')}|{c.get('title', '')}").alias("key"),
                                 F.lit(float(len(c.get("parameters", ())))).alias("value")) for c in charts])
    listed = flights.select("flight_id", F.explode(entries).alias("c")).select(
        "flight_id", F.lit("charts").alias("section"), "c.key", F.lit("n_parameters").alias("field"), "c.value")
    return sections.unionByName(listed)


def auto_report_long(samples: DataFrame, limits: DataFrame, charts: Sequence[dict] = ()) -> DataFrame:
    """Automatic report as rows (flight_id, section, key, field, value); times as seconds since 1970."""
    t = auto_report_tables(samples, limits, charts)
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    ts = t["describe_timestamp"].select("flight_id", "parameter", "count", *[
        (F.timestamp_diff("MICROSECOND", epoch, F.col(c)) / 1e6).alias(c) for c in ("first", "last")])
    out = (_long(t["overview"], "overview", [], ["n_points", "n_parameters", "duration_min"])
            .unionByName(_long(t["describe"], "describe", ["parameter"],
                               ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]))
            .unionByName(_long(ts, "describe", ["parameter"], ["count", "first", "last"]))
            .unionByName(_long(t["missing"].withColumn("any_missing", F.col("any_missing").cast("int")),
                               "missing", [], ["any_missing", "n_columns_with_missing"]))
            .unionByName(_long(t["limits"].filter(F.col("parameter").isNotNull()), "limits", ["parameter", "status"],
                               ["min_value", "max_value"])))
    return _with_charts(out, t["overview"], charts)


def _long(df: DataFrame, section: str, key_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]) \
        if key_cols else F.lit("")
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value"))
                      for c in value_cols])
    return df.select("flight_id", F.lit(section).alias("section"), key.alias("key"),
                     F.explode(cells).alias("c")).select("flight_id", "section", "key", "c.field", "c.value")


def report_long(samples: DataFrame, charts: Sequence[dict] = ()) -> DataFrame:
    """Flight report as rows (flight_id, section, key, field, value)."""
    t = flight_report_tables(samples, charts)
    out = (_long(t["overview"], "overview", [], ["n_points", "n_parameters", "duration_min"])
            .unionByName(_long(t["statistics"], "statistics", ["parameter"], ["mean", "std", "min", "max", "range"]))
            .unionByName(_long(t["missing"].withColumn("any_missing", F.col("any_missing").cast("int")),
                               "missing", [], ["any_missing", "n_columns_with_missing"]))
            .unionByName(_long(t["constants"], "constants", ["parameter"], ["first_value"])))
    return _with_charts(out, t["overview"], charts)
