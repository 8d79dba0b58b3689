"""Limit check against a user's limits table.

``limits(parameter, min, max)`` is joined to the bounds of each flight's
parameters, one row per (flight, parameter), after a single aggregate over the
samples. Key match is exact and case-sensitive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.operators.stats import Summary
from aerolytics.session import join_small


def limit_check(samples: DataFrame, limits: DataFrame, summary: Summary | None = None) -> DataFrame:
    """One row per finding: (flight_id, parameter, status, min_value, max_value,
    limit_min, limit_max).

    ``below`` when the smallest value is under the minimum, ``above`` when the
    largest is over the maximum (both may hold), ``ok`` when both are inside
    (bounds inclusive). A parameter with no value gives nothing. A flight with
    no finding at all gets one ``none`` row. Text parameters are skipped (see
    ``limit_skipped``). A ``summary`` of the same samples saves the scan.
    """
    lim = limits.select("parameter", F.col("min").cast("double").alias("limit_min"),
                        F.col("max").cast("double").alias("limit_max"))
    # One scan (none with a summary): every parameter's bounds (a text cell has no value), then the small tables meet.
    bounds = summary.table.select("flight_id", "parameter", F.col("min").alias("min_value"), F.col("max").alias(
        "max_value")) if summary is not None else samples.groupBy("flight_id", "parameter").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    mm = bounds.join(lim, "parameter", "left")
    status = F.array_compact(F.array(
        F.when(F.col("min_value") < F.col("limit_min"), F.lit("below")),
        F.when(F.col("max_value") > F.col("limit_max"), F.lit("above")),
        F.when((F.col("limit_min") <= F.col("min_value")) & (F.col("max_value") <= F.col("limit_max")),
               F.lit("ok"))))
    flight = Window.partitionBy("flight_id")
    mm = (mm.withColumn("found", status).withColumn("any", F.max(F.size("found")).over(flight))
          .withColumn("first", F.row_number().over(flight.orderBy("parameter")) == 1))
    none = (F.col("any") == 0) & F.col("first")
    rows = mm.select("*", F.explode(F.when(none, F.array(F.lit("none"))).otherwise(F.col("found"))).alias("status"))
    given = F.col("status") != "none"
    return rows.select("flight_id", F.when(given, F.col("parameter")).alias("parameter"), "status",
                       *[F.when(given, F.col(c)).alias(c) for c in ("min_value", "max_value", "limit_min", "limit_max")])


def limit_skipped(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """Catalogued parameters that hold text: (flight_id, parameter)."""
    t = samples.filter(F.col("text").isNotNull()).select("flight_id", "parameter").distinct()
    return join_small(t, limits.select("parameter").distinct(), "parameter", "left_semi")
