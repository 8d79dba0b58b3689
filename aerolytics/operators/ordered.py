"""Operators on file order (E1-E4, A6, A7): gaps, step sampling, first/last.

All use the dense ``row_no``; none sorts a whole flight in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.plans.ordering import previous_values
from aerolytics.plans.quantiles import quantile_columns
from aerolytics.schema import rows_of
from aerolytics.session import join_small

# Fixed value: the bar chart shows about this many rows (k = max(1, n // 50)).
BAR_TARGET_ROWS = 50


def elapsed_gaps(samples: DataFrame) -> DataFrame:
    """Row-to-row difference of elapsed time in file order, first row dropped."""
    g = previous_values(rows_of(samples), ["flight_id"], ["elapsed_s"])
    return (g.filter(F.col("prev_elapsed_s").isNotNull())
            .select("flight_id", "row_no", (F.col("elapsed_s") - F.col("prev_elapsed_s")).alias("gap_s")))


def sampling(samples: DataFrame) -> DataFrame:
    """Median gap and sampling rate per flight (A7); the rate only for a
    positive median and more than one row."""
    med = quantile_columns(elapsed_gaps(samples), ["flight_id"], "gap_s", [0.5], ["median_interval_s"])
    return med.select("flight_id", "median_interval_s",
                      F.when(F.col("median_interval_s") > 0, 1.0 / F.col("median_interval_s"))
                      .alias("sampling_rate_hz"))


def step_of(samples: DataFrame, target: int = BAR_TARGET_ROWS) -> DataFrame:
    """(flight_id, n_rows, k) with k = max(1, n // target)."""
    return (rows_of(samples).groupBy("flight_id").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n_rows") / target)).cast("long")))


def every_kth(samples: DataFrame, target: int = BAR_TARGET_ROWS) -> DataFrame:
    """Samples on every k-th row from row 0 (E2); ceil(n/k) rows per flight."""
    k = step_of(samples, target).select("flight_id", "k")
    return (join_small(samples, k, "flight_id")
            .filter(F.col("row_no") % F.col("k") == 0).drop("k"))


def mean_time_step(samples: DataFrame) -> DataFrame:
    """(last - first elapsed, in file order) / (n - 1) per flight."""
    r = rows_of(samples)
    return (r.groupBy("flight_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("elapsed_s", "row_no").alias("first_elapsed_s"),
                 F.max_by("elapsed_s", "row_no").alias("last_elapsed_s"))
            .withColumn("dt_s", F.try_divide(F.col("last_elapsed_s") - F.col("first_elapsed_s"),
                                             (F.col("n_rows") - 1).cast("double"))))


def first_values(samples: DataFrame) -> DataFrame:
    """Value (or text) on the first row of each parameter."""
    return (samples.groupBy("flight_id", "parameter")
            .agg(F.min_by("value", "row_no").alias("first_value"),
                 F.min_by("text", "row_no").alias("first_text")))
