"""Outlier flags (O1-O4): z-score or IQR per (flight, parameter).

Per-parameter statistics are one aggregate; they are joined back onto the
samples through ``join_small`` (broadcast when the table of (flight,
parameter) pairs is small, else a shuffle join). Every sample of the
parameter gets a flag; a missing value is never an outlier.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.operators.stats import Summary, summary_quartiles
from aerolytics.plans.quantiles import quantile_columns
from aerolytics.schema import numeric
from aerolytics.session import join_small

# Default threshold and the method names.
DEFAULT_THRESHOLD = 3.0
METHODS = ("zscore", "iqr", "isolation")


def outliers(samples: DataFrame, parameters: Sequence[str] | str, method: str = "zscore",
             threshold: float = DEFAULT_THRESHOLD, summary: Summary | None = None) -> DataFrame:
    """(flight_id, row_no, parameter, value, is_outlier).

    ``iqr``: outside [q25 - t*IQR, q75 + t*IQR]; any other method (also
    ``isolation``) is the z-score: |v - mean| / std > t, std with n-1. Both
    strict. An absent or text parameter gives no rows. Infinite values are data:
    a mean or quartile that they leave undefined flags no sample. A ``summary``
    of the same samples gives mean and deviation, or the quartiles' brackets, so
    that z-score flags take the one scan that writes them, and IQR flags two.
    """
    if isinstance(parameters, str):
        parameters = [parameters]
    s = numeric(samples).filter(F.col("parameter").isin(list(parameters))).select(
        "flight_id", "row_no", "parameter", "value")
    v = F.col("value")
    t = F.lit(float(threshold))
    if method == "iqr":
        if summary is None:
            st, n = quantile_columns(s, ["flight_id", "parameter"], "value", [0.25, 0.75], ["_q1", "_q3"]), None
        else:
            chosen = Summary(summary.table.filter(F.col("parameter").isin(list(parameters))), summary.n)
            st, n = summary_quartiles(s.withColumn("text", F.lit(None).cast("string")), chosen, ["_q1", "_q2", "_q3"]), summary.n
        j = join_small(s, st, ["flight_id", "parameter"], n_rows=n)
        iqr = F.col("_q3") - F.col("_q1")
        low, high = F.col("_q1") - t * iqr, F.col("_q3") + t * iqr
        # Spark orders NaN above every number; a bound that infinite data left undefined flags nothing.
        flag = (~F.isnan(low) & (v < low)) | (~F.isnan(high) & (v > high))
    else:
        if summary is None:
            st, n = s.groupBy("flight_id", "parameter").agg(F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s")), None
        else:
            st, n = summary.table.select("flight_id", "parameter", F.col("mean").alias("_m"), F.col("std").alias("_s")), summary.n
        j = join_small(s, st, ["flight_id", "parameter"], n_rows=n)
        z = F.try_divide(v - F.col("_m"), F.col("_s"))
        flag = ~F.isnan(z) & (F.abs(z) > t)
    return j.select("flight_id", "row_no", "parameter", "value",
                    F.coalesce(flag & ~F.isnan(v), F.lit(False)).alias("is_outlier"))
