"""Per-parameter statistics.

One ``groupBy(flight_id, parameter)`` per call with every moment in the same
aggregate (one scan, partial then final). Quartiles (linear interpolation, as
the reference) come from ``plans.quantiles.exact_quantiles``: exact, and no
(flight, parameter) group is ever held by one task. ``quantiles="map"`` uses
Spark's one-pass ``percentile`` instead (one buffer entry per distinct value
of a group: only for groups known to be small); ``"approx"`` the bounded
``percentile_approx`` sketch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolytics.functions.numbers import sample_kurtosis, sample_skewness
from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.plans.quantiles import quantile_columns, rank_brackets
from aerolytics.schema import numeric
from aerolytics.session import materialize_counted

APPROX_ACCURACY = 100_000
QUARTILES = [0.25, 0.5, 0.75]


def _quartiles(v: Column, approx: bool) -> Column:
    if approx:
        return F.percentile_approx(v, QUARTILES, APPROX_ACCURACY)
    return F.percentile(v, F.array(*[F.lit(q) for q in QUARTILES]))


def _brackets(v: Column, quantiles: str) -> list[Column]:
    return [] if quantiles in ("map", "approx") else [rank_brackets(v, QUARTILES).alias("_br")]


def _with_quartiles(moments: DataFrame, s: DataFrame, quantiles: str, names=("q25", "q50", "q75")) -> DataFrame:
    """Add quartile columns to a per-(flight, parameter) moment table."""
    if quantiles in ("map", "approx"):
        q = s.groupBy("flight_id", "parameter").agg(_quartiles(F.col("value"), quantiles == "approx").alias("_q"))
        q = q.select("flight_id", "parameter", *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
    else:
        moments = materialize_counted(moments)  # with the brackets, in the same aggregate
        known = (moments[0].select("flight_id", "parameter", F.col("count").alias("_n"), F.col("min").alias("_lo"),
                                   F.col("max").alias("_hi"), "_br"), moments[1])
        q = quantile_columns(s, ["flight_id", "parameter"], "value", QUARTILES, list(names), known)
        moments = moments[0].drop("_br")
    return moments.join(q, ["flight_id", "parameter"], "left")


@dataclass
class Summary:
    """One stored row per (flight, parameter), merged from one scan; many operators read it instead of the samples.

    Counts, bounds, moments, rank brackets of the quartiles, first value and times.
    """

    table: DataFrame
    n: int


def parameter_summary(samples: DataFrame) -> Summary:
    """The ``Summary`` of all parameters; it has as many rows as there are columns over all flights."""
    v = F.col("value")
    return Summary(*materialize_counted(samples.groupBy("flight_id", "parameter").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("n_valid"),
        F.count_if(v.isNull() & F.col("text").isNull()).alias("missing"),
        F.count_if(F.col("text").isNull()).alias("n_numeric"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min_by(v, "row_no").alias("first_value"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        rank_brackets(v, QUARTILES).alias("_br"))))


def summary_quartiles(samples: DataFrame, summary: Summary, names: Sequence[str] = ("q25", "q50", "q75")) -> DataFrame:
    """(flight_id, parameter, quartiles): one scan that keeps only values inside the summary's brackets."""
    known = summary.table.select("flight_id", "parameter", F.col("n_valid").alias("_n"), F.col("min").alias("_lo"),
                                 F.col("max").alias("_hi"), "_br")
    return quantile_columns(numeric(samples), ["flight_id", "parameter"], "value", QUARTILES, list(names), (known, summary.n))


def overview(samples: DataFrame) -> DataFrame:
    """Per flight: points, parameters (all columns but timestamp and elapsed),
    columns, duration in minutes (D1)."""
    is_el = F.col("parameter") == ELAPSED_COLUMN
    return (samples.groupBy("flight_id")
            .agg(F.count_if(is_el).alias("n_points"),
                 F.count_distinct(F.when(~is_el, F.col("parameter"))).alias("n_parameters"),
                 F.max(F.when(is_el, F.col("value"))).alias("_max_el"))
            .select("flight_id", "n_points", "n_parameters", (F.col("n_parameters") + 2).alias("n_columns"),
                    F.coalesce(F.col("_max_el") / 60.0, F.lit(0.0)).alias("duration_min")))


def describe(samples: DataFrame, quantiles: str = "exact", include_elapsed: bool = True,
             summary: Summary | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles, max of every numeric parameter.

    A ``summary`` of the same samples leaves one scan to do.
    """
    columns = ["flight_id", "parameter", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if summary is not None and quantiles == "exact":
        m = summary.table.filter(F.col("n_numeric") > 0).withColumnRenamed("n_valid", "count")
        m = m if include_elapsed else m.filter(F.col("parameter") != ELAPSED_COLUMN)
        return m.join(summary_quartiles(samples, summary), ["flight_id", "parameter"], "left").select(columns)
    v = F.col("value")
    s = numeric(samples, include_elapsed)
    m = (s.groupBy("flight_id", "parameter")
         .agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
              F.min(v).alias("min"), F.max(v).alias("max"), *_brackets(v, quantiles)))
    return _with_quartiles(m, s, quantiles).select(columns)


def statistics(samples: DataFrame, parameters: Sequence[str] | None = None,
               quantiles: str = "exact") -> DataFrame:
    """Extended statistics of the requested numeric parameters (D3).

    Absent, text and all-missing parameters are left out. Skewness and
    kurtosis are bias-corrected (sample) values.
    """
    s = numeric(samples)
    if parameters is not None:
        s = s.filter(F.col("parameter").isin(list(parameters)))
    v = F.col("value")
    s = s.filter(v.isNotNull())
    out = (s.groupBy("flight_id", "parameter")
           .agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"), F.max(v).alias("max"),
                sample_skewness(v).alias("skewness"), sample_kurtosis(v).alias("kurtosis"), *_brackets(v, quantiles)))
    out = _with_quartiles(out, s, quantiles, ("q25", "median", "q75"))
    return out.select("flight_id", "parameter", "count", "mean", "std", "min", "max", "median", "q25", "q75",
                      (F.col("max") - F.col("min")).alias("range"), "skewness", "kurtosis")


def ranges(samples: DataFrame) -> DataFrame:
    """Min, max, mean, std of every numeric parameter but elapsed."""
    v = F.col("value")
    return (numeric(samples, include_elapsed=False).groupBy("flight_id", "parameter")
            .agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
                 F.stddev_samp(v).alias("std")))


def report_statistics(samples: DataFrame) -> DataFrame:
    """Mean, std, min, max, range of every numeric parameter but elapsed."""
    return ranges(samples).withColumn("range", F.col("max") - F.col("min"))
