"""Data quality: empty, constant and low-variety parameters, duplicate
timestamps, missing values (A8-A10, D6-D8).

All are aggregates by (flight_id[, parameter]); Catalyst runs them partial
then final. Distinct values are counted where they lie or only as far as the
1 % threshold needs; ``variety``, which reports the count itself, plans
``count(DISTINCT ...)`` as a two-level aggregate keyed by the value.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.functions.numbers import round_half_even
from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.schema import numeric, rows_of
from aerolytics.session import join_small, materialize, materialize_counted

# Fixed value: distinct values below this share of the rows is "low variety".
LOW_VARIETY_SHARE = 0.01


def empty_parameters(samples: DataFrame) -> DataFrame:
    """Numeric parameters with no value at all: (flight_id, parameter)."""
    return (numeric(samples).groupBy("flight_id", "parameter")
            .agg(F.count("value").alias("n")).filter(F.col("n") == 0).drop("n"))


def drop_empty(samples: DataFrame) -> DataFrame:
    """Samples without the empty parameters."""
    return join_small(samples, empty_parameters(samples), ["flight_id", "parameter"], "left_anti")


def _timestamp_runs(rows: DataFrame) -> DataFrame:
    """(flight_id, low, high, n_rows, n_distinct) per partition and flight; times in microseconds.

    A task holds the distinct times of its own partition.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[np.ndarray]] = {}
        sizes: Counter = Counter()
        for batch in batches:
            flights = batch.column(0).dictionary_encode()
            code, micros = flights.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(flights.dictionary.to_pylist()):
                mine = micros[code == i] if len(flights.dictionary) > 1 else micros
                sizes[name] += len(mine)
                seen.setdefault(name, []).append(np.unique(mine))
        out = [(name, np.unique(np.concatenate(parts))) for name, parts in seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in out], pa.string()), pa.array([int(u[0]) for _, u in out], pa.int64()),
             pa.array([int(u[-1]) for _, u in out], pa.int64()), pa.array([sizes[f] for f, _ in out], pa.int64()),
             pa.array([len(u) for _, u in out], pa.int64())], ["flight_id", "low", "high", "n_rows", "n_distinct"])

    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz"))
    return (rows.filter(F.col("flight_id").isNotNull() & F.col("ts").isNotNull()).select("flight_id", micros.alias("ts"))
            .mapInArrow(read, "flight_id string, low long, high long, n_rows long, n_distinct long"))


def duplicate_timestamps(samples: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Rows minus distinct timestamps per flight.

    Partitions count their own distinct times. Where a flight's partitions follow
    each other in time, as recordings do, the counts add up (times that end one
    and begin the next count once); only flights whose partitions overlap are
    counted value by value. ``rows`` may give the sample rows (flight_id, ts).
    """
    rows = rows_of(samples) if rows is None else rows
    runs = materialize(_timestamp_runs(rows))
    before = Window.partitionBy("flight_id").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max("high").over(before)
    apart = runs.withColumn("overlap", F.coalesce(until > F.col("low"), F.lit(False))).withColumn(
        "shared", F.coalesce((until == F.col("low")).cast("int"), F.lit(0)))
    per = apart.groupBy("flight_id").agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_distinct") - F.sum("shared")).alias("n_distinct"),
                                         F.bool_or("overlap").alias("overlap"))
    mixed = materialize(per.filter("overlap").select("flight_id", "n_rows"))
    out = per.filter(~F.col("overlap")).select("flight_id", "n_rows", "n_distinct")
    n_mixed = mixed.count()
    if n_mixed:
        counted = (join_small(rows.select("flight_id", "ts"), mixed, "flight_id", n_rows=n_mixed)
                   .groupBy("flight_id", "n_rows").agg(F.count_distinct("ts").alias("n_distinct")))
        out = out.unionByName(counted)
    return out.withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))


def low_variety(samples: DataFrame) -> DataFrame:
    """(flight_id, parameter, n_rows, n_valid, n_distinct) of numeric parameters; ``n_distinct`` only below the share.

    A sketch in the first aggregate says how varied a parameter is. A varied
    one then counts distinct values only among a share of all possible values
    (by hash), so few are shuffled: if those alone reach the threshold it is
    proven not to be of low variety and its count stays NULL. Any other count
    is exact. One distinct value is known from the bounds.
    """
    keys, share = ["flight_id", "parameter"], LOW_VARIETY_SHARE
    s = numeric(samples).select(*keys, "value")
    per, n_per = materialize_counted(s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_valid"), F.min("value").alias("lo"),
        F.max("value").alias("hi"), F.approx_count_distinct("value", 0.05).alias("about")))
    constant = (F.col("n_valid") > 0) & F.col("lo").eqNullSafe(F.col("hi"))
    slots = 1 << 20
    # Four times the threshold's worth of values are looked at, all of them where there are not so many.
    looked = F.ceil(F.least(F.lit(1.0), 4 * share * F.col("n_rows") / F.greatest("about", F.lit(1))) * slots)
    asked = per.filter((F.col("n_valid") > 0) & ~constant).select(*keys, looked.alias("looked"))

    def distinct(groups: DataFrame) -> DataFrame:
        j = join_small(s.filter(F.col("value").isNotNull()), groups, keys, n_rows=n_per)
        return (j.filter(F.pmod(F.xxhash64("value"), F.lit(slots)) < F.col("looked")).groupBy(*keys, "looked")
                .agg(F.count_distinct("value").alias("seen")))

    found = materialize(asked.join(per.select(*keys, "n_rows"), keys).join(distinct(asked).drop("looked"), keys, "left")
                        .withColumn("seen", F.coalesce("seen", F.lit(0)))
                        .withColumn("proven", F.col("seen").cast("double") >= F.col("n_rows").cast("double") * F.lit(share)))
    exact = found.filter((F.col("looked") >= slots)).select(*keys, "seen")
    doubt = found.filter((F.col("looked") < slots) & ~F.col("proven")).select(*keys, F.lit(slots).cast("long").alias("looked"))
    if doubt.limit(1).count():  # the sketch erred by more than a factor of four
        exact = exact.unionByName(distinct(doubt).select(*keys, "seen"))
    below = exact.join(per.select(*keys, "n_rows"), keys).filter(
        F.col("seen").cast("double") < F.col("n_rows").cast("double") * F.lit(share)).select(*keys, "seen")
    return (per.join(below, keys, "left")
            .select(*keys, "n_rows", "n_valid", F.when(F.col("n_valid") == 0, F.lit(0)).when(constant, F.lit(1))
                    .otherwise(F.col("seen")).cast("long").alias("n_distinct")))


def variety(samples: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct values of each numeric parameter but elapsed.

    ``status`` is ``constant`` for one distinct value, ``low_variety`` when the
    distinct count is below 1 % of the rows, else NULL. ``first_value`` is the
    value on the first row (may be NULL). Empty parameters are left out (they
    are dropped before this check). ``approx`` uses a sketch for the distinct
    count.
    """
    distinct = F.approx_count_distinct("value") if approx else F.count_distinct("value")
    v = (numeric(samples, include_elapsed=False).groupBy("flight_id", "parameter")
         .agg(distinct.alias("n_distinct"), F.count(F.lit(1)).alias("n_rows"),
              F.min_by("value", "row_no").alias("first_value"), F.count("value").alias("_n_valid"))
         .filter(F.col("_n_valid") > 0).drop("_n_valid"))
    status = (F.when(F.col("n_distinct") == 1, F.lit("constant"))
              .when(F.col("n_distinct").cast("double") < F.col("n_rows").cast("double") * F.lit(LOW_VARIETY_SHARE),
                    F.lit("low_variety")))
    return v.withColumn("status", status)


def constant_parameters(samples: DataFrame) -> DataFrame:
    """(flight_id, parameter, first_value) of constant parameters (D8): the least value is the largest."""
    return (numeric(samples, include_elapsed=False).groupBy("flight_id", "parameter")
            .agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.min_by("value", "row_no").alias("first_value"))
            .filter(F.col("_lo") == F.col("_hi")).select("flight_id", "parameter", "first_value"))


def missing_values(samples: DataFrame) -> DataFrame:
    """Missing count and percent (2 decimals, half to even) per column with any.

    Text cells are never missing ('' is a value); the timestamp never is after ingest.
    """
    m = (samples.groupBy("flight_id", "parameter")
         .agg(F.count_if(F.col("value").isNull() & F.col("text").isNull()).alias("missing"),
              F.count(F.lit(1)).alias("n_rows")))
    return (m.filter(F.col("missing") > 0)
            .select("flight_id", "parameter", "missing",
                    round_half_even(F.col("missing").cast("double") / F.col("n_rows").cast("double") * 100.0, 2)
                    .alias("percent")))


def missing_summary(samples: DataFrame) -> DataFrame:
    """Per flight: any missing value, and how many columns have one."""
    m = (samples.groupBy("flight_id", "parameter")
         .agg(F.count_if(F.col("value").isNull() & F.col("text").isNull()).alias("missing")))
    return m.groupBy("flight_id").agg(F.bool_or(F.col("missing") > 0).alias("any_missing"),
                                      F.count_if(F.col("missing") > 0).alias("n_columns_with_missing"))


def quality_issues(samples: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Load-time quality notes as issue rows: duplicate timestamps, constant,
    low variety and empty parameters. ``rows`` may give the sample rows."""
    dup = duplicate_timestamps(samples, rows).filter(F.col("duplicates") > 0).select(
        "flight_id", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("column"),
        F.lit("DUPLICATE_TIMESTAMPS").alias("code"), F.col("duplicates").cast("long").alias("count"))
    nd = F.col("n_distinct")
    # A parameter has at most one of these notes.
    code = (F.when(F.col("n_valid") == 0, F.lit("EMPTY_COLUMN")).when(F.col("parameter") == ELAPSED_COLUMN, None)
            .when(nd == 1, F.lit("CONSTANT"))
            .when(nd.cast("double") < F.col("n_rows").cast("double") * F.lit(LOW_VARIETY_SHARE), F.lit("LOW_VARIETY")))
    found = low_variety(samples).withColumn("code", code).filter(F.col("code").isNotNull()).select(
        "flight_id", F.lit(None).cast("long").alias("line_no"), F.col("parameter").alias("column"), "code",
        nd.alias("count"))
    return dup.unionByName(found)


__all__ = ["empty_parameters", "drop_empty", "low_variety", "duplicate_timestamps", "variety", "constant_parameters",
           "missing_values", "missing_summary", "quality_issues", "ELAPSED_COLUMN"]
