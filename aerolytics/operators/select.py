"""Parameter selectors (C1-C5, C11): lists, categories, quick selectors.

Input is a parameter table ``(flight_id, parameter, position)`` - from
ingest, or ``parameters_of(samples)`` for adapted tables. Top-k picks use
``row_number() <= k``, which Spark plans with a partial group limit before
the shuffle, so no flight's full list travels to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN, TIMESTAMP_COLUMN

# Category rules, first match wins, plain substrings of the
# lower-cased name.
CATEGORY_RULES = [
    ("Control Surfaces", ["aileron", "elevator", "rudder", "flap", "spoiler", "tab"]),
    ("Flight Angles", ["angle", "alpha", "beta", "aoa", "sideslip", "pitch", "roll", "yaw"]),
    ("Forces & Loads", ["force", "load", "strain", "stress", "moment", "torque"]),
    ("Positions & Commands", ["position", "cmd", "command", "stick", "pedal"]),
    ("Trim Settings", ["trim"]),
]
OTHER_CATEGORY = "Other Parameters"
# Quick selector buttons and how many names each picks.
QUICK_SELECTORS = [
    ("control", ["aileron", "elevator", "rudder", "flap"]),
    ("angle", ["angle", "alpha", "beta"]),
    ("force", ["force", "strain", "load"]),
]
QUICK_LIMIT = 4


def contains_any(name: Column, words: Sequence[str]) -> Column:
    low = F.lower(name)
    out = None
    for w in words:
        c = low.contains(w)
        out = c if out is None else (out | c)
    return out


def parameters_of(samples: DataFrame, with_special: bool = False) -> DataFrame:
    """(flight_id, parameter, position) from samples; position by name order
    (samples carry no column order). ``with_special`` adds the timestamp
    (position 0) and elapsed (last) columns."""
    p = samples.select("flight_id", "parameter").distinct().filter(F.col("parameter") != ELAPSED_COLUMN)
    w = Window.partitionBy("flight_id").orderBy("parameter")
    p = p.withColumn("position", F.row_number().over(w).cast("int"))
    if not with_special:
        return p
    return with_special_columns(p)


def with_special_columns(params: DataFrame) -> DataFrame:
    """Add ``Timestamp`` at position 0 and the elapsed column after the last."""
    base = params.select("flight_id", "parameter", F.col("position").cast("int"))
    last = base.groupBy("flight_id").agg((F.max("position") + 1).cast("int").alias("position"))
    ts = last.select("flight_id", F.lit(TIMESTAMP_COLUMN).alias("parameter"), F.lit(0).alias("position"))
    el = last.select("flight_id", F.lit(ELAPSED_COLUMN).alias("parameter"), "position")
    return base.unionByName(ts).unionByName(el)


def available_parameters(params: DataFrame) -> DataFrame:
    """All columns but the timestamp and elapsed."""
    return params.filter(~F.col("parameter").isin(TIMESTAMP_COLUMN, ELAPSED_COLUMN))


def numeric_parameters(params: DataFrame, include_elapsed: bool = False) -> DataFrame:
    """Numeric columns (C3); ``params`` needs ``is_numeric``."""
    p = params.filter(F.col("is_numeric"))
    return p if include_elapsed else p.filter(F.col("parameter") != ELAPSED_COLUMN)


def requested(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """A request as a tiny table (request_pos, parameter)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "request_pos int, parameter string")


def valid_parameters(params: DataFrame, names: Sequence[str]) -> DataFrame:
    """Requested names present in each flight, in request order."""
    req = requested(params.sparkSession, names)
    # req is the request list itself: its size is the request's
    return params.join(F.broadcast(req), "parameter").select("flight_id", "request_pos", "parameter")


def categories(params: DataFrame) -> DataFrame:
    """(flight_id, category, parameter, position): first matching rule wins;
    the timestamp and elapsed columns are skipped (C4). Empty categories do
    not appear."""
    p = available_parameters(params)
    cat = F.lit(OTHER_CATEGORY)
    for name, words in reversed(CATEGORY_RULES):
        cat = F.when(contains_any(F.col("parameter"), words), F.lit(name)).otherwise(cat)
    return p.select("flight_id", cat.alias("category"), "parameter", "position")


def quick_selectors(params: DataFrame, limit: int = QUICK_LIMIT) -> DataFrame:
    """First ``limit`` columns per selector in column order (C5); the search
    covers every column, the timestamp included."""
    parts = []
    for sel, words in QUICK_SELECTORS:
        parts.append(params.filter(contains_any(F.col("parameter"), words))
                     .select("flight_id", F.lit(sel).alias("selector"), "parameter", "position"))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("flight_id", "selector").orderBy("position")
    return u.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
