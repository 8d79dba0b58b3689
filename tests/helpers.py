"""Small builders for literal test recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.schema import unpivot


def series_samples(spark, flights: dict[str, dict[str, list]], dt: float = 0.1):
    """flight -> {parameter -> values}; row i at elapsed i*dt."""
    rows = []
    for fid, params in flights.items():
        n = max(len(v) for v in params.values())
        for i in range(n):
            rec = {p: (v[i] if i < len(v) else None) for p, v in params.items()}
            rows.append((fid, i, float(i) * dt, rec))
    names = sorted({p for params in flights.values() for p in params})
    data = [(fid, i, el, *[None if rec.get(p) is None else float(rec[p]) for p in names]) for fid, i, el, rec in rows]
    schema = "flight_id string, row_no long, elapsed_s double, " + ", ".join(f"p{i} double" for i in range(len(names)))
    df = spark.createDataFrame(data, schema).withColumn(
        "ts", F.timestamp_add("MICROSECOND", (F.col("elapsed_s") * 1e6).cast("long"),
                              F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")))
    return unpivot(df, {p: f"p{i}" for i, p in enumerate(names)}, "flight_id", "row_no", "ts", "elapsed_s")


def rows_by(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=repr)


__all__ = ["series_samples", "rows_by", "ELAPSED_COLUMN"]
