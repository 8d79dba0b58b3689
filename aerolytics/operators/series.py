"""Chart series (G1-G7): the data each chart configuration selects.

Drawing is not done here; ``series(samples, spec)`` returns the points a chart
would draw as a DataFrame ``(flight_id, chart_id, series_no, parameter,
row_no, x, x_ts, x_text, y, y_text, baseline, axis)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN, TIMESTAMP_COLUMN
from aerolytics.operators.ordered import every_kth
from aerolytics.operators.spectrum import spectrum

# Chart types, defaults, x columns and grid sizes.
CHART_TYPES = ["line", "scatter", "bar", "area", "frequency"]
DEFAULT_TYPE = "line"
DEFAULT_COLOR = "viridis"
X_AXES = [ELAPSED_COLUMN, TIMESTAMP_COLUMN]
LAYOUT_CAPACITY = {"1x1": 1, "1x2": 2, "2x2": 4, "3x2": 6, "2x3": 6, "1x4": 4}
DEFAULT_LAYOUT = "2x2"

SERIES_SCHEMA = ("flight_id string, chart_id string, series_no int, parameter string, row_no long, "
                 "x double, x_ts timestamp_ntz, x_text string, y double, y_text string, baseline double, axis string")


@dataclass(frozen=True)
class SeriesSpec:
    """One chart configuration."""

    id: str
    title: str = ""
    type: str = DEFAULT_TYPE
    parameters: Sequence[str] = field(default_factory=tuple)
    x_axis: str = ELAPSED_COLUMN
    y_axis_label: str = ""
    color_scheme: str = DEFAULT_COLOR
    freq_type: str = "fft"

    @staticmethod
    def from_dict(d: dict) -> "SeriesSpec":
        return SeriesSpec(id=str(d.get("id", "")), title=d.get("title", ""), type=d.get("type", DEFAULT_TYPE),
                          parameters=tuple(d.get("parameters", ())), x_axis=d.get("x_axis", ELAPSED_COLUMN),
                          y_axis_label=d.get("y_axis_label", ""), color_scheme=d.get("color_scheme", DEFAULT_COLOR),
                          freq_type=d.get("freq_type", "fft"))


def _empty(samples: DataFrame) -> DataFrame:
    return samples.sparkSession.createDataFrame([], SERIES_SCHEMA)


def _points(samples: DataFrame, spec: SeriesSpec, axis: str = "y1", first_no: int = 0) -> DataFrame:
    req = samples.sparkSession.createDataFrame(
        [(first_no + i, p) for i, p in enumerate(spec.parameters)], "series_no int, parameter string")
    s = samples.join(F.broadcast(req), "parameter")  # req: the chart's own parameter list
    x, x_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if spec.x_axis == ELAPSED_COLUMN:
        x = F.col("elapsed_s")
    elif spec.x_axis not in X_AXES:
        # Another parameter: its cell of the same row; a flight without it has no points.
        across = samples.filter(F.col("parameter") == spec.x_axis).select(
            "flight_id", "row_no", F.col("value").alias("_x"), F.col("text").alias("_x_text"))
        s = s.join(across, ["flight_id", "row_no"])
        x, x_text = F.col("_x"), F.col("_x_text")
    x_ts = F.col("ts") if spec.x_axis == TIMESTAMP_COLUMN else F.lit(None).cast("timestamp_ntz")
    return s.select("flight_id", F.lit(spec.id).alias("chart_id"), "series_no", "parameter", "row_no",
                    x.alias("x"), x_ts.alias("x_ts"), x_text.alias("x_text"), F.col("value").alias("y"), F.col("text").alias("y_text"),
                    F.lit(None).cast("double").alias("baseline"), F.lit(axis).alias("axis"))


def series(samples: DataFrame, spec: SeriesSpec | dict) -> DataFrame:
    """Points of one chart (G1-G4, G6). x is the elapsed time, the timestamp or
    any parameter. No parameters or an x column that no flight has give no rows; an unknown type draws as a line; ``frequency`` returns the
    spectrum instead (see ``frequency_series``)."""
    if isinstance(spec, dict):
        spec = SeriesSpec.from_dict(spec)
    if not spec.parameters:
        return _empty(samples)
    kind = spec.type if spec.type in CHART_TYPES else DEFAULT_TYPE
    if kind == "frequency":
        return frequency_series(samples, spec)
    base = every_kth(samples) if kind == "bar" else samples
    pts = _points(base, spec)
    if kind == "area":
        w = Window.partitionBy("flight_id", "row_no").orderBy("series_no")
        pts = pts.withColumn("baseline", F.when(F.row_number().over(w) == 1, F.lit(0.0))
                             .otherwise(F.lag("y").over(w)))
    return pts


def frequency_series(samples: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Spectrum of the chart's parameters (S3); elapsed time is used
    whatever the x column says."""
    sp = spectrum(samples, list(spec.parameters), "fft" if spec.freq_type == "fft" else "psd")
    req = samples.sparkSession.createDataFrame(
        [(i, p) for i, p in enumerate(spec.parameters)], "series_no int, parameter string")
    return (sp.join(F.broadcast(req), "parameter")
            .select("flight_id", F.lit(spec.id).alias("chart_id"), "series_no", "parameter",
                    F.col("bin").alias("row_no"), F.col("frequency_hz").alias("x"),
                    F.lit(None).cast("timestamp_ntz").alias("x_ts"), F.lit(None).cast("string").alias("x_text"),
                    F.col("amplitude").alias("y"),
                    F.lit(None).cast("string").alias("y_text"), F.lit(None).cast("double").alias("baseline"),
                    F.lit(spec.freq_type).alias("axis")))


def two_axis_series(samples: DataFrame, primary: Sequence[str], secondary: Sequence[str],
                    chart_id: str = "multi_axis") -> DataFrame:
    """Primary and secondary parameter lists on elapsed time (G5); absent
    names are skipped."""
    p = _points(samples, SeriesSpec(id=chart_id, parameters=tuple(primary)), "y1")
    s = _points(samples, SeriesSpec(id=chart_id, parameters=tuple(secondary)), "y2", first_no=len(primary))
    return p.unionByName(s)


def layout_limit(charts: Sequence, layout: str = DEFAULT_LAYOUT) -> list:
    """The charts a grid shows: the first ``capacity`` of them (G7); an
    unknown grid is 2x2."""
    return list(charts)[: LAYOUT_CAPACITY.get(layout, LAYOUT_CAPACITY[DEFAULT_LAYOUT])]


def layout_charts(charts: DataFrame, layout: str = DEFAULT_LAYOUT) -> DataFrame:
    """``layout_limit`` on a chart table (flight_id, template, chart_id, ...):
    the first charts of each flight and template by chart number."""
    k = LAYOUT_CAPACITY.get(layout, LAYOUT_CAPACITY[DEFAULT_LAYOUT])
    no = F.regexp_extract(F.col("chart_id"), r"(\d+)$", 1).cast("int")
    return charts.filter(no < k)
