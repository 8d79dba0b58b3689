"""The registered queries: one Spark builder per operator, each over the
driver tables (or data Spark derives from them), and its DuckDB twin.

Shared conventions, identical on both sides: every computed column is
aliased; doubles are rounded as round(x * 10^d) / 10^d (ties away from zero
in both engines) plus 0.0 (no negative zero).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.functions.timestamps import TS_FORMATS
from aerolytics.operators import (corr, export, ingest, limits, ordered, outliers, quality, report, select,
                                  series, spectrum, stats, templates)
from aerolytics.plans.quantiles import quantile_columns
from aerolytics.session import checkpoint_dir, materialize
from aerolytics.sources import tables
from aerolytics.sources.recordings import read_recordings, write_recordings

# The limits table the limit-check query uses.
QUERY_LIMITS = [("value", 0.0, 250.0), ("k", 10.0, 99.0), ("Elapsed Time (s)", 0.0, 3.0e6),
                ("absent parameter", 0.0, 1.0)]
INFINITE_VALUE_EVERY = 500
MIXED_TEXT_FLIGHTS = ["click", "error"]
QUERY_CHARTS = [
    {"id": "c1", "title": "Values", "type": "line", "parameters": ("value", "k"), "x_axis": "Elapsed Time (s)"},
    {"id": "c2", "title": "Key", "type": "bar", "parameters": ("k",), "x_axis": "Timestamp"},
]
EXPORT_DATE = "2024-02-01T00:00:00"
VALID_REQUEST = ["VALUE (deg)", "NOTE", "ALTITUDE (ft)", "K"]


def rnd(c: Column | str, d: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** d)
    return F.round(c * F.lit(s), 0) / F.lit(s) + F.lit(0.0)


def _rounded(df: DataFrame, cols: dict[str, int]) -> DataFrame:
    return df.select(*[rnd(c, cols[c]).alias(c) if c in cols else F.col(c) for c in df.columns])


# --- data every query starts from -------------------------------------------

def ev(spark, sf):
    return tables.events_samples(spark, sf)


def ev_null(spark, sf):
    return tables.events_samples(spark, sf, with_nulls=True)


def li(spark, sf):
    return tables.lineitem_samples(spark, sf)


def li_extra(spark, sf):
    return tables.lineitem_samples(spark, sf, extra=True)


def ev_unordered(spark, sf, with_nulls=False):
    return tables.events_samples(spark, sf, with_nulls=with_nulls, numbered=False)


def li_unordered(spark, sf):
    return tables.lineitem_samples(spark, sf, numbered=False)


_INGEST_CACHE: dict = {}


def recording(spark, sf) -> ingest.Recording:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INGEST_CACHE:
        # The event-derived text is itself a shuffle; store it once, as a
        # recording file would be, since ingest reads its input three times.
        _INGEST_CACHE[key] = ingest.ingest(materialize(tables.events_lines(spark, sf)))
    return _INGEST_CACHE[key]


def part_params(spark, sf, special=True):
    p = tables.part_parameters(spark, sf)
    return select.with_special_columns(p) if special else p


# --- Spark builders -----------------------------------------------------------

def q_ingest_cells(spark, sf):
    return recording(spark, sf).cells


def q_ingest_schema(spark, sf):
    return recording(spark, sf).parameters


def q_ingest_samples(spark, sf):
    return _rounded(recording(spark, sf).samples, {"elapsed_s": 6, "value": 6})


def q_ingest_flights(spark, sf):
    return _rounded(recording(spark, sf).flights,
                    {"duration_s": 6, "median_interval_s": 6, "sampling_rate_hz": 12})


def q_ingest_issues(spark, sf):
    return recording(spark, sf).issues


def q_elapsed(spark, sf):
    return _rounded(ordered.elapsed_gaps(ev(spark, sf)), {"gap_s": 6})


def q_sampling_rate(spark, sf):
    return _rounded(ordered.sampling(ev(spark, sf)), {"median_interval_s": 6, "sampling_rate_hz": 12})


def q_duplicate_timestamps(spark, sf):
    s = ev(spark, sf).withColumn("ts", F.date_trunc("hour", F.col("ts")))
    return quality.duplicate_timestamps(s)


def q_constant_low_variety(spark, sf):
    return _rounded(quality.variety(li_extra(spark, sf)), {"first_value": 6})


def q_empty_columns(spark, sf):
    s = li_extra(spark, sf)
    blank = (s.filter(F.col("parameter") == ELAPSED_COLUMN)
             .withColumn("parameter", F.lit("blank")).withColumn("value", F.lit(None).cast("double")))
    both = s.unionByName(blank)
    kept = quality.drop_empty(both).groupBy("flight_id").agg(F.count_distinct("parameter").alias("n_kept"))
    return quality.empty_parameters(both).join(kept, "flight_id")


def q_overview(spark, sf):
    return _rounded(stats.overview(ev_unordered(spark, sf)), {"duration_min": 6})


def q_describe(spark, sf):
    return _rounded(stats.describe(li_unordered(spark, sf)),
                    {c: 4 for c in ("mean", "std", "min", "q25", "q50", "q75", "max")})


def q_statistics(spark, sf):
    out = stats.statistics(ev_unordered(spark, sf, True), ["value", "k", "absent"])
    return _rounded(out, {c: 6 for c in ("mean", "std", "min", "max", "median", "q25", "q75", "range",
                                         "skewness", "kurtosis")})


def q_ranges(spark, sf):
    return _rounded(stats.ranges(li_unordered(spark, sf)), {"min": 4, "max": 4, "mean": 4, "std": 4})


def q_report_statistics(spark, sf):
    return _rounded(stats.report_statistics(li_unordered(spark, sf)),
                    {"min": 4, "max": 4, "mean": 4, "std": 4, "range": 4})


def q_missing_values(spark, sf):
    return quality.missing_values(ev_unordered(spark, sf, True))


def q_missing_summary(spark, sf):
    return quality.missing_summary(ev_unordered(spark, sf, True))


def q_correlation_matrix(spark, sf):
    return _rounded(corr.correlation(li_extra(spark, sf)), {"r": 6})


def q_correlation_labels(spark, sf):
    out = corr.correlation_labels(li_extra(spark, sf), ["l_quantity", "tax_gaps", "absent"])
    return _rounded(out, {"r": 6})


def _limits_df(spark):
    return spark.createDataFrame(QUERY_LIMITS, "parameter string, min double, max double")


def q_limit_check(spark, sf):
    out = limits.limit_check(ev_unordered(spark, sf), _limits_df(spark))
    return _rounded(out, {"min_value": 6, "max_value": 6})


def q_outliers_zscore(spark, sf):
    return outliers.outliers(ev_null(spark, sf), ["value", "k"], "zscore", 3.0)


def q_outliers_iqr(spark, sf):
    return outliers.outliers(ev_null(spark, sf), ["value"], "iqr", 1.5)


def q_outliers_isolation(spark, sf):
    return outliers.outliers(ev_null(spark, sf), ["value"], "isolation", 2.5)


def q_every_kth_row(spark, sf):
    return _rounded(ordered.every_kth(ev(spark, sf)), {"elapsed_s": 6, "value": 6})


def q_mean_time_step(spark, sf):
    return _rounded(ordered.mean_time_step(ev(spark, sf)),
                    {"first_elapsed_s": 6, "last_elapsed_s": 6, "dt_s": 6})


def q_first_value(spark, sf):
    return _rounded(ordered.first_values(ev(spark, sf)), {"first_value": 6})


def q_fft(spark, sf):
    out = spectrum.fft_spectrum(tables.hourly_counts_samples(spark, sf))
    return _rounded(out, {"frequency_hz": 12, "amplitude": 6})


def q_psd_welch(spark, sf):
    out = spectrum.welch_psd(ev(spark, sf), ["value"])
    out = out.withColumn("psd_db", 10.0 * F.log10(F.col("psd"))).drop("psd")
    return _rounded(out, {"frequency_hz": 12, "psd_db": 6})


def q_spectrum_dispatch(spark, sf):
    s = ev(spark, sf)
    out = (spectrum.spectrum(s, ["value", "absent"], "fft")
           .unionByName(spectrum.spectrum(s, ["k"], "welch")))
    return _rounded(out, {"frequency_hz": 12, "amplitude": 3})


def q_fft_large(spark, sf):
    """The distributed transform, forced for every series, on data the small path also takes."""
    out = spectrum.fft_spectrum(tables.hourly_counts_samples(spark, sf), single_task_max=8)
    return _rounded(out, {"frequency_hz": 12, "amplitude": 6})


def q_quantiles_large(spark, sf):
    """Quartiles by histogram refinement, forced for every group above 500 values."""
    out = quantile_columns(li_unordered(spark, sf), ["flight_id", "parameter"], "value", [0.25, 0.5, 0.75],
                           ["q25", "q50", "q75"], final_rows=500)
    return _rounded(out, {c: 4 for c in ("q25", "q50", "q75")})


def ev_inf(spark, sf):
    """Event samples whose ``value`` is infinite on every INFINITE_VALUE_EVERY-th row of a flight."""
    every = F.col("row_no") % INFINITE_VALUE_EVERY == 0
    return ev(spark, sf).withColumn("value", F.when(every & (F.col("parameter") == "value"), F.lit(float("inf")))
                                    .otherwise(F.col("value")))


def q_outliers_zscore_inf(spark, sf):
    return outliers.outliers(ev_inf(spark, sf), ["value", "k"], "zscore", 3.0).drop("value")


def q_outliers_iqr_inf(spark, sf):
    return outliers.outliers(ev_inf(spark, sf), ["value"], "iqr", 1.5).drop("value")


def q_correlation_missing(spark, sf):
    """The matrix of parameters of which one has no value at all and two never share a row."""
    s = li_extra(spark, sf)
    odd = F.col("row_no") % 2 == 1
    first = F.col("parameter") == "l_tax"
    s = s.withColumn("value", F.when(first & odd, None).when((F.col("parameter") == "tax_gaps") & ~odd, None)
                     .when(F.col("parameter") == "l_discount", None).otherwise(F.col("value")))
    return _rounded(corr.correlation(s), {"r": 6})


def q_series_scatter_xy(spark, sf):
    spec = {"id": "c3", "type": "scatter", "parameters": ["value"], "x_axis": "k"}
    return _rounded(series.series(ev(spark, sf), spec).drop("x_ts", "x_text", "y_text", "baseline", "axis"),
                    {"x": 6, "y": 6})


def q_categories(spark, sf):
    return select.categories(part_params(spark, sf))


def q_quick_selectors(spark, sf):
    return select.quick_selectors(part_params(spark, sf))


def q_templates(spark, sf):
    t = templates.template_charts(part_params(spark, sf))
    return t.withColumn("parameters", F.array_join("parameters", ", "))


def q_layout_limit(spark, sf):
    t = series.layout_charts(templates.template_charts(part_params(spark, sf)), "1x2")
    return t.withColumn("parameters", F.array_join("parameters", ", "))


def q_valid_parameters(spark, sf):
    p = recording(spark, sf).parameters
    v = select.valid_parameters(select.available_parameters(p), VALID_REQUEST)
    return v.join(p.select("flight_id", "parameter", "is_numeric"), ["flight_id", "parameter"])


def q_series_line(spark, sf):
    spec = {"id": "c0", "type": "line", "parameters": ["value", "k", "absent"]}
    return _rounded(series.series(ev(spark, sf), spec).drop("x_ts", "x_text", "y_text", "baseline", "axis"),
                    {"x": 6, "y": 6})


def q_series_area(spark, sf):
    spec = {"id": "c1", "type": "area", "parameters": ["l_quantity", "l_discount"]}
    return _rounded(series.series(li(spark, sf), spec).drop("x_ts", "x_text", "y_text", "axis"),
                    {"x": 6, "y": 6, "baseline": 6})


def q_series_two_axes(spark, sf):
    return _rounded(series.two_axis_series(ev(spark, sf), ["value"], ["k", "absent"])
                    .drop("x_ts", "x_text", "y_text", "baseline"), {"x": 6, "y": 6})


def q_series_timestamp_bar(spark, sf):
    spec = {"id": "c2", "type": "bar", "parameters": ["k"], "x_axis": "Timestamp"}
    return _rounded(series.series(ev(spark, sf), spec).drop("x", "x_text", "y_text", "baseline", "axis"), {"y": 6})


def q_export_metadata(spark, sf):
    return _rounded(export.export_metadata(ev_null(spark, sf), EXPORT_DATE),
                    {"duration_s": 6, "sampling_rate_hz": 12})


def q_validate_export(spark, sf):
    return export.validate_export(ev_null(spark, sf))


def q_export_roundtrip(spark, sf):
    path = _export_folder(spark)
    export.export_json(ev_null(spark, sf), path, EXPORT_DATE)
    schema = ("Timestamp string, k double, value double, `Elapsed Time (s)` double, flight_id string")
    back = spark.read.schema(schema).json(f"{path}/data")
    return _rounded(back.select("flight_id", "Timestamp", "k", "value",
                                F.col(ELAPSED_COLUMN).alias("elapsed_s")),
                    {"k": 6, "value": 6, "elapsed_s": 6})


def ev_mixed(spark, sf):
    """Flights with different columns; ``mixed`` is text in two of them and a number in the others."""
    s = ev_null(spark, sf)
    as_text = F.col("flight_id").isin(MIXED_TEXT_FLIGHTS)
    k = s.filter(F.col("parameter") == "k")
    mixed = k.withColumn("parameter", F.lit("mixed, kind")).withColumn(
        "text", F.when(as_text, F.concat(F.lit('t"'), F.coalesce(F.col("value").cast("int").cast("string"), F.lit("")))))
    mixed = mixed.withColumn("value", F.when(~as_text, F.col("value")))
    only = (s.filter((F.col("parameter") == "k") & (F.col("flight_id") == "click"))
            .withColumn("parameter", F.lit("only_click")).withColumn("value", F.col("value") * 2))
    return s.unionByName(mixed).unionByName(only)


def _export_folder(spark):
    return f"{checkpoint_dir(spark)}/exports/{uuid.uuid4().hex}"


def _cell_parts(cells):
    """Long cells (flight_id, Timestamp, parameter, cell) -> text or rounded number."""
    is_text = F.col("cell").startswith("t")
    number = F.when(~is_text & (F.col("cell") != ""), F.col("cell").cast("double"))
    return cells.select("flight_id", F.col("stamp"), "parameter", F.when(is_text, F.col("cell")).alias("text"),
                        rnd(number).alias("value"))


def q_export_csv(spark, sf):
    """The CSV export read back: every cell under its own flight's header."""
    path = _export_folder(spark)
    export.export_csv(ev_mixed(spark, sf), path, True, EXPORT_DATE)
    raw = spark.read.text(f"{path}/data").withColumn("c", _csv_split("value"))
    head = F.get("c", F.lit(0)) == "Timestamp"
    names = raw.filter(head).select("flight_id", "part", F.col("c").alias("names"))
    rows = raw.filter(~head).join(names, ["flight_id", "part"])
    cells = rows.select("flight_id", F.get("c", F.lit(0)).alias("stamp"),
                        F.explode(F.slice(F.arrays_zip("names", "c"), F.lit(2), F.size("names"))).alias("z"))
    return _cell_parts(cells.select("flight_id", "stamp", F.col("z.names").alias("parameter"), F.col("z.c").alias("cell")))


def _csv_split(column):
    """Cells of a CSV line with quoted cells (the quotes go)."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col(column)), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(
        F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def q_export_json_mixed(spark, sf):
    """The JSON export read back as maps: columns and kinds are the flight's own."""
    path = _export_folder(spark)
    export.export_json(ev_mixed(spark, sf), path, EXPORT_DATE)
    raw = spark.read.text(f"{path}/data").select("flight_id", F.from_json("value", "map<string,string>").alias("m"))
    cells = raw.select("flight_id", F.try_element_at("m", F.lit("Timestamp")).alias("stamp"), F.explode("m")
                       .alias("parameter", "cell")).filter(F.col("parameter") != "Timestamp")
    return _cell_parts(cells.withColumn("cell", F.coalesce("cell", F.lit(""))))


def q_export_plain_csv(spark, sf):
    """The CSV export without metadata: lines and bytes of each flight's files, and whether metadata was written."""
    path = _export_folder(spark)
    export.export_csv(ev_null(spark, sf), path, False)
    raw = spark.read.text(f"{path}/data")
    head = F.col("value").startswith("Timestamp,")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/metadata")
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return raw.groupBy("flight_id").agg(F.count_if(~head).alias("n_rows"), F.max(F.when(head, F.col("value"))).alias("header"),
                                        F.lit(there).alias("metadata"))


def q_export_json_metadata(spark, sf):
    """The metadata of the JSON export read back, column list and chart configurations included."""
    path = _export_folder(spark)
    export.export_json(ev_mixed(spark, sf), path, EXPORT_DATE, QUERY_CHARTS)
    meta = spark.read.json(f"{path}/metadata")
    chart = F.from_json("charts", "array<struct<id string, title string, type string, parameters array<string>>>")
    charts = F.transform(chart, lambda c: F.concat_ws(":", c["id"], c["type"], c["title"], F.concat_ws("+", c["parameters"])))
    return meta.select("flight_id", "export_date", "data_points", "n_parameters", "n_columns", rnd("duration_s").alias("duration_s"),
                       "duration_text", "charts_count", F.concat_ws("|", "columns").alias("columns"),
                       F.concat_ws("|", charts).alias("charts"))


def q_export_bundle(spark, sf):
    """The bundle's flight data read back."""
    path = _export_folder(spark)
    export.export_bundle(ev_mixed(spark, sf), path, (), EXPORT_DATE)
    rows = spark.read.parquet(f"{path}/flight_data")
    cells = rows.select("flight_id", F.date_format("Timestamp", export.CSV_TIME).alias("stamp"), F.explode("cells").alias("c"))
    return cells.select("flight_id", "stamp", F.col("c.parameter").alias("parameter"), F.col("c.text").alias("text"),
                        rnd(F.col("c.value")).alias("value"))


def q_auto_report(spark, sf):
    return _rounded(report.auto_report_long(ev_null(spark, sf), _limits_df(spark), QUERY_CHARTS), {"value": 4})


def q_ingest_files(spark, sf):
    """The event recordings written as files, in parts per flight, and read back from disk.

    One folder name holds a space; its recording is too short and is refused,
    which the result shows as a row with the refusal as parameter.
    """
    path = f"{checkpoint_dir(spark)}/recordings/{uuid.uuid4().hex}"
    short = spark.createDataFrame([("too short", 0, "Description,A"), ("too short", 1, "EU,-")],
                                  "flight_id string, line_no long, line string")
    lines = tables.events_lines(spark, sf).unionByName(short)
    write_recordings(lines, path)
    rec = ingest.ingest(read_recordings(spark, path, flight_id_from="parts"))
    folder = F.regexp_extract("flight_id", "flight_id=([^/]+)", 1)
    samples = _rounded(rec.samples, {"elapsed_s": 6, "value": 6})
    refused = rec.issues.filter(F.col("code") == "TOO_FEW_LINES").select("flight_id", F.col("code").alias("parameter"))
    return (samples.unionByName(refused, allowMissingColumns=True).withColumn("flight_id", folder))


def q_report_tables(spark, sf):
    return _rounded(report.report_long(li_extra(spark, sf), QUERY_CHARTS), {"value": 4})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_cells": q_ingest_cells,
    "ingest_schema": q_ingest_schema,
    "ingest_samples": q_ingest_samples,
    "ingest_flights": q_ingest_flights,
    "ingest_issues": q_ingest_issues,
    "elapsed": q_elapsed,
    "sampling_rate": q_sampling_rate,
    "duplicate_timestamps": q_duplicate_timestamps,
    "constant_low_variety": q_constant_low_variety,
    "empty_columns": q_empty_columns,
    "overview": q_overview,
    "describe": q_describe,
    "statistics": q_statistics,
    "ranges": q_ranges,
    "report_statistics": q_report_statistics,
    "missing_values": q_missing_values,
    "missing_summary": q_missing_summary,
    "correlation_matrix": q_correlation_matrix,
    "correlation_labels": q_correlation_labels,
    "correlation_missing": q_correlation_missing,
    "quantiles_large": q_quantiles_large,
    "limit_check": q_limit_check,
    "outliers_zscore": q_outliers_zscore,
    "outliers_iqr": q_outliers_iqr,
    "outliers_isolation": q_outliers_isolation,
    "outliers_zscore_inf": q_outliers_zscore_inf,
    "outliers_iqr_inf": q_outliers_iqr_inf,
    "every_kth_row": q_every_kth_row,
    "mean_time_step": q_mean_time_step,
    "first_value": q_first_value,
    "fft": q_fft,
    "fft_large": q_fft_large,
    "psd_welch": q_psd_welch,
    "spectrum_dispatch": q_spectrum_dispatch,
    "categories": q_categories,
    "quick_selectors": q_quick_selectors,
    "templates": q_templates,
    "layout_limit": q_layout_limit,
    "valid_parameters": q_valid_parameters,
    "series_line": q_series_line,
    "series_area": q_series_area,
    "series_two_axes": q_series_two_axes,
    "series_scatter_xy": q_series_scatter_xy,
    "series_timestamp_bar": q_series_timestamp_bar,
    "export_metadata": q_export_metadata,
    "validate_export": q_validate_export,
    "export_roundtrip": q_export_roundtrip,
    "export_csv": q_export_csv,
    "export_plain_csv": q_export_plain_csv,
    "export_json_mixed": q_export_json_mixed,
    "export_json_metadata": q_export_json_metadata,
    "export_bundle": q_export_bundle,
    "auto_report": q_auto_report,
    "ingest_files": q_ingest_files,
    "report_tables": q_report_tables,
}

__all__ = ["QUERIES", "TS_FORMATS", "rnd"]
