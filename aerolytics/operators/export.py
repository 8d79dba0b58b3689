"""Exports (B1-B8): CSV and JSON folders, the table bundle, metadata, validation.

Every flight is written with its own columns in file order; no list of columns
over all flights exists anywhere, and a parameter that is text in one flight and
a number in another keeps both. One small table, a row per flight and column,
is read from the samples first; it gives the column lists, the metadata and the
file layout: a flight is cut into parts of about ``FILE_BYTES``, every part is
one self-contained file below ``flight_id=.../part=...``, and parts are dealt to
as many tasks as the whole has such sizes, small flights together. So files
number at most the flights plus the bytes by the target, and cells are shuffled
once, by part. Nothing is collected on the driver.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from aerolytics.functions.text import ELAPSED_COLUMN, TIMESTAMP_COLUMN
from aerolytics.operators.ordered import sampling
from aerolytics.operators.quality import missing_summary
from aerolytics.operators.stats import describe
from aerolytics.schema import numeric
from aerolytics.session import join_small, materialize_counted

# Formats really written, and the CSV metadata title.
EXPORT_FORMATS = ["csv", "json", "parquet"]
CSV_TITLE = "Flight Data Export"
# Bytes of a file, and of a written cell, assumed for the layout.
FILE_BYTES, CELL_BYTES = 128 << 20, 24
CSV_TIME, JSON_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def export_formats() -> list[str]:
    """Formats this package writes."""
    return list(EXPORT_FORMATS)


def _placed(samples: DataFrame, parameters: DataFrame | None) -> DataFrame:
    """Samples with ``place``: column order, elapsed last, by file position if ``parameters`` tells it."""
    s, position = samples, F.lit(0)
    if parameters is not None:
        s = join_small(samples, parameters.select("flight_id", "parameter", F.col("position").alias("_pos")),
                       ["flight_id", "parameter"], "left")
        position = F.coalesce(F.col("_pos"), F.lit(0))
    return s.withColumn("place", F.struct((F.col("parameter") == ELAPSED_COLUMN).alias("last"),
                                          position.alias("position"), F.col("parameter").alias("name")))


@dataclass
class Layout:
    """What the files of an export follow from; ``flights`` has one row per flight."""

    flights: DataFrame  # flight_id, columns, n_columns, data_points, duration_s, part_rows
    n_flights: int
    n_tasks: int


def file_layout(samples: DataFrame, parameters: DataFrame | None = None, file_bytes: int = FILE_BYTES) -> Layout:
    """One scan of the samples: each flight's columns in order, its size, and how many rows make a file."""
    is_el = F.col("place")["last"]
    per = _placed(samples, parameters).groupBy("flight_id", "place").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("place")["last"], F.col("value"))).alias("last"),
        F.max("row_no").alias("last_row"))
    names = F.transform(F.array_sort(F.collect_list("place")), lambda p: p["name"])
    n_bytes = F.sum("n") * CELL_BYTES
    files = F.ceil(n_bytes / file_bytes)
    flights, n = materialize_counted(per.groupBy("flight_id").agg(
        names.alias("columns"), F.count_if(~is_el).alias("n_parameters"),
        F.coalesce(F.sum(F.when(is_el, F.col("n"))), F.lit(0)).alias("data_points"), F.max("last").alias("duration_s"),
        n_bytes.alias("n_bytes"), F.ceil((F.max("last_row") + 1) / files).alias("part_rows")))
    total = flights.agg(F.sum("n_bytes")).first()[0] or 0
    return Layout(flights, n, max(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes)))


def column_lists(samples: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """(flight_id, columns): the parameter names of each flight in column order."""
    return file_layout(samples, parameters).flights.select("flight_id", "columns")


def records(samples: DataFrame, parameters: DataFrame | None = None, layout: Layout | None = None) -> DataFrame:
    """One row per (flight, row): Timestamp and the row's cells in column order.

    ``cells`` is array<struct<parameter, text, value>>; its length is the row's
    own number of columns. Grouping by (flight, row) spreads a large flight;
    with a ``layout`` the rows also have ``part`` and lie together by part, in
    order, after the same single shuffle.
    """
    cell = F.struct("place", "parameter", "text", "value")
    s, keys = _placed(samples, parameters), ["flight_id", "row_no"]
    if layout is not None:
        keys = ["flight_id", "part", "row_no"]
        s = join_small(s, layout.flights.select("flight_id", "part_rows"), "flight_id", n_rows=layout.n_flights)
        s = s.withColumn("part", F.floor(F.col("row_no") / F.col("part_rows")).cast("long")).repartition(
            layout.n_tasks, "flight_id", "part")
    rows = s.groupBy(*keys).agg(F.first("ts").alias(TIMESTAMP_COLUMN), F.array_sort(F.collect_list(cell)).alias("_c"))
    if layout is not None:
        rows = rows.sortWithinPartitions(*keys)
    cells = F.transform("_c", lambda c: F.struct(c["parameter"].alias("parameter"), c["text"].alias("text"),
                                                 c["value"].alias("value")))
    return rows.select(*keys, TIMESTAMP_COLUMN, cells.alias("cells"))


def _json_string(c: Column) -> Column:
    """A JSON string literal: the only element of a JSON list, without its brackets."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _csv_cell(c: Column) -> Column:
    return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _write_lines(lines: DataFrame, path: str) -> None:
    """Lines (flight_id, part, line), lying together by part, as one file per flight and part."""
    lines.select("flight_id", "part", "line").write.mode("overwrite").partitionBy("flight_id", "part").text(path)


@F.pandas_udf(StringType())
def _two_decimals(v: pd.Series) -> pd.Series:
    """The number with two decimals, rounded from its exact binary value (one row per flight)."""
    return v.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


def _metadata(layout: Layout, export_date: str | None, n_charts: int) -> DataFrame:
    """Per flight, from the layout's table alone: date, points, parameters (columns - 2), columns (all), duration."""
    export_date = export_date or _dt.datetime.now().isoformat()
    return layout.flights.select(
        "flight_id", F.lit(export_date).alias("export_date"), "data_points", "n_parameters",
        (F.col("n_parameters") + 2).alias("n_columns"), "duration_s", _two_decimals("duration_s").alias("duration_text"),
        F.lit(n_charts).alias("charts_count"))


def export_metadata(samples: DataFrame, export_date: str | None = None, n_charts: int = 0,
                    layout: Layout | None = None) -> DataFrame:
    """Per flight: export date, points, parameters (columns - 2), columns
    (all), duration (s, max elapsed), sampling rate (1 / median gap, no
    guard), chart count (B5, B6)."""
    rate = sampling(samples).select("flight_id", F.try_divide(F.lit(1.0), F.col("median_interval_s"))
                                    .alias("sampling_rate_hz"))
    return (_metadata(layout or file_layout(samples), export_date, n_charts).join(rate, "flight_id", "left")
            .select("flight_id", "export_date", "data_points", "n_parameters", "n_columns", "duration_s", "duration_text",
                    "sampling_rate_hz", "charts_count"))


def validate_export(samples: DataFrame) -> DataFrame:
    """Rows (flight_id, severity, code, n) (B7). Warnings: no elapsed
    column, no numeric column, columns with missing values; info: points,
    columns, numeric columns (elapsed counts as numeric). Samples without any
    row give one error row without a flight."""
    is_el = F.col("parameter") == ELAPSED_COLUMN
    base = samples.groupBy("flight_id").agg(
        F.count_if(is_el).alias("points"),
        F.count_distinct(F.when(~is_el, F.col("parameter"))).alias("_p"),
        F.count_distinct(F.when(F.col("text").isNull(), F.col("parameter"))).alias("numeric_columns"),
        F.bool_or(is_el).alias("has_elapsed"))
    miss = missing_summary(samples).select("flight_id", "n_columns_with_missing")
    b = base.join(miss, "flight_id", "left")
    cols = (F.col("_p") + F.when(F.col("has_elapsed"), 2).otherwise(1))

    def row(sev, code, n, cond=F.lit(True)):
        return b.filter(cond).select("flight_id", F.lit(sev).alias("severity"), F.lit(code).alias("code"),
                                     n.cast("long").alias("n"))

    nothing = samples.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == 0).select(
        F.lit(None).cast("string").alias("flight_id"), F.lit("error").alias("severity"), F.lit("NO_DATA").alias("code"),
        "n")
    return (nothing.unionByName(row("warning", "NO_ELAPSED_COLUMN", F.lit(0), ~F.col("has_elapsed")))
            .unionByName(row("warning", "NO_NUMERIC_COLUMN", F.lit(0), F.col("numeric_columns") == 0))
            .unionByName(row("warning", "MISSING_VALUES", F.col("n_columns_with_missing"),
                             F.col("n_columns_with_missing") > 0))
            .unionByName(row("info", "DATA_POINTS", F.col("points")))
            .unionByName(row("info", "PARAMETERS", cols))
            .unionByName(row("info", "NUMERIC_PARAMETERS", F.col("numeric_columns"))))


def export_csv(samples: DataFrame, path: str, include_metadata: bool = True,
               export_date: str | None = None, parameters: DataFrame | None = None) -> None:
    """CSV per flight under ``path/data`` (B1, B2): a header and one line per
    row, missing cells empty; the metadata head as ``path/metadata`` (JSON lines)."""
    layout = file_layout(samples, parameters)
    rows = join_small(records(samples, parameters, layout), layout.flights.select("flight_id", "columns"), ["flight_id"],
                      n_rows=layout.n_flights)
    cells = F.map_from_entries(F.transform("cells", lambda c: F.struct(
        c["parameter"], F.coalesce(_csv_cell(c["text"]), c["value"].cast("string"), F.lit("")))))
    body = F.transform("columns", lambda n: F.coalesce(F.try_element_at(F.col("_cells"), n), F.lit("")))
    head = F.concat_ws(",", F.lit(TIMESTAMP_COLUMN), F.concat_ws(",", F.transform("columns", _csv_cell)))
    # The part's first line brings the header; the rows lie by part already.
    first = F.row_number().over(Window.partitionBy("flight_id", "part").orderBy("row_no")) == 1
    data = rows.withColumn("_cells", cells).select("flight_id", "part", "row_no", first.alias("first"), head.alias("head"), F.concat_ws(
        ",", F.date_format(TIMESTAMP_COLUMN, CSV_TIME), F.concat_ws(",", body)).alias("line"))
    data = data.select("flight_id", "part", F.explode(
        F.when(F.col("first"), F.array("head", "line")).otherwise(F.array("line"))).alias("line"))
    _write_lines(data, f"{path}/data")
    if include_metadata:
        (_metadata(layout, export_date, 0).withColumn("title", F.lit(CSV_TITLE))
         .write.mode("overwrite").json(f"{path}/metadata"))


def export_json(samples: DataFrame, path: str, export_date: str | None = None, charts: Sequence[dict] = (),
                parameters: DataFrame | None = None) -> None:
    """JSON records per flight with ISO dates and explicit nulls (B3, B4);
    ``path/metadata`` holds the metadata with column list and chart configurations."""
    layout = file_layout(samples, parameters)
    pairs = F.transform("cells", lambda c: F.concat(_json_string(c["parameter"]), F.lit(":"), F.when(
        c["text"].isNotNull(), _json_string(c["text"])).otherwise(F.coalesce(c["value"].cast("string"), F.lit("null")))))
    stamp = F.concat(F.lit(f'"{TIMESTAMP_COLUMN}":"'), F.date_format(TIMESTAMP_COLUMN, JSON_TIME), F.lit('"'))
    lines = records(samples, parameters, layout).select(
        "flight_id", "part", F.concat(F.lit("{"), F.concat_ws(",", stamp, F.concat_ws(",", pairs)), F.lit("}")).alias("line"))
    _write_lines(lines, f"{path}/data")
    configurations = F.lit(json.dumps([dict(c, parameters=list(c.get("parameters", ()))) for c in charts]))
    (_metadata(layout, export_date, len(charts)).join(layout.flights.select("flight_id", "columns"), "flight_id")
     .withColumn("columns", F.concat(F.array(F.lit(TIMESTAMP_COLUMN)), F.col("columns")))
     .withColumn("charts", configurations).write.mode("overwrite").json(f"{path}/metadata"))


def chart_table(spark, charts: Sequence) -> DataFrame:
    """Chart configurations as a table, parameters joined by ', ' (B5)."""
    rows = [(str(c.get("id", "")), c.get("title", ""), c.get("type", ""), ", ".join(c.get("parameters", [])),
             c.get("x_axis", ""), c.get("y_axis_label", ""), c.get("color_scheme", "")) for c in charts]
    return spark.createDataFrame(rows, "id string, title string, type string, parameters string, x_axis string, "
                                       "y_axis_label string, color_scheme string")


def export_bundle(samples: DataFrame, path: str, charts: Sequence = (), export_date: str | None = None,
                  parameters: DataFrame | None = None) -> None:
    """The workbook's four tables as Parquet folders (B5): flight data (records
    in column order), statistics (describe of numeric columns, elapsed
    included), metadata, chart configurations."""
    layout = file_layout(samples, parameters)
    (records(samples, parameters, layout).drop("part").write.mode("overwrite").partitionBy("flight_id")
     .parquet(f"{path}/flight_data"))
    describe(samples).write.mode("overwrite").parquet(f"{path}/statistics")
    export_metadata(samples, export_date, len(charts), layout).write.mode("overwrite").parquet(f"{path}/metadata")
    chart_table(samples.sparkSession, charts).write.mode("overwrite").parquet(f"{path}/chart_configurations")


__all__ = ["export_formats", "records", "column_lists", "export_metadata", "validate_export", "export_csv",
           "export_json", "export_bundle", "file_layout", "chart_table", "numeric", "TIMESTAMP_COLUMN"]
