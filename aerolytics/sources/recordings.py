"""Recording files -> ``lines(flight_id, line_no, line)``.

Text is read with ``spark.read.text`` split on ``\\n`` only (a lone ``\\r`` is
data, as in the reference's ``split('\\n')``); ``\\r`` and other whitespace are
stripped from cells later. No CSV reader: commas are never quoted.

Line numbers follow file order without sorting a file in one task: every input
split is numbered locally from ``monotonically_increasing_id`` (contiguous
within a split), and a per-split count table gives each split its offset in
its file. That table has one row per split (input bytes / split size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aerolytics.session import join_small


#: Lines of a written part: 2^20, as in the exports.
PART_BITS = 20


def decoded_path(path: Column) -> Column:
    """A file path as it is on disk; the metadata column gives it URL-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def read_recordings(spark: SparkSession, paths: str | Sequence[str],
                    flight_id_from: str = "name") -> DataFrame:
    """Read recording files into ``lines``.

    ``flight_id_from``: ``"name"`` uses the file name without extension, but the
    path for files that share a name with another one read here; ``"path"``
    always the full path; ``"parts"`` the path of the folder over ``part=0``,
    ``part=1``, ..., whose files in this order are one recording (see
    ``write_recordings``). All are decoded (a space is a space). Spark cuts files
    by the cores it has: where executors come and go between two passes, set
    ``spark.sql.files.minPartitionNum`` so that both meet the same splits.
    """
    if isinstance(paths, str):
        paths = [paths]
    raw = (spark.read.option("lineSep", "\n").option("wholetext", "false").text(list(paths))
           .select(F.col("_metadata.file_path").alias("_file"),
                   F.col("_metadata.file_block_start").alias("_split"),
                   F.monotonically_increasing_id().alias("_id"),
                   F.col("value").alias("line")))
    # Lines carry the path as it is given; one row per split is decoded.
    splits = (raw.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .withColumn("_path", decoded_path(F.col("_file"))))
    fid, part = F.col("_path"), F.lit(0)
    if flight_id_from == "parts":
        fid = F.regexp_extract("_path", r"^(.*)/part=\d+/[^/]*$", 1)
        part = F.regexp_extract("_path", r"/part=(\d+)/[^/]*$", 1).cast("long")
    before = Window.partitionBy(fid).orderBy(part, "_path", "_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_path", "_split", "_first",
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if flight_id_from == "name":
        # One row per input split: a name that several files have names none of them.
        name = F.regexp_extract(F.col("_path"), r"([^/]+?)(\.[^./]*)?$", 1)
        paths = splits.groupBy(name.alias("_name")).agg(F.count_distinct("_path").alias("_paths"))
        splits = splits.withColumn("_name", name).join(paths, "_name")
        fid = F.when(F.col("_paths") == 1, F.col("_name")).otherwise(fid)
    lines = join_small(raw, splits.withColumn("_flight", fid).drop("_path"), ["_file", "_split"])
    fid = F.col("_flight")
    return lines.select(fid.alias("flight_id"),
                        (F.col("_off") + F.col("_id") - F.col("_first")).cast("long").alias("line_no"),
                        "line")


def write_recordings(lines: DataFrame, path: str, part_bits: int = PART_BITS) -> None:
    """Writes ``lines`` below ``path`` as ``flight_id=.../part=...``, one file per 2^part_bits lines.

    A file has one writer, so parts and not recordings are dealt to the tasks:
    a long recording is spread like many short ones. ``read_recordings`` with
    ``flight_id_from="parts"`` puts the parts together.
    """
    (lines.withColumn("part", F.shiftright("line_no", part_bits)).repartition("flight_id", "part")
     .sortWithinPartitions("flight_id", "part", "line_no")
     .select("flight_id", "part", "line").write.partitionBy("flight_id", "part").text(path))


def lines_from_text(spark: SparkSession, recordings: dict[str, str]) -> DataFrame:
    """Small in-memory recordings (flight_id -> file text) as ``lines``.

    For tests and single uploads: the text passes through the driver, so use
    ``read_recordings`` for anything large. The text is split on ``\\n`` only.
    """
    rows = [(fid, i, line) for fid, text in recordings.items() for i, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "flight_id string, line_no long, line string")
