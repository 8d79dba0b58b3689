"""Ingest from split state: numbering in place, its fallback, and the Python parsers against the column expressions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolytics.functions.numbers import parse_number
from aerolytics.functions.timestamps import with_timestamp
from aerolytics.operators import ingest as ingest_module
from aerolytics.operators import ingest_state
from aerolytics.operators.ingest import _reads_in_place, ingest
from aerolytics.plans.ordering import range_row_number
from aerolytics.sources.recordings import read_recordings
from tests.helpers import rows_by

COLUMNS = ("flight_id", "row_no", "parameter", "text", "value")


def recording(n, seed):
    rng = random.Random(seed)
    lines = ["Description,A,B", "EU,deg,-"]
    for i in range(n):
        bad = rng.random()
        stamp = "oops" if bad < 0.05 else f"001:00:{i // 60 % 60:02d}:{i % 60:02d}.{rng.randrange(10)}"
        lines.append("   " if bad > 0.95 else f"{stamp},{i},{'x' if i % 11 else ''}" + (",more" if i % 13 == 0 else ""))
    return lines


def by_hand(lines):
    """row_no -> value of A, straight from the text."""
    kept = [x.split(",") for x in lines[2:] if x.strip() and not x.startswith("oops")]
    return [(i, float(c[1])) for i, c in enumerate(kept)]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Recordings of several splits each (the session cuts files at 256 bytes), one of them most of the rows."""
    folder = tmp_path_factory.mktemp("rec")
    texts = {"hot": recording(250, 1), "small": recording(9, 2), "mid": recording(60, 3)}
    for name, lines in texts.items():
        (folder / f"{name}.csv").write_text("\n".join(["", " "] + lines + [""]))
    return read_recordings(spark, str(folder)), texts


def test_rows_are_numbered_where_they_lie(spark, files):
    lines, texts = files
    rec = ingest(lines)
    for name, text in texts.items():
        got = sorted((r.row_no, r.value) for r in rec.samples.where((F.col("flight_id") == name) & F.col("parameter").startswith("A")).collect())
        assert got == by_hand(text)
    assert _reads_in_place(rec.samples), "no line passes a shuffle"


def test_scattered_lines_give_the_same_samples(spark, files):
    lines, _ = files
    in_place, shuffled = ingest(lines).samples, ingest(lines.repartition(5)).samples
    assert not _reads_in_place(lines.repartition(5)) and _reads_in_place(shuffled)
    assert rows_by(in_place, *COLUMNS) == rows_by(shuffled, *COLUMNS)
    stored = spark.createDataFrame(lines.orderBy(F.rand(1)).collect(), lines.schema)  # a plain scan, out of order
    assert rows_by(ingest(stored).samples, *COLUMNS) == rows_by(in_place, *COLUMNS)


def test_numbering_beyond_the_broadcast_bound(spark, files, monkeypatch):
    lines, _ = files
    want = rows_by(ingest(lines).samples, *COLUMNS)
    monkeypatch.setattr(ingest_module, "BROADCAST_MAX_BYTES", 0)
    shuffled = ingest(lines).samples
    assert not _reads_in_place(shuffled) and rows_by(shuffled, *COLUMNS) == want


def test_null_flights_and_lines_are_left_out(spark):
    rows = [("f", 0, "Description,A"), ("f", 1, "EU,-"), ("f", 2, None), ("f", 3, "1:00:00:00.0,4"), (None, 0, "x"), (None, 3, None)]
    rec = ingest(spark.createDataFrame(rows, "flight_id string, line_no long, line string"))
    assert rows_by(rec.samples.where("parameter = 'A'"), "flight_id", "row_no", "value") == [("f", 0, 4.0)]


STAMPS = ["001:00:00:00.0", "366:23:59:61.999999999", "367:00:00:00.0", "0:0:0:0.1", "2024-02-29 1:2:3", "2023-02-29 1:2:3",
          "2024-12-31  23:59:60.5", "2024-1-5 1:2:3.", "1677-09-21 00:12:43", "1677-09-21 00:12:44", "2262-04-11 23:47:17",
          "0000-01-01 00:00:00", "10:00:00", "24:00:00", "9:9:9.123456789", "9:9:9.", "", "x", "2024-13-01 00:00:00", "1:2", "٣:00:00"]
NUMBERS = ["1", "-1.5", "+.5", "5.", ".", "", "1e5", "1E-400", "1e400", "-1e999", "inf", "-Infinity", "nan", "1d", "0x1A", "1_000",
           "True", "1,5", "9" * 400, "0." + "0" * 400 + "1", " 1", "٣"]


def test_split_parsers_agree_with_the_column_expressions(spark):
    kind, micros = ingest_state.timestamps(pa.array(STAMPS))
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    df = with_timestamp(spark.createDataFrame(list(enumerate(STAMPS)), "i int, c string"), "c")
    for r in df.select("i", "ts_shape", F.timestamp_diff("MICROSECOND", epoch, F.col("ts_any")).alias("us")).collect():
        want = (-1, 0) if r.us is None else (r.ts_shape, r.us)
        assert (kind[r.i], micros[r.i]) == want, STAMPS[r.i]
    ok = ingest_state.numeric_cells(pa.array(NUMBERS))
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, c string").select("i", parse_number(F.col("c")).isNotNull().alias("ok"))
    for r in df.collect():
        assert bool(ok[r.i]) == r.ok, NUMBERS[r.i]


def test_range_numbering_of_a_burst_is_even(spark):
    """90 % of a flight within one second: blocks follow the rows, not the clock."""
    burst = spark.range(18_000).select(F.lit("hot").alias("f"), (F.col("id") % 1000).alias("ts"), F.col("id").alias("k"))
    rest = spark.range(2_000).select(F.when(F.col("id") % 4 == 0, "cold").otherwise("hot").alias("f"),
                                     (F.col("id") * 100_000).alias("ts"), (F.col("id") + 50_000).alias("k"))
    df = burst.unionByName(rest).repartition(4)
    got = range_row_number(df, ["f"], ["ts", "k"], "n", block_rows=1000)
    w = Window.partitionBy("f").orderBy("ts", "k")
    want = df.withColumn("n", F.row_number().over(w) - 1)
    assert rows_by(got, "f", "ts", "k", "n") == rows_by(want, "f", "ts", "k", "n")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) <= 2 * 1000
