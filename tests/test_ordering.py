"""Blocked row numbering and previous-row lookup across many small blocks,
with one flight holding most rows, against plain flight-wide windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerolytics.plans.ordering import dense_row_number, keep_not_null, previous_values


def _data(spark):
    rows = [("hot", i, float((i * 37) % 101)) for i in range(0, 3000, 3)]
    rows += [("cold", i, float(i)) for i in range(0, 40, 7)]
    return spark.createDataFrame(rows, "flight_id string, line_no long, v double")


def test_dense_row_number_across_blocks(spark):
    df = _data(spark)
    got = dense_row_number(df, ["flight_id"], ["line_no"], F.shiftright(F.col("line_no"), 4))
    want = df.withColumn("row_no", F.row_number().over(Window.partitionBy("flight_id").orderBy("line_no")) - 1)
    assert sorted(got.select("flight_id", "line_no", "row_no").collect()) == \
        sorted(want.select("flight_id", "line_no", F.col("row_no").cast("long")).collect())


def test_counted_rows_only(spark):
    df = _data(spark).withColumn("keep", F.col("v") % 2 == 0)
    got = dense_row_number(df, ["flight_id"], ["line_no"], F.shiftright(F.col("line_no"), 3),
                           counted=F.col("keep")).filter("keep")
    kept = df.filter("keep")
    want = kept.withColumn("row_no", F.row_number().over(Window.partitionBy("flight_id").orderBy("line_no")) - 1)
    assert sorted(got.select("flight_id", "line_no", "row_no").collect()) == \
        sorted(want.select("flight_id", "line_no", F.col("row_no").cast("long")).collect())


def test_previous_values_across_blocks(spark):
    df = dense_row_number(_data(spark), ["flight_id"], ["line_no"], F.shiftright(F.col("line_no"), 4))
    got = previous_values(df, ["flight_id"], ["v"], bits=3)
    want = df.withColumn("prev_v", F.lag("v").over(Window.partitionBy("flight_id").orderBy("row_no")))
    assert sorted(got.select("flight_id", "row_no", "prev_v").collect()) == \
        sorted(want.select("flight_id", "row_no", "prev_v").collect())


def test_keep_not_null(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 6.0)], "k int, x double")
    assert [r.k for r in keep_not_null(df, "x").orderBy("k").collect()] == [2, 4]
