"""Cell parsers against pandas' coercing parsers (timestamp formats, numbers)."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolytics.functions import TS_FORMATS, parse_number, parse_timestamp, py_strip

TS_CASES = {
    0: ["198:10:20:30.5", "1:2:3:4.1", "000:01:01:01.1", "366:00:00:00.1", "367:00:00:00.1", "001:24:00:00.1",
        "001:23:59:60.1", "001:23:59:61.123456789", "001:23:60:00.1", "001:01:01:01", "001:01:01:01.1234567891",
        "01:01:01:01.5", "2024-01-01 01:01:01.5", "0:01:01:01.1"],
    1: ["2024-01-05 01:02:03.5", "2024-1-5 1:2:3.5", "2024-02-30 01:02:03.5", "2024-01-05 01:02:60.5",
        "2024-01-05 24:00:00.5", "2024-01-05T01:02:03.5", "2024-01-05 01:02:03", "2023-02-29 00:00:00.1",
        "2024-02-29 00:00:00.1", "2024-01-05  01:02:03.5", "0001-01-01 00:00:00.1", "2024-01-05 01:02:03.",
        "1677-09-21 00:12:43.1", "2262-04-11 23:47:17.0"],
    2: ["2024-01-05 01:02:03", "2024-1-5 1:2:3", "2024-01-05 01:02:03.5", "2024-01-05 01:02:61", "2024-13-05 01:02:03"],
    3: ["01:02:03.5", "1:2:3.5", "23:59:60.5", "23:59:61.5", "24:00:00.5", "01:02:03", "01:02:03.1234567891"],
    4: ["01:02:03", "1:2:3", "23:59:60", "23:59:61", "01:02:03.5", "24:00:00", "23:59:62"],
}
NUMBERS = ["1d", "1f", "1e400", "0x1A", "1_000", "inf", "Infinity", "nan", "+5", ".5", "5.", "True", "-inf", "+inf",
           "INF", "1e5", "1E+05", "1,5", "-0", "1.5e-3", "e5", ".", "-.5", "+.5e2", "iNf", "1e-400", "9" * 400, ""]


@pytest.mark.parametrize("fmt", range(5))
def test_timestamp_formats_match_pandas(spark, fmt):
    cells = TS_CASES[fmt]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = {r.c: r.t for r in df.select("c", parse_timestamp(F.col("c"), fmt).alias("t")).collect()}
    for c in cells:
        p = pd.to_datetime(pd.Series([c]), format=TS_FORMATS[fmt], errors="coerce")[0]
        want = None if pd.isna(p) else p.to_pydatetime()
        assert got[c] == want, (fmt, c)


def test_numbers_match_pandas(spark):
    df = spark.createDataFrame([(c,) for c in NUMBERS], "c string")
    got = {r.c: r.x for r in df.select("c", parse_number(F.col("c")).alias("x")).collect()}
    want = pd.to_numeric(pd.Series(NUMBERS, dtype=object), errors="coerce")
    for c, w in zip(NUMBERS, want):
        w = None if (w is None or (isinstance(w, float) and math.isnan(w))) else float(w)
        assert got[c] == w, c


def test_strip_is_python_strip(spark):
    texts = ["  a ", "\ta\r", "　a ", "\x1ca\x1f", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(py_strip(F.col("t")).alias("s")).collect()]
    assert got == [t.strip() for t in texts]
