"""Passes over many lines and long series: compiled code, one split per line, bounded memory."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolytics.operators import spectrum
from aerolytics.operators.ingest import ingest
from aerolytics.plans.ordering import range_row_number
from aerolytics.session import materialize
from aerolytics.sources.recordings import lines_from_text, read_recordings

TEXT = "\n".join(["Description,A,Elapsed Time (s),B,NOTE", "EU,deg,s,-,-", "10:00:00,1, 9 , 2 ,x", "10:00:01,3", "",
                  "10:00:02,,1e400,inf, y ,extra,more", "bad,5,5,5,z", "10:00:61,4,8,7,"])


@pytest.fixture
def recording(spark):
    lines = lines_from_text(spark, {"f": TEXT, "only time": "Description\nEU\n10:00:00\n10:00:01"})
    return ingest(materialize(lines.coalesce(1)))


def _method_bytes(spark, df) -> int:
    """The largest method Spark generates for a plan; the JVM compiles those of up to 8,000 bytes."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size()))


def test_typed_samples_are_compiled(spark, recording):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (recording.samples, recording._parts["kept"].select("flight_id", "ts")):
            assert 0 < _method_bytes(spark, df.select(*df.columns)) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_cells_of_short_and_long_lines(recording):
    got = {(r["row_no"], r["parameter"]): (r["text"], r["value"]) for r in recording.samples.collect()}
    assert {p for _, p in got} == {"A (deg)", "Elapsed Time (s) (s)", "B", "NOTE", "Elapsed Time (s)"}
    assert [got[i, "Elapsed Time (s)"] for i in range(4)] == [(None, 0.0), (None, 1.0), (None, 2.0), (None, 61.0)]
    assert [got[i, "NOTE"] for i in range(4)] == [("x", None), ("", None), ("y", None), ("", None)]
    assert [got[i, "B"] for i in range(4)] == [("2", None), ("", None), ("inf", None), ("7", None)]
    assert len(got) == 20


def test_stored_columns_of_numbered_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("f"), (F.col("id") * 7 % 500).alias("ts"), F.col("id").alias("k"))
    got = range_row_number(df, ["f"], ["ts", "k"], "n", block_rows=100, stored={"text": F.concat_ws("-", "ts", "k")})
    assert got.columns == ["f", "text", "n"]
    want = {}
    for i in sorted(range(500), key=lambda i: (i % 3, i * 7 % 500, i)):
        want.setdefault(i % 3, []).append(f"{i * 7 % 500}-{i}")
    assert {(r["f"], r["n"]): r["text"] for r in got.collect()} == {(f, n): t for f, ts in want.items() for n, t in enumerate(ts)}


def test_paths_are_decoded_once_per_split(spark, tmp_path):
    (tmp_path / "a b+c%d.csv").write_text("1\n2")
    lines = read_recordings(spark, str(tmp_path))
    plan = lines._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "urlcodec" not in plan and "url_decode" not in plan
    assert sorted(tuple(r) for r in lines.collect()) == [("a b+c%d", 0, "1"), ("a b+c%d", 1, "2")]


def test_fft_of_one_series_in_few_bytes_a_point():
    n = 1 << 17
    x = np.random.default_rng(3).normal(size=n)
    row = np.random.default_rng(4).permutation(n)
    series = pa.table({"flight_id": pa.repeat(pa.scalar("f"), n), "parameter": pa.repeat(pa.scalar("p"), n),
                       "row_no": row, "elapsed_s": row * 0.5, "value": x[row]})
    tracemalloc.start()
    try:
        out = spectrum._fft_group(series)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 * n and spectrum.FFT_SINGLE_TASK_MAX <= 1 << 20
    np.testing.assert_allclose(out["amplitude"].to_numpy(), 2 / n * np.abs(np.fft.fft(x)[:n // 2]), atol=1e-12)
    np.testing.assert_array_equal(out["frequency_hz"].to_numpy(), np.fft.fftfreq(n, 0.5)[:n // 2])
