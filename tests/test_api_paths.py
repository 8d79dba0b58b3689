"""API paths not covered elsewhere: skipped text limits, bundle export,
frequency charts, report dictionaries."""

from pyspark.sql import functions as F

from aerolytics.operators import export, limits, report, series
from aerolytics.operators.ingest import ingest
from aerolytics.sources.recordings import lines_from_text
from tests.helpers import series_samples


def test_limit_skips_text_parameters(spark):
    rec = ingest(lines_from_text(spark, {"f": "Description,A,B\nEU,-,-\n1:00:00:00.0,1,x\n1:00:00:01.0,2,y\n"}))
    lim = spark.createDataFrame([("A", 0.0, 1.5), ("B", 0.0, 1.0)], "parameter string, min double, max double")
    found = sorted((r.parameter, r.status) for r in limits.limit_check(rec.samples, lim).collect())
    assert found == [("A", "above")]
    assert [(r.flight_id, r.parameter) for r in limits.limit_skipped(rec.samples, lim).collect()] == [("f", "B")]


def test_export_bundle(spark, tmp_path):
    s = series_samples(spark, {"f": {"a": [1.0, 2.0, 4.0]}})
    charts = [{"id": "c", "title": "t", "type": "line", "parameters": ["a", "b"], "x_axis": "Elapsed Time (s)"}]
    export.export_bundle(s, str(tmp_path / "b"), charts, "2024-01-01T00:00:00")
    out = {n: spark.read.parquet(str(tmp_path / "b" / n)) for n in
           ("flight_data", "statistics", "metadata", "chart_configurations")}
    assert out["flight_data"].count() == 3
    st = {r.parameter: r for r in out["statistics"].collect()}
    assert st["a"].q50 == 2.0 and st["a"]["count"] == 3
    assert out["metadata"].first().charts_count == 1
    assert out["chart_configurations"].first().parameters == "a, b"


def test_frequency_chart_and_two_axes(spark):
    s = series_samples(spark, {"f": {"a": [float(i % 4) for i in range(64)], "b": [1.0] * 64}})
    fft = series.series(s, {"id": "f1", "type": "frequency", "parameters": ["a"], "freq_type": "fft"})
    assert fft.count() == 32
    psd = series.series(s, {"id": "f2", "type": "frequency", "parameters": ["a"], "freq_type": "psd"})
    assert psd.count() == 33
    two = series.two_axis_series(s, ["a"], ["b", "absent"])
    assert {r.axis for r in two.select("axis").distinct().collect()} == {"y1", "y2"}


def test_report_dictionaries(spark):
    s = series_samples(spark, {"f": {"a": [1.0, None, 3.0], "c": [2.0, 2.0, 2.0]}})
    lim = spark.createDataFrame([("a", 0.0, 2.0)], "parameter string, min double, max double")
    auto = report.auto_report_tables(s, lim)
    assert set(auto) == {"overview", "describe", "describe_timestamp", "missing", "limits"}
    assert auto["describe_timestamp"].first()["count"] == 3
    charts = [{"id": "c", "parameters": ["a"]}]
    assert report.flight_report_tables(s, charts)["charts"].first().id == "c"
    assert auto["limits"].first().status == "above"
    flight = report.flight_report_tables(s)
    assert [r.parameter for r in flight["constants"].collect()] == ["c"]
    assert flight["missing"].first().n_columns_with_missing == 1
    assert report.report_long(s).filter(F.col("section") == "statistics").count() == 10
