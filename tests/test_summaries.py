"""Distinct counts, quantile brackets, limits and file layouts without needless shuffles or scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolytics import session
from aerolytics.operators import export, limits, outliers, quality, stats
from aerolytics.plans import quantiles as Q
from tests.helpers import rows_by, series_samples


def test_sketch_brackets_give_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(0, 1, 30_000), "steps": rng.integers(0, 50, 20_000).astype(float), "two": np.repeat([0.0, 1.0], 5000),
              "tail": rng.exponential(1e6, 5000), "few": rng.normal(0, 1, 100), "constant": np.full(9000, 2.5),
              "inf": np.concatenate([rng.normal(0, 1, 6000), [np.inf] * 10, [-np.inf] * 9])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x]
    random.Random(1).shuffle(rows)
    probs = [0.25, 0.5, 0.75, 0.0, 1.0, 0.999]
    got = Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", probs)
    for r in got.collect():
        want = np.quantile(groups[r.g], probs[r.q_index])
        assert r.quantile == pytest.approx(want, rel=1e-12, nan_ok=True), (r.g, probs[r.q_index])


def test_a_rank_that_its_bracket_misses_is_still_found(spark, monkeypatch):
    monkeypatch.setattr(Q, "SPREAD", 0.0)
    monkeypatch.setattr(Q, "ACCURACY", 20)
    monkeypatch.setattr(Q, "SKETCH_ROWS", 10)
    values = np.random.default_rng(2).normal(0, 1, 20_000)
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = {r.q_index: r.quantile for r in Q.exact_quantiles(df, ["g"], "v", [0.1, 0.5]).collect()}
    assert [got[0], got[1]] == pytest.approx(np.quantile(values, [0.1, 0.5]).tolist(), rel=1e-12)


def test_low_variety_matches_plain_counts(spark):
    rng = random.Random(3)
    n = 4000
    s = series_samples(spark, {"f": {
        "varied": [rng.random() for _ in range(n)], "steps": [float(i % 20) for i in range(n)], "edge": [float(i % 40) for i in range(n)],
        "under": [float(i % 39) for i in range(n)], "same": [4.0] * n, "blank": [None] * n, "sparse": [1.0] + [None] * (n - 1),
        "zero": [0.0 if i % 2 else -0.0 for i in range(n)]}}).repartition(4)
    got = {r.parameter: (r.n_valid, r.n_distinct) for r in quality.low_variety(s).collect()}
    assert got["steps"] == (n, 20) and got["under"] == (n, 39) and got["same"] == (n, 1) and got["blank"] == (0, 0)
    assert got["edge"] == (n, None) and got["varied"] == (n, None) and got["sparse"] == (1, 1) and got["zero"] == (n, 1)
    codes = {(r.column, r.code) for r in quality.quality_issues(s).collect()}
    assert codes == {("steps", "LOW_VARIETY"), ("under", "LOW_VARIETY"), ("same", "CONSTANT"), ("sparse", "CONSTANT"),
                     ("zero", "CONSTANT"), ("blank", "EMPTY_COLUMN")}
    assert {r.parameter for r in quality.constant_parameters(s).collect()} == {"same", "sparse", "zero"}


def test_a_sketch_that_errs_is_made_good(spark, monkeypatch):
    """Were the estimate far too high, too few values would be looked at: the count is then taken in full."""
    monkeypatch.setattr(F, "approx_count_distinct", lambda c, rsd=None: F.count(c) * 1000)
    s = series_samples(spark, {"f": {"steps": [float(i % 20) for i in range(4000)], "varied": [i / 7 for i in range(4000)]}})
    assert {r.parameter: r.n_distinct for r in quality.low_variety(s).collect()}["steps"] == 20


@pytest.mark.parametrize("scattered", [False, True])
def test_duplicate_timestamps_in_order_or_scattered(spark, scattered):
    rng = random.Random(4)
    times = sorted(rng.randrange(500) for _ in range(900))
    rows = [("a", i, t) for i, t in enumerate(times)] + [("b", i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "flight_id string, row_no long, t long")
    df = df.repartition(6) if scattered else df.repartitionByRange(6, "flight_id", "t", "row_no").sortWithinPartitions("t")
    ts = df.select("flight_id", F.timestamp_add("SECOND", "t", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("ts"))
    got = {r.flight_id: (r.n_rows, r.n_distinct, r.duplicates) for r in quality.duplicate_timestamps(None, ts).collect()}
    assert got == {"a": (900, len(set(times)), 900 - len(set(times))), "b": (50, 50, 0)}


@pytest.mark.parametrize("method", ["zscore", "iqr"])
def test_outliers_from_a_summary_are_the_same(spark, method):
    rng = np.random.default_rng(6)
    s = series_samples(spark, {"f": {"a": [*rng.normal(0, 1, 200).tolist(), 50.0, None], "b": [1.0] * 202},
                               "g": {"a": [*rng.normal(9, 2, 50).tolist(), -90.0]}}).repartition(3)
    keys = ("flight_id", "row_no", "parameter", "value", "is_outlier")
    plain = rows_by(outliers.outliers(s, ["a", "b"], method, 2.0), *keys)
    assert rows_by(outliers.outliers(s, ["a", "b"], method, 2.0, stats.parameter_summary(s)), *keys) == plain
    assert sum(r[4] for r in plain) >= 2


def test_describe_and_limits_from_a_summary_are_the_same(spark):
    rng = np.random.default_rng(7)
    s = series_samples(spark, {"f": {"a": rng.normal(0, 1, 5000).tolist(), "b": [None] * 5000}}).repartition(3)
    summary = stats.parameter_summary(s)
    keys = ("flight_id", "parameter", "count", "min", "q25", "q50", "q75", "max")
    assert rows_by(stats.describe(s, summary=summary), *keys) == rows_by(stats.describe(s), *keys)
    lim = spark.createDataFrame([("a", -1.0, 1.0)], "parameter string, min double, max double")
    keys = ("flight_id", "parameter", "status", "min_value")
    assert rows_by(limits.limit_check(s, lim, summary), *keys) == rows_by(limits.limit_check(s, lim), *keys)


def test_stored_tables_can_be_removed(spark):
    path = f"{session.checkpoint_dir(spark)}/to-remove/t"
    spark.range(3).write.parquet(path)
    assert session.remove_stored(spark, "to-remove") and not session.remove_stored(spark, "to-remove")
    for bad in ("", "/etc", "../x"):
        with pytest.raises(ValueError):
            session.remove_stored(spark, bad)


def test_limit_check_reads_the_samples_once(spark, tmp_path):
    series_samples(spark, {"f": {"a": [1.0, 9.0], "b": [2.0, 2.0]}, "g": {"b": [3.0, 3.0]}}).write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    lim = spark.createDataFrame([("a", 2.0, 8.0), ("c", 0.0, 1.0)], "parameter string, min double, max double")
    out = limits.limit_check(s, lim)
    assert rows_by(out, "flight_id", "parameter", "status") == [("f", "a", "above"), ("f", "a", "below"), ("g", None, "none")]
    assert len(re.findall("FileScan parquet|Scan parquet", out._jdf.queryExecution().optimizedPlan().toString()
                          + out._jdf.queryExecution().sparkPlan().toString())) == 1


def test_file_layout_splits_long_flights_and_writes_one_file_per_part(spark, tmp_path, monkeypatch):
    s = series_samples(spark, {"long": {"a": [float(i) for i in range(400)], "b": [1.0] * 400}, "s1": {"a": [1.0, 2.0]}, "s2": {"z": [3.0]}})
    s = s.repartition(7)
    whole = export.file_layout(s)
    assert {r.flight_id: r.part_rows for r in whole.flights.collect()} == {"long": 400, "s1": 2, "s2": 1}
    monkeypatch.setattr(export.file_layout, "__defaults__", (None, 4000))
    export.export_json(s, str(tmp_path / "j"))
    export.export_csv(s, str(tmp_path / "c"))
    export.export_bundle(s, str(tmp_path / "b"))
    n_bytes = 400 * 4 * export.CELL_BYTES  # three parameters in all flights and the elapsed time
    files = {k: [p for p in (tmp_path / k).rglob("part-*") if p.suffix != ".crc" and "flight_id" in str(p)] for k in "jcb"}
    assert len(files["j"]) == len(files["c"]) == 2 + -(-n_bytes // 4000)
    assert len(files["b"]) <= 3 + n_bytes // 4000
    for p in files["c"]:
        text = p.read_text().splitlines()
        assert text[0].startswith("Timestamp,") and not any(x.startswith("Timestamp") for x in text[1:])
    stamps = [line.split(",")[0] for p in sorted(files["c"]) if "flight_id=long" in str(p) for line in p.read_text().splitlines()[1:]]
    assert len(stamps) == 400 and len(set(stamps)) == 400


def test_duration_text_has_two_decimals_and_no_commas(spark):
    s = series_samples(spark, {"f": {"a": [1.0] * 3}}, dt=6172.8395).withColumn("value", F.col("value"))
    assert [r.duration_text for r in export.export_metadata(s, "d").collect()] == [f"{2 * 6172.8395:.2f}"]
    assert [r.t for r in spark.createDataFrame([(0.125,), (1.005,), (None,)], "v double")
            .select(export._two_decimals("v").alias("t")).collect()] == ["0.12", "1.00", None]
