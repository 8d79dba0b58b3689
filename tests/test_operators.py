"""Analytic operators on literal series, cross-checked with pandas / NumPy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.operators import (corr, export, limits, ordered, outliers, quality, select, series, spectrum,
                                  stats, templates)
from tests.helpers import series_samples

RNG = np.random.default_rng(7)
X = [float(v) for v in RNG.normal(10, 3, 200).round(3)]


def close(a, b, tol=1e-9):
    if a is None or b is None or (isinstance(b, float) and math.isnan(b)):
        return (a is None or (isinstance(a, float) and math.isnan(a))) and (
            b is None or (isinstance(b, float) and math.isnan(b)))
    return abs(a - b) <= tol * max(1.0, abs(b))


def test_describe_and_statistics_match_pandas(spark):
    data = {"x": X, "c": [5.0] * 200, "n1": [1.0] + [None] * 199, "n3": [1.0, 2.0, 4.0] + [None] * 197,
            "n4": [1.0, 2.0, 4.0, 8.0] + [None] * 196}
    s = series_samples(spark, {"f": data})
    d = {r.parameter: r for r in stats.describe(s).collect()}
    st = {r.parameter: r for r in stats.statistics(s).collect()}
    for p, vals in data.items():
        ser = pd.Series(vals, dtype=float)
        desc = ser.describe()
        r = d[p]
        assert r["count"] == desc["count"]
        for k, pk in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                      ("q75", "75%"), ("max", "max")):
            assert close(r[k], float(desc[pk])), (p, k)
        x = ser.dropna()
        e = st[p]
        skew, kurt = x.skew(), x.kurtosis()
        assert close(e["skewness"], None if pd.isna(skew) else float(skew), 1e-7), (p, e["skewness"], skew)
        assert close(e["kurtosis"], None if pd.isna(kurt) else float(kurt), 1e-7), (p, e["kurtosis"], kurt)
        assert close(e["range"], float(x.max() - x.min()))
    assert ELAPSED_COLUMN in d and ELAPSED_COLUMN in {r.parameter for r in stats.describe(s).collect()}
    assert ELAPSED_COLUMN not in {r.parameter for r in stats.ranges(s).collect()}


def test_missing_and_variety(spark):
    s = series_samples(spark, {"f": {"a": [1.0, None, 3.0, None], "b": [2.0, 2.0, 2.0, 2.0]}})
    m = {r.parameter: (r.missing, r.percent) for r in quality.missing_values(s).collect()}
    assert m == {"a": (2, 50.0)}
    v = {r.parameter: r.status for r in quality.variety(s).collect()}
    assert v == {"a": None, "b": "constant"}
    summ = quality.missing_summary(s).first()
    assert summ.any_missing and summ.n_columns_with_missing == 1


def test_correlation_pairwise_complete(spark):
    a = X[:50]
    b = [v * 2 + (i % 3) if i % 4 else None for i, v in enumerate(a)]
    c = [7.0] * 50
    d = [None] * 49 + [1.0]
    s = series_samples(spark, {"f": {"a": a, "b": b, "c": c, "d": d}})
    got = {(r.x, r.y): r.r for r in corr.correlation(s).collect()}
    want = pd.DataFrame({"a": a, "b": b, "c": c, "d": d}, dtype=float).corr()
    for (x, y), r in got.items():
        w = want.loc[x, y]
        assert close(r, None if pd.isna(w) else float(w), 1e-9), (x, y, r, w)
    assert got[("c", "c")] is None and got[("a", "a")] == pytest.approx(1.0)


def test_limit_check_cases(spark):
    s = series_samples(spark, {"f": {"below": [-1.0, 0.5], "above": [0.5, 2.0], "both": [-1.0, 2.0],
                                     "inside": [0.0, 1.0], "zero": [0.0, 0.0]},
                               "g": {"other": [1.0]}})
    lim = spark.createDataFrame([("below", 0.0, 1.0), ("above", 0.0, 1.0), ("both", 0.0, 1.0), ("inside", 0.0, 1.0),
                                 ("zero", 0.0, 0.0), ("unknown", 0.0, 1.0)], "parameter string, min double, max double")
    got = sorted((r.flight_id, r.parameter, r.status) for r in limits.limit_check(s, lim).collect())
    assert got == [("f", "above", "above"), ("f", "below", "below"), ("f", "both", "above"), ("f", "both", "below"),
                   ("f", "inside", "ok"), ("f", "zero", "ok"), ("g", None, "none")]


def test_outliers(spark):
    vals = [0.0] * 20 + [10.0, None]
    s = series_samples(spark, {"f": {"x": vals}})
    z = {r.row_no: r.is_outlier for r in outliers.outliers(s, "x", "zscore", 3.0).collect()}
    ser = pd.Series(vals, dtype=float).dropna()
    zs = ((ser - ser.mean()) / ser.std()).abs() > 3.0
    assert z[20] == bool(zs.iloc[20]) and z[21] is False and sum(z.values()) == int(zs.sum())
    iso = {r.row_no: r.is_outlier for r in outliers.outliers(s, "x", "isolation", 3.0).collect()}
    assert iso == z
    q = {r.row_no: r.is_outlier for r in outliers.outliers(s, "x", "iqr", 3.0).collect()}
    assert q[20] is True and q[0] is False
    assert outliers.outliers(s, "absent").count() == 0


@pytest.mark.parametrize("n,rows", [(49, 49), (50, 50), (99, 99), (100, 50), (101, 51), (149, 75)])
def test_every_kth(spark, n, rows):
    s = series_samples(spark, {"f": {"x": [float(i) for i in range(n)]}})
    got = ordered.every_kth(s).filter(F.col("parameter") == "x").count()
    assert got == rows


def test_gaps_step_first(spark):
    s = series_samples(spark, {"f": {"x": [3.0, 1.0, 2.0]}}, dt=0.5)
    assert [r.gap_s for r in ordered.elapsed_gaps(s).orderBy("row_no").collect()] == [0.5, 0.5]
    m = ordered.mean_time_step(s).first()
    assert m.dt_s == 0.5 and m.n_rows == 3
    assert ordered.sampling(s).first().sampling_rate_hz == 2.0
    fv = {r.parameter: r.first_value for r in ordered.first_values(s).collect()}
    assert fv["x"] == 3.0


def _np_welch(x, fs, nper=256):
    n = len(x)
    L = min(nper, n)
    step = L - L // 2
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(L) / L) if L > 1 else np.ones(1)
    ps = []
    for s0 in range(0, n - L + 1, step):
        seg = (x[s0:s0 + L] - x[s0:s0 + L].mean()) * win
        p = np.abs(np.fft.rfft(seg)) ** 2 / (fs * (win * win).sum())
        if L % 2:
            p[1:] *= 2
        else:
            p[1:-1] *= 2
        ps.append(p)
    return np.mean(ps, axis=0)


def test_fft_known_spectra(spark):
    n = 64
    t = np.arange(n)
    sig = {"sine": np.sin(2 * np.pi * 4 * t / n), "dc": np.full(n, 3.0), "impulse": (t == 0).astype(float)}
    odd = np.sin(2 * np.pi * 2 * np.arange(33) / 33)
    data = {k: [float(v) for v in a] for k, a in sig.items()}
    s = series_samples(spark, {"f": data, "g": {"odd_n": [float(v) for v in odd]},
                               "h": {"with_gap": [1.0, None, 3.0, 4.0]}}, dt=0.1)
    out = spectrum.fft_spectrum(s).toPandas()
    for fid, name, a in [("f", k, v) for k, v in sig.items()] + [("g", "odd_n", odd)]:
        got = out[(out.parameter == name) & (out.flight_id == fid)].sort_values("bin")
        m = len(a)
        want = 2.0 / m * np.abs(np.fft.fft(a)[: m // 2])
        assert np.allclose(got.amplitude.to_numpy(), want, atol=1e-12)
        assert np.allclose(got.frequency_hz.to_numpy(), np.fft.fftfreq(m, 0.1)[: m // 2])
    gap = out[(out.parameter == "with_gap") & (out.flight_id == "h")]
    assert len(gap) == 2 and gap.amplitude.isna().all()
    sine = out[(out.parameter == "sine") & (out.flight_id == "f")].set_index("bin").amplitude
    assert sine.idxmax() == 4 and sine.max() == pytest.approx(1.0)


@pytest.mark.parametrize("n", [100, 255, 256, 1000])
def test_welch_against_numpy(spark, n):
    x = np.sin(np.arange(n) * 0.3) + np.arange(n) * 0.01
    s = series_samples(spark, {"f": {"x": [float(v) for v in x]}}, dt=0.1)
    got = spectrum.welch_psd(s).toPandas().sort_values("bin")
    want = _np_welch(x, 10.0)
    assert len(got) == len(want)
    assert np.allclose(got.psd.to_numpy(), want, rtol=1e-9, atol=1e-15)


def test_categories_and_selectors(spark):
    names = ["TABLET", "CONTROLLER", "PITCH TRIM", "BETHA", "AILERON LH", "STICK FORCE", "TRIM TAB", "FUEL"]
    p = spark.createDataFrame([("f", n, i + 1) for i, n in enumerate(names)], "flight_id string, parameter string, position int")
    cats = {r.parameter: r.category for r in select.categories(p).collect()}
    assert cats["TABLET"] == "Control Surfaces" and cats["CONTROLLER"] == "Flight Angles"
    assert cats["PITCH TRIM"] == "Flight Angles" and cats["BETHA"] == "Other Parameters"
    assert cats["FUEL"] == "Other Parameters" and cats["STICK FORCE"] == "Forces & Loads"
    q = select.quick_selectors(select.with_special_columns(p)).collect()
    control = [r.parameter for r in sorted(q, key=lambda r: r.position) if r.selector == "control"]
    assert control == ["AILERON LH"]
    t = {(r.template, r.title): r.parameters for r in templates.template_charts(select.with_special_columns(p)).collect()}
    assert t[("flight_angles", "Sideslip Angle")] == ["BETHA"]
    assert t[("forces", "Other Forces")] == ["STICK FORCE"]
    assert templates.template_charts(p, "no_such_template").count() == 0


def test_series_specs(spark):
    s = series_samples(spark, {"f": {"a": [1.0, 2.0], "b": [10.0, 20.0]}})
    assert series.series(s, {"id": "x", "parameters": []}).count() == 0
    assert series.series(s, {"id": "x", "parameters": ["a"], "x_axis": "nope"}).count() == 0
    area = series.series(s, {"id": "x", "type": "area", "parameters": ["a", "b", "absent"]}).collect()
    base = {(r.parameter, r.row_no): r.baseline for r in area}
    assert base[("a", 0)] == 0.0 and base[("b", 1)] == 2.0
    unknown = series.series(s, {"id": "x", "type": "pie", "parameters": ["a"]}).count()
    assert unknown == 2
    assert series.layout_limit([1, 2, 3, 4, 5], "1x2") == [1, 2] and len(series.layout_limit(range(9), "zz")) == 4


def test_export_roundtrip_and_validation(spark, tmp_path):
    s = series_samples(spark, {"f": {"a": [1.0, None], "b": [2.0, 3.0]}})
    export.export_json(s, str(tmp_path / "j"), "2024-01-01T00:00:00")
    back = spark.read.json(str(tmp_path / "j" / "data")).orderBy(ELAPSED_COLUMN).collect()
    assert [r["a"] for r in back] == [1.0, None] and [r["b"] for r in back] == [2.0, 3.0]
    export.export_csv(s, str(tmp_path / "c"))
    meta = spark.read.json(str(tmp_path / "c" / "metadata")).first()
    assert meta.data_points == 2 and meta.n_columns == 4 and meta.title == "Flight Data Export"
    v = {(r.severity, r.code): r.n for r in export.validate_export(s).collect()}
    assert v[("warning", "MISSING_VALUES")] == 1 and v[("info", "PARAMETERS")] == 4
    assert v[("info", "NUMERIC_PARAMETERS")] == 3
    assert export.export_formats() == ["csv", "json", "parquet"]


def test_distributed_fft_matches_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"f": {"x": [float(v) for v in rng.normal(0, 1, 300)]}, "g": {"y": [float(v) for v in rng.normal(2, 1, 257)]},
            "h": {"w": [1.0, None] + [2.0] * 40}}
    s = series_samples(spark, data, dt=0.01)
    out = spectrum.fft_spectrum(s, single_task_max=16).toPandas()
    for fid, p in (("f", "x"), ("g", "y")):
        a = np.array(data[fid][p])
        got = out[(out.flight_id == fid) & (out.parameter == p)].sort_values("bin")
        want = 2.0 / len(a) * np.abs(np.fft.fft(a)[: len(a) // 2])
        assert len(got) == len(a) // 2
        assert np.allclose(got.amplitude.to_numpy(), want, atol=1e-11)
        assert np.allclose(got.frequency_hz.to_numpy(), np.fft.fftfreq(len(a), 0.01)[: len(a) // 2])
    gap = out[(out.flight_id == "h") & (out.parameter == "w")]
    assert len(gap) == 21 and gap.amplitude.isna().all()
