"""Spectra and correlation computed in tiles, against NumPy on whole series."""

import numpy as np
import pandas as pd
import pytest

from aerolytics.operators import corr, spectrum
from tests.helpers import series_samples


@pytest.mark.parametrize("points", [1, 16, 64, 1 << 18])
def test_distributed_fft_in_tiles_matches_numpy(spark, monkeypatch, points):
    monkeypatch.setattr(spectrum, "FFT_TASK_POINTS", points)
    rng = np.random.default_rng(7)
    series = {"long": rng.normal(0, 3, 150), "odd": rng.normal(0, 1, 67), "short": np.array([1.0, 5.0, 2.0]), "pair": np.array([1.0, 2.0])}
    s = series_samples(spark, {name: {"x": x.tolist()} for name, x in series.items()}).repartition(3)
    got = {}
    for r in spectrum.fft_spectrum(s, single_task_max=1).collect():
        got.setdefault(r.flight_id, {})[r.bin] = (r.frequency_hz, r.amplitude)
    for name, x in series.items():
        n = len(x)
        want = 2.0 / n * np.abs(np.fft.fft(x)[:n // 2])
        assert sorted(got[name]) == list(range(n // 2))
        assert [got[name][k][1] for k in range(n // 2)] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-9)
        assert [got[name][k][0] for k in range(n // 2)] == pytest.approx(np.fft.fftfreq(n, 0.1)[:n // 2].tolist())


def test_a_missing_value_blanks_every_bin(spark):
    s = series_samples(spark, {"f": {"x": [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0]}})
    rows = spectrum.fft_spectrum(s, single_task_max=1).collect()
    assert sorted((r.bin, r.amplitude) for r in rows) == [(0, None), (1, None), (2, None)]


def brute_welch(x, dt, size=256):
    n = len(x)
    size = min(size, n)
    hop = size - size // 2
    win = np.ones(1) if size == 1 else 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    total, count = 0.0, 0
    for a in range(0, n - size + 1, hop):
        seg = (x[a:a + size] - x[a:a + size].mean()) * win
        p = np.abs(np.fft.rfft(seg)) ** 2 * dt / (win * win).sum()
        p[1:None if size % 2 else -1] *= 2
        total, count = total + p, count + 1
    return total / count


@pytest.mark.parametrize("block,segment", [(1, 16), (3, 16), (2, 7), (64, 256)])
def test_welch_blocks_match_numpy(spark, monkeypatch, block, segment):
    monkeypatch.setattr(spectrum, "WELCH_BLOCK", block)
    rng = np.random.default_rng(8)
    series = {"a": rng.normal(0, 1, 203), "b": rng.normal(5, 1, 16), "c": rng.normal(0, 1, 5), "d": np.arange(31.0)}
    s = series_samples(spark, {name: {"x": x.tolist()} for name, x in series.items()}).repartition(3)
    got = {}
    for r in spectrum.welch_psd(s, segment=segment).collect():
        got.setdefault(r.flight_id, {})[r.bin] = r.psd
    for name, x in series.items():
        want = brute_welch(x, 0.1, segment)
        assert [got[name][k] for k in range(len(want))] == pytest.approx(want.tolist(), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("tile", [1, 2, 3, 128])
def test_correlation_tiles_match_pandas(spark, monkeypatch, tile):
    monkeypatch.setattr(corr, "TILE", tile)
    rng = np.random.default_rng(9)
    flights = {}
    for name, p, n in (("wide", 7, 120), ("two", 2, 50)):
        x = rng.normal(0, 1, (n, p)) @ rng.normal(0, 1, (p, p))
        x[rng.random((n, p)) < 0.2] = np.nan
        flights[name] = pd.DataFrame(x, columns=[f"p{i}" for i in range(p)])
    rows = {name: {c: [None if np.isnan(v) else float(v) for v in d[c]] for c in d} for name, d in flights.items()}
    parts = [series_samples(spark, {name: r}) for name, r in rows.items()]
    got = {(r.flight_id, r.x, r.y): (r.n, r.r) for r in corr.correlation(parts[0].unionByName(parts[1]).repartition(4)).collect()}
    for name, d in flights.items():
        want, both = d.corr(), d.notna().astype(int).T @ d.notna().astype(int)
        for x in d:
            for y in d:
                assert got[name, x, y][0] == both.loc[x, y]
                assert got[name, x, y][1] == pytest.approx(want.loc[x, y], rel=1e-9, abs=1e-9)


def test_moment_rows_of_a_wide_flight_are_few():
    """985 parameters give 36 tiles per flight and partition."""
    total = np.zeros((4, 985, 985), np.float32)
    assert len(corr._tiles("f", total)) == 36
