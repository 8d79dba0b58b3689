"""Spectra (S1-S3): FFT amplitude spectrum and Welch power spectral density.

Welch is fully partitioned: a block of ``WELCH_BLOCK`` segments takes its own
samples and the head of the next block's (one segment less a step), so nearly
every sample is shuffled once; a block is one array, transformed with one 2-D
``rfft`` and summed over its segments before Spark adds up the blocks.

The FFT spectrum needs the whole series. Series up to FFT_SINGLE_TASK_MAX
points run as one ``applyInArrow`` group each. Longer series use Bluestein's
chirp transform (any length n becomes a circular convolution of power-of-two
length M >= 2n-1) on a grid of M = M1 * M2 points. Tasks hold tiles of whole
columns or rows, and tiles are exchanged as binary arrays: columns (forward
transform over j1), rows (over k2, product with the filter, inverse over k2),
columns (inverse over the rest). A task holds about FFT_TASK_POINTS points, or
one column or row where that is longer: about sqrt(M).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from aerolytics.schema import numeric
from aerolytics.session import join_small, materialize_counted

# Welch defaults (segment length, half overlap, periodic Hann,
# constant detrend, density scaling, one-sided).
WELCH_SEGMENT = 256
# Segments that one block of samples holds.
WELCH_BLOCK = 64
SPECTRUM_SCHEMA = "flight_id string, parameter string, bin long, frequency_hz double, amplitude double"
# Longest series one task transforms whole (points); longer ones are distributed.
# A task holds about 150 bytes a point, and an executor runs several at once.
FFT_SINGLE_TASK_MAX = 1 << 20
# Longest series the distributed transform takes (exact 64-bit chirp angles), and their limb.
FFT_MAX = 1 << 41
FFT_LIMB = 1 << 20
# Points of a transform that one task holds (more only where a single row or column is longer).
FFT_TASK_POINTS = 1 << 18
_KEYS = ["flight_id", "parameter"]


def _fft_group(series: pa.Table) -> pa.Table:
    """The spectrum of one series from plain arrays, half of the bins only."""
    n, half = series.num_rows, series.num_rows // 2
    order = np.argsort(series["row_no"].to_numpy(), kind="stable")
    x = series["value"].to_numpy().astype(np.float64)[order]
    t = series["elapsed_s"].to_numpy()[order[[0, -1]]].astype(np.float64)
    amp, freqs = np.empty(0), np.empty(0)
    if half:
        with np.errstate(all="ignore"):
            amp = 2.0 / n * np.abs(np.fft.rfft(x)[:half])
            freqs = np.arange(half) * (1.0 / (n * ((t[1] - t[0]) / (n - 1))))
    # NaN is null, as pandas results are.
    return pa.table({**{c: pa.repeat(pa.scalar(series[c][0].as_py(), pa.string()), half) for c in _KEYS},
                     "bin": pa.array(np.arange(half, dtype=np.int64)),
                     "frequency_hz": pa.array(freqs, from_pandas=True), "amplitude": pa.array(amp, from_pandas=True)})


def _select(samples: DataFrame, parameters: Sequence[str] | None) -> DataFrame:
    s = numeric(samples, include_elapsed=False)
    if parameters is not None:
        s = s.filter(F.col("parameter").isin(list(parameters)))
    return s.select("flight_id", "parameter", "row_no", "elapsed_s", "value")


def fft_spectrum(samples: DataFrame, parameters: Sequence[str] | None = None,
                 single_task_max: int = FFT_SINGLE_TASK_MAX) -> DataFrame:
    """Amplitude spectrum per series: bins 0 .. n//2-1, frequency k/(n*dt),
    amplitude 2/n*|X_k| (DC doubled too). A missing value makes every
    amplitude missing. ``row_no`` must number each series densely from 0."""
    s = _select(samples, parameters)
    info = s.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min_by("elapsed_s", "row_no").alias("e0"), F.max_by("elapsed_s", "row_no").alias("e1"))
    info, n_info = materialize_counted(info)
    small = info.filter(F.col("n") <= single_task_max).select(*_KEYS)
    large = info.filter(F.col("n") > single_task_max)
    one = (join_small(s, small, _KEYS, "left_semi", n_rows=n_info)
           .groupBy(*_KEYS).applyInArrow(_fft_group, SPECTRUM_SCHEMA))
    dist = _bluestein_spectrum(join_small(s, large.select(*_KEYS), _KEYS, "left_semi", n_rows=n_info),
                               large, n_info)
    out = one.unionByName(dist)
    return out.withColumn("amplitude", F.when(~F.isnan("amplitude"), F.col("amplitude")))


# --- distributed transform ----------------------------------------------------

_TILES = ("flight_id string, parameter string, n long, m1 long, m2 long, wide long, tall long, dt double, "
          "column_tile long, row_tile long, points binary")


def _square_mod(j, m):
    """j * j mod m for 0 <= j < m < 2^42 in 64-bit integers (arrays or columns).

    j = h 2^20 + l: h^2 is shifted by 20 bits twice with a reduction between.
    """
    h, low = (j - j % FFT_LIMB) / FFT_LIMB, j % FFT_LIMB
    h = h.cast("long") if isinstance(h, Column) else h.astype(np.int64)
    t = (h * h) % m * FFT_LIMB % m
    return ((t + 2 * h * low % m) * FFT_LIMB % m + low * low) % m


def _chirp_angle(j: np.ndarray, n: int) -> np.ndarray:
    """pi * (j^2 mod 2n) / n, exact in integers."""
    return np.pi * _square_mod(np.mod(j, 2 * n).astype(np.int64), 2 * n).astype(np.float64) / n


def _twiddle(rows: np.ndarray, columns: np.ndarray, m: int) -> np.ndarray:
    """exp(-2 pi i r c / m) for every row and column number, the product reduced in integers."""
    return np.exp(-2j * np.pi * ((rows[:, None] * columns[None, :]) % m) / m)


def _row_tiles(pdf: pd.DataFrame, grids: list[np.ndarray], names: dict) -> pd.DataFrame:
    """A column tile's grids cut into row tiles, one binary row each, for the transposition."""
    tall = int(pdf["tall"].iloc[0])
    rows = range(grids[0].shape[0] // tall)
    cut = [b"".join(np.ascontiguousarray(g[r * tall:(r + 1) * tall]).tobytes() for g in grids) for r in rows]
    return pd.DataFrame({**names, "row_tile": list(rows), "points": cut})


def _same(pdf: pd.DataFrame) -> dict:
    """The columns that are alike in all rows of a group."""
    return {c: pdf[c].iloc[0] for c in (*_KEYS, "n", "m1", "m2", "wide", "tall", "dt")}


def _chirped_columns(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile of columns j2 of the series and of the chirp filter: FFT over j1, times the twiddle factor."""
    one = _same(pdf)
    n, m1, m2, wide = (int(one[c]) for c in ("n", "m1", "m2", "wide"))
    tile, m = int(pdf["column_tile"].iloc[0]), m1 * m2
    a = np.zeros((m1, wide), np.complex128)
    rows = pdf[pdf["rows"].notna()]
    if len(rows):
        j = np.concatenate(list(rows["rows"])).astype(np.int64)
        v = np.concatenate(list(rows["values"])).astype(np.float64)
        a[j // m2, j % m2 - tile * wide] = v * np.exp(-1j * _chirp_angle(j, n))
    j2 = tile * wide + np.arange(wide, dtype=np.int64)
    j = np.arange(m1, dtype=np.int64)[:, None] * m2 + j2[None, :]
    from_end = np.minimum(j, m - j)  # the filter is even; it is zero away from both ends
    b = np.where(from_end < n, np.exp(1j * _chirp_angle(np.where(from_end < n, from_end, 0), n)), 0)
    turn = _twiddle(np.arange(m1, dtype=np.int64), j2, m)
    return _row_tiles(pdf, [np.fft.fft(a, axis=0) * turn, np.fft.fft(b, axis=0) * turn], {**one, "column_tile": tile})


def _joined(pdf: pd.DataFrame, order: str, shape: tuple[int, int], axis: int, n_grids: int) -> list[np.ndarray]:
    """The grids of a group from its tiles, side by side along ``axis``."""
    parts = [np.frombuffer(p, np.complex128).reshape(n_grids, *shape) for p in pdf.sort_values(order)["points"]]
    return list(np.concatenate(parts, axis=axis + 1))


def _convolved_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile of rows k1: finish both transforms over k2, multiply, and begin the inverse over k2 where it lies.

    Bin k1 + M1 k2 is the point (k1, k2) of a transform whose inner sums run
    over k2, so the product needs no transposition before the inverse.
    """
    one = _same(pdf)
    m1, m2, wide, tall = (int(one[c]) for c in ("m1", "m2", "wide", "tall"))
    tile = int(pdf["row_tile"].iloc[0])
    xa, xb = (np.fft.fft(g, axis=1) for g in _joined(pdf, "column_tile", (tall, wide), 1, 2))
    rows = tile * tall + np.arange(tall, dtype=np.int64)
    y = np.fft.fft(np.conj(xa * xb), axis=1) * _twiddle(rows, np.arange(m2, dtype=np.int64), m1 * m2)
    cut = [np.ascontiguousarray(y[:, c * wide:(c + 1) * wide]).tobytes() for c in range(m2 // wide)]
    return pd.DataFrame({**one, "column_tile": range(m2 // wide), "row_tile": tile, "points": cut})


def _amplitudes(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile of columns of the inverse: finish it over the rows, apply the output chirp, keep bins below n // 2."""
    one = _same(pdf)
    n, m1, m2, wide, tall = (int(one[c]) for c in ("n", "m1", "m2", "wide", "tall"))
    tile = int(pdf["column_tile"].iloc[0])
    grid = np.fft.fft(_joined(pdf, "row_tile", (tall, wide), 0, 1)[0], axis=0)
    used = min(m1, (n // 2 - 1) // m2 + 1) if n > 1 else 0
    k = np.arange(used, dtype=np.int64)[:, None] * m2 + tile * wide + np.arange(wide, dtype=np.int64)[None, :]
    keep = k < n // 2
    x = np.conj(grid[:used])[keep] / (m1 * m2) * np.exp(-1j * _chirp_angle(k[keep], n))
    with np.errstate(all="ignore"):
        freq = k[keep] * (1.0 / (n * np.float64(one["dt"])))
    return pd.DataFrame({"flight_id": one["flight_id"], "parameter": one["parameter"],
                         "bin": k[keep], "frequency_hz": freq, "amplitude": 2.0 / n * np.abs(x)})


def _sizes(info: DataFrame) -> DataFrame:
    """Transform length M = 2^m >= 2n - 1, split as M1 = 2^floor(m/2), M2 = M / M1."""
    m = F.ceil(F.log2(2 * F.col("n") - 1)).cast("int")
    info = info.withColumn("n", F.when(F.col("n") <= FFT_MAX, F.col("n")).otherwise(F.raise_error(
        F.lit(f"FFT of a series longer than {FFT_MAX} points"))))
    return (info.withColumn("m1", F.pow(F.lit(2.0), F.floor(m / 2)).cast("long"))
            .withColumn("m2", F.pow(F.lit(2.0), m - F.floor(m / 2)).cast("long"))
            .withColumn("wide", F.greatest(F.lit(1), F.least("m2", F.floor(F.lit(FFT_TASK_POINTS) / F.col("m1")))).cast("long"))
            .withColumn("tall", F.greatest(F.lit(1), F.least("m1", F.floor(F.lit(FFT_TASK_POINTS) / F.col("m2")))).cast("long")))


def _bin_frequency():
    """bin / (n dt); a zero time step leaves bin 0 undefined and the others infinite, as in floating point."""
    step = F.col("n") * F.col("dt")
    none = F.when(F.col("bin") > 0, F.lit(float("inf")))
    return F.when(step == 0, none).otherwise(F.col("bin") * F.try_divide(F.lit(1.0), step))


def _bluestein_spectrum(s: DataFrame, large: DataFrame, n_info: int) -> DataFrame:
    sizes = _sizes(large).withColumn("dt", (F.col("e1") - F.col("e0")) / (F.col("n") - 1).cast("double"))
    columns = [*_KEYS, "n", "m1", "m2", "wide", "tall", "dt"]
    whole = sizes.filter(F.col("n_null") == 0).select(columns)
    d = join_small(s, whole, _KEYS, n_rows=n_info)
    # Consecutive points of a series lie in one row of a column tile and travel as one array.
    d = (d.groupBy(*columns, F.floor(F.col("row_no") / F.col("wide")).alias("piece"))
         .agg(F.collect_list(F.struct("row_no", "value")).alias("cells"))
         .withColumn("column_tile", F.pmod(F.col("piece"), F.floor(F.col("m2") / F.col("wide")))))
    # The chirp filter fills every column tile, also those without a point.
    tiles = whole.withColumn("column_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m2") / F.col("wide")) - 1)))
    # As two plain arrays: a list of structs would become a dict per point in Python.
    parts = d.select(*columns, "column_tile", F.col("cells.row_no").alias("rows"), F.col("cells.value").alias("values")).unionByName(tiles, allowMissingColumns=True)
    first = parts.groupBy(*_KEYS, "column_tile").applyInPandas(_chirped_columns, _TILES)
    second = first.groupBy(*_KEYS, "row_tile").applyInPandas(_convolved_rows, _TILES)
    fin = second.groupBy(*_KEYS, "column_tile").applyInPandas(_amplitudes, SPECTRUM_SCHEMA)
    # The bins of a series with a missing value come from its own rows.
    missing = sizes.filter(F.col("n_null") > 0).select(*_KEYS, "n", "dt")
    nulls = (join_small(s.select(*_KEYS, F.col("row_no").alias("bin")), missing, _KEYS, n_rows=n_info)
             .filter(F.col("bin") < F.floor(F.col("n") / 2))
             .select(*_KEYS, "bin", _bin_frequency().alias("frequency_hz"), F.lit(None).cast("double").alias("amplitude")))
    return fin.unionByName(nulls)


@F.pandas_udf(ArrayType(DoubleType()))
def _block_psd(vals: pd.Series, length: pd.Series, step: pd.Series, fs: pd.Series) -> pd.Series:
    """Sum of the PSDs of a block's segments, one array per block and one 2-D rfft for them."""
    out = []
    for v, size, hop, rate in zip(vals, length, step, fs):
        size, hop = int(size), int(hop)
        x = np.lib.stride_tricks.sliding_window_view(np.asarray(v, np.float64), size)[::hop]
        win = np.ones(1) if size == 1 else 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(size) / size)
        spec = np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * win, axis=1)
        with np.errstate(all="ignore"):
            p = (np.conjugate(spec) * spec).real * (1.0 / (np.float64(np.nan if rate is None else rate) * (win * win).sum()))
        p[:, 1:None if size % 2 else -1] *= 2
        out.append(p.sum(axis=0))
    return pd.Series(out)


def welch_psd(samples: DataFrame, parameters: Sequence[str] | None = None,
              segment: int = WELCH_SEGMENT) -> DataFrame:
    """Welch PSD per series: (flight_id, parameter, bin, frequency_hz, psd).

    Segment L = min(segment, n), step L - L//2, segments from row 0, tail
    unused; fs = 1 / mean time step. A missing value makes the spectrum missing.
    """
    s = _select(samples, parameters)
    info = s.groupBy("flight_id", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.min_by("elapsed_s", "row_no").alias("e0"), F.max_by("elapsed_s", "row_no").alias("e1"))
    L = F.least(F.lit(segment), F.col("n"))
    info = (info.withColumn("L", L.cast("long"))
            .withColumn("step", (F.col("L") - F.floor(F.col("L") / 2)).cast("long"))
            .withColumn("nseg", (F.floor((F.col("n") - F.col("L")) / F.col("step")) + 1).cast("long"))
            .withColumn("fs", F.try_divide(F.lit(1.0), F.try_divide(F.col("e1") - F.col("e0"),
                                                                   (F.col("n") - 1).cast("double")))))

    info, n_info = materialize_counted(info)
    j = join_small(s, info.select("flight_id", "parameter", "L", "step", "nseg", "fs", "n_null"), ["flight_id", "parameter"],
                   n_rows=n_info)
    # A block of segments takes its own rows and the head of the next block's: each sample once, but for that halo.
    j = j.withColumn("span", F.col("step") * WELCH_BLOCK)
    own = F.floor(F.col("row_no") / F.col("span"))
    halo = (own > 0) & (F.col("row_no") - own * F.col("span") < F.col("L") - F.col("step"))
    used = F.col("row_no") < (F.col("nseg") - 1) * F.col("step") + F.col("L")  # the tail is in no segment
    m = j.filter((F.col("n_null") == 0) & used).select(
        "flight_id", "parameter", "row_no", "value", "L", "step", "nseg", "fs",
        F.explode(F.when(halo, F.array(own - 1, own)).otherwise(F.array(own))).alias("block"))
    m = m.filter(F.col("block") * WELCH_BLOCK < F.col("nseg"))
    blocks = (m.groupBy("flight_id", "parameter", "block", "L", "step", "nseg", "fs")
              .agg(F.array_sort(F.collect_list(F.struct("row_no", "value"))).alias("c")))
    sums = blocks.select("flight_id", "parameter", "nseg", F.posexplode(_block_psd(
        F.col("c.value"), "L", "step", "fs")).alias("bin", "p"))
    avg = sums.groupBy("flight_id", "parameter", "bin").agg((F.sum("p") / F.first("nseg")).alias("psd"))
    bins = info.select("flight_id", "parameter", "L", "fs", "n_null",
                       F.explode(F.sequence(F.lit(0), (F.floor(F.col("L") / 2)).cast("int"))).alias("bin"))
    out = bins.join(avg, ["flight_id", "parameter", "bin"], "left")
    freq = F.col("bin") * (F.lit(1.0) / (F.col("L") * (F.lit(1.0) / F.col("fs"))))
    return out.select("flight_id", "parameter", F.col("bin").cast("long").alias("bin"),
                      freq.alias("frequency_hz"),
                      F.when(F.col("n_null") == 0, F.col("psd")).alias("psd"))


def spectrum(samples: DataFrame, parameters: Sequence[str], kind: str = "fft") -> DataFrame:
    """Dispatch (S3): ``fft`` (default) or anything else = Welch PSD. Absent
    parameters are skipped. Output (flight_id, parameter, kind, bin,
    frequency_hz, amplitude)."""
    if kind == "fft":
        return fft_spectrum(samples, parameters).withColumn("kind", F.lit("fft"))
    return (welch_psd(samples, parameters).withColumnRenamed("psd", "amplitude")
            .withColumn("kind", F.lit("psd")))
