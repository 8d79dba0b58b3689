"""Correlation (D9, D10): Pearson, pairwise-complete, numeric parameters but elapsed.

Plan: one aggregate gives each (flight, parameter) its index, mean and
whether it is constant (small table, joined back with a size check). Samples
are dealt by (flight, row block) - a big flight spreads over all tasks - and
sorted by row. ``mapInPandas`` adds up moment matrices with NumPy (counts,
sums, sums of squares and cross products over rows where both values exist, on
mean-shifted values) and emits them as binary tiles of ``TILE`` x ``TILE``
parameters, the upper triangle of tiles per flight and partition. Tiles are
dealt by (flight, tile), sorted, and added up one after another, so a task holds
two tiles at a time; only the sums become rows. Work is linear in rows; no row
pairs are ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.functions.numbers import round_half_even
from aerolytics.plans.ordering import ROW_BLOCK_BITS
from aerolytics.schema import numeric
from aerolytics.session import join_small, materialize_counted

_TILES = "flight_id string, ti int, tj int, rows int, columns int, sums binary"
_MOMENTS = ("flight_id string, i int, j int, n double, sx double, sy double, sxx double, "
            "syy double, sxy double")
#: Parameters along the side of a tile.
TILE = 128
# Relative size under which a variance over the common rows counts as zero.
_ZERO_VARIANCE = 1e-13
# Rows of one flight turned into a dense block at once.
_ROWS_AT_ONCE = 4096


def _moments(x: np.ndarray) -> np.ndarray:
    """Counts, sums, squares and products over rows where both values exist: (5, p, p)."""
    mf = (~np.isnan(x)).astype(np.float64)
    x0 = np.where(mf > 0, x, 0.0)
    # [1][i, j] = sum of x_i where x_j also exists, [2] likewise of squares
    return np.stack([mf.T @ mf, x0.T @ mf, (x0 * x0).T @ mf, x0.T @ x0])


def _tiles(fid: str, total: np.ndarray, tile: int | None = None) -> pd.DataFrame:
    """The upper triangle of tiles of a flight's moment matrices: n, sx, sy, sxx, syy, sxy of each pair."""
    n, sx, sxx, sxy = total
    tile, out = tile or TILE, []
    for a in range(0, n.shape[0], tile):
        for b in range(a, n.shape[0], tile):
            i, j = slice(a, a + tile), slice(b, b + tile)
            sums = np.stack([n[i, j], sx[i, j], sx[j, i].T, sxx[i, j], sxx[j, i].T, sxy[i, j]])
            out.append((fid, a // tile, b // tile, sums.shape[1], sums.shape[2], sums.astype(np.float64).tobytes()))
    return pd.DataFrame(out, columns=["flight_id", "ti", "tj", "rows", "columns", "sums"])


def _added_tiles(batches: Iterator[pd.DataFrame], tile: int) -> Iterator[pd.DataFrame]:
    """Tiles sorted by flight and place -> their sums as one row per pair."""
    key, total = None, None

    def pairs() -> pd.DataFrame:
        i, j = np.indices(total.shape[1:])
        i, j = i + key[1] * tile, j + key[2] * tile
        upper = i <= j
        cells = dict(zip(("n", "sx", "sy", "sxx", "syy", "sxy"), (t[upper] for t in total)))
        return pd.DataFrame({"flight_id": key[0], "i": i[upper].astype(np.int32), "j": j[upper].astype(np.int32), **cells})

    for pdf in batches:
        for fid, ti, tj, rows, columns, sums in pdf.itertuples(index=False, name=None):
            part = np.frombuffer(sums, np.float64).reshape(6, rows, columns)
            if key == (fid, ti, tj):
                total += part
                continue
            if key is not None:
                yield pairs()
            key, total = (fid, ti, tj), part.copy()
    if key is not None:
        yield pairs()


def _moment_batches(batches: Iterator[pd.DataFrame], tile: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by flight and row -> the tiles of one flight after another."""
    fid, total, held = None, None, None

    def emitted() -> pd.DataFrame:
        return _tiles(fid, total, tile)

    def add(g: pd.DataFrame) -> None:
        nonlocal total
        rows, p = pd.factorize(g["row_no"])[0], int(g["p"].iloc[0])
        if total is None:
            total = np.zeros((4, p, p))
        for at in range(0, len(g) and rows[-1] + 1, _ROWS_AT_ONCE):
            a, b = np.searchsorted(rows, [at, at + _ROWS_AT_ONCE])
            x = np.full((rows[b - 1] + 1 - at, p), np.nan)
            x[rows[a:b] - at, g["idx"].to_numpy()[a:b]] = g["v"].to_numpy()[a:b]
            total += _moments(x)

    for pdf in batches:
        if held is not None:
            pdf, held = pd.concat([held, pdf], ignore_index=True), None
        if pdf.empty:
            continue
        # The last row may go on in the next batch.
        last = (pdf["flight_id"] == pdf["flight_id"].iloc[-1]) & (pdf["row_no"] == pdf["row_no"].iloc[-1])
        pdf, held = pdf[~last], pdf[last]
        for name, g in pdf.groupby("flight_id", sort=False):
            if fid != name:
                if total is not None:
                    yield emitted()
                fid, total = name, None
            add(g)
    if held is not None:
        if fid != held["flight_id"].iloc[0]:
            if total is not None:
                yield emitted()
            fid, total = held["flight_id"].iloc[0], None
        add(held)
        yield emitted()


def correlation(samples: DataFrame, parameters: Sequence[str] | None = None) -> DataFrame:
    """Full matrix as rows (flight_id, x, y, n, r); r NULL where undefined.

    A flight needs at least two numeric parameters (elapsed not counted). A
    constant parameter gives NULL, on the diagonal too; so does a pair with no
    common row (n = 0), and a parameter without any value.
    """
    s = numeric(samples, include_elapsed=False)
    if parameters is not None:
        s = s.filter(F.col("parameter").isin(list(parameters)))
    s = s.select("flight_id", "row_no", "parameter", "value")
    per = s.groupBy("flight_id", "parameter").agg(
        F.avg("value").alias("mean"), (F.min("value") == F.max("value")).alias("constant"))
    w = Window.partitionBy("flight_id")
    per = (per.withColumn("idx", (F.dense_rank().over(w.orderBy("parameter")) - 1).cast("int"))
           .withColumn("p", F.count(F.lit(1)).over(w).cast("int"))
           .filter(F.col("p") >= 2))

    per, n_per = materialize_counted(per)
    v = join_small(s.filter(F.col("value").isNotNull()), per.select("flight_id", "parameter", "idx", "mean", "p"),
                   ["flight_id", "parameter"], n_rows=n_per)
    rows = (v.select("flight_id", "row_no", "idx", (F.col("value") - F.col("mean")).alias("v"), "p")
            .repartition("flight_id", F.shiftright("row_no", ROW_BLOCK_BITS))
            .sortWithinPartitions("flight_id", "row_no"))
    tile = TILE
    mom = (rows.mapInPandas(lambda b: _moment_batches(b, tile), _TILES)
           .repartition("flight_id", "ti", "tj").sortWithinPartitions("flight_id", "ti", "tj")
           .mapInPandas(lambda b: _added_tiles(b, tile), _MOMENTS))
    names = per.select("flight_id", "idx", "parameter", "constant")
    xs = names.withColumnRenamed("idx", "i").withColumnRenamed("parameter", "x").withColumnRenamed("constant", "cx")
    ys = names.withColumnRenamed("idx", "j").withColumnRenamed("parameter", "y").withColumnRenamed("constant", "cy")
    # Every pair of a flight's parameters, also those without a common row: the matrix that is asked for.
    pairs = join_small(xs, ys, ["flight_id"], n_rows=n_per).filter(F.col("i") <= F.col("j"))
    found = pairs.join(mom, ["flight_id", "i", "j"], "left")
    n = F.coalesce(F.col("n"), F.lit(0.0))
    some = F.when(n > 0, n)
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / some
    vy = F.col("syy") - F.col("sy") * F.col("sy") / some
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / some
    degenerate = ((n < 2) | F.coalesce(F.col("cx") | F.col("cy"), F.lit(True))
                  | (vx <= F.lit(_ZERO_VARIANCE) * F.col("sxx")) | (vy <= F.lit(_ZERO_VARIANCE) * F.col("syy")))
    ratio = cov / F.sqrt(vx * vy)
    r = F.when(~degenerate, F.when(F.isnan(ratio), None).otherwise(F.least(F.greatest(ratio, F.lit(-1.0)), F.lit(1.0))))
    upper = found.select("flight_id", "x", "y", n.cast("long").alias("n"), r.alias("r"))
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return (upper.withColumn("xy", F.explode(F.when(F.col("x") == F.col("y"), F.slice(both, 1, 1)).otherwise(both)))
            .select("flight_id", "xy.x", "xy.y", "n", "r"))


def correlation_labels(samples: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Correlation of chosen parameters with r rounded to 2 decimals.

    Absent parameters are skipped; a flight with fewer than two left gives none.
    """
    c = correlation(samples, parameters)
    return c.withColumn("r_label", round_half_even(F.col("r"), 2))
