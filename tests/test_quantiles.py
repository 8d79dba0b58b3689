"""Exact quantiles by histogram refinement against NumPy's linear method."""

import numpy as np
import pytest

from aerolytics.plans import quantiles as Q


@pytest.mark.parametrize("buckets,final_rows", [(4096, 1 << 20), (4, 3), (2, 1), (3, 0)])
def test_exact_quantiles(spark, monkeypatch, buckets, final_rows):
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    monkeypatch.setattr(Q, "FINAL_ROWS", final_rows)
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(0, 1, 300),
        "dups": np.repeat([1.0, 2.0, 2.0, 7.0], 25),
        "const": np.full(10, 3.5),
        "one": np.array([4.0]),
        "two": np.array([1.0, 9.0]),
        "skewed": np.concatenate([np.full(200, 1.0), rng.exponential(1e6, 50), [1e300]]),
        "inf": np.array([1.0, 2.0, np.inf, 3.0, -np.inf]),
    }
    rows = [(g, float(v)) for g, vals in groups.items() for v in vals]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.25, 0.5, 0.75, 0.0, 1.0]
    got = {(r.g, r.q_index): r.quantile for r in Q.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g, vals in groups.items():
        for i, q in enumerate(probs):
            with np.errstate(invalid="ignore"):
                want = float(np.quantile(vals, q))
            x = got[(g, i)]
            if np.isnan(want):
                assert x is None or np.isnan(x), (g, q, x)
            else:
                assert x == pytest.approx(want, rel=1e-12, abs=1e-12), (g, q, x, want)
