"""Seasonal decomposition against loops that follow the definition, and on tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from windrose.operators.seasonal import decomposed, local_line, stl


def plain_line(y: np.ndarray, span: int, weight: np.ndarray, at: float) -> float:
    """A weighted least-squares line through the nearest points, by numpy's solver."""
    n, q = len(y), min(span, len(y))
    first = int(min(max(np.floor(at) - (q - 1) // 2, 0), n - q))
    x = np.arange(first, first + q)
    reach = max(abs(at - x[0]), abs(at - x[-1])) + max(0, (span - n) // 2)
    w = np.array([0.0 if d > 0.999 * reach else 1.0 if d <= 0.001 * reach else (1 - (d / reach) ** 3) ** 3 for d in np.abs(x - at)]) * weight[x]
    design = np.stack([np.ones(q), x - at], axis=1) * np.sqrt(w)[:, None]
    return float(np.linalg.lstsq(design, y[x] * np.sqrt(w), rcond=None)[0][0])


@pytest.mark.parametrize(("n", "span"), [(30, 7), (30, 31), (9, 13), (50, 25)])
def test_lines_equal_least_squares(n: int, span: int) -> None:
    rng = np.random.default_rng(n + span)
    y, weight = rng.normal(size=n), rng.random(n) + 0.01
    at = np.r_[-1.0, np.arange(n), n]
    assert np.allclose(local_line(y, span, weight, at), [plain_line(y, span, weight, a) for a in at])


def series(n: int = 336) -> np.ndarray:
    t = np.arange(n)
    y = 0.05 * t + 10 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(1).normal(size=n)
    y[[40, 100, 222]] += 80
    return y


def test_parts_add_up_and_find_the_wave() -> None:
    y, t = series(), np.arange(336)
    wave, level, rest = decomposed(y, 24)
    assert np.allclose(wave + level + rest, y)
    assert np.abs(wave - 10 * np.sin(2 * np.pi * t / 24)).mean() < 1.5
    assert np.abs(level - 0.05 * t).mean() < 1.0
    assert rest[40] > 70
    # Without robust weights the outliers reach the other parts.
    assert np.abs(decomposed(y, 24, robust=False)[1] - 0.05 * t).mean() > np.abs(level - 0.05 * t).mean()
    flat = decomposed(np.full(96, 3.0), 24)
    assert np.allclose(flat[1], 3) and np.allclose(flat[0], 0)


def test_a_series_for_each_key(spark: SparkSession) -> None:
    y = series()
    rows = [(k, i, float(v * f)) for k, f in (("a", 1.0), (None, 2.0)) for i, v in enumerate(y)] + [("short", 0, 1.0), ("short", 1, 2.0)]
    out = stl(spark.createDataFrame(rows, "k string, t bigint, v double").repartition(7), ["k"], "t", "v", 24).collect()
    wave = decomposed(y, 24)[0]
    assert len(out) == len(rows)
    for r in out:
        if r.k == "short":
            assert r.seasonal is None and r.rest is None
        else:
            assert np.isclose(r.seasonal, wave[r.t] * (2.0 if r.k is None else 1.0))
    assert stl(spark.createDataFrame([], "k string, t bigint, v double"), ["k"], "t", "v", 24).count() == 0
