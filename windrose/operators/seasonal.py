"""Seasonal decomposition of regular series by local regression (Cleveland and others, 1990), a series to each key.

A series is what is left of a key after aggregation to regular steps, a number for each hour or day, so its length is that of
the calendar and not of the data. Series are decomposed in parallel, each in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Loops of the robust form: within each round of weights, and rounds; of the plain form.
ROBUST_LOOPS, PLAIN_LOOPS = (2, 15), (5, 0)


def local_line(y: np.ndarray, span: int, weight: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """At each place (by default 0, 1, ...; others may lie outside) the value of a line through the ``span`` nearest points,
    weighted by the tricube of their distance, as a share of the farthest one's, and by ``weight``."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    weight = np.ones(n) if weight is None else weight
    q = min(span, n)
    first = np.clip(np.floor(at).astype(int) - (q - 1) // 2, 0, n - q)
    x = first[:, None] + np.arange(q)
    reach = np.maximum(at - first, first + q - 1 - at) + max(0, (span - n) // 2)
    distance = np.abs(x - at[:, None])
    share = distance / np.maximum(reach, 1e-300)[:, None]
    w = np.where(share <= 0.999, np.where(share <= 0.001, 1.0, (1 - np.minimum(share, 1) ** 3) ** 3), 0.0) * weight[x]
    total = w.sum(axis=1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    middle = (w * x).sum(axis=1, keepdims=True)
    spread = (w * (x - middle) ** 2).sum(axis=1, keepdims=True)
    tilted = (np.sqrt(spread) > 0.001 * (n - 1)) & (reach[:, None] > 0)
    slope = np.divide(at[:, None] - middle, spread, out=np.zeros_like(spread), where=tilted)
    value = (w * (1 + slope * (x - middle)) * y[x]).sum(axis=1)
    #: Where no point has any weight the value stays as it is; beyond the ends it is that of the end.
    lost = total[:, 0] <= 0
    value = np.where(lost, y[np.clip(at, 0, n - 1).astype(int)], value)
    for k in np.flatnonzero(lost & ((at < 0) | (at > n - 1))):
        value[k] = value[k + 1] if at[k] < 0 else value[k - 1]
    return value


def _average(y: np.ndarray, n: int) -> np.ndarray:
    sums = np.r_[0.0, np.cumsum(y)]
    return (sums[n:] - sums[:-n]) / n


def decomposed(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, robust: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seasonal, trend, rest), which add up to ``y``. Needs two periods at least."""
    n = len(y)
    if period < 2 or n < 2 * period:
        raise ValueError(f"a series of {n} values is too short for the period {period}")
    odd = lambda x: int(x) + (int(x) % 2 == 0)
    trend = trend or odd(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    low_pass = low_pass or odd(period + 1)
    inner, outer = ROBUST_LOOPS if robust else PLAIN_LOOPS
    weight, level, wave = np.ones(n), np.zeros(n), np.zeros(n)
    for round_ in range(outer + 1):
        for _ in range(inner):
            free = y - level
            cycle = np.zeros(n + 2 * period)
            for k in range(period):
                part = free[k::period]
                cycle[k::period] = local_line(part, seasonal, weight[k::period], np.arange(-1, len(part) + 1))
            smooth = local_line(_average(_average(_average(cycle, period), period), 3), low_pass)
            wave = cycle[period : period + n] - smooth
            level = local_line(y - wave, trend, weight)
        if round_ < outer:
            off = np.abs(y - wave - level)
            limit = 6 * np.median(off)
            share = off / limit if limit > 0 else np.zeros(n)
            weight = np.where(share <= 0.001, 1.0, np.where(share <= 0.999, (1 - np.minimum(share, 1) ** 2) ** 2, 0.0))
    return wave, level, y - wave - level


def stl(series: DataFrame, on: Sequence[str], ts: str, value: str, period: int, robust: bool = True) -> DataFrame:
    """``on``, ``ts``, ``value`` with ``seasonal``, ``trend`` and ``rest`` of each key's series in order of ``ts``.

    Steps have to be regular and values known; a series of less than two periods has nulls. Of repeated times the order is
    that of the values.
    """
    rows = series.select(*on, ts, F.col(value).cast("double").alias(value))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*on, ts, value)), "seasonal double", "trend double", "rest double"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(ts, "ascending"), (value, "ascending")])
        y = table.column(value).to_numpy()
        parts = decomposed(y, period, robust=robust) if len(y) >= 2 * period else [pa.nulls(len(y), pa.float64())] * 3
        for name, part in zip(("seasonal", "trend", "rest"), parts, strict=True):
            table = table.append_column(name, pa.array(part))
        return table

    return rows.groupBy(*on).applyInArrow(run, schema)
