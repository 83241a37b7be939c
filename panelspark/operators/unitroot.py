"""Tests of series for a unit root, with lags chosen by information and p-values from response surfaces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values, by deterministic part (none, constant, constant and trend): the published response surfaces of the statistic's
# distribution (MacKinnon 1994, one variable): where the two polynomials meet, the ends, and their coefficients, lowest power first.
SURFACES = {
    "n": (-1.04, -19.04, math.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    "c": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    "ct": (-2.89, -16.18, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}


def p_value(t: float, kind: str = "ct") -> float:
    """Probability of a statistic as small as t if there is a unit root."""
    meet, low, high, small, large = SURFACES[kind]
    if t <= low or t > high:
        return 0.0 if t <= low else 1.0
    z = sum(c * t**k for k, c in enumerate(small if t <= meet else large))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def design(x: np.ndarray, lags: int, kind: str, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Regressors (deterministic part, level, lagged differences) and differences, without the first `skip` of them."""
    d = np.diff(x)
    n = len(d) - skip
    fixed = {"n": [], "c": [np.ones(n)], "ct": [np.ones(n), np.arange(1.0, n + 1)]}[kind]
    return np.column_stack([*fixed, x[skip:-1], *(d[skip - i : len(d) - i] for i in range(1, lags + 1))]), d[skip:]


def chosen_lag(x: np.ndarray, most: int, kind: str) -> int:
    """The number of lags of least AIC, all judged on the rows that the most lags leave; the smallest of equal ones.

    Regressors are nested, so one orthogonal basis gives the sums of squares of all numbers of lags.
    """
    m, y = design(x, most, kind, most)
    q, _ = np.linalg.qr(m)
    gain = np.cumsum((q.T @ y) ** 2)
    fixed, n = m.shape[1] - most, len(y)
    rest = np.maximum(y @ y - gain[fixed - 1 :], 1e-300)
    return int((n * np.log(rest / n) + 2 * (fixed + np.arange(most + 1))).argmin())


def statistic(x: np.ndarray, lags: int, kind: str) -> tuple[float, int]:
    m, y = design(x, lags, kind, lags)
    b, *_ = np.linalg.lstsq(m, y, rcond=None)
    at = m.shape[1] - lags - 1
    s2 = ((y - m @ b) ** 2).sum() / (len(y) - m.shape[1])
    return float(b[at] / math.sqrt(s2 * np.linalg.pinv(m.T @ m)[at, at])), len(y)


def tested(x: np.ndarray, kind: str = "ct", lags: int | None = None) -> tuple[float, float, int, int] | None:
    """Statistic, p-value, lags and rows; None for series that are too short or constant."""
    x = x[np.isfinite(x)]
    trend = {"n": 0, "c": 1, "ct": 2}[kind]
    most = min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - trend - 1) if lags is None else lags
    if most < 0 or len(x) - 1 - most <= most + trend + 1 or (x == x[0]).all():
        return None
    used = chosen_lag(x, most, kind) if lags is None else lags
    t, n = statistic(x, used, kind)
    return t, p_value(t, kind), used, n


def designs(x: np.ndarray, lags: int, kind: str, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """design() of many series of one length, a row each."""
    d = np.diff(x, axis=1)
    n = d.shape[1] - skip
    fixed = {"n": [], "c": [np.ones(n)], "ct": [np.ones(n), np.arange(1.0, n + 1)]}[kind]
    rows = [*(np.broadcast_to(f, (len(x), n)) for f in fixed), x[:, skip:-1], *(d[:, skip - i : d.shape[1] - i] for i in range(1, lags + 1))]
    return np.stack(rows, axis=2), d[:, skip:]


def tested_together(x: np.ndarray, kind: str = "ct", lags: int | None = None) -> list[tuple[float, float, int, int] | None]:
    """tested() of many series of one length, finite and a row each, with their matrices stacked."""
    size, trend = x.shape[1], {"n": 0, "c": 1, "ct": 2}[kind]
    most = min(math.ceil(12 * (size / 100) ** 0.25), size // 2 - trend - 1) if lags is None else lags
    found: list = [None] * len(x)
    if most < 0 or size - 1 - most <= most + trend + 1:
        return found
    places = np.flatnonzero((x != x[:, :1]).any(axis=1))
    used = np.full(len(x), most)
    if lags is None and len(places):
        m, y = designs(x[places], most, kind, most)
        gain = np.cumsum((np.swapaxes(np.linalg.qr(m)[0], 1, 2) @ y[:, :, None])[:, :, 0] ** 2, axis=1)
        rest = np.maximum((y * y).sum(axis=1)[:, None] - gain[:, trend:], 1e-300)
        n = y.shape[1]
        used[places] = (n * np.log(rest / n) + 2 * (trend + 1 + np.arange(most + 1))).argmin(axis=1)
    for k in np.unique(used[places]):
        some = places[used[places] == k]
        m, y = designs(x[some], int(k), kind, int(k))
        n, columns = m.shape[1:]
        b = np.linalg.pinv(m, rcond=np.finfo(float).eps * max(n, columns)) @ y[:, :, None]
        s2 = ((y[:, :, None] - m @ b) ** 2).sum(axis=(1, 2)) / (n - columns)
        t = b[:, trend, 0] / np.sqrt(s2 * np.linalg.pinv(np.swapaxes(m, 1, 2) @ m)[:, trend, trend])
        for i, v in zip(some, t, strict=True):
            found[i] = float(v), p_value(float(v), kind), int(k), n
    return found


#: Numbers in the matrices of the series that are tested together.
TOGETHER = 1 << 20


def unit_root(df: DataFrame, kind: str = "ct", lags: int | None = None, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """by, t, p, lags and n (rows of the regression) of the augmented Dickey-Fuller test of each series; nulls are left out.

    A series is one row of a batch; those of one length are tested together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes, found = pdf["x"].map(len).to_numpy(), np.empty(len(pdf), object)
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                wide = 3 + (lags if lags is not None else math.ceil(12 * (size / 100) ** 0.25))
                step = max(1, TOGETHER // max(1, int(size) * wide))
                for a in range(0, len(places), step):
                    some = places[a : a + step]
                    x = np.array([pdf["x"].iat[i] for i in some], float).reshape(len(some), size)
                    for i, r in zip(some, tested_together(x, kind, lags) if size else [None] * len(some), strict=True):
                        found[i] = r or (None,) * 4
            out = pd.DataFrame(list(found), columns=["t", "p", "lags", "n"])
            out.insert(0, by, pdf[by].array)
            yield out.astype({"t": float, "p": float, "lags": "Int64", "n": "Int64"})

    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)
    walked = F.sort_array(F.collect_list(F.when(finite, F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), x.alias("x")))))
    return df.groupBy(by).agg(walked.alias("s")).select(by, F.col("s.x").alias("x")).mapInPandas(run, f"{by} {dict(df.dtypes)[by]}, t double, p double, lags long, n long")
