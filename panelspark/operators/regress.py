"""Regressions and programmes of few variables: sums in Spark, the small problem solved once per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quadratic(p: np.ndarray, q: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, rho: float = 1.0, rounds: int = 20_000, tol: float = 1e-10) -> np.ndarray:
    """x that makes x'Px/2 + q'x least under low <= Ax <= high, by the alternating direction method; ValueError if there is none."""
    scale = max(1.0, float(np.abs(p).max()))
    p, q = p / scale, q / scale
    n, m = len(q), len(low)
    weight = np.where(low == high, 1e3 * rho, rho)
    x, z, y = np.zeros(n), np.clip(np.zeros(m), low, high), np.zeros(m)
    solve = np.linalg.inv(p + 1e-9 * np.eye(n) + a.T @ (weight[:, None] * a))
    for i in range(rounds):
        x = solve @ (1e-9 * x - q + a.T @ (weight * z - y))
        ax = a @ x
        new = np.clip(ax + y / weight, low, high)
        y = y + weight * (ax - new)
        primal, dual = np.abs(ax - new).max(initial=0), np.abs(weight * (new - z)).max(initial=0)
        z = new
        if primal < tol and dual < tol:
            return x
        if i % 200 == 199 and (primal > 10 * dual or dual > 10 * primal):
            weight = np.clip(weight * (3.0 if primal > dual else 1 / 3.0), 1e-6, 1e7)
            solve = np.linalg.inv(p + 1e-9 * np.eye(n) + a.T @ (weight[:, None] * a))
    if primal > 1e-5:
        raise ValueError("no point meets all constraints")
    return x


def gram(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X, X'y, y'y and the number of complete rows: one aggregation of fixed size."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    names = [*xs, y]
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    r = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col(names[i]) * F.col(names[j])), F.lit(0.0)).alias(f"g{i}_{j}") for i, j in cells)).first()
    g = np.zeros((len(names), len(names)))
    for i, j in cells:
        g[i, j] = g[j, i] = r[f"g{i}_{j}"]
    return g[:-1, :-1], g[:-1, -1], g[-1, -1], r["n"]


def restricted(df: DataFrame, y: str, xs: list[str], equal: tuple | None = None, between: tuple | None = None, bounds: tuple | None = None) -> np.ndarray:
    """Least squares of y on xs under A b = c, low <= B b <= high, and bounds of the coefficients."""
    g, r, _, _ = gram(df, y, xs)
    parts = [(np.atleast_2d(equal[0]), np.atleast_1d(equal[1]), np.atleast_1d(equal[1]))] if equal else []
    parts += [(np.atleast_2d(between[0]), *map(np.atleast_1d, between[1:]))] if between else []
    parts += [(np.eye(len(xs)), *map(np.asarray, bounds))] if bounds else []
    if not parts:
        return np.linalg.lstsq(g, r, rcond=None)[0]
    a, low, high = (np.concatenate(x).astype(float) for x in zip(*parts, strict=True))
    return quadratic(g, -r, a, low, high)


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t, by the incomplete beta function."""
    x = df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.lgamma(0.5) + df / 2 * math.log(x) + 0.5 * math.log1p(-x))
    if x < (df / 2 + 1) / (df / 2 + 2.5):
        return front * _beta_fraction(df / 2, 0.5, x) / (df / 2)
    return 1 - front * _beta_fraction(0.5, df / 2, 1 - x) / 0.5


def _p_values(g: np.ndarray, r: np.ndarray, yy: float, n: int, chosen: list[int]) -> np.ndarray:
    sub = g[np.ix_(chosen, chosen)]
    beta = np.linalg.solve(sub, r[chosen])
    left = n - len(chosen)
    s2 = max(yy - beta @ r[chosen], 0.0) / left
    t = beta / np.sqrt(np.maximum(s2 * np.diag(np.linalg.inv(sub)), 1e-300))
    return np.array([t_tail(float(v), left) for v in t])


def selected(df: DataFrame, y: str, xs: list[str], threshold: float = 0.05, forward: bool = True) -> list[str]:
    """Regressors (with a constant) chosen by p-values: the best added while below the threshold, or the worst dropped."""
    df = df.withColumn("_one", F.lit(1.0))
    g, r, yy, n = gram(df, y, ["_one", *xs])
    inside = [] if forward else list(range(1, len(xs) + 1))
    while True:
        if forward:
            trial = {i: _p_values(g, r, yy, n, [0, *inside, i])[-1] for i in range(1, len(xs) + 1) if i not in inside}
            best = min(trial, key=lambda i: (trial[i], i), default=None)
            if best is None or trial[best] >= threshold:
                break
            inside.append(best)
        else:
            p = _p_values(g, r, yy, n, [0, *inside])[1:]
            if not len(p) or p.max() <= threshold:
                break
            inside.pop(int(p.argmax()))
    return [xs[i - 1] for i in inside]


def adf(df: DataFrame, lags: int = 1, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """Dickey-Fuller t-statistic with constant and trend and so many lagged differences."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].dropna().to_numpy(float)
        d = np.diff(x)
        n = len(d) - lags
        stat = None
        if n > lags + 4:
            cols = [x[lags:-1], np.ones(n), np.arange(n, dtype=float), *(d[lags - i : len(d) - i] for i in range(1, lags + 1))]
            m, t = np.column_stack(cols), d[lags:]
            b, *_ = np.linalg.lstsq(m, t, rcond=None)
            s2 = ((t - m @ b) ** 2).sum() / (n - m.shape[1])
            stat = float(b[0] / math.sqrt(s2 * np.linalg.pinv(m.T @ m)[0, 0]))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "t": [stat], "n": [n]})

    return df.select(by, order, value).groupBy(by).applyInPandas(one, f"{by} {dict(df.dtypes)[by]}, t double, n long")


def optimised(assets: DataFrame, covariance: DataFrame, risk: float = 1.0, cost: float = 0.0, total: float | None = 0.0) -> DataFrame:
    """Active weights x per date that make r'x - cost |wb + x - w0| - risk x'Vx largest, within wmin <= wb + x <= wmax and
    with a sum of `total`. assets: date, id, r, wb, w0, wmin, wmax; covariance: date, id1, id2, cov (missing: 0).
    A date is one group; a date without a solution gives no rows."""
    left = assets.select("date", F.col("id").cast("string").alias("id"), *(F.col(c).cast("double") for c in ("r", "wb", "w0", "wmin", "wmax")))
    right = covariance.select(F.col("date").alias("_date"), F.col("id1").cast("string").alias("id1"), F.col("id2").cast("string").alias("id2"), F.col("cov").cast("double").alias("cov"))

    def one(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("id").reset_index(drop=True)
        n, at = len(a), {k: i for i, k in enumerate(a["id"])}
        v = np.zeros((n, n))
        for i, j, x in zip(c["id1"], c["id2"], c["cov"], strict=True):
            if i in at and j in at:
                v[at[i], at[j]] = v[at[j], at[i]] = x
        empty = a[["date", "id"]].iloc[:0].assign(weight=0.0, active=0.0)
        # buying and selling as two variables above 0: x = w0 - wb + u - s
        base = (a["w0"] - a["wb"]).to_numpy()
        both = np.hstack([np.eye(n), -np.eye(n)])
        p = 2 * risk * both.T @ v @ both
        q = both.T @ (2 * risk * v @ base - a["r"].to_numpy()) + cost
        rows = [np.eye(2 * n), both] + ([both.sum(axis=0, keepdims=True)] if total is not None else [])
        low = [np.zeros(2 * n), (a["wmin"] - a["wb"]).to_numpy() - base] + ([[total - base.sum()]] if total is not None else [])
        high = [np.full(2 * n, np.inf), (a["wmax"] - a["wb"]).to_numpy() - base] + ([[total - base.sum()]] if total is not None else [])
        try:
            x = base + both @ quadratic(p, q, np.vstack(rows), np.concatenate(low), np.concatenate(high), tol=1e-9)
        except ValueError:
            return empty
        return pd.DataFrame({"date": a["date"], "id": a["id"], "weight": a["wb"] + x, "active": x})

    return left.groupBy("date").cogroup(right.groupBy("_date")).applyInPandas(one, "date date, id string, weight double, active double")


def factor_covariance(exposures: DataFrame, factors: DataFrame, specific: DataFrame) -> DataFrame:
    """date, id1, id2, cov by a factor model: exposures' product over the factors' covariance, and the squares of specific
    risks on the diagonal. exposures: date, id, factor, x; factors: date, factor1, factor2, cov; specific: date, id, sd.

    Every two ids of a date are asked for, so the result is as large as that.
    """
    left = exposures.select("date", F.col("id").alias("id1"), F.col("factor").alias("factor1"), F.col("x").alias("_x1"))
    right = exposures.select("date", F.col("id").alias("id2"), F.col("factor").alias("factor2"), F.col("x").alias("_x2"))
    half = left.join(factors, ["date", "factor1"]).groupBy("date", "id1", "factor2").agg(F.sum(F.col("_x1") * F.col("cov")).alias("_h"))
    common = half.join(right, ["date", "factor2"]).groupBy("date", "id1", "id2").agg(F.sum(F.col("_h") * F.col("_x2")).alias("cov"))
    own = specific.select("date", F.col("id").alias("id1"), F.col("id").alias("id2"), (F.col("sd") * F.col("sd")).alias("cov"))
    return common.unionByName(own).groupBy("date", "id1", "id2").agg(F.sum("cov").alias("cov"))
