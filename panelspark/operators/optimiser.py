"""Active portfolios under a factor model of risk: many ids, few factors and limits.

Risk is a diagonal of own risks and a product of few factors, so each step of the alternating direction method solves a
diagonal system that few columns (factors and limits) correct. What trading costs and the weights' ends are
handled weight by weight. A step of n ids and k columns takes n times k, and no n by n matrix is made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Diagonal:
    """Solves (diag + U U') x = b by the k by k system of U's columns."""

    def __init__(self, diagonal: np.ndarray, columns: np.ndarray):
        self.d, self.u = diagonal, columns
        self.inner = np.linalg.inv(np.eye(columns.shape[1]) + columns.T @ (columns / diagonal[:, None]))

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b / self.d
        return x - (self.u @ (self.inner @ (self.u.T @ x))) / self.d


def solved(r: np.ndarray, columns: np.ndarray, own: np.ndarray, base: np.ndarray, cost: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, rounds: int = 40_000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """x that makes r'x - cost'|x - base| - |columns'x|^2 - sum(own x^2) largest, with low <= x <= high and least <= rows x <= most;
    with it the prices of the ends (and of trading) and of the rows. None if no x meets all limits.
    """
    n, m = len(r), len(least)
    scale = max(np.abs(r).max(initial=0), 2 * own.max(initial=0), 1e-12)
    r, own, cost, columns = r / scale, own / scale, cost / scale, columns / np.sqrt(scale)
    size = np.maximum(np.linalg.norm(rows, axis=1), 1e-12) if m else np.ones(0)
    rows, least, most = rows / size[:, None], least / size, most / size
    if (low > high + 1e-12).any() or (least > most + 1e-12).any():
        return None
    rho, z, v = 1.0, np.clip(base, low, high), np.zeros(n)
    s, u = np.clip(rows @ z, least, most), np.zeros(m)
    stiff = np.where(least == most, 1e2, 1.0)

    def prepared(rho: float) -> Diagonal:
        return Diagonal(2 * own + rho, np.hstack([np.sqrt(2) * columns, rows.T * np.sqrt(rho * stiff)]))

    system = prepared(rho)
    for i in range(rounds):
        x = system.solve(r + rho * z - v + rows.T @ (rho * stiff * s - u))
        ax = rows @ x
        at = x + v / rho - base
        new = np.clip(base + np.sign(at) * np.maximum(np.abs(at) - cost / rho, 0), low, high)
        inside = np.clip(ax + u / (rho * stiff), least, most)
        v, u = v + rho * (x - new), u + rho * stiff * (ax - inside)
        primal = max(np.abs(x - new).max(initial=0), np.abs(ax - inside).max(initial=0))
        dual = rho * max(np.abs(new - z).max(initial=0), np.abs(stiff * (inside - s)).max(initial=0))
        z, s = new, inside
        if primal < tol and dual < tol:
            return z, v * scale, u * scale / size
        if i % 100 == 99 and (primal > 10 * dual or dual > 10 * primal):
            rho = float(np.clip(rho * (2.5 if primal > dual else 0.4), 1e-7, 1e7))
            system = prepared(rho)
    return (z, v * scale, u * scale / size) if primal < 1e-7 else None


ASSETS = ["r", "wb", "w0", "cost", "wmin", "wmax", "own"]
#: Parts of a date's problem, as rows of one table.
EXPOSURE, FACTOR, ROW, LIMIT = "exposure", "factor", "row", "limit"


def parts(exposures: DataFrame, factors: DataFrame, rows: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """One long table (date, kind, a, b, x, y) of exposures (date, id, factor, x), factors (date, factor1, factor2, cov), coefficients of
    rows (date, name, id, x) and limits of rows (date, name, low, high; null: open)."""
    of = lambda df, kind, a, b, x, y=None: df.select("date", F.lit(kind).alias("kind"), F.col(a).cast("string").alias("a"), (F.col(b).cast("string") if b else F.lit(None).cast("string")).alias("b"), F.col(x).cast("double").alias("x"), (F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("y"))
    out = of(exposures, EXPOSURE, "id", "factor", "x").unionByName(of(factors, FACTOR, "factor1", "factor2", "cov"))
    if rows is not None:
        out = out.unionByName(of(rows, ROW, "name", "id", "x"))
    return out.unionByName(of(limits, LIMIT, "name", None, "low", "high")) if limits is not None else out


def matrix(p: pd.DataFrame, kind: str, left: dict, right: dict) -> np.ndarray:
    mine = p[(p["kind"] == kind) & p["a"].isin(left) & p["b"].isin(right)]
    out = np.zeros((len(left), len(right)))
    out[mine["a"].map(left).to_numpy(int), mine["b"].map(right).to_numpy(int)] = mine["x"].to_numpy(float)
    return out


def optimised(assets: DataFrame, problem: DataFrame, risk: float = 1.0, total: float | None = 0.0, members: float | None = None) -> DataFrame:
    """date, id, weight, active, gain (r'x) and variance of the best portfolio of each date; no rows where limits can't be met.

    assets: date, id, r (expected return), wb (benchmark), w0 (held), cost (of trading one), wmin, wmax, own (deviation that factors
    don't explain); problem: parts(). Made largest is r'x - cost'|wb + x - w0| - risk times the variance of x, where wmin <= wb + x
    <= wmax, x sums to `total` (None: to anything), rows keep within their limits, and ids of the benchmark hold at least `members`.
    A date is one group: its ids times its factors.
    """
    left = assets.select("date", F.col("id").cast("string").alias("id"), *(F.col(c).cast("double").alias(c) for c in ASSETS))
    right = problem.withColumnRenamed("date", "_date")

    def one(a: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        a = a.sort_values("id").reset_index(drop=True)
        none = a[["date", "id"]].iloc[:0].assign(weight=0.0, active=0.0, gain=0.0, variance=0.0)
        if not len(a):
            return none
        ids = {k: i for i, k in enumerate(a["id"])}
        factor = {k: i for i, k in enumerate(sorted({*p[p["kind"] == EXPOSURE]["b"], *p[p["kind"] == FACTOR]["a"]}))}
        cov = matrix(p, FACTOR, factor, factor)
        value, vector = np.linalg.eigh((cov + cov.T) / 2) if factor else (np.zeros(0), np.zeros((0, 0)))
        columns = matrix(p, EXPOSURE, ids, factor) @ (vector * np.sqrt(np.maximum(value, 0)))
        ends = p[p["kind"] == LIMIT].sort_values("a")
        name = {k: i for i, k in enumerate(ends["a"])}
        rows, least, most = [matrix(p, ROW, name, ids)], [ends["x"].fillna(-np.inf).to_numpy(float)], [ends["y"].fillna(np.inf).to_numpy(float)]
        wb, r, own = (a[c].to_numpy(float) for c in ("wb", "r", "own"))
        if total is not None:
            rows, least, most = [*rows, np.ones((1, len(a)))], [*least, [total]], [*most, [total]]
        if members is not None:
            inside = (wb != 0).astype(float)
            rows, least, most = [*rows, inside[None, :]], [*least, [members - wb.sum()]], [*most, [np.inf]]
        found = solved(r, columns * np.sqrt(risk), own**2 * risk, (a["w0"] - a["wb"]).to_numpy(float), a["cost"].fillna(0.0).to_numpy(float), (a["wmin"] - a["wb"]).fillna(-np.inf).to_numpy(float), (a["wmax"] - a["wb"]).fillna(np.inf).to_numpy(float), np.vstack(rows), np.concatenate(least), np.concatenate(most))
        if found is None:
            return none
        x = found[0]
        return pd.DataFrame({"date": a["date"], "id": a["id"], "weight": wb + x, "active": x, "gain": r @ x, "variance": ((columns.T @ x) ** 2).sum() + (own**2 * x**2).sum()})

    return left.groupBy("date").cogroup(right.groupBy("_date")).applyInPandas(one, f"date {dict(left.dtypes)['date']}, id string, weight double, active double, gain double, variance double")
