"""Seasonal adjustment by moving averages (the X-11 way), with a festival's effect by regression.

A monthly (or quarterly) series is parted into trend, season and rest, by sums or by products. Trends come from a centred year's mean
first and from Henderson's averages then; seasons from averages of the same month of the years around, of three by three
and then of three by five; extreme values of the rest get less or no weight. Ends have one-sided averages: the
tabled ones for seasons, Musgrave's for trends. A regressor's effect is estimated on what remains of the series after
seasonal and plain differences, whose errors are moving averages of both kinds, and taken off before.

Each series is a group; a series of a thousand months is worked out in one task, any number of series side by side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One-sided seasonal averages by the number of later years that are there (newest year first), and the limits
# in standard deviations between which extreme values lose their weight.
SEASONAL = {
    3: {0: np.array([11, 11, 5]) / 27, 1: np.array([7, 10, 7, 3]) / 27, 2: np.array([1, 2, 3, 2, 1]) / 9},
    5: {0: np.array([17, 17, 17, 9]) / 60, 1: np.array([15, 15, 15, 11, 4]) / 60, 2: np.array([9, 13, 13, 13, 8, 4]) / 60, 3: np.array([1, 2, 3, 3, 3, 2, 1]) / 15},
}
FULL, NONE = 1.5, 2.5
#: Henderson's average by the ratio of the rest's changes to the trend's: (up to, terms, ratio that the ends assume).
TERMS = [(1.0, 9, 1.0), (3.5, 13, 3.5), (math.inf, 23, 4.5)]


def centred_mean(x: np.ndarray, period: int) -> np.ndarray:
    """The mean of a year around each point, the first and last month of it by half; null within half a year of the ends."""
    weights = np.full(period + 1 - period % 2, 1 / period)
    if period % 2 == 0:
        weights[[0, -1]] /= 2
    out, half = np.full(len(x), np.nan), len(weights) // 2
    if len(x) >= len(weights):
        out[half : len(x) - half] = np.convolve(x, weights, "valid")
    return out


def henderson(terms: int) -> np.ndarray:
    """Weights of the average of so many terms that keeps cubics and is the smoothest."""
    n = terms // 2 + 2
    j = np.arange(-(terms // 2), terms // 2 + 1.0)
    return 315 * ((n - 1) ** 2 - j**2) * (n**2 - j**2) * ((n + 1) ** 2 - j**2) * (3 * n**2 - 16 - 11 * j**2) / (8 * n * (n**2 - 1) * (4 * n**2 - 1) * (4 * n**2 - 9) * (4 * n**2 - 25))


def musgrave(weights: np.ndarray, known: int, ratio: float) -> np.ndarray:
    """Weights for the first `known` terms alone, which change least for a straight line with noise of that ratio."""
    d, middle = 4 / (math.pi * ratio**2), (known + 1) / 2
    place, lost = np.arange(1, known + 1), weights[known:]
    tilt = ((np.arange(known + 1, len(weights) + 1) - middle) * lost).sum()
    return weights[:known] + lost.sum() / known + (place - middle) * d * tilt / (1 + known * (known - 1) * (known + 1) / 12 * d)


def trend(x: np.ndarray, terms: int, ratio: float) -> np.ndarray:
    weights, half, n = henderson(terms), terms // 2, len(x)
    out = np.empty(n)
    for t in range(n):
        before, after = min(half, t), min(half, n - 1 - t)
        if before == half and after == half:
            w = weights
        elif before == half:
            w = musgrave(weights, half + 1 + after, ratio)
        elif after == half:
            w = musgrave(weights, half + 1 + before, ratio)[::-1]
        else:  # shorter than the average
            w = weights[half - before : half + after + 1]
            w = w / w.sum()
        out[t] = w @ x[t - before : t + after + 1]
    return out


def seasonal_average(x: np.ndarray, period: int, size: int) -> np.ndarray:
    """Each month's average over the years around; nulls count as the nearest year that has a value."""
    out, tables = np.empty(len(x)), SEASONAL[size]
    reach = max(tables)
    for month in range(min(period, len(x))):
        of = pd.Series(x[month::period]).ffill().bfill().to_numpy()
        n = len(of)
        for i in range(n):
            later, earlier = min(reach, n - 1 - i), min(reach, i)
            if later <= earlier:
                w = tables[later][: i + later + 1]
                part = of[i + later - len(w) + 1 : i + later + 1][::-1]
            else:
                w = tables[earlier][: n - 1 - i + earlier + 1]
                part = of[i - earlier : i - earlier + len(w)]
            out[month + i * period] = w @ part / w.sum()
    return out


def normalised(s: np.ndarray, period: int, product: bool) -> np.ndarray:
    """Seasons that sum to nothing (or make one) over any year around; at the ends by the nearest such year."""
    level = pd.Series(centred_mean(s, period)).ffill().bfill().fillna(1.0 if product else 0.0).to_numpy()
    return s / level if product else s - level


def weights_of(rest: np.ndarray, period: int, centre: float) -> np.ndarray:
    """1 for usual values of the rest and 0 for extreme ones, by the deviation in five years around, extreme values left out."""
    gap, n = rest - centre, len(rest)
    years = np.arange(n) // period
    deviation = np.empty(n)
    for y in range(years[-1] + 1):
        first = max(0, min(y - 2, years[-1] - 4))
        inside = gap[(years >= first) & (years <= first + 4)]
        inside = inside[np.isfinite(inside)]
        spread = math.sqrt((inside**2).mean()) if len(inside) else 0.0
        usual = inside[np.abs(inside) <= NONE * spread]
        deviation[years == y] = math.sqrt((usual**2).mean()) if len(usual) else 0.0
    far = np.divide(np.abs(gap), deviation, out=np.zeros(n), where=deviation > 0)
    return np.where(np.isnan(gap), 1.0, np.clip((NONE - far) / (NONE - FULL), 0.0, 1.0))


def replaced(si: np.ndarray, weight: np.ndarray, period: int) -> np.ndarray:
    """Values of less than full weight give way to the mean of themselves, so weighted, and the nearest two full ones of their month before and after."""
    out = si.copy()
    for t in np.flatnonzero((weight < 1) & np.isfinite(si)):
        full = lambda places: [si[p] for p in places if weight[p] == 1 and np.isfinite(si[p])][:2]
        near = full(range(t - period, -1, -period)) + full(range(t + period, len(si), period))
        total = weight[t] + len(near)
        if total > 0:
            out[t] = (weight[t] * si[t] + sum(near)) / total
    return out


def adjusted(x: np.ndarray, period: int = 12, product: bool = False) -> dict[str, np.ndarray]:
    """trend, seasonal, irregular and adjusted of a series; of one of less than three years, what it is without seasons."""
    n, centre = len(x), 1.0 if product else 0.0
    off = (lambda a, b: a / b) if product else (lambda a, b: a - b)
    if n < 3 * period:
        return {"trend": trend(x, 9, 1.0) if n else x, "seasonal": np.full(n, centre), "irregular": off(x, trend(x, 9, 1.0)) if n else x, "adjusted": x}
    cleaned = x
    for _ in range(3):  # each round knows better which values are extreme
        si = off(cleaned, centred_mean(cleaned, period))
        season = normalised(seasonal_average(si, period, 3), period, product)
        si = replaced(si, weights_of(off(si, season), period, centre), period)
        season = normalised(seasonal_average(si, period, 3), period, product)
        si = off(x, fitted(off(cleaned, season), product)[0])
        season = normalised(seasonal_average(si, period, 5), period, product)
        si = replaced(si, weights_of(off(si, season), period, centre), period)
        season = normalised(seasonal_average(si, period, 5), period, product)
        smooth, _ = fitted(off(cleaned, season), product)
        rest = off(off(x, season), smooth)
        usual = centre + weights_of(rest, period, centre) * (rest - centre)
        cleaned = smooth * season * usual if product else smooth + season + usual
    smooth, _ = fitted(off(cleaned, season), product)
    final = off(x, season)
    return {"trend": smooth, "seasonal": season, "irregular": off(final, smooth), "adjusted": final}


def fitted(x: np.ndarray, product: bool) -> tuple[np.ndarray, int]:
    """The trend of an adjusted series by the average that its noise asks for, and its number of terms."""
    first = trend(x, 13, 3.5)
    rest = x / first if product else x - first
    change = lambda v: np.abs(v[1:] / v[:-1] - 1).mean() if product else np.abs(np.diff(v)).mean()
    ratio = change(rest) / c if (c := change(first)) else math.inf
    terms, assumed = next((t, a) for limit, t, a in TERMS if ratio <= limit)
    return trend(x, terms, assumed), terms


def differenced(x: np.ndarray, period: int) -> np.ndarray:
    x = x[period:] - x[:-period]
    return x[1:] - x[:-1]


def covariance(n: int, plain: float, seasonal: float, period: int) -> np.ndarray:
    """Of n successive values of (1 - plain B)(1 - seasonal B^period) on noise of variance 1."""
    weights = np.zeros(period + 2)
    weights[[0, 1, period, period + 1]] = 1.0, -plain, -seasonal, plain * seasonal
    at_lag = np.zeros(max(n, period + 2))
    at_lag[: period + 2] = np.correlate(weights, weights, "full")[period + 1 :]
    return at_lag[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def effects(y: np.ndarray, x: np.ndarray, period: int = 12) -> tuple[np.ndarray, float, float]:
    """Coefficients of the columns of x on y, and the two moving-average parameters of the differenced errors.

    For each pair of a grid, which grows finer around the best, generalised least squares; the likeliest pair wins. The
    likelihood is exact, so that a parameter of one (a steady season or trend) is no trouble.
    """
    both = np.column_stack([differenced(c, period) for c in (y, *x.T)])
    n, centre, width, best = len(both), (0.4, 0.4), 0.6, None
    for _ in range(4):
        for plain in np.unique(np.clip(centre[0] + np.linspace(-width, width, 5), -0.99, 1.0)):
            for seasonal in np.unique(np.clip(centre[1] + np.linspace(-width, width, 5), -0.99, 1.0)):
                root = np.linalg.cholesky(covariance(n, plain, seasonal, period) + 1e-9 * np.eye(n))
                white = np.linalg.solve(root, both)
                b, *_ = np.linalg.lstsq(white[:, 1:], white[:, 0], rcond=None)
                rest = ((white[:, 0] - white[:, 1:] @ b) ** 2).mean()
                loss = n * math.log(max(rest, 1e-300)) + 2 * np.log(np.diag(root)).sum()
                if best is None or loss < best[0]:
                    best = (loss, b, plain, seasonal)
        centre, width = best[2:], width / 2.5
    return best[1], float(best[2]), float(best[3])


COLUMNS = ["effect", "trend", "seasonal", "irregular", "adjusted"]


def seasonally_adjusted(df: DataFrame, period: int = 12, product: bool = False, regressors: list[str] | None = None, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """by, order, value, effect (of the regressors), trend, seasonal, irregular, adjusted (the value without season and effect).

    product: parts are multiplied, which asks for positive values; effects are then those on logarithms. Series need a row for each period; nulls are left out.
    """
    regressors = regressors or []
    narrow = df.select(F.col(by), F.col(order), F.col(value).cast("double").alias("value"), *(F.col(c).cast("double").alias(c) for c in regressors)).where("value is not null")
    kinds = dict(narrow.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "value"]).reset_index(drop=True)
        y, x = pdf["value"].to_numpy(float), pdf[regressors].fillna(0.0).to_numpy(float)
        effect = np.full(len(y), 1.0 if product else 0.0)
        if regressors and len(y) > period + 1 + len(regressors) + 2:
            b, *_ = effects(np.log(y) if product else y, x, period)
            effect = np.exp(x @ b) if product else x @ b
        found = adjusted(y / effect if product else y - effect, period, product)
        return pdf[[by, order, "value"]].assign(effect=effect, **found)

    return narrow.groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {order} {kinds[order]}, value double, " + ", ".join(f"{c} double" for c in COLUMNS))


def rolling_adjusted(df: DataFrame, window: int, period: int = 12, product: bool = False, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """Each point's adjusted value by the `window` points up to it; null until there are so many."""
    narrow = df.select(F.col(by), F.col(order), F.col(value).cast("double").alias("value")).where("value is not null")
    kinds = dict(narrow.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "value"]).reset_index(drop=True)
        x, out = pdf["value"].to_numpy(float), [None] * len(pdf)
        for i in range(window - 1, len(x)):
            out[i] = adjusted(x[i + 1 - window : i + 1], period, product)["adjusted"][-1]
        return pdf.assign(adjusted=pd.Series(out, dtype=object))

    return narrow.groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {order} {kinds[order]}, value double, adjusted double")
