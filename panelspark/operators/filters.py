"""Time-series filters and turning points. A series is a group of rows; what is recursive runs over it in order, once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.align import as_of

LAMBDA = {"M": 129600.0, "Q": 1600.0, "Y": 6.25, "D": 1600.0 * 60**4}


def ewma(df: DataFrame, window: float | None = None, half_life: float | None = None, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """y0 = x0, then (1 - a) y + a x, with a = 2 / (1 + window), or by half-life."""
    a = 2 / (1 + window) if window is not None else 1 - math.exp(math.log(0.5) / half_life)

    def f(x: np.ndarray) -> list[np.ndarray]:
        y = x.copy()
        for t in range(1, len(x)):
            y[t] = (1 - a) * y[t - 1] + a * x[t]
        return [y]

    return _per_series(df, f, by, value, order, ["ewma"])


def llt(df: DataFrame, window: float = 6, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """Second-order low-lag trend line, begun in the steady state of the first value."""
    a = 2 / (1 + window)

    def f(x: np.ndarray) -> list[np.ndarray]:
        out = np.empty(len(x))
        x1 = x2 = y1 = y2 = x[0] if len(x) else 0.0
        for t, v in enumerate(x):
            out[t] = y = (a - a * a / 4) * v + (a * a / 2) * x1 - (a - 3 * a * a / 4) * x2 + 2 * (1 - a) * y1 - (1 - a) ** 2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
        return [out]

    return _per_series(df, f, by, value, order, ["llt"])


def _per_series(df: DataFrame, f, by: str, value: str, order: str, columns: list[str]) -> DataFrame:
    """f(values) -> arrays, on each series in order; one series is held by one task."""
    narrow = df.select(F.col(by), F.col(order), F.col(value).cast("double").alias("value")).where("value is not null")
    kinds = dict(narrow.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "value"]).reset_index(drop=True)
        return pdf.assign(**dict(zip(columns, f(pdf["value"].to_numpy(float)), strict=True)))

    return narrow.groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {order} {kinds[order]}, value double, " + ", ".join(f"{c} double" for c in columns))


def hp_trend(x: np.ndarray, lamb: float) -> np.ndarray:
    """Hodrick-Prescott trend: (I + lambda D'D) t = x, by elimination in the band of two."""
    n = len(x)
    if n < 3:
        return x.copy()
    main, one, two = np.ones(n), np.zeros(n - 1), np.zeros(n - 2)
    main[:-2] += lamb
    main[1:-1] += 4 * lamb
    main[2:] += lamb
    one[:-1] -= 2 * lamb
    one[1:] -= 2 * lamb
    two += lamb
    d, l1, l2, y = main.copy(), np.zeros(n), np.zeros(n), x.astype(float).copy()
    for i in range(n):
        if i >= 2:
            l2[i] = two[i - 2] / d[i - 2]
        if i >= 1:
            l1[i] = (one[i - 1] - (l2[i] * d[i - 2] * l1[i - 1] if i >= 2 else 0.0)) / d[i - 1]
        d[i] -= (l1[i] ** 2 * d[i - 1] if i >= 1 else 0.0) + (l2[i] ** 2 * d[i - 2] if i >= 2 else 0.0)
        y[i] -= (l1[i] * y[i - 1] if i >= 1 else 0.0) + (l2[i] * y[i - 2] if i >= 2 else 0.0)
    y /= d
    for i in range(n - 2, -1, -1):
        y[i] -= l1[i + 1] * y[i + 1] + (l2[i + 2] * y[i + 2] if i + 2 < n else 0.0)
    return y


def hp_last(x: np.ndarray, lamb: float) -> np.ndarray:
    """The last point of the trend of each beginning of x, in one pass.

    The equations of two beginnings differ in their last two rows alone. So all rows but these are eliminated once, and each
    beginning ends the elimination with two rows of its own, whose last gives the point.
    """
    n = len(x)
    out = np.array([hp_trend(x[: m + 1], lamb)[-1] for m in range(min(n, 4))])
    if n <= 4:
        return out
    d, l1, y = np.zeros(n), np.zeros(n), np.zeros(n)  # l2 is lamb / d two rows before

    def row(i: int, diagonal: float, beside: float) -> tuple[float, float, float]:
        """What elimination makes of row i: its pivot, its factor of the row before, its right side."""
        two = lamb / d[i - 2] if i >= 2 else 0.0
        one = (beside - (lamb * l1[i - 1] if i >= 2 else 0.0)) / d[i - 1] if i >= 1 else 0.0
        pivot = diagonal - (one * one * d[i - 1] if i >= 1 else 0.0) - (two * two * d[i - 2] if i >= 2 else 0.0)
        return pivot, one, x[i] - (one * y[i - 1] if i >= 1 else 0.0) - (two * y[i - 2] if i >= 2 else 0.0)

    last = np.empty(n)
    last[:4] = out
    for i in range(n):
        # as an inner row, which the beginnings share
        inner = 1 + lamb * (1.0 if i == 0 else 5.0 if i == 1 else 6.0), lamb * (-2.0 if i == 1 else -4.0)
        if i >= 4:
            kept = d[i - 1], l1[i - 1], y[i - 1]
            d[i - 1], l1[i - 1], y[i - 1] = row(i - 1, 1 + 5 * lamb, -4 * lamb)
            pivot, _, right = row(i, 1 + lamb, -2 * lamb)
            last[i] = right / pivot
            d[i - 1], l1[i - 1], y[i - 1] = kept
        d[i], l1[i], y[i] = row(i, *inner)
    return last


def hp_cycle(df: DataFrame, freq: str = "M", min_periods: int = 24, lamb: float | None = None, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """Each point's cycle by the series up to it; the first `min_periods` by the whole series."""
    size = lamb or LAMBDA[freq]

    def f(x: np.ndarray) -> list[np.ndarray]:
        out = x - hp_trend(x, size)
        out[min_periods:] = (x - hp_last(x, size))[min_periods:]
        return [out]

    return _per_series(df, f, by, value, order, ["cycle"])


def local_level(x: np.ndarray, iterations: int) -> list[np.ndarray]:
    """Kalman filter and smoother of an AR(1) state seen with noise, its three parameters by EM."""
    n = len(x)
    a, q, r = 1.0, max(np.var(x) / 2, 1e-12), max(np.var(x) / 2, 1e-12)
    m0, p0 = (x[0] if n else 0.0), 1.0
    for _ in range(iterations + 1):
        m, p, mp, pp = (np.zeros(n) for _ in range(4))
        for t in range(n):
            mp[t], pp[t] = (a * m[t - 1], a * a * p[t - 1] + q) if t else (m0, p0)
            k = pp[t] / (pp[t] + r)
            m[t], p[t] = mp[t] + k * (x[t] - mp[t]), (1 - k) * pp[t]
        ms, ps, cross = m.copy(), p.copy(), np.zeros(n)
        for t in range(n - 2, -1, -1):
            j = p[t] * a / pp[t + 1]
            ms[t] += j * (ms[t + 1] - mp[t + 1])
            ps[t] += j * j * (ps[t + 1] - pp[t + 1])
            cross[t + 1] = j * ps[t + 1]
        if n < 3:
            break
        before, now, both = (ms[:-1] ** 2 + ps[:-1]).sum(), (ms[1:] ** 2 + ps[1:]).sum(), (ms[1:] * ms[:-1] + cross[1:]).sum()
        new = both / before if before else 1.0
        result = m, ms, a
        a, q = new, max((now - new * both) / (n - 1), 1e-12)
        r = max(((x - ms) ** 2 + ps).mean(), 1e-12)
        m, ms, _ = result
    return [m, ms, np.full(n, a)]


def kalman(df: DataFrame, iterations: int = 5, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    return _per_series(df, lambda x: local_level(x, iterations), by, value, order, ["filtered", "smoothed", "persistence"])


def turning(x: np.ndarray, cycle: int = 15, phase: int = 5, reach: int = 5) -> np.ndarray:
    """Peaks 1 and troughs -1 by Bry and Boschan's rules: local extremes, alternation, least cycle and phase length."""
    n, sign = len(x), np.zeros(len(x))
    for i in range(reach, n - reach):  # the ends can't be told
        near = x[i - reach : i + reach + 1]
        if near.max() > near.min():
            sign[i] = 1.0 if x[i] == near.max() else -1.0 if x[i] == near.min() else 0.0

    def alternate() -> None:
        last = -1
        for i in np.flatnonzero(sign):
            if last >= 0 and sign[i] == sign[last]:
                worse = last if sign[i] * x[i] > sign[i] * x[last] else i
                sign[worse] = 0
                last = i if worse == last else last
            else:
                last = i

    def thin(kind: float, least: int) -> None:
        """Of two like points closer than a cycle the weaker goes."""
        last = -1
        for i in np.flatnonzero(sign == kind):
            if last >= 0 and i - last < least:
                worse = last if kind * x[i] > kind * x[last] else i
                sign[worse] = 0
                last = i if worse == last else last
            else:
                last = i

    alternate()
    for kind in (1.0, -1.0):
        thin(kind, cycle)
        alternate()
    points = np.flatnonzero(sign)
    for a, b in zip(points[:-1], points[1:], strict=True):
        if sign[a] and sign[b] and b - a < phase:
            sign[a] = sign[b] = 0
    alternate()
    return sign


def turning_points(df: DataFrame, cycle: int = 15, phase: int = 5, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    return _per_series(df, lambda x: [turning(x, cycle, phase)], by, value, order, ["turning"])


def seasonal(x: np.ndarray, period: int) -> list[np.ndarray]:
    """Classical additive decomposition; not the census method, for which an external program would be needed."""
    n = len(x)
    trend = np.full(n, np.nan)
    half = period // 2
    weights = np.full(period + 1 - period % 2, 1 / period)
    if period % 2 == 0:
        weights[[0, -1]] /= 2
    if n >= len(weights):
        trend[half : n - half] = np.convolve(x, weights, "valid")
    gap = x - trend
    means = np.array([np.nanmean(gap[i::period]) if np.isfinite(gap[i::period]).any() else 0.0 for i in range(period)])
    season = (means - means.mean())[np.arange(n) % period]
    return [trend, season, x - season]


def seasonally_adjusted(df: DataFrame, period: int = 12, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    return _per_series(df, lambda x: seasonal(x, period), by, value, order, ["trend", "seasonal", "adjusted"])


def rolling_adjusted(df: DataFrame, window: int, period: int = 12, by: str = "series", value: str = "value", order: str = "date") -> DataFrame:
    """Each point's seasonally adjusted value by the `window` points up to it; null until there are so many."""

    def f(x: np.ndarray) -> list[np.ndarray]:
        out = np.full(len(x), np.nan)
        for i in range(window - 1, len(x)):
            out[i] = seasonal(x[i + 1 - window : i + 1], period)[2][-1]
        return [out]

    return _per_series(df, f, by, value, order, ["adjusted"]).withColumn("adjusted", F.when(~F.isnan("adjusted"), F.col("adjusted")))


def random_walk_regression(y: np.ndarray, x: np.ndarray, iterations: int) -> np.ndarray:
    """Smoothed coefficients of y on x that move as random walks; begun by least squares, variances by EM."""
    n, k = x.shape
    start, *_ = np.linalg.lstsq(x, y, rcond=None)
    r = max(float(np.var(y - x @ start)), 1e-8)
    q, m0, p0 = np.eye(k) * r * 1e-2, start, np.eye(k) * max(r, 1.0)
    smooth = np.tile(start, (n, 1))
    for _ in range(iterations + 1):
        m, p, pp = np.zeros((n, k)), np.zeros((n, k, k)), np.zeros((n, k, k))
        for t in range(n):
            before, pp[t] = (m[t - 1], p[t - 1] + q) if t else (m0, p0)
            gain = pp[t] @ x[t] / (x[t] @ pp[t] @ x[t] + r)
            m[t] = before + gain * (y[t] - x[t] @ before)
            p[t] = pp[t] - np.outer(gain, x[t]) @ pp[t]
        smooth, ps, moved = m.copy(), p.copy(), np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            j = p[t] @ np.linalg.pinv(pp[t + 1])
            smooth[t] += j @ (smooth[t + 1] - m[t])
            ps[t] += j @ (ps[t + 1] - pp[t + 1]) @ j.T
            cross = ps[t + 1] @ j.T
            step = smooth[t + 1] - smooth[t]
            moved += np.outer(step, step) + ps[t + 1] + ps[t] - cross - cross.T
        if n > k + 2:
            q = moved / (n - 1) + 1e-12 * np.eye(k)
            left = y - (x * smooth).sum(axis=1)
            r = max(float((left**2 + np.einsum("ti,tij,tj->t", x, ps, x)).mean()), 1e-8)
    return smooth


def changing_coefficients(df: DataFrame, y: str, xs: list[str], iterations: int = 5, intercept: bool = True, by: str = "series", order: str = "date") -> DataFrame:
    """Time-varying regression per series: each row's coefficients (b_<x>, and b_const); rows with a null are left out."""
    names = [*xs, *(["const"] if intercept else [])]
    narrow = df.select(by, order, *(F.col(c).cast("double").alias(c) for c in [y, *xs])).dropna(subset=[y, *xs])
    kinds = dict(narrow.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        x = np.column_stack([pdf[xs].to_numpy(float), *([np.ones(len(pdf))] if intercept else [])])
        b = random_walk_regression(pdf[y].to_numpy(float), x, iterations)
        return pdf[[by, order]].assign(**{f"b_{c}": b[:, i] for i, c in enumerate(names)})

    return narrow.groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {order} {kinds[order]}, " + ", ".join(f"b_{c} double" for c in names))


def festival_regressor(festivals: DataFrame, before: int = 10, after: int = 7) -> DataFrame:
    """Share of the festival's days from `before` days ahead to `after` days on that falls in each month of January to
    March, less the month's mean over the years; festivals: year, month, day."""
    day = F.make_date("year", "month", "day")
    days = festivals.select("year", F.explode(F.sequence(F.date_sub(day, before), F.date_add(day, after))).alias("d"))
    share = days.groupBy(F.col("year"), F.month("d").alias("month")).agg((F.count("*") / (before + after + 1)).alias("share"))
    grid = festivals.select("year", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("month"))
    filled = grid.join(share, ["year", "month"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    mean = filled.groupBy("month").agg(F.avg("share").alias("_mean"))
    return filled.join(F.broadcast(mean), "month").select("year", "month", (F.col("share") - F.col("_mean")).alias("value"))


def merged_spring(df: DataFrame, by: str = "series") -> DataFrame:
    """January and February replaced by their mean, dated at the end of February."""
    spring = df.where(F.month("date") <= 2).groupBy(by, F.last_day(F.make_date(F.year("date"), F.lit(2), F.lit(1))).alias("date")).agg(F.avg("value").alias("value"))
    return df.where(F.month("date") > 2).select(by, "date", "value").unionByName(spring)


def matched_turns(a: DataFrame, b: DataFrame, look_back: int, look_forward: int = 0, by: str = "series") -> DataFrame:
    """Turning points of a with those of b that they match; both: by, date, turning.

    A point is matched by the last one of b up to it, if that is alike, at most `look_back` days before, and no other
    point of a lies from it on. If the last one is not alike, the last one of b up to `look_forward` days after the point
    matches if it is alike. lead: days by which b's comes first. known: whether b has any point up to this one.
    """
    own = a.select(by, "date", "turning").withColumn("_before", F.lag("date").over(Window.partitionBy(by).orderBy("date")))
    other = b.select(F.col(by), F.col("date").alias("_day"), F.col("turning").alias("_turn"))
    near = as_of(own, other, by, "date", ["_day", "_turn"], right_order="_day").withColumn("_until", F.date_add("date", look_forward))
    ahead = other.select(by, F.col("_day").alias("_day2"), F.col("_turn").alias("_turn2"))
    near = as_of(near, ahead, by, "_until", ["_day2", "_turn2"], right_order="_day2")
    alike = F.col("turning") == F.col("_turn")
    first = alike & (F.datediff("date", "_day") <= look_back) & (F.col("_before").isNull() | (F.col("_before") < F.col("_day")))
    match = F.when(first, F.col("_day")).when(~alike & (F.col("turning") == F.col("_turn2")), F.col("_day2"))
    out = near.select(by, "date", "turning", match.alias("other"), F.col("_turn").isNotNull().alias("known"))
    return out.withColumn("lead", F.datediff("date", "other")).withColumn("matched", F.col("other").isNotNull())


def match_report(a: DataFrame, b: DataFrame, look_back: int, look_forward: int = 0, by: str = "series") -> DataFrame:
    """Per series: points of a without data, matched, their share, b's superfluous share, mean and spread of the lead.

    Of b's points those count that lie within a's, and the next beyond either end.
    """
    rows = matched_turns(a, b, look_back, look_forward, by)
    ends = a.groupBy(by).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    within = b.join(ends, by).groupBy(by).agg(
        F.sum(F.col("date").between(F.col("_lo"), F.col("_hi")).cast("long")).alias("_in"),
        F.max((F.col("date") < F.col("_lo")).cast("long")).alias("_early"), F.max((F.col("date") > F.col("_hi")).cast("long")).alias("_late"),
    )
    n = lambda c: F.sum(c.cast("long"))
    stats = rows.groupBy(by).agg(n(~F.col("known")).alias("without_data"), n(F.col("matched")).alias("matched"), n(F.col("known")).alias("_all"), F.avg("lead").alias("mean_lead"), F.stddev_pop("lead").alias("std_lead"))
    other = F.col("_in") + F.col("_early") + F.col("_late")
    return stats.join(within, by, "left").select(by, "without_data", "matched", (F.col("matched") / F.nullif(F.col("_all"), F.lit(0))).alias("match_ratio"), ((other - F.col("matched")) / other).alias("redundant_ratio"), "mean_lead", "std_lead")
