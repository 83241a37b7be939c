"""Option prices and Greeks as Column expressions: Black-Scholes, Black-76 and an American binomial tree on futures.

s spot or future, k strike, r rate, t years, v volatility, cp 1 for calls and -1 for puts. Delta and gamma are in money
per 1 %, theta per trading day of 240, vega per percentage point.

What takes many steps a row (implied volatilities, trees) is computed over batches of rows as arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from panelspark.functions.maths import exp_of, ln_of, normal_cdf, normal_cdf_of, normal_pdf

C = Column


def _d1(s: C, k: C, r: C | float, t: C, v: C) -> C:
    return (F.log(s / k) + (F.lit(r) + v * v / 2) * t) / (v * F.sqrt(t))


def bs_price(s: C, k: C, r: C, t: C, v: C, cp: C) -> C:
    """Volatility of 0 or less gives the intrinsic value."""
    d1 = _d1(s, k, r, t, v)
    price = cp * (s * normal_cdf(cp * d1) - k * normal_cdf(cp * (d1 - v * F.sqrt(t))) * F.exp(-r * t))
    return F.when(v <= 0, F.greatest(F.lit(0.0), cp * (s - k))).otherwise(price)


def bs_greeks(s: C, k: C, r: C, t: C, v: C, cp: C) -> dict[str, C]:
    d1 = _d1(s, k, r, t, v)
    d2 = d1 - v * F.sqrt(t)
    decay = -s * normal_pdf(d1) * v / (2 * F.sqrt(t)) - cp * r * k * F.exp(-r * t) * normal_cdf(cp * d2)
    return {
        "price": bs_price(s, k, r, t, v, cp),
        "delta": cp * normal_cdf(cp * d1) * s * 0.01,
        "gamma": normal_pdf(d1) / (s * v * F.sqrt(t)) * s * s * 1e-4,
        "theta": decay / 240,
        "vega": s * normal_pdf(d1) * F.sqrt(t) / 100,
    }


def black_price(s: C, k: C, r: C, t: C, v: C, cp: C) -> C:
    d1 = _d1(s, k, 0.0, t, v)
    price = cp * F.exp(-r * t) * (s * normal_cdf(cp * d1) - k * normal_cdf(cp * (d1 - v * F.sqrt(t))))
    return F.when(v <= 0, F.greatest(F.lit(0.0), cp * (s - k))).otherwise(price)


def black_greeks(s: C, k: C, r: C, t: C, v: C, cp: C) -> dict[str, C]:
    d1, off = _d1(s, k, 0.0, t, v), F.exp(-r * t)
    price = black_price(s, k, r, t, v, cp)
    return {
        "price": price,
        "delta": cp * off * normal_cdf(cp * d1) * s * 0.01,
        "gamma": off * normal_pdf(d1) / (s * v * F.sqrt(t)) * s * s * 1e-4,
        "theta": (r * price - off * s * normal_pdf(d1) * v / (2 * F.sqrt(t))) / 240,
        "vega": off * s * normal_pdf(d1) * F.sqrt(t) / 100,
    }


def _batched(returns: str, kernel: Callable[..., np.ndarray | dict[str, np.ndarray]], *columns: C) -> C:
    """kernel over whole batches of rows as arrays of doubles (nulls as nan); nan comes back as null."""

    def run(series) -> pd.Series | pd.DataFrame:
        with np.errstate(all="ignore"):
            found = kernel(*(x.to_numpy(float, na_value=np.nan) for x in series))
        return pd.DataFrame(found) if isinstance(found, dict) else pd.Series(found)

    def row(*series: pd.Series) -> pd.Series:
        return run(series)

    def rows(*series: pd.Series) -> pd.DataFrame:
        return run(series)

    return F.pandas_udf(rows if returns.startswith("struct") else row, returns)(*columns)


def _bs_price(s, k, r, t, v, cp):
    d1 = (ln_of(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    return cp * (s * normal_cdf_of(cp * d1) - k * exp_of(-r * t) * normal_cdf_of(cp * (d1 - v * np.sqrt(t))))


def bs_price_in_batches(s: C, k: C, r: C, t: C, v: C, cp: C) -> C:
    """bs_price to the last place as bs_implied computes it, where a price is next to its bound and that place decides."""
    return _batched("double", lambda s, k, r, t, v, cp: np.where(v <= 0, np.maximum(0.0, cp * (s - k)), _bs_price(s, k, r, t, v, cp)), s, k, r, t, v, cp)


def _black_price(s, k, r, t, v, cp):
    d1 = (ln_of(s / k) + (0.0 + v * v / 2) * t) / (v * np.sqrt(t))
    return cp * exp_of(-r * t) * (s * normal_cdf_of(cp * d1) - k * normal_cdf_of(cp * (d1 - v * np.sqrt(t))))


def implied(price_of: Callable, low_bound: Callable, s: C, k: C, r: C, t: C, price: C, cp: C, digits: int = 4, steps: int = 60) -> C:
    """Volatility by bisection of an increasing price on (0, 8), rounded once; 0 where there is none, null where a figure is missing.

    price_of (s, k, r, t, v, cp) and low_bound (s, k, r, t, cp) take arrays: a batch of rows is halved at once.
    """

    def kernel(s, k, r, t, price, cp):
        low, high = np.zeros(len(s)), np.full(len(s), 8.0)
        for _ in range(steps):
            middle = (low + high) / 2
            over = price_of(s, k, r, t, middle, cp) > price
            low, high = np.where(over, low, middle), np.where(over, middle, high)
        found = np.where((price <= 0) | (price <= low_bound(s, k, r, t, cp)), 0.0, (low + high) / 2)
        return np.where(np.isnan(s + k + r + t + price + cp), np.nan, found)

    return F.round(_batched("double", kernel, s, k, r, t, price, cp), digits)


def bs_implied(s: C, k: C, r: C, t: C, price: C, cp: C, digits: int = 4) -> C:
    def bound(s, k, r, t, cp):
        off = exp_of(-r * t)
        return np.where(cp > 0, s - k * off, k * off - s)

    return implied(_bs_price, bound, s, k, r, t, price, cp, digits)


def black_implied(s: C, k: C, r: C, t: C, price: C, cp: C, digits: int = 4) -> C:
    return implied(_black_price, lambda s, k, r, t, cp: cp * (s - k) * exp_of(-r * t), s, k, r, t, price, cp, digits)


def _levels(s, k, t, v, cp, n: int) -> list[np.ndarray]:
    """Values of the first three levels of an American tree on a future (growth 1, no discount), a row for each place."""
    step = v * np.sqrt(t / n)
    up = exp_of(step)
    p = (1 - 1 / up) / (up - 1 / up)
    rise = {m: s * exp_of(step * m) for m in range(-n, n + 1)}  # after i steps, j of them up, m is 2 j - i
    worth = lambda i: np.stack([np.maximum(0.0, cp * (rise[2 * j - i] - k)) for j in range(i + 1)])
    values, levels = worth(n), {}
    for i in range(n - 1, -1, -1):
        values = np.maximum(p * values[1:] + (1 - p) * values[:-1], worth(i))
        levels[i] = values
    return [levels[i] for i in (0, 1, 2)]


def _tree_price(s, k, t, v, cp, n: int):
    return np.where(v <= 0, np.maximum(0.0, cp * (s - k)), _levels(s, k, t, v, cp, n)[0][0])


def _tree_greeks(s, k, t, v, cp, n: int) -> dict[str, np.ndarray]:
    zero, one, two = _levels(s, k, t, v, cp, n)
    up = exp_of(v * np.sqrt(t / n))
    down, price = 1 / up, zero[0]
    high, low = (two[2] - two[1]) / (s * up * up - s), (two[1] - two[0]) / (s - s * down * down)
    return {
        "price": price,
        "delta": (one[1] - one[0]) / (s * up - s * down),
        "gamma": (high - low) / ((s * up * up - s * down * down) / 2),
        "theta": (two[1] - price) / (2 * t / n) / 240,
        "vega": (_tree_price(s, k, t, v * 1.001, cp, n) - price) / (v * 0.001) / 100,
    }


def tree_price(s: C, k: C, t: C, v: C, cp: C, n: int = 15) -> C:
    return _batched("double", lambda *a: _tree_price(*a, n), s, k, t, v, cp)


def tree_greeks(s: C, k: C, t: C, v: C, cp: C, n: int = 15) -> dict[str, C]:
    """Delta and gamma per unit; theta by two steps, vega by a bump of 0.1 %. All come from one walk over the tree."""
    names = ("price", "delta", "gamma", "theta", "vega")
    found = _batched(f"struct<{', '.join(f'{x}: double' for x in names)}>", lambda *a: _tree_greeks(*a, n), s, k, t, v, cp)
    return {x: found[x] for x in names}


def in_money(s: C, k: C, cp: C) -> C:
    return reduce(lambda a, b: a | b, [(cp > 0) & (s > k), (cp < 0) & (s < k)])
