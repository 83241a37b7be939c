"""Arithmetic that Spark has no function for, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of the normal distribution by Hart (double precision), numerator and denominator.
HART_TOP = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# Acklam's rational approximation of the normal quantile, centre and tails.
CENTRE_TOP = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239]
CENTRE_BOTTOM = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0]
TAIL_TOP = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
TAIL_BOTTOM = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0]
TAIL = 0.02425


def polynomial(x, coefficients: list[float]):
    """Of a Column or an array, highest power first."""
    out = coefficients[0] * x + coefficients[1]
    for c in coefficients[2:]:
        out = out * x + c
    return out


def normal_cdf(x: Column) -> Column:
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    near = e * polynomial(z, HART_TOP) / polynomial(z, HART_BOTTOM)
    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def exp_of(x: np.ndarray) -> np.ndarray:
    """By the C library, as databases have it; numpy's own may differ in the last place, Spark's does."""
    return pc.exp(pa.array(x)).to_numpy(zero_copy_only=False)


def ln_of(x: np.ndarray) -> np.ndarray:
    return pc.ln(pa.array(x)).to_numpy(zero_copy_only=False)


def normal_cdf_of(x: np.ndarray) -> np.ndarray:
    """normal_cdf over arrays."""
    z = np.abs(x)
    e = exp_of(-z * z / 2)
    near = e * polynomial(z, HART_TOP) / polynomial(z, HART_BOTTOM)
    far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / 2.506628274631
    tail = np.where(z > 37, 0.0, np.where(z < 7.07106781186547, near, far))
    return np.where(x > 0, 1 - tail, tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def normal_quantile(p: Column) -> Column:
    """Relative error about 1e-9; null outside (0, 1)."""
    q = p - 0.5
    r = q * q
    centre = polynomial(r, CENTRE_TOP) * q / polynomial(r, CENTRE_BOTTOM)
    tail: Callable = lambda t: polynomial(t, TAIL_TOP) / polynomial(t, TAIL_BOTTOM)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when((p <= 0) | (p >= 1), None).when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(centre)


def _sql_polynomial(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out}) * {x} + ({c!r}))"
    return out


def normal_cdf_sql(x: str) -> str:
    """normal_cdf as SQL text, for comparisons with other engines."""
    z = f"abs({x})"
    e = f"exp(-{z} * {z} / 2)"
    near = f"{e} * {_sql_polynomial(z, HART_TOP)} / {_sql_polynomial(z, HART_BOTTOM)}"
    far = f"{e} / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65e0))))) / 2.506628274631e0"
    tail = f"(CASE WHEN {z} > 37 THEN 0e0 WHEN {z} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_quantile_sql(p: str) -> str:
    q = f"(({p}) - 0.5e0)"
    r = f"({q} * {q})"
    centre = f"{_sql_polynomial(r, CENTRE_TOP)} * {q} / {_sql_polynomial(r, CENTRE_BOTTOM)}"
    tail = lambda t: f"{_sql_polynomial(t, TAIL_TOP)} / {_sql_polynomial(t, TAIL_BOTTOM)}"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {TAIL} THEN {tail(low)} WHEN ({p}) > 1 - {TAIL} THEN -({tail(high)}) ELSE {centre} END)"


def growth(new: Column, old: Column) -> Column:
    """Change over the absolute old value; null if that is 0 or missing."""
    return (new - old) / F.nullif(F.abs(old), F.lit(0.0))


def mean_of(new: Column, old: Column) -> Column:
    """Mean of two figures, the new one where the old is missing."""
    return (F.coalesce(old, new) + new) / 2


def ratio(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)
