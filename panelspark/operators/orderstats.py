"""Ranks and quantiles in windows of rows, each series walked once, whatever the window.

Rows are numbered over all series in order and cut into chunks of CHUNK places; a chunk also gets the rows of the window
before its first. So a series of any length is many chunks, and a chunk holds many short series. Within a chunk values are
replaced by their ranks and laid out as a wavelet matrix: one bit of the ranks a level, rows parted by it from level to
level. Counting what lies below a value in any range of rows, or finding the k-th of them, then takes one step a level, for all
rows at once; the work grows with rows times the bits of their number, and not with the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.align import numbered

CHUNK = 1 << 16


class WaveletMatrix:
    """Counts and k-th smallest of whole numbers within ranges of their places."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.split = [], []  # for each level, from the highest bit: zeros up to each place, and all zeros
        for bit in reversed(range(self.bits)):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.split.append(int(self.zeros[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the places from start up to stop hold less than value."""
        count, every = np.zeros(len(start), np.int64), stop - start
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            one = (value >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[start], zeros[stop]
            count += np.where(one, b - a, 0)
            start, stop = np.where(one, split + start - a, a), np.where(one, split + stop - b, b)
        return np.where(value >> self.bits > 0, every, count)

    def smallest(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the places from start up to stop."""
        found = np.zeros(len(start), np.int64)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split, strict=True)):
            a, b = zeros[start], zeros[stop]
            one = k >= b - a
            found |= one.astype(np.int64) << (self.bits - 1 - level)
            k = np.where(one, k - (b - a), k)
            start, stop = np.where(one, split + start - a, a), np.where(one, split + stop - b, b)
        return found


def chunked(df: DataFrame, by: str, order: str, back: int, work, schema: str, size: int = CHUNK) -> DataFrame:
    """work on chunks (pandas frames in order: _series changes with the series, _own is false for rows of the chunk before), and what it returns of own rows.

    back: rows before a row that its result depends on. A row is copied to as many chunks as windows from them reach back to it.
    """
    size = max(size, 2 * back)
    rows = numbered(df, [by, order], "_place")
    own = F.floor(F.col("_place") / size)
    rows = rows.withColumn("_chunk", F.explode(F.sequence(own, F.floor((F.col("_place") + back) / size))))
    rows = rows.withColumn("_own", own == F.col("_chunk"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place", ignore_index=True)
        key = pdf[by]
        pdf["_series"] = ((key != key.shift()) & ~(key.isna() & key.shift().isna())).cumsum()
        return work(pdf)[pdf["_own"]]

    return rows.groupBy("_chunk").applyInPandas(run, schema)


def spans(pdf: pd.DataFrame, x: str, window: int, current: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of x, where each row's window starts and stops, and whether it has `window` values of its series."""
    value = pdf[x].to_numpy(float, na_value=np.nan)
    place, series = np.arange(len(pdf)), pdf["_series"].to_numpy()
    stop = place + current
    start = np.maximum(stop - window, 0)
    first = np.searchsorted(series, series)  # of the series in this chunk
    known = np.concatenate([[0], np.cumsum(~np.isnan(value))])
    return value, start, stop, (stop - window >= first) & (known[stop] - known[start] == window)


def ranked(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of values (nulls as if they were the least) and the distinct values."""
    distinct, rank = np.unique(np.where(np.isnan(value), -np.inf, value), return_inverse=True)
    return rank.astype(np.int64), distinct


def with_shares(df: DataFrame, x: str, window: int, by: str = "id", order: str = "date", out: str = "share", size: int = CHUNK) -> DataFrame:
    """df with the share of the `window` rows before that are at or below the row's x; null unless all of these have a value."""

    columns = [*df.columns, out]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        value, start, stop, full = spans(pdf, x, window, False)
        rank, _ = ranked(value)
        at = WaveletMatrix(rank).below(start[full], stop[full], rank[full] + 1)
        share = np.full(len(pdf), np.nan)
        share[full] = np.where(np.isnan(value[full]), 0, at) / window
        return pdf.assign(**{out: pd.Series(share).astype(object).where(full, None)})[columns]

    return chunked(df, by, order, window, work, f"{ddl(df)}, `{out}` double", size)


def with_quantiles(df: DataFrame, x: str, window: int, probabilities: dict[str, float], by: str = "id", order: str = "date", size: int = CHUNK) -> DataFrame:
    """df with quantiles of x over the `window` rows up to each row, by linear interpolation; null unless all have a value."""

    columns = [*df.columns, *probabilities]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        value, start, stop, full = spans(pdf, x, window, True)
        rank, distinct = ranked(value)
        tree, found = WaveletMatrix(rank), {}
        for name, p in probabilities.items():
            at = (window - 1) * p
            low, high = (distinct[tree.smallest(start[full], stop[full], np.full(int(full.sum()), k))] for k in (int(np.floor(at)), int(np.ceil(at))))
            q = np.full(len(pdf), np.nan)
            q[full] = low if np.floor(at) == np.ceil(at) else (np.ceil(at) - at) * low + (at - np.floor(at)) * high
            found[name] = pd.Series(q).astype(object).where(full, None)
        return pdf.assign(**found)[columns]

    return chunked(df, by, order, window, work, ddl(df) + "".join(f", `{name}` double" for name in probabilities), size)


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
