"""The same aggregates over streams: time windows with late data, and the recursive average with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """Count, sum, least and largest per key and window; rows later than `late` are left out. Works on a batch as well."""
    stamped = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        stamped = stamped.withWatermark("_ts", late)
    grouped = stamped.groupBy(F.window("_ts", width).alias("w"), F.col(key))
    aggs = grouped.agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return aggs.select(F.col("w.start").alias("start"), key, "n", "total", "low", "high")


def ewma(stream: DataFrame, key: str, value: str, order: str, window: float) -> DataFrame:
    """The exponential average of each key after every batch of its rows, carried on in state."""
    a = 2 / (1 + window)
    kind = dict(stream.dtypes)[key]

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, y = state.get if state.exists else (0, 0.0)
        rows = pd.concat(list(frames)).sort_values(order)
        for x in rows[value].dropna():
            y = float(x) if n == 0 else (1 - a) * y + a * float(x)
            n += 1
        state.update((n, y))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ewma": [y]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, ewma double", "n long, y double", "update", "NoTimeout")
