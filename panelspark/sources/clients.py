"""Vendors' tables through a client that the caller hands over: pages, a limit of calls, and what their tables need next."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Limiter:
    """At most `calls` calls in a row, then a pause."""

    def __init__(self, calls: int = 60, pause: float = 60.0, sleep: Callable[[float], None] = time.sleep):
        self.calls, self.pause, self.sleep, self.made = calls, pause, sleep, 0

    def __call__(self) -> None:
        if self.made == self.calls:
            self.sleep(self.pause)
            self.made = 0
        self.made += 1


def paged(call: Callable[..., pd.DataFrame], arguments: dict, cap: int, limiter: Limiter | None = None) -> Iterator[pd.DataFrame]:
    """All rows of a call that returns `cap` rows at most, page by page; call takes the arguments, offset and limit."""
    offset = 0
    while True:
        if limiter:
            limiter()
        page = call(**arguments, offset=offset, limit=cap)
        if len(page):
            yield page
        if len(page) < cap:
            return
        offset += len(page)


def fetched(calls: DataFrame, client: Callable[[], Callable[..., pd.DataFrame]], schema: str, cap: int = 3000, limit: int | None = None, pause: float = 60.0) -> DataFrame:
    """The rows of many calls, made in tasks: calls has one row of arguments a call; client() gives a task its call.

    limit: calls that a task makes before it pauses. A table is fetched by ids or dates, a row for each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call, limiter = client(), Limiter(limit, pause) if limit else None
        for pdf in frames:
            for arguments in pdf.to_dict("records"):
                yield from paged(call, arguments, cap, limiter)

    return calls.mapInPandas(run, schema)


def latest_within(dates: DataFrame, snapshots: DataFrame, days: int = 30, order: str = "snapshot") -> DataFrame:
    """Every date with all rows of the last snapshot at or before it that is less than so many days old."""
    from panelspark.operators.align import snapshot_as_of

    return snapshot_as_of(dates, snapshots, order).where(F.datediff("date", order) < days)


def suffixed(code: str, exchange: str) -> F.Column:
    """A vendor's code with its exchange's short name."""
    return F.concat(F.col(code), F.lit("."), F.when(F.col(exchange).isin("XSHG", "SSE"), "SH").when(F.col(exchange).isin("XSHE", "SZSE"), "SZ").otherwise(F.col(exchange)))
