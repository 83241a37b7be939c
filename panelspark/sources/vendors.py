"""Vendors' tables as a source that spark.read and spark.readStream know by name.

A client is what a vendor's library offers, behind a few methods (Client). registered() makes a format of it:

    registered(spark, "quotes", make_client)
    spark.read.format("quotes").option("table", "daily").load().where("date >= '2020-01-01' and code in ('a', 'b')")

Filters that a table's calls can take are handed to them, the others stay with Spark. A table is fetched in calls for
one value each of its `by` column (a cross-section by date, a history by code), a partition a call, page by page up to the
vendor's cap; a task pauses after `limit` calls. Only values that pass the filters are called for. As a stream, a
table brings the values of its `by` column that have come since, in order.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from panelspark.sources.clients import Limiter

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Table:
    """schema, the column that calls are made by, the columns that calls can be narrowed by, and rows of a call at most."""

    schema: str
    by: str
    arguments: tuple[str, ...] = ()
    cap: int = 3000


class Client(Protocol):
    def tables(self) -> dict[str, Table]: ...

    def values(self, table: str) -> list:
        """What the `by` column holds, in order."""
        ...

    def fetch(self, table: str, value: Any, equal: dict[str, list], between: dict[str, tuple], offset: int, limit: int) -> pa.Table:
        """A page of the rows of one value, with columns that are one of a list or between two ends (None: open)."""
        ...


@dataclass
class Narrowed:
    """What calls are narrowed by."""

    equal: dict[str, list]
    between: dict[str, tuple]

    def take(self, f: ds.Filter, columns: set[str]) -> bool:
        """Whether calls can do all that a filter asks for; if so, they will."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name not in columns:
            return False
        low, high = self.between.get(name, (None, None))
        if isinstance(f, ds.EqualTo | ds.In):
            wanted = [f.value] if isinstance(f, ds.EqualTo) else list(f.value)
            self.equal[name] = [v for v in wanted if v in self.equal.get(name, wanted)]
        elif isinstance(f, ds.GreaterThanOrEqual):
            self.between[name] = (f.value if low is None else max(low, f.value), high)
        elif isinstance(f, ds.LessThanOrEqual):
            self.between[name] = (low, f.value if high is None else min(high, f.value))
        else:
            return False
        return True

    def passes(self, name: str, value: Any) -> bool:
        low, high = self.between.get(name, (None, None))
        return (name not in self.equal or value in self.equal[name]) and (low is None or value >= low) and (high is None or value <= high)


class Call(ds.InputPartition):
    def __init__(self, value: Any):
        super().__init__(value)


class Source:
    """What readers share: the table that the options name, and how one of its calls is made in a task."""

    def __init__(self, make: Callable[[], Client], options: dict, schema: StructType):
        self.make, self.name, self.schema = make, options["table"], schema
        self.table = make().tables()[self.name]
        self.calls, self.pause = int(options.get("limit", 0)), float(options.get("pause", 60))
        self.narrowed = Narrowed({}, {})

    def rows(self, call: Call) -> Iterator[pa.RecordBatch]:
        client, narrowed, offset = self.make(), self.narrowed, 0
        limiter = Limiter(self.calls, self.pause, time.sleep) if self.calls else None
        while True:
            if limiter:
                limiter()
            page = client.fetch(self.name, call.value, narrowed.equal, narrowed.between, offset, self.table.cap)
            yield from page.select(self.schema.names).to_batches()
            if page.num_rows < self.table.cap:
                return
            offset += page.num_rows


class Reader(Source, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        columns = {*self.table.arguments, self.table.by}
        return (f for f in filters if not self.narrowed.take(f, columns))

    def partitions(self) -> list[Call]:
        return [Call(v) for v in self.make().values(self.name) if self.narrowed.passes(self.table.by, v)]

    def read(self, partition: Call) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class StreamReader(Source, ds.DataSourceStreamReader):
    """Offsets are values of the `by` column as text; a batch has those after its start, up to its end."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        values = self.make().values(self.name)
        return {"after": text(values[-1]) if values else ""}

    def partitions(self, start: dict, end: dict) -> list[Call]:
        return [Call(v) for v in self.make().values(self.name) if start["after"] < text(v) <= end["after"]]

    def read(self, partition: Call) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


def text(value: Any) -> str:
    """A value as text that sorts as the values do."""
    if isinstance(value, int):
        return f"{value:020d}"
    return value.isoformat() if isinstance(value, dt.date) else str(value)


def registered(spark: SparkSession, name: str, make: Callable[[], Client]) -> None:
    """Make spark.read.format(name) and spark.readStream.format(name) read a client's tables; make() is called wherever a client is needed."""

    class Vendor(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return make().tables()[self.options["table"]].schema

        def reader(self, schema: StructType) -> Reader:
            return Reader(make, self.options, schema)

        def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
            return StreamReader(make, self.options, schema)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Vendor)
