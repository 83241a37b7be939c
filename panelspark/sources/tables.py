"""Tables of the session's catalog: list, create, rename, drop, add and drop columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create(spark: SparkSession, name: str, schema: str, if_exists: str = "fail", path: str | None = None) -> None:
    """if_exists: fail, keep, or replace."""
    if exists(spark, name):
        if if_exists == "keep":
            return
        if if_exists != "replace":
            raise ValueError(f"the table {name} exists")
        drop(spark, name)
    place = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {quoted(name)} ({schema}) USING parquet{place}")


def rename(spark: SparkSession, name: str, to: str) -> None:
    spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(to)}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def add_columns(spark: SparkSession, name: str, columns: str) -> None:
    """Rows written before have nulls."""
    spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({columns})")


def drop_columns(spark: SparkSession, name: str, columns: list[str], path: str | None = None) -> None:
    """The table is written anew without them, under its name."""
    fresh = f"{name}_{uuid.uuid4().hex[:8]}"
    writer = spark.table(name).drop(*columns).write
    (writer.option("path", path) if path else writer).saveAsTable(fresh)
    drop(spark, name)
    rename(spark, fresh, name)


def insert(spark: SparkSession, name: str, rows: DataFrame) -> None:
    rows.select(*spark.table(name).columns).write.insertInto(name)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Several tables as the sheets of one report, a folder of CSV each."""
    for name, rows in sheets.items():
        rows.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
