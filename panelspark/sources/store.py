"""Panels in Parquet: one dataset a namespace, factors as columns, partitioned by year; reads prune rows and columns.

Writes follow one of four modes. append: only dates that aren't there yet; update: the new row of a key replaces the old;
overlay: new values replace old ones where they aren't null; replace: everything anew. A write makes a new version
folder of the years it touches and then moves the pointers to it, so that readers and failed writers never see half a
version; years not touched stay where they are. What no pointer names any more stays for readers until clean().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["date", "id"]
SPARK_ENCODINGS = {"utf-8", "us-ascii", "iso-8859-1", "utf-16", "utf-16be", "utf-16le", "utf-32"}
ALLOWED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BooleanType)


class Folder:
    """Files of a folder by Spark's own file systems, local or not."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.child = lambda name: jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def count(self) -> int:
        return len(self.fs.listStatus(self.path))

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.child(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.child(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.child(name), True)


class PanelStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str = "") -> Folder:
        return Folder(self.spark, f"{self.root}/{name}" if name else self.root)

    def _meta(self, name: str) -> dict:
        path = f"{self.root}/{name}/meta.json"
        return json.loads("".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def exists(self, name: str) -> bool:
        return self._folder(name).exists("meta.json")

    def names(self) -> list[str]:
        return [n for n in self._folder().names() if self.exists(n)]

    def load(self, name: str, factors: list[str] | None = None, dates: list | tuple | None = None, ids: list | None = None, index: DataFrame | None = None, drop_empty: bool = False) -> DataFrame:
        """Factors of some dates (a list, or a pair of ends with None for open) and ids; index: keys to return instead."""
        meta = self._meta(name)
        df, keys = self._read(name, meta, years_of(dates)), meta["keys"]
        if isinstance(dates, tuple):
            df = df.where(F.col("date") >= F.lit(dates[0]).cast("date")) if dates[0] is not None else df
            df = df.where(F.col("date") <= F.lit(dates[1]).cast("date")) if dates[1] is not None else df
        elif dates is not None:
            df = df.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
        if ids is not None:
            df = df.where(F.col("id").isin(list(ids)))
        if factors is not None:
            df = df.select(*keys, *factors)
        if drop_empty:
            df = df.dropna("all", subset=[c for c in df.columns if c not in keys])
        return index.select(*keys).join(df, keys, "left") if index is not None else df

    def _read(self, name: str, meta: dict, years=None) -> DataFrame:
        """The rows of the years for which years(year) holds (None: all)."""
        schema = T.StructType.fromJson(meta["schema"])
        paths = [f"{self.root}/{name}/{version}/_year={year}" for year, version in meta["parts"].items() if years is None or years(int(year))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def save(self, name: str, df: DataFrame, mode: str = "update", keys: list[str] = KEYS, attributes: dict | None = None) -> None:
        bad = [f.name for f in df.schema if not isinstance(f.dataType, ALLOWED)]
        if bad:
            raise TypeError(f"no panel type: {', '.join(bad)}")
        for f in df.schema:
            if isinstance(f.dataType, T.DoubleType | T.FloatType):
                df = df.withColumn(f.name, F.when(~F.isnan(f.name), F.col(f.name)))
        meta = self._meta(name) if self.exists(name) else {"attributes": {}, "parts": {}}
        kept = mode != "replace" and bool(meta["parts"])
        year = F.year("date") if "date" in df.columns else F.lit(0)
        touched = {r[0] for r in df.select(year).distinct().collect()}  # one number a year
        new = self.merged(self._read(name, meta, touched.__contains__), df, mode, keys) if kept else last_of(df, keys)
        version = f"v-{uuid.uuid4().hex}"
        new.withColumn("_year", year).repartition("_year", F.pmod(F.xxhash64(*keys), F.lit(16))).sortWithinPartitions(*keys).write.partitionBy("_year").parquet(f"{self.root}/{name}/{version}")
        written = {n.removeprefix("_year="): version for n in self._folder(f"{name}/{version}").names() if n.startswith("_year=")}
        stay = {y: v for y, v in meta["parts"].items() if kept and int(y) not in touched}
        meta |= {"parts": stay | written, "schema": new.schema.jsonValue(), "keys": keys, "attributes": meta["attributes"] | (attributes or {})}
        self._folder(name).write("meta.json", json.dumps(meta))

    def save_filled(self, name: str, df: DataFrame, mode: str = "append", value=None, forward: bool = False, keys: list[str] = KEYS) -> None:
        """save(), and then every date with every id, gaps filled by a value, or forward by each id's last one before.

        The grid is asked for: its size is dates times ids.
        """
        whole = self.merged(self._read(name, self._meta(name)), df, mode, keys) if mode != "replace" and self.exists(name) else last_of(df, keys)
        columns = [c for c in whole.columns if c not in keys]
        grid = whole.select("date").distinct().crossJoin(whole.select("id").distinct()).join(whole, keys, "left")
        if value is not None:
            grid = grid.fillna(value, columns)
        if forward:
            before = Window.partitionBy("id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
            grid = grid.select(*keys, *(F.last(c, ignorenulls=True).over(before).alias(c) for c in columns))
        self.save(name, grid, "replace", keys)

    def clean(self, name: str) -> None:
        """Delete versions that no year points to; no reader may be at them."""
        folder, used = self._folder(name), set(self._meta(name)["parts"].values())
        for n in folder.names():
            if n.startswith("v-") and n not in used:
                folder.delete(n)

    @staticmethod
    def merged(old: DataFrame, new: DataFrame, mode: str, keys: list[str] = KEYS) -> DataFrame:
        new = last_of(new, keys)
        if mode == "append":
            return old.unionByName(new.join(old.select("date").distinct(), "date", "left_anti"), allowMissingColumns=True)
        if mode == "update":
            return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)
        if mode == "overlay":
            values = list(dict.fromkeys(c for c in [*old.columns, *new.columns] if c not in keys))
            a = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in old.columns if c not in keys))
            b = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys))
            pick = lambda c: F.coalesce(*(F.col(f"_{s}_{c}") for s, f in (("new", new), ("old", old)) if c in f.columns)).alias(c)
            return a.join(b, keys, "full").select(*keys, *map(pick, values))
        raise ValueError(f"no such mode: {mode}")

    def delete(self, name: str) -> None:
        self._folder().delete(name)

    def rename(self, name: str, to: str) -> None:
        folder = self._folder()
        folder.fs.rename(folder.child(name), folder.child(to))

    def date_range(self, name: str) -> tuple:
        r = self.load(name).agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        return r["a"], r["b"]

    def columns(self, name: str) -> list[str]:
        return [c for c in self.load(name).columns if c not in self._meta(name)["keys"]]

    def attributes(self, name: str) -> dict:
        return self._meta(name)["attributes"]

    def free_name(self, name: str) -> str:
        if not self.exists(name):
            return name
        n = 1
        while self.exists(f"{name}_{n}"):
            n += 1
        return f"{name}_{n}"


def years_of(dates: list | tuple | None):
    """Whether a year can hold any of the dates (a list, or a pair of ends); None: every year."""
    if dates is None:
        return None
    year = lambda d: int(str(d)[:4])
    if isinstance(dates, tuple):
        low, high = (None if d is None else year(d) for d in dates)
        return lambda y: y == 0 or (low is None or y >= low) and (high is None or y <= high)
    wanted = {year(d) for d in dates} | {0}
    return wanted.__contains__


def last_of(df: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row a key: the last by `order`, else the largest."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = F.max_by(F.struct(*rest), order) if order is not None else F.max(F.struct(*rest))
    return df.groupBy(*keys).agg(picked.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def with_labels(df: DataFrame, known: DataFrame | None, label: str) -> tuple[DataFrame, DataFrame]:
    """Labels as whole numbers and the dictionary (label, code); new labels come after the known."""
    from panelspark.functions.codes import new_keys

    known = known if known is not None else df.sparkSession.createDataFrame([], f"{label} string, code long")
    names = new_keys(known, df, label, "code")
    return df.join(names, label, "left"), names


def read_csv_dates(spark: SparkSession, folder: str, schema: str, encoding: str = "GBK") -> DataFrame:
    """CSV files named by date, ids as text; the date comes from the file's name. Columns are those of the schema, in
    the files' order. Encodings that Spark's reader lacks are decoded file by file, in tasks."""
    stamp = F.to_date(F.regexp_extract("path", "([0-9]{8})[^/]*$", 1), "yyyyMMdd")
    if encoding.lower() in SPARK_ENCODINGS:
        return spark.read.csv(folder, schema=schema, header=True, encoding=encoding).withColumn("date", F.to_date(F.regexp_extract(F.input_file_name(), "([0-9]{8})[^/]*$", 1), "yyyyMMdd"))

    def lines(frames):
        for pdf in frames:
            yield pdf.assign(content=pdf.content.map(lambda b: bytes(b).decode(encoding).replace("\r\n", "\n").split("\n", 1)[-1]))

    text = spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(lines, "path string, content string")
    rows = text.select(stamp.alias("date"), F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    return rows.select(F.from_csv("line", schema).alias("r"), "date").select("r.*", "date")


def write_csv_dates(df: DataFrame, folder: str) -> None:
    df.repartition("date").write.partitionBy("date").mode("overwrite").option("header", True).csv(folder)


def read_csv_folders(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What write_csv_dates wrote, a folder a date; filters on date read these folders alone."""
    return spark.read.csv(folder, schema=f"{schema}, date date", header=True)


def read_query(spark: SparkSession, url: str, sql: str, **options) -> DataFrame:
    """The rows of a statement that the database runs itself."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def read_table(spark: SparkSession, url: str, table: str, equal: dict | None = None, between: dict | None = None, fields: list[str] | None = None, **options) -> DataFrame:
    """A database table over JDBC; filters are Column predicates that Spark pushes down, never text put together."""
    from panelspark.operators.align import matching

    return matching(spark.read.jdbc(url, table, properties=options), equal, between, fields=fields)


def insert_missing(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert: those whose keys aren't there."""
    return last_of(df, keys).join(existing.select(*keys), keys, "left_anti")


def risk_model(rows: DataFrame, universe: str) -> dict[str, DataFrame]:
    """JSON maps of a risk model as long tables, in yearly decimals: rows have date, universe, and JSON texts exposures,
    returns, covariance (maps of maps or of numbers), specific, specific_returns."""
    mine = rows.where(F.col("universe") == universe)
    flat = lambda c: mine.select("date", F.explode(F.from_json(c, "map<string,double>")).alias("id", "value"))
    nested = lambda c, a, b: mine.select("date", F.explode(F.from_json(c, "map<string,map<string,double>>")).alias(a, "_m")).select("date", a, F.explode("_m").alias(b, "value"))
    return {
        "exposures": nested("exposures", "id", "factor"),
        "returns": flat("returns"),
        "covariance": nested("covariance", "factor1", "factor2").withColumn("value", F.col("value") * 21 * 12 * 1e-4),
        "specific": flat("specific").withColumn("value", F.pow(F.col("value") * F.sqrt(F.lit(252.0)) * 0.01, 2)),
        "specific_returns": flat("specific_returns").withColumn("value", F.col("value") / 100),
    }
