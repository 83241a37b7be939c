"""Panels in Parquet, clustered by key: files that hold one range of keys each, sorted, under a zone map.

The order of keys (ids first, unless told otherwise) is cut into ranges of about ROWS rows, one file each. The zone map, a table
beside the files, has each file's first key, the ends of each key column, and its rows; a read opens only those files whose
ends meet what is asked for. A key belongs to the last file that begins at or before it (else to the first), so that the
rows of a write are told to files without a look into them, by the files' first keys alone; a write reads and replaces the files that its keys belong to,
and leaves the others where they are. Files that are replaced and lie side by side are cut anew together, so that they are
full again. A task writes many files, one after the other, however small they are.

Every write makes a new numbered description of the table and fails if another writer has made it meanwhile. Readers and
failed writers never see half a version; what no description names any more stays for readers until clean().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import align
from panelspark.sources.store import ALLOWED, KEYS, PanelStore

#: Rows of a file.
ROWS = 1 << 20
#: Small files of a task, at most.
FILES = 64


class RangeStore(PanelStore):
    """A PanelStore whose tables are clustered by key; modes of save() and filters of load() are the same."""

    def _versions(self, name: str) -> list[int]:
        return sorted(int(n[5:-5]) for n in self._folder(name).names() if n.startswith("meta-"))

    def _meta(self, name: str) -> dict:
        path = f"{self.root}/{name}/meta-{self._versions(name)[-1]:012d}.json"
        return json.loads("".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect()))

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def zones(self, name: str, meta: dict | None = None) -> DataFrame:
        """The zone map: file (below the table's folder), rows, low (its first key) and min_, max_ of each key."""
        meta = meta or self._meta(name)
        fields = [T.StructType.fromJson(meta["schema"])[k] for k in meta["order"]]
        schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("low", T.StructType(fields))])
        for f in fields:
            schema = schema.add(f"min_{f.name}", f.dataType).add(f"max_{f.name}", f.dataType)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{meta['zones']}") if meta["zones"] else self.spark.createDataFrame([], schema)

    def files(self, name: str, dates: list | tuple | None = None, ids: list | tuple | None = None, meta: dict | None = None) -> list[str]:
        """The files that can hold rows of some dates and ids, each a list or a pair of ends with None for open."""
        meta = meta or self._meta(name)
        zones = self.zones(name, meta)
        for key, wanted in (("date", dates), ("id", ids)):
            if wanted is not None and key in meta["order"]:
                zones = zones.where(self._may_hold(zones, key, wanted))
        return [r[0] for r in zones.select("file").collect()]  # what is opened

    @staticmethod
    def _may_hold(zones: DataFrame, key: str, wanted: list | tuple) -> Column:
        kind = zones.schema[f"min_{key}"].dataType
        low, high, value = F.col(f"min_{key}"), F.col(f"max_{key}"), lambda v: F.lit(v).cast(kind)
        if isinstance(wanted, tuple):
            a, b = wanted
            return (high >= value(a) if a is not None else F.lit(True)) & (low <= value(b) if b is not None else F.lit(True))
        return F.exists(F.array(*map(value, wanted)), lambda v: (v >= low) & (v <= high)) if wanted else F.lit(False)

    def load(self, name: str, factors: list[str] | None = None, dates: list | tuple | None = None, ids: list | tuple | None = None, index: DataFrame | None = None, drop_empty: bool = False) -> DataFrame:
        """Factors of some dates and ids (each a list, or a pair of ends with None for open); index: keys to return instead."""
        meta = self._meta(name)
        df = self._open(name, meta, self.files(name, dates, ids, meta) if dates is not None or ids is not None else None)
        for key, wanted in (("date", dates), ("id", ids)):
            value = lambda v, kind=df.schema[key].dataType if key in df.columns else None: F.lit(v).cast(kind)
            if isinstance(wanted, tuple):
                df = df.where(F.col(key) >= value(wanted[0])) if wanted[0] is not None else df
                df = df.where(F.col(key) <= value(wanted[1])) if wanted[1] is not None else df
            elif wanted is not None:
                df = df.where(F.col(key).isin(list(map(value, wanted))) if wanted else F.lit(False))
        df = df.select(*meta["keys"], *factors) if factors is not None else df
        if drop_empty:
            df = df.dropna("all", subset=[c for c in df.columns if c not in meta["keys"]])
        return index.select(*meta["keys"]).join(df, meta["keys"], "left") if index is not None else df

    def _open(self, name: str, meta: dict, files: list[str] | None = None) -> DataFrame:
        schema, found = T.StructType.fromJson(meta["schema"]), self.files(name, meta=meta) if files is None else files
        if not found:
            return self.spark.createDataFrame([], schema)
        paths, others = self._listed(name, found)
        df = self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{f}" for f in paths))
        return df.where(~F.substring_index("_metadata.file_path", "/", -3).isin(others)) if others else df

    def _listed(self, name: str, files: list[str]) -> tuple[list[str], list[str]]:
        """files, with folders in place of those files that are most of a folder, and what else is in these folders: one
        listing for thousands of files, of which Spark then leaves out the others by their paths."""
        by_folder: dict[str, list[str]] = {}
        for f in files:
            by_folder.setdefault(f.rsplit("/", 1)[0], []).append(f)
        out, others = [], []
        for folder, inside in by_folder.items():
            place = self._folder(f"{name}/{folder}")
            most = len(inside) > 1 and 2 * len(inside) > (n := place.count())
            out += [folder] if most else inside
            if most and n > len(inside):
                others += {f"{folder}/{f}" for f in place.names()} - set(inside)
        return out, others

    def save(self, name: str, df: DataFrame, mode: str = "update", keys: list[str] = KEYS, attributes: dict | None = None, order: list[str] | None = None, rows: int = ROWS) -> None:
        """Write df in one of the modes; order (at first, or with replace): the keys' order, ids before dates unless told otherwise."""
        if mode not in ("append", "update", "overlay", "replace"):
            raise ValueError(f"no such mode: {mode}")
        bad = [f.name for f in df.schema if not isinstance(f.dataType, ALLOWED)]
        if bad:
            raise TypeError(f"no panel type: {', '.join(bad)}")
        df = df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})
        version = self._versions(name)[-1] if self.exists(name) else -1
        meta = self._meta(name) if version >= 0 else {"attributes": {}, "zones": None}
        kept = version >= 0 and mode != "replace"
        order = meta["order"] if kept else order or sorted(keys, key=lambda k: k == "date")
        if sorted(order) != sorted(meta["keys"] if kept else keys):
            raise ValueError("the order is one of all keys")
        if kept and mode == "append":
            df = df.join(self._open(name, meta).select("date").distinct(), "date", "left_anti")
        keys = meta["keys"] if kept else keys
        stay, old, new, held = self._with_touched(name, meta, df) if kept else (None, None, align.as_table(df).withColumn("_run", F.lit(0)), 0)
        whole = self._put_in(old, new, mode, keys, order, self._tasks(held + new.count(), rows))
        found, schema = self._written(name, whole, order, rows), whole.drop("_run").schema
        zones = found if stay is None else stay.unionByName(found)
        folder = f"zones-{uuid.uuid4().hex}"
        zones.coalesce(1).write.parquet(f"{self.root}/{name}/{folder}")
        meta |= {"zones": folder, "schema": schema.jsonValue(), "keys": keys, "order": order, "attributes": meta["attributes"] | (attributes or {})}
        self._publish(name, version + 1, meta)

    def _publish(self, name: str, version: int, meta: dict) -> None:
        folder = self._folder(name)
        try:
            out = folder.fs.create(folder.child(f"meta-{version:012d}.json"), False)
        except Exception as e:
            if folder.exists(f"meta-{version:012d}.json"):
                raise RuntimeError(f"{name} was written by someone else meanwhile") from e
            raise
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()

    def _with_touched(self, name: str, meta: dict, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """Zones that stay; the rows of the files that df's keys belong to, and df, both with _run; these files' number of rows."""
        zones = self.zones(name, meta)
        new = align.as_table(self._placed(df, zones, meta["order"]))  # it is read more than once
        runs = align.as_table(self._runs(zones, new.select("_at").distinct()))
        touched = runs.select("_file", "rows").collect()  # names of files to be replaced
        old = self._open(name, meta, [r["_file"] for r in touched])
        old = old.withColumn("_file", F.substring_index("_metadata.file_path", "/", -3) if touched else F.lit(""))
        old, new = (x.join(F.broadcast(runs.select(c, "_run")), c, "left").drop(c).withColumn("_run", F.coalesce("_run", F.lit(0))) for x, c in ((old, "_file"), (new, "_at")))  # a row a file
        return zones.join(runs, F.col("file") == F.col("_file"), "left_anti"), old, new, sum(r["rows"] for r in touched)

    @staticmethod
    def _placed(df: DataFrame, zones: DataFrame, order: list[str]) -> DataFrame:
        """df with the place (_at, from 0) of the file that a row's key belongs to among all files in their order.

        The files' first keys, one a file, are sent to all tasks, and halved until one is left; no row is moved for it.
        """
        lows = zones.agg(F.sort_array(F.collect_list("low")).alias("_lows"))
        found = df.crossJoin(F.broadcast(lows)).select("*", F.struct(*order).alias("_key"), F.lit(0).alias("_at"))
        for k in reversed(range(max(0, zones.count() - 1).bit_length())):
            further = F.col("_at") + (1 << k)
            found = found.withColumn("_at", F.when(F.get("_lows", further) <= F.col("_key"), further).otherwise(F.col("_at")))
        return found.drop("_lows", "_key")

    @staticmethod
    def _runs(zones: DataFrame, hit: DataFrame) -> DataFrame:
        """The files whose places (_at) are hit; those side by side have one number (_run). Rows of the zone map, one a file."""
        order = Window.orderBy("low")
        placed = zones.withColumn("_at", F.row_number().over(order) - 1).join(hit.withColumn("_hit", F.lit(True)), "_at", "left")
        start = (F.col("_hit") & F.lag("_hit").over(order).isNull()).cast("int")
        marked = placed.withColumn("_run", F.sum(start).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        return marked.where("_hit").select(F.col("file").alias("_file"), "rows", "_at", "_run")

    def _tasks(self, total: int, rows: int) -> int:
        """Tasks hold many files' rows; with few rows a task a core, but not less than a file."""
        return max(1, -(-total // min(ROWS, FILES * rows)), min(-(-total // rows), self.spark.sparkContext.defaultParallelism))

    @staticmethod
    def _put_in(old: DataFrame | None, new: DataFrame, mode: str, keys: list[str], order: list[str], tasks: int) -> DataFrame:
        """new put into old in one of the modes, one row a key, in order. Rows are dealt by ranges of the order and meet there,
        so that they needn't be dealt again to be written; a run's rows lie together, as runs' keys don't overlap. Rows are
        grouped by exactly what they are dealt by (a key has one run): grouped by more, Spark would deal them by a hash."""
        a, b = ([c for c in df.columns if c not in (*keys, "_run")] if df is not None else [] for df in (old, new))
        packed = lambda df, columns, to: df.select("_run", *keys, F.struct(F.lit(True).alias("_there"), *columns).alias(to))
        both = packed(new, b, "_new")
        both = packed(old, a, "_old").unionByName(both, allowMissingColumns=True) if old is not None else both
        best = both.repartitionByRange(tasks, *order).groupBy(*order).agg(*(F.max(c).alias(c) for c in both.columns if c not in keys))
        mine, its = (lambda c, side=side, own=own: F.col(f"{side}.{c}") if c in own else F.lit(None) for side, own in (("_new", b), ("_old", a)))
        pick = (lambda c: F.coalesce(mine(c), its(c))) if mode == "overlay" else (lambda c: F.when(F.col("_new").isNotNull(), mine(c)).otherwise(its(c)))
        return best.select("_run", *keys, *(pick(c).alias(c) for c in dict.fromkeys([*a, *b]))).sortWithinPartitions("_run", *order)

    def _written(self, name: str, df: DataFrame, order: list[str], rows: int) -> DataFrame:
        """Zones of df, written as it lies as files of at most `rows` rows, none with keys of two runs of files."""
        place = f"v-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).partitionBy("_run").parquet(f"{self.root}/{name}/{place}")
        # files are sorted, so that the first row of each has its first key: ends are told without a sort by file
        path, first = F.col("_metadata.file_path"), F.col("_metadata.row_index") == 0
        stored = self.spark.read.schema(df.drop("_run").schema).parquet(f"{self.root}/{name}/{place}").select(*order, path.alias("_file"), first.alias("_first"))
        ends = [f(k).alias(f"{n}_{k}") for k in order for n, f in (("min", F.min), ("max", F.max))]
        lows = [F.min(F.when(F.col("_first"), F.col(k))).alias(f"_low_{k}") for k in order]
        found = stored.groupBy("_file").agg(F.count("*").alias("rows"), *lows, *ends)
        low = F.struct(*(F.col(f"_low_{k}").alias(k) for k in order)).alias("low")
        return found.select(F.substring_index("_file", "/", -3).alias("file"), "rows", low, *(c for c in found.columns if c[:4] in ("min_", "max_")))

    def compact(self, name: str, rows: int = ROWS) -> None:
        """Cut the whole table anew."""
        meta = self._meta(name)
        self.save(name, self._open(name, meta), "replace", meta["keys"], order=meta["order"], rows=rows)

    def clean(self, name: str) -> None:
        """Delete files, zone maps and descriptions of earlier versions; no reader or writer may be at them."""
        folder, meta, last = self._folder(name), self._meta(name), self._versions(name)[-1]
        used = {f.split("/")[0] for f in self.files(name, meta=meta)} | {meta["zones"], f"meta-{last:012d}.json"}
        for n in folder.names():
            if n not in used:
                folder.delete(n)
