"""Alignment, as-of and interval joins, set algebra on keys, and reshaping."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ["date", "id"]
#: Rows of a task, about, where the number of tasks follows the rows.
ROWS_A_PART = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only on one machine, where none is named."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that what follows doesn't run it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def as_table(df: DataFrame) -> DataFrame:
    """df written to the shared folder as a table, of which what follows reads the columns it needs."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def parts_of(df: DataFrame, times: int = 1) -> int:
    """Into how many partitions df's rows, each taken so many times, go, about ROWS_A_PART each, so that a task holds no more
    of a larger table; the session's own number at least. df is counted, so it should be a table."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * times // ROWS_A_PART))


def key_union(frames: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*keys) for f in frames]).distinct()


def key_intersection(frames: list[DataFrame], keys: list[str] = KEYS) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(*keys), keys, "left_semi"), frames[1:], frames[0].select(*keys).distinct())


def aligned(frames: list[DataFrame], how: str = "outer", keys: list[str] = KEYS) -> list[DataFrame]:
    """Every frame on the union, the intersection, or the first frame's keys."""
    axis = {"outer": key_union, "inner": key_intersection, "first": lambda fs, ks: fs[0].select(*ks).distinct()}[how](frames, keys)
    return [axis.join(f, keys, "left") for f in frames]


def merged(frames: list[DataFrame], how: str = "outer", keys: list[str] = KEYS) -> DataFrame:
    """The frames side by side."""
    kind = {"outer": "full", "inner": "inner", "first": "left"}[how]
    return reduce(lambda a, b: a.join(b, keys, kind), frames)


def stacked_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def reindexed(panel: DataFrame, index: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return index.select(*keys).join(panel, keys, "left")


def dense_grid(dates: DataFrame, ids: DataFrame, panels: list[DataFrame]) -> DataFrame:
    """Every date with every id, and the panels' columns beside; the grid is asked for, its size is dates times ids."""
    grid = dates.select("date").distinct().crossJoin(ids.select("id").distinct())
    return reduce(lambda a, b: a.join(b, KEYS, "left"), panels, grid)


def as_of(left: DataFrame, right: DataFrame, on: str, order: str, values: list[str], right_order: str | None = None, forward: bool = False) -> DataFrame:
    """left with the values of the last row of right at or before `order` (first at or after, if forward), per `on`.

    Both sides are sorted once per key; the matched row is carried whole, so nulls within it survive.
    """
    right_order = right_order or order
    side = right.select(F.col(on), F.col(right_order).alias("_at"), F.lit(0 if not forward else 1).alias("_side"), F.struct(*values).alias("_row"))
    kept = left.select(F.col(on), F.col(order).alias("_at"), F.lit(1 if not forward else 0).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = side.unionByName(kept, allowMissingColumns=True)
    if forward:
        w = Window.partitionBy(on).orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
        match = F.first("_row", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        match = F.last("_row", ignorenulls=True).over(w)
    found = both.withColumn("_match", match).where("_left is not null")
    return found.select("_left.*", *(F.col(f"_match.{v}").alias(v) for v in values))


def as_of_in_ranges(left: DataFrame, right: DataFrame, on: str | list[str], order: str, values: list[str], right_order: str | None = None, forward: bool = False) -> DataFrame:
    """What as_of returns, with a key's rows spread over tasks however many they are.

    Rows of both sides are dealt by ranges of (key, order) and written. Each range fills its own rows from the row of right
    before them; what stands at the beginning of a range takes the last row of right before the range, if that has its key.
    Of the rows of right one for each range meets in one task. Equal places are parted by a hash, so a hot one is spread, too.
    """
    keys, right_order = [on] if isinstance(on, str) else on, right_order or order
    key = F.struct(*(F.col(k).alias(k) for k in keys)).alias("_key")
    first, second = (0, 1) if not forward else (1, 0)  # of equal places right comes first in the direction of filling
    side = right.select(key, F.col(right_order).alias("_at"), F.lit(first).alias("_side"), F.xxhash64(*values).alias("_spread"), F.struct(*values).alias("_row"))
    kept = left.select(key, F.col(order).alias("_at"), F.lit(second).alias("_side"), F.xxhash64(*left.columns).alias("_spread"), F.struct(*left.columns).alias("_left"))
    place = ["_key", "_at", "_side", "_spread"]
    ranges = settled(side.unionByName(kept, allowMissingColumns=True).repartitionByRange(*place).withColumn("_range", F.spark_partition_id()))
    known = F.when(F.col("_row").isNotNull(), F.struct("_key", "_row"))
    way = (lambda c: F.col(c).desc()) if forward else (lambda c: F.col(c).asc())
    inside = Window.partitionBy("_range").orderBy(*map(way, place)).rowsBetween(Window.unboundedPreceding, 0)
    last = (F.min_by if forward else F.max_by)(F.struct("_key", "_row"), F.struct(*place))
    of_right = ranges.where("_row is not null").groupBy("_range").agg(last.alias("_known"))
    ends = ranges.select("_range").distinct().join(of_right, "_range", "left")
    before = Window.orderBy(way("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_range", F.last("_known", ignorenulls=True).over(before).alias("_carried"))
    found = ranges.withColumn("_near", F.last(known, ignorenulls=True).over(inside)).join(carried, "_range", "left").where("_left is not null")
    near = F.coalesce("_near", "_carried")
    match = F.when(near["_key"] == F.col("_key"), near["_row"])
    return found.withColumn("_match", match).select("_left.*", *(F.col(f"_match.{v}").alias(v) for v in values))


def snapshot_as_of(dates: DataFrame, snapshots: DataFrame, order: str = "snapshot") -> DataFrame:
    """Every date with all rows of the last snapshot at or before it; members left out by a later one don't linger."""
    known = snapshots.select(order).distinct().withColumn("_k", F.lit(1))
    wanted = as_of(dates.select("date").distinct().withColumn("_k", F.lit(1)), known.withColumn("_at_snapshot", F.col(order)), "_k", "date", ["_at_snapshot"], right_order=order)
    return wanted.drop("_k").join(snapshots, F.col("_at_snapshot") == F.col(order)).drop("_at_snapshot")


def members_on(dates: DataFrame, intervals: DataFrame, entry: str = "entry_dt", removal: str = "removal_dt") -> DataFrame:
    """dates joined with the intervals that hold them, both ends included, open ends valid for ever.

    Intervals are spread over the months they touch, so that the join has an equal key and no list is compared with all.
    """
    months = dates.agg(F.min(F.trunc("date", "month")).alias("_lo"), F.max(F.trunc("date", "month")).alias("_hi"))
    spread = intervals.crossJoin(F.broadcast(months))  # months is one row
    start = F.greatest(F.trunc(entry, "month"), F.col("_lo"))
    end = F.least(F.trunc(F.coalesce(removal, "_hi"), "month"), F.col("_hi"))
    spread = spread.where(start <= end).withColumn("_month", F.explode(F.sequence(start, end, F.expr("interval 1 month")))).drop("_lo", "_hi")
    found = dates.withColumn("_month", F.trunc("date", "month")).join(spread, "_month")
    return found.where((F.col(entry) <= F.col("date")) & (F.col(removal).isNull() | (F.col(removal) >= F.col("date")))).drop("_month")


def one_hot(df: DataFrame, label: str, values: list[str], drop_first: bool = False) -> DataFrame:
    chosen = sorted(values)[1:] if drop_first else sorted(values)
    return df.withColumns({v: F.when(F.col(label) == v, 1).otherwise(0).cast("tinyint") for v in chosen})


def label_of(df: DataFrame, values: list[str], out: str = "label") -> DataFrame:
    return df.withColumn(out, F.coalesce(*(F.when(F.col(v) == 1, v) for v in values)))


def numbered(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """df with each row's place (from 0) in an order. Ranges of the order are numbered side by side and then moved on by the
    sizes of those before them, so no task meets more than a range; one row a range meets in one."""
    ranges = settled(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_moved"))
    place = F.row_number().over(inside) - 1 + F.col("_moved")
    return ranges.join(moved, "_range").withColumn(out, place).drop("_range", "_moved")


def codes_as_of(dates: DataFrame, codes: DataFrame, label: str, values: list[str]) -> DataFrame:
    """0/1 columns of each id's last label at or before each date; an id without one yet is left out."""
    grid = dates.select("date").distinct().crossJoin(codes.select("id").distinct())
    return one_hot(as_of(grid, codes, "id", "date", [label]).where(F.col(label).isNotNull()), label, values).drop(label)


def announced_by(stamps: DataFrame, macro: DataFrame, time: str = "15:00") -> DataFrame:
    """Each name's value announced last by a time of each date; macro: name, date, value, ann_dt; stamps: name, date."""
    at = F.to_timestamp_ntz(F.concat(F.col("date").cast("string"), F.lit(f" {time}")), F.lit("yyyy-MM-dd HH:mm"))
    known = macro.where("ann_dt is not null").groupBy("name", F.col("ann_dt").alias("_at")).agg(F.max_by(F.struct("value"), "date").alias("r")).select("name", "_at", "r.value")
    return as_of(stamps.select("name", "date", at.alias("_at")), known, "name", "_at", ["value"]).drop("_at")


def long(df: DataFrame, keys: list[str], values: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def wide(df: DataFrame, key: str, name: str, value: str, names: list) -> DataFrame:
    return df.groupBy(key).pivot(name, names).agg(F.first(value, ignorenulls=True))


def matching(df: DataFrame, equal: dict | None = None, between: dict | None = None, contains: dict | None = None, fields: list[str] | None = None, like: dict | None = None) -> DataFrame:
    """Rows by optional predicates: equal to a value or one of a list, between two ends (None: open), containing a text, like an expression."""
    tests: list[Column] = []
    for c, v in (equal or {}).items():
        tests.append(F.col(c).isin(list(v)) if isinstance(v, list | tuple | set) else F.col(c) == v)
    for c, (a, b) in (between or {}).items():
        tests += [F.col(c) >= a] * (a is not None) + [F.col(c) <= b] * (b is not None)
    tests += [F.col(c).contains(v) for c, v in (contains or {}).items()]
    tests += [F.col(c).rlike(v) for c, v in (like or {}).items()]
    out = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return out.select(*fields) if fields else out


def shares(df: DataFrame, weight: str, by: str | list[str]) -> DataFrame:
    """The weight scaled to a sum of 1 per group."""
    return df.withColumn(weight, F.col(weight) / F.nullif(F.sum(weight).over(Window.partitionBy(*([by] if isinstance(by, str) else by))), F.lit(0.0)))


def ancestors(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """Every node with each of its ancestors and the distance, by joining one level at a time up to the root.

    A cycle is an error: some node of it would come to stand above itself.
    """
    settle = settled  # else each level would run all before it again
    step = settle(tree.select(F.col(node).alias("node"), F.col(parent).alias("ancestor")).where("ancestor is not null"))
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"))
    found = front = step.withColumn("depth", F.lit(1))
    depth = 1
    while not front.isEmpty():
        if not front.where(F.col("node") == F.col("ancestor")).isEmpty():
            raise ValueError("the tree has a cycle")
        depth += 1
        front = settle(front.join(up, "ancestor").select("node", F.col("_next").alias("ancestor"), F.lit(depth).alias("depth")))
        found = found.unionByName(front)
    return found
