"""Portfolio simulation and net-asset-value analytics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.align import as_of, matching, settled
from panelspark.operators.calendar import shifted_days

PERIODS = {"d": 252, "w": 52, "m": 12}


def adjusted(df: DataFrame, by: str = "date", target: str = "weight", held: str = "w0") -> DataFrame:
    """Weights that can be traded to: blocked names (no_buy above what is held, no_sell below) keep theirs, the others
    share what is left in proportion to their targets."""
    blocked = (F.col("no_buy") & (F.col(target) > F.col(held))) | (F.col("no_sell") & (F.col(target) < F.col(held)))
    w = Window.partitionBy(by)
    df = df.withColumn("_blocked", F.coalesce(blocked, F.lit(False)))
    kept = F.sum(F.when(F.col("_blocked"), F.col(held)).otherwise(0.0)).over(w)
    free = F.sum(F.when(F.col("_blocked"), 0.0).otherwise(F.col(target))).over(w)
    new = F.when(F.col("_blocked"), F.col(held)).otherwise(F.col(target) * (1 - kept) / F.nullif(free, F.lit(0.0)))
    return df.withColumn("w1", new).drop("_blocked")


def held_returns(targets: DataFrame, returns: DataFrame, commission: float = 0.0) -> DataFrame:
    """date, value (return), turnover of a portfolio without blocked names.

    targets: date, id, weight at each rebalance; returns: date, id, ret. Each day belongs to the last rebalance at or
    before it; weights drift with returns and sum to 1 each day. As no weight depends on the one before the rebalance,
    all chunks run side by side, and turnover compares each chunk's first weights with the last of the one before.
    """
    rebalances = targets.select("date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("date")))
    scaled = targets.withColumn("w1", F.col("weight") / F.sum("weight").over(Window.partitionBy("date")))
    chunks = scaled.join(rebalances, "date").select("nth", "id", "w1")
    # each day is told its rebalance, so that days meet weights by an equal key
    one = F.lit(1).alias("_k")
    days = as_of(returns.select("date", one).distinct(), rebalances.select("date", "nth", one), "_k", "date", ["nth"]).drop("_k")
    held = returns.select("date", "id", F.coalesce("ret", F.lit(0.0)).alias("ret")).join(days, "date").join(chunks, ["nth", "id"])
    path = Window.partitionBy("nth", "id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = held.withColumn("end", F.col("w1") * F.product(1 + F.col("ret")).over(path)).withColumn("start", F.col("end") / F.nullif(1 + F.col("ret"), F.lit(0.0)))
    day = Window.partitionBy("date")
    grown = grown.withColumn("w", F.col("start") / F.sum("start").over(day)).withColumn("after", F.col("end") / F.sum("end").over(day))
    daily = grown.groupBy("date", "nth").agg(F.sum(F.col("w") * F.col("ret")).alias("value"))
    last = grown.withColumn("_last", F.max("date").over(Window.partitionBy("nth"))).where("date = _last").select((F.col("nth") + 1).alias("nth"), "id", F.col("after").alias("w0"))
    moves = chunks.select("nth", "id", "w1").join(last, ["nth", "id"], "full").groupBy("nth").agg(F.sum(F.abs(F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))).alias("turnover"))
    first = F.col("date") == F.min("date").over(Window.partitionBy("nth"))
    joined = daily.join(moves, "nth").withColumn("turnover", F.when(first, F.col("turnover")).otherwise(0.0))
    return joined.select("date", (F.col("value") - commission * F.col("turnover")).alias("value"), "turnover")


def flat_paths(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of path and told of all rows of a batch, one after another, and where each row ends."""
    out = {}
    for column in ("path", "told"):
        values = batch.column(column).flatten()
        out |= {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    return out, np.cumsum(batch.column("path").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def walked(x: dict[str, np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's weight before and after every rebalance, and whether it was blocked, all ids at once; x has the portfolio's share and scale, too."""
    begins = np.concatenate([[0], ends[:-1]])
    old, new, blocked = np.zeros(len(x["goal"])), np.zeros(len(x["goal"])), np.zeros(len(x["goal"]), bool)
    w, lengths = np.zeros(len(ends)), ends - begins
    for n in range(int(lengths.max(initial=0))):
        row = np.flatnonzero(lengths > n)
        at = begins[row] + n
        goal, mine = x["goal"][at], w[row]
        stuck = (x["no_buy"][at] & (goal > mine)) | (x["no_sell"][at] & (goal < mine))
        to = np.where(stuck, mine, goal * x["share"][at])
        old[at], new[at], blocked[at] = mine, to, stuck
        w[row] = to * x["growth"][at] * x["scale"][at]
    return old, new, blocked


def rebalanced(rows: DataFrame, key: str = "portfolio", tolerance: float = 1e-13) -> DataFrame:
    """key, nth, id, w1 (the weight traded to) and turnover (of the whole rebalance).

    rows: key, nth (1, 2, ... without gaps), id, goal, growth (until the next rebalance), no_buy, no_sell; every id at every
    nth. All that one id has to know of the others at a rebalance are two numbers: share, by which the goals of free names
    are scaled, and scale, which makes grown weights sum to what they were. Told these, ids are walked side by side,
    wherever they are; sums of what they do give better numbers. A round makes those of one more rebalance right at least, as
    weights depend on earlier ones alone; where few names are blocked for long, few rounds settle all. No task meets all
    ids of a portfolio.
    """
    kinds = dict(rows.dtypes)
    fields = F.struct("nth", "goal", "growth", "no_buy", "no_sell")
    paths = settled(rows.groupBy(key, "id").agg(F.array_sort(F.collect_list(fields)).alias("path")))
    over = lambda a, b, other: F.when(b != 0, a / b).otherwise(F.lit(other))
    goals = paths.select(key, F.explode("path").alias("p")).select(key, "p.*").groupBy(key, "nth").agg(F.sum("goal").alias("_g"), F.sum(F.col("goal") * F.col("growth")).alias("_h"))
    told = settled(goals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", over(F.lit(1.0), F.col("_g"), 0.0).alias("share"), over(F.col("_g"), F.col("_h"), 1.0).alias("scale")))).alias("told"), F.lit(1.0).alias("gap")))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ends = flat_paths(batch)
            old, _, blocked = walked(x, ends)
            coded = batch.column(key).dictionary_encode()
            code, lengths = coded.indices.to_numpy(zero_copy_only=False), np.diff(np.concatenate([[0], ends]))
            most = np.zeros(len(coded.dictionary), np.int64)
            np.maximum.at(most, code, lengths)
            before = np.concatenate([[0], np.cumsum(most)])
            at = np.repeat(before[code], lengths) + x["nth"] - 1
            total = lambda v: pa.array(np.bincount(at, v, before[-1]))  # noqa: B023, E731
            free, nth = np.where(blocked, 0.0, x["goal"]), np.arange(before[-1]) - np.repeat(before[:-1], most) + 1
            kept = np.where(blocked, old, 0.0)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(np.repeat(np.arange(len(most)), most))), pa.array(nth.astype(np.int32)), *map(total, (kept, free, kept * x["growth"], free * x["growth"]))], [key, "nth", "kept", "free", "kept_grown", "free_grown"])

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ends = flat_paths(batch)
            old, new, _ = walked(x, ends)
            row = pa.array(np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends]))))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(row), pa.array(x["nth"].astype(np.int32)), batch.column("id").take(row), pa.array(new), pa.array(np.abs(new - old))], [key, "nth", "id", "w1", "moved"])

    rounds = (goals.agg(F.max("nth")).first()[0] or 0) + 2
    for _ in range(rounds):
        still = told.where(F.col("gap") > tolerance)
        if still.isEmpty():
            break
        found = paths.join(still, key).select(key, "path", "told").mapInArrow(sums, f"{key} {kinds[key]}, nth int, kept double, free double, kept_grown double, free_grown double")
        found = found.groupBy(key, "nth").agg(*(F.sum(c).alias(c) for c in ("kept", "free", "kept_grown", "free_grown")))
        share = F.when(F.col("free") != 0, (1 - F.col("kept")) / F.col("free")).otherwise(0.0)
        found = found.withColumn("share", share).withColumn("scale", over(F.col("kept") + F.col("share") * F.col("free"), F.col("kept_grown") + F.col("share") * F.col("free_grown"), 1.0))
        better = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "share", "scale"))).alias("better"))
        apart = lambda a, b: F.greatest(*(F.abs(a[c] - b[c]) / F.greatest(F.abs(a[c]), F.lit(1e-300)) for c in ("share", "scale")))
        moved = still.join(better, key).select(key, F.col("better").alias("told"), F.array_max(F.zip_with("told", "better", apart)).alias("gap"))
        told = settled(told.where(F.col("gap") <= tolerance).unionByName(moved))
    held = settled(paths.join(told, key).select(key, "id", "path", "told").mapInArrow(weights, f"{key} {kinds[key]}, nth int, id {kinds['id']}, w1 double, moved double"))
    return held.drop("moved").join(held.groupBy(key, "nth").agg(F.sum("moved").alias("turnover")), [key, "nth"])


def backtest(targets: DataFrame, returns: DataFrame, status: DataFrame, commission: float = 0.0) -> DataFrame:
    """portfolio, date, value, turnover with names that can't be traded.

    targets: portfolio, date, id, weight; returns: portfolio, date, id, ret; status: portfolio, date, id, no_buy, no_sell
    (missing: both). A target counts from the first day with returns at or after its date, the last one of a day. Only the
    weights that rebalances trade to depend on what was held before (rebalanced()); the days between are worked out side by side.
    """
    key = "portfolio"
    days = returns.select(key, "date").distinct()
    first = as_of(targets.select(key, "date").distinct(), days.withColumn("day", F.col("date")), key, "date", ["day"], right_order="day", forward=True)
    starts = first.where("day is not null").groupBy(key, "day").agg(F.max("date").alias("target"))
    starts = starts.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    days = as_of(days, starts.select(key, "day", "nth"), key, "date", ["nth"], right_order="day").where("nth is not null")
    paid = returns.select(key, "date", "id", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    growth = paid.join(days, [key, "date"]).groupBy(key, "nth", "id").agg(F.product(1 + F.col("ret")).alias("growth"))
    goals = targets.withColumnRenamed("date", "target").join(starts, [key, "target"]).select(key, "nth", "id", "weight")
    ids = goals.select(key, "id").distinct()  # what is never a target is never held
    grid = starts.select(key, "nth", "day").join(ids, key)
    flags = status.select(key, F.col("date").alias("day"), "id", "no_buy", "no_sell")
    yes = F.lit(True)
    rows = grid.join(goals, [key, "nth", "id"], "left").join(growth, [key, "nth", "id"], "left").join(flags, [key, "day", "id"], "left")
    rows = rows.select(key, "nth", "id", F.coalesce("weight", F.lit(0.0)).alias("goal"), F.coalesce("growth", F.lit(1.0)).alias("growth"), F.coalesce("no_buy", yes).alias("no_buy"), F.coalesce("no_sell", yes).alias("no_sell"))

    held = rebalanced(rows, key)
    path = Window.partitionBy(key, "nth", "id").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    daily = days.join(held, [key, "nth"]).join(paid, [key, "date", "id"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))
    daily = daily.withColumn("at", F.col("w1") * F.coalesce(F.product(1 + F.col("ret")).over(path), F.lit(1.0)))
    value = F.coalesce(F.sum(F.col("at") * F.col("ret")) / F.nullif(F.sum("at"), F.lit(0.0)) * F.sum("w1"), F.lit(0.0))
    out = daily.groupBy(key, "nth", "date").agg(value.alias("value"), F.max("turnover").alias("turnover"))
    begins = F.col("date") == F.min("date").over(Window.partitionBy(key, "nth"))
    out = out.withColumn("turnover", F.when(begins, F.col("turnover")).otherwise(0.0))
    return out.select(key, "date", (F.col("value") - commission * F.col("turnover")).alias("value"), "turnover")


def price_returns(prices: DataFrame, price: str = "close", at_open: bool = False) -> DataFrame:
    """Returns of a day: over the close before, or to the next open."""
    w = Window.partitionBy("id").orderBy("date")
    p = F.col(price)
    ret = F.lead(p).over(w) / F.nullif(p, F.lit(0.0)) - 1 if at_open else p / F.nullif(F.lag(p).over(w), F.lit(0.0)) - 1
    return prices.withColumn("ret", F.coalesce(ret, F.lit(0.0)))


#: By kind of price: trade days from a signal to the first day on which new weights earn, and whether days earn to the next open.
PRICE_TYPES = {"close": (2, False), "open": (1, True)}


def stock_backtest(targets: DataFrame, prices: DataFrame, cal: DataFrame, price_type: str = "open", commission: float = 0.0) -> DataFrame:
    """portfolio, date, value, turnover of stock portfolios that are traded on the trade day after their signals.

    targets: portfolio, date, id, weight; prices: date, id, the price (open or close), suspend, go_up_limit, go_down_limit (0 or 1); cal: a calendar.
    On its trade day a suspended stock stays, one at its upper limit can't be bought and one at its lower limit can't be sold; one
    without a row neither. Traded at the close, new weights earn from the day after; at the open, from the day itself to the next open.
    """
    if price_type not in PRICE_TYPES:
        raise ValueError(f"no such price: {price_type}")
    shift, at_open = PRICE_TYPES[price_type]
    moved = shifted_days(targets, cal, shift, out="_day").where("_day is not null").select("portfolio", F.col("_day").alias("date"), "id", "weight")
    ids = moved.select("portfolio", "id").distinct()
    paid = price_returns(prices.select("date", "id", F.col(price_type).cast("double").alias("_price")), "_price", at_open).select("date", "id", "ret")
    stopped = lambda limit: F.greatest(F.col("suspend"), F.col(limit)).cast("int") > 0
    flags = prices.select("date", "id", stopped("go_up_limit").alias("no_buy"), stopped("go_down_limit").alias("no_sell"))
    if shift > 1:  # flags are those of the trade day
        flags = shifted_days(flags, cal, shift - 1, out="_day").where("_day is not null").select(F.col("_day").alias("date"), "id", "no_buy", "no_sell")
    return backtest(moved, ids.join(paid, "id"), ids.join(flags, "id"), commission)


def drawdown(df: DataFrame, value: str, by: list[str], order: str = "date") -> DataFrame:
    """df with nav (from 1 before the first return) and its fall from the highest so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("nav", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(w))
    return df.withColumn("drawdown", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1)


def metrics(value: Column, benchmark: Column, fall: Column, rf: float, a: int) -> list[Column]:
    n, total, bench = F.count(value), F.product(1 + value) - 1, F.product(1 + benchmark) - 1
    yearly = lambda r: F.pow(1 + r, a / n) - 1
    gap = F.stddev_samp(value - benchmark) * a**0.5
    return [
        total.alias("total_return"), yearly(total).alias("annual_return"), yearly(bench).alias("benchmark_return"),
        (F.stddev_samp(value) * a**0.5).alias("volatility"), F.least(F.lit(0.0), F.min(fall)).alias("max_drawdown"),
        (F.avg(value - rf / a) / F.nullif(F.stddev_samp(value), F.lit(0.0)) * a**0.5).alias("sharpe"),
        gap.alias("tracking_error"), (F.avg(value - benchmark) * a / F.nullif(gap, F.lit(0.0))).alias("information_ratio"),
    ]


def report(returns: DataFrame, by: str = "series", rf: float = 0.02, period: str = "d", yearly: bool = False, between: tuple | None = None) -> DataFrame:
    """Eight figures per series over all dates (or those between two ends, None for open), or per calendar year; returns: by, date, value, benchmark."""
    keys = [by, "year"] if yearly else [by]
    rows = matching(returns, between={"date": tuple(None if d is None else F.lit(d).cast("date") for d in between)} if between else None)
    rows = rows.where("value is not null and benchmark is not null").withColumn("year", F.year("date"))
    return drawdown(rows, "value", keys).groupBy(*keys).agg(*metrics(F.col("value"), F.col("benchmark"), F.col("drawdown"), rf, PERIODS[period]))
