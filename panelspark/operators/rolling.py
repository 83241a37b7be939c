"""Rolling windows, weights and statistics along time."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(x: str, window: int, f, by: str = "id", order: str = "date") -> Column:
    """f over the last `window` rows; null until there are so many."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - window, 0)
    return F.when(F.count(F.lit(1)).over(w) == window, f(x).over(w))


def half_life_weights(df: DataFrame, half: float, by: str = "id", order: str = "date", scale: bool = True, out: str = "weight") -> DataFrame:
    """0.5^(age / half), the newest row's age 0; scaled to a sum of 1 if asked for."""
    age = F.row_number().over(Window.partitionBy(by).orderBy(F.col(order).desc())) - 1
    df = df.withColumn(out, F.pow(F.lit(0.5), age / half))
    return df.withColumn(out, F.col(out) / F.sum(out).over(Window.partitionBy(by))) if scale else df


def with_base(df: DataFrame, cal: DataFrame, by: str = "id", ret: str = "ret") -> DataFrame:
    """df (date, by, ret) with a return of 0 on the trade day before each one's first, from which net asset values start at 1."""
    first = df.groupBy(by).agg(F.min("date").alias("_d")).withColumn("_before", F.date_sub("_d", 1))
    base = first.join(cal.select(F.col("date").alias("_before"), "prev_td"), "_before").select(by, F.col("prev_td").alias("date"), F.lit(0.0).alias(ret))
    return df.select(by, "date", ret).unionByName(base)


def rolling_all(x: str, window: int, functions: dict, by: str = "id", order: str = "date") -> Column:
    """A struct of several results over the last `window` rows; null until there are so many."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - window, 0)
    return F.when(F.count(F.lit(1)).over(w) == window, F.struct(*(f(x).over(w).alias(k) for k, f in functions.items())))


def nav(ret: str, by: str = "id", order: str = "date") -> Column:
    """Growth of 1 by the returns so far; a missing return changes nothing."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(w)


def weighted_covariance(x: str, y: str, w: str) -> Column:
    """Aggregate: population covariance under weights of sum 1."""
    a, b, c = F.col(x), F.col(y), F.col(w)
    return F.sum(a * b * c) - F.sum(a * c) * F.sum(b * c)


def weighted_correlation(x: str, y: str, w: str) -> Column:
    return weighted_covariance(x, y, w) / F.sqrt(weighted_covariance(x, x, w) * weighted_covariance(y, y, w))


def percentile_of(x: str, window: int, by: str = "id", order: str = "date") -> Column:
    """Share of the window's rows before that are at or below the row's value; null until there are so many."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-window, -1)
    values = F.collect_list(x).over(w)
    return F.when(F.size(values) == window, F.size(F.filter(values, lambda v: v <= F.col(x))) / window)


def position_of(x: str, window: int, by: str = "id", order: str = "date") -> Column:
    """Place of the value between the least and largest of the window's rows before, within [0, 1]."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-window, -1)
    low, high = F.min(x).over(w), F.max(x).over(w)
    place = (F.col(x) - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(F.count(x).over(w) == window, F.greatest(F.lit(0.0), F.least(F.lit(1.0), place)))


def drawn_splits(blocks: int, draws: int, seed: int) -> list[tuple[int, list[int]]]:
    """Halves of the blocks drawn at random, with replacement from all halves."""
    rng = random.Random(seed)
    return [(i, sorted(rng.sample(range(blocks), blocks // 2))) for i in range(draws)]


def overfitting(returns: DataFrame, blocks: int = 8, order: str = "date", strategy: str = "id", value: str = "value", draws: int | None = None, seed: int = 0) -> DataFrame:
    """Probability of backtest overfitting: of all ways to take half of the blocks as sample, the share in which the
    sample's best strategy by Sharpe ratio ranks in the lower half outside of it. One row: pbo, splits. draws: so many halves drawn at random instead of all.

    Blocks are sums per strategy, so a split adds up blocks and no returns are read again.
    """
    spark = returns.sparkSession
    dates = returns.select(order).distinct().withColumn("_n", F.row_number().over(Window.orderBy(order)) - 1)
    size = dates.agg(F.count("*").alias("_all"))
    cut = dates.crossJoin(F.broadcast(size)).select(order, F.floor(F.col("_n") * blocks / F.col("_all")).cast("int").alias("block"))
    stats = returns.join(cut, order).groupBy(strategy, "block").agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    chosen = drawn_splits(blocks, draws, seed) if draws else [(i, list(c)) for i, c in enumerate(combinations(range(blocks), blocks // 2))]
    splits = spark.createDataFrame(chosen, "split int, inside array<int>")
    every = stats.crossJoin(F.broadcast(splits)).withColumn("side", F.array_contains("inside", F.col("block")))
    sums = every.groupBy("split", "side", strategy).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean, var = F.col("s") / F.col("n"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    sharpe = F.round(mean / F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)), 9)
    wide = sums.withColumn("sharpe", sharpe).groupBy("split", strategy).agg(F.max(F.when(F.col("side"), F.col("sharpe"))).alias("inside"), F.max(F.when(~F.col("side"), F.col("sharpe"))).alias("outside"))
    w = Window.partitionBy("split")
    ranked = wide.withColumn("r", F.rank().over(w.orderBy("outside"))).withColumn("all", F.count("*").over(w)).withColumn("first", F.row_number().over(w.orderBy(F.col("inside").desc(), F.col(strategy))))
    best = ranked.where("first = 1")
    return best.agg(F.avg((1 - F.col("r") / F.col("all") > 0.5).cast("double")).alias("pbo"), F.count("*").alias("splits"))
