"""Tests of timing signals against a benchmark's returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.orderstats import with_quantiles


def discrete(signals: DataFrame) -> DataFrame:
    """name and whether all its signals are -1, 0 or 1."""
    return signals.groupBy("name").agg(F.coalesce(F.bool_and(F.col("signal").isin(-1.0, 0.0, 1.0)), F.lit(True)).alias("is_discrete"))


def signs(df: DataFrame) -> DataFrame:
    return df.withColumn("signal", F.signum("signal"))


def win_rates(df: DataFrame) -> DataFrame:
    """Per name and year, and over all years (year null): counts of signs, win rates (0 without a signal), gain to loss.

    df: name, date, signal of -1, 0, 1, benchmark.
    """
    s, b = F.col("signal"), F.signum("benchmark")
    result = s * F.col("benchmark")
    n = lambda c: F.sum(c.cast("long"))
    share = lambda hit, of: F.coalesce(n(hit) / F.nullif(n(of), F.lit(0)), F.lit(0.0))
    aggs = [
        n(s > 0).alias("ups"), n(s < 0).alias("downs"), n(s == 0).alias("flats"),
        share((s != 0) & (s == b), s != 0).alias("win_rate"), share((s > 0) & (b > 0), s > 0).alias("win_rate_up"), share((s < 0) & (b < 0), s < 0).alias("win_rate_down"),
        (-F.avg(F.when(result > 0, result)) / F.nullif(F.avg(F.when(result < 0, result)), F.lit(0.0))).alias("gain_to_loss"),
    ]
    rows = df.where("signal is not null and benchmark is not null").withColumn("year", F.year("date"))
    return rows.groupingSets([["name", "year"], ["name"]], "name", "year").agg(*aggs)


def performance(df: DataFrame, commission: float = 0.0, short: bool = True) -> DataFrame:
    """Returns of following the signal; without `short` a signal of -1 holds nothing."""
    s = F.col("signal") if short else F.greatest(F.col("signal"), F.lit(0.0))
    w = Window.partitionBy("name").orderBy("date")
    df = df.withColumn("_s", s)
    return df.withColumn("value", F.col("_s") * F.col("benchmark") - F.abs(F.col("_s") - F.coalesce(F.lag("_s").over(w), F.lit(0.0))) * commission).drop("_s")


def by_score(df: DataFrame) -> DataFrame:
    return df.groupBy("name", "signal").agg(F.avg("benchmark").alias("mean_return"), F.stddev_samp("benchmark").alias("std_return"), F.count("benchmark").alias("n"))


def forward_returns(df: DataFrame, days: int, shift: int = 1, ret: str = "benchmark") -> DataFrame:
    """df with the factor `shift` rows before and the compounded return of the next rows, null where these end."""
    w = Window.partitionBy("name").orderBy("date")
    ahead = w.rowsBetween(0, days - 1)
    full = F.count(F.lit(1)).over(ahead) == days
    return df.withColumn("factor", F.lag("signal", shift).over(w)).withColumn("forward", F.when(full, F.product(1 + F.col(ret)).over(ahead) - 1))


def _tercile(x, low, high):
    return F.when(x <= low, 1).when(x <= high, 2).when(x.isNotNull(), 3)


def terciles(df: DataFrame, days: int, shift: int = 1) -> DataFrame:
    """Mean forward return of each third of the factor over the whole sample, with the pooled t of the first less the last."""
    rows = forward_returns(df, days, shift).where("factor is not null and forward is not null")
    w = Window.partitionBy("name")
    q = lambda r: F.percentile("factor", F.lit(r)).over(w)
    third = _tercile(F.col("factor"), q(1 / 3), q(2 / 3))
    return _contrast(rows.withColumn("third", third))


def _contrast(rows: DataFrame) -> DataFrame:
    of = lambda k, f: f(F.when(F.col("third") == k, F.col("forward")))
    stats = rows.groupBy("name").agg(*(of(k, f).alias(f"{c}{k}") for k in (1, 2, 3) for c, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    n1, n3 = F.col("n1"), F.col("n3")
    pooled = ((n1 - 1) * F.col("v1") + (n3 - 1) * F.col("v3")) / F.nullif(n1 + n3 - 2, F.lit(0))
    t = (F.col("m1") - F.col("m3")) / F.nullif(F.sqrt(pooled * (1 / F.nullif(n1, F.lit(0)) + 1 / F.nullif(n3, F.lit(0)))), F.lit(0.0))
    return stats.select("name", "n1", "n2", "n3", "m1", "m2", "m3", t.alias("t"))


def rolling_terciles(df: DataFrame, window: int, days: int, shift: int = 1) -> DataFrame:
    """The same with each row's third taken within the `window` rows up to it."""
    rows = with_quantiles(forward_returns(df, days, shift), "factor", window, {"_low": 1 / 3, "_high": 2 / 3}, "name")
    third = F.when(F.col("_low").isNotNull(), _tercile(F.col("factor"), F.col("_low"), F.col("_high")))
    return _contrast(rows.withColumn("third", third).where("third is not null and forward is not null"))
