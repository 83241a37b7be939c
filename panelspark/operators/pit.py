"""Point-in-time fundamentals: what was known on a date of statements that are announced later and restated.

raw: id, period, ann_dt, value. On a date the latest period is that of the largest (ann_dt, period) announced by then,
and a period's value is the one announced last by then. Each revision is valid until the next of its period, so a lookup
is an equal join on id and period and a range test, not a comparison with all revisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.dates import shifted
from panelspark.functions.maths import growth, mean_of
from panelspark.operators.align import as_of


def revisions(raw: DataFrame) -> DataFrame:
    """id, period, value with the dates [ann_dt, until) on which it is the known one."""
    once = raw.where("value is not null and ann_dt is not null").groupBy("id", "period", "ann_dt").agg(F.max("value").alias("value"))
    return once.withColumn("until", F.lead("ann_dt").over(Window.partitionBy("id", "period").orderBy("ann_dt")))


def latest(keys: DataFrame, raw: DataFrame, quarter: int | None = None) -> DataFrame:
    """keys (date, id) with the period and value known last; of one fiscal quarter if that is given."""
    known = raw.where("value is not null and ann_dt is not null")
    if quarter is not None:
        known = known.where(F.quarter("period") == quarter)
    # one row per announcement day: the largest period announced on it, its value the largest of equals
    day = known.groupBy("id", "ann_dt").agg(F.max(F.struct("period", "value")).alias("r")).select("id", "ann_dt", "r.period", "r.value")
    return as_of(keys.select("date", "id"), day, "id", "date", ["period", "value"], right_order="ann_dt")


def looked_up(df: DataFrame, raw: DataFrame, period: Column, out: str) -> DataFrame:
    """df (date, id and others) with the value known on date of each row's `period`."""
    r = revisions(raw).select(F.col("id").alias("_id"), F.col("period").alias("_period"), F.col("ann_dt").alias("_from"), "until", F.col("value").alias(out))
    tagged = df.withColumn("_want", period)
    match = (F.col("id") == F.col("_id")) & (F.col("_want") == F.col("_period")) & (F.col("_from") <= F.col("date")) & (F.col("until").isNull() | (F.col("until") > F.col("date")))
    return tagged.join(r, match, "left").drop("_id", "_period", "_from", "until", "_want")


def ttm(keys: DataFrame, raw: DataFrame, years: int = 0, quarters: int = 0) -> DataFrame:
    """Trailing twelve months, as of so many years or quarters back; null if a part is missing."""
    rows = latest(keys, raw)
    base = shifted(F.col("period"), years, quarters)
    rows = looked_up(rows, raw, base, "_now") if years or quarters else rows.withColumn("_now", F.col("value"))
    rows = looked_up(rows, raw, shifted(base, 1, quarter=4), "_year")
    rows = looked_up(rows, raw, shifted(base, 1), "_before")
    # a full year is its own trailing sum
    return rows.select("date", "id", (F.col("_now") + F.col("_year") - F.col("_before")).alias("value"))


def back(keys: DataFrame, raw: DataFrame, years: int = 0, quarters: int = 0, quarter: int | None = None) -> DataFrame:
    """The value of the period so many years or quarters before the latest."""
    rows = looked_up(latest(keys, raw), raw, shifted(F.col("period"), years, quarters, quarter), "old")
    return rows.select("date", "id", F.col("old").alias("value"))


def last_periods(keys: DataFrame, raw: DataFrame, n: int, quarter: int | None = None) -> DataFrame:
    """The n last known periods of each date and id, nth from 1 for the latest announced."""
    r = revisions(raw if quarter is None else raw.where(F.quarter("period") == quarter))
    known = keys.select("date", "id").join(r, "id").where("ann_dt <= date and (until is null or until > date)")
    nth = F.row_number().over(Window.partitionBy("date", "id").orderBy(F.col("ann_dt").desc(), F.col("period").desc()))
    return known.withColumn("nth", nth).where(F.col("nth") <= n).select("date", "id", "nth", "period", "value")


def compared(keys: DataFrame, raw: DataFrame, kind: str = "growth", years: int = 0, quarters: int = 0) -> DataFrame:
    """Growth on, or mean with, the period so many years or quarters before the latest."""
    rows = looked_up(latest(keys, raw), raw, shifted(F.col("period"), years, quarters), "old")
    f = {"growth": growth, "mean": mean_of}[kind]
    return rows.select("date", "id", f(F.col("value"), F.col("old")).alias("value"))


def single_quarter(raw: DataFrame) -> DataFrame:
    """Cumulative figures as those of each quarter alone: less the quarter before in the same year, as known when announced."""
    r = raw.where("value is not null").withColumn("date", F.col("ann_dt"))
    rows = looked_up(r.select("id", "period", "ann_dt", "date", "value"), raw, shifted(F.col("period"), 0, 1), "old")
    return rows.select("id", "period", "ann_dt", F.when(F.quarter("period") == 1, F.col("value")).otherwise(F.col("value") - F.col("old")).alias("value"))


FUNCTIONS = {
    "latest_period": lambda k, r, **a: latest(k, r, **a),
    "ttm": lambda k, r: ttm(k, r),
    "last_nyear_ttm": lambda k, r, n=1: ttm(k, r, years=n),
    "last_nperiod_ttm": lambda k, r, n=1: ttm(k, r, quarters=n),
    "last_nyear": lambda k, r, n=1, quarter=None: back(k, r, years=n, quarter=quarter),
    "last_nperiod": lambda k, r, n=1: back(k, r, quarters=n),
    "last_nyears": lambda k, r, n=1, quarter=None: last_periods(k, r, n, quarter),
    "inc_rate_tb": lambda k, r, n=1: compared(k, r, "growth", years=n),
    "inc_rate_hb": lambda k, r, n=1: compared(k, r, "growth", quarters=n),
    "ttm_avg": lambda k, r: compared(k, r, "mean", years=1),
    "sq_avg": lambda k, r: compared(k, r, "mean", quarters=1),
}


def run(name: str, keys: DataFrame, raw: DataFrame, **arguments) -> DataFrame:
    return FUNCTIONS[name](keys, raw, **arguments)
