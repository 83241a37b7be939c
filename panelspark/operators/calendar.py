"""Trading calendar as a table, and operators that join it.

The table has date, is_td, seq (trade days up to and with the date), prev_td, next_td (nearest trade day at or before,
at or after). It has a row a day, so it is small whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.align import as_of

PERIODS = {"w": "week", "m": "month", "q": "quarter", "y": "year"}


def calendar(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Mondays to Fridays that are no holidays."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date")
    off = holidays.select("date").distinct().withColumn("_off", F.lit(True)) if holidays is not None else None
    days = days.join(off, "date", "left") if off is not None else days.withColumn("_off", F.lit(None).cast("boolean"))
    return with_neighbours(days.withColumn("is_td", (F.weekday("date") < 5) & F.col("_off").isNull()).drop("_off"))


def with_neighbours(days: DataFrame) -> DataFrame:
    """days (date, is_td) with seq, prev_td, next_td."""
    w = Window.orderBy("date")
    td = F.when(F.col("is_td"), F.col("date"))
    return days.select(
        "date", "is_td",
        F.sum(F.col("is_td").cast("int")).over(w).alias("seq"),
        F.last(td, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("prev_td"),
        F.first(td, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next_td"),
    )


def trade_days(cal: DataFrame, start: str, end: str, freq: str = "d", begin: bool = False, periods: int | None = None) -> DataFrame:
    """Trade days of a range; by week, month, quarter or year the last (or first) of each; first or last `periods` of them."""
    days = cal.where(F.col("is_td") & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date")
    if freq != "d":
        days = days.groupBy(F.date_trunc(PERIODS[freq], "date").alias("_p")).agg((F.min if begin else F.max)("date").alias("date")).select("date")
    if periods is None:
        return days
    nth = F.row_number().over(Window.orderBy("date" if periods > 0 else F.col("date").desc()))
    return days.withColumn("_n", nth).where(F.col("_n") <= abs(periods)).drop("_n")


def latest_trade_days(df: DataFrame, cal: DataFrame, column: str = "date", out: str = "trade_day") -> DataFrame:
    """df with the last trade day at or before its date."""
    return df.join(cal.select(F.col("date").alias("_d"), F.col("prev_td").alias(out)), F.col(column) == F.col("_d"), "left").drop("_d")


def in_range(df: DataFrame, cal: DataFrame, start: str | None = None, end: str | None = None, dates: list | None = None) -> DataFrame:
    """Rows of df on the trade days of a range (ends may be open), or on those among a list of dates."""
    days = cal.where("is_td").select("date")
    if dates is not None:
        days = days.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    else:
        days = days.where(F.col("date") >= F.lit(start).cast("date")) if start else days
        days = days.where(F.col("date") <= F.lit(end).cast("date")) if end else days
    return df.join(days, "date", "left_semi")


def period_ends(cal: DataFrame, freq: str, backwards: bool = True) -> DataFrame:
    """Nominal ends of the calendar's weeks (Fridays), months, quarters or years, with the trade day each is moved to.

    backwards: to the last trade day up to the nominal end, else to the first from it on.
    """
    end = {"w": F.date_add(F.trunc("date", "week"), 4), "m": F.last_day("date"), "q": F.last_day(F.add_months(F.trunc("date", "quarter"), 2)), "y": F.make_date(F.year("date"), F.lit(12), F.lit(31))}[freq]
    nominal = cal.select(end.alias("nominal")).distinct()
    moved = cal.select(F.col("date").alias("nominal"), F.col("prev_td" if backwards else "next_td").alias("date"))
    return nominal.join(moved, "nominal")


def moved_dates(df: DataFrame, cal: DataFrame, n: int, freq: str = "d") -> DataFrame:
    """df with its dates moved by n trade days, or by n ends of periods that trade days are counted by; values stay.

    Rows that would leave the calendar go.
    """
    if freq == "d":
        return shifted_days(df, cal, n, out="_to").where("_to is not null").withColumn("date", F.col("_to")).drop("_to")
    ends = cal.where("is_td").groupBy(F.date_trunc(PERIODS[freq], "date").alias("_p")).agg(F.max("date").alias("_to"))
    step = F.expr({"w": f"interval {7 * n} days", "m": f"interval {n} months", "q": f"interval {3 * n} months", "y": f"interval {n} years"}[freq])
    joined = df.withColumn("_p", F.date_trunc(PERIODS[freq], "date") + step).join(ends, "_p")
    return joined.withColumn("date", F.col("_to")).drop("_to", "_p")


def shifted_days(df: DataFrame, cal: DataFrame, n: int, column: str = "date", out: str = "shifted", inclusive: bool = False) -> DataFrame:
    """df with the trade day n after (before, if negative) its date; inclusive: a trade day counts as the first itself."""
    days = cal.select(F.col("date").alias("_d"), "is_td", "seq")
    target = cal.where("is_td").select(F.col("seq").alias("_seq"), F.col("date").alias(out))
    step = n - (1 if n > 0 else -1) if inclusive and n else n
    # seq counts trade days up to the date, so from a day without trade n steps back end one earlier
    move = F.when(F.col("is_td"), F.lit(step)).otherwise(F.lit(n if n > 0 else n + 1))
    joined = df.join(days, F.col(column) == F.col("_d"), "left").withColumn("_seq", F.col("seq") + move)
    return joined.join(target, "_seq", "left").drop("_seq", "_d", "is_td", "seq")


def period_flags(cal: DataFrame) -> DataFrame:
    """Trade days with whether each is the first and the last of its week, month, quarter and year."""
    days, w = cal.where("is_td").select("date", "seq"), Window.orderBy("date")
    out = days
    for k, p in PERIODS.items():
        own = F.date_trunc(p, "date")
        out = out.withColumn(f"first_{k}", F.coalesce(own != F.date_trunc(p, F.lag("date").over(w)), F.lit(True))).withColumn(f"last_{k}", F.coalesce(own != F.date_trunc(p, F.lead("date").over(w)), F.lit(True)))
    return out


def days_between(df: DataFrame, cal: DataFrame, start: str, end: str, out: str = "days") -> DataFrame:
    """Trade days in (start, end]."""
    a, b = (cal.select(F.col("date").alias(f"_d{i}"), F.col("seq").alias(f"_s{i}")) for i in "ab")
    joined = df.join(a, F.col(start) == F.col("_da"), "left").join(b, F.col(end) == F.col("_db"), "left")
    return joined.withColumn(out, F.col("_sb") - F.col("_sa")).drop("_da", "_sa", "_db", "_sb")


def trading_time(ts: Column) -> Column:
    """After 9:25 and before 15:00 (the day is tested by the calendar)."""
    t = F.date_format(ts, "HH:mm:ss")
    return (t > "09:25:00") & (t < "15:00:00")


def intraday(days: DataFrame, minutes: int) -> DataFrame:
    """Stamps every so many minutes in (9:30, 11:30] and (13:00, 15:00] of each trade day."""
    day = F.col("date").cast("timestamp_ntz")
    at = lambda h, m: day + F.make_dt_interval(F.lit(0), F.lit(h), F.lit(m), F.lit(0))
    step = F.expr(f"interval {minutes} minutes")
    stamps = F.concat(F.sequence(at(9, 30) + step, at(11, 30), step), F.sequence(at(13, 0) + step, at(15, 0), step))
    return days.select("date", F.explode(stamps).alias("ts"))


def expiry_days(cal: DataFrame, week: int = 4, weekday: str = "WED") -> DataFrame:
    """The n-th such weekday of every month, on the next trade day if there is no trade."""
    months = cal.select(F.trunc("date", "month").alias("month")).distinct()
    day = F.date_add(F.next_day(F.date_sub("month", 1), weekday), 7 * (week - 1))
    return months.select("month", day.alias("nominal")).join(cal.select(F.col("date").alias("nominal"), F.col("next_td").alias("expiry")), "nominal")


def compounded(df: DataFrame, value: str, by: list[str], freq: str) -> DataFrame:
    """Returns compounded by week, month, quarter or year, labelled by the last date."""
    p = F.date_trunc(PERIODS[freq], "date").alias("_p")
    return df.where(F.col(value).isNotNull()).groupBy(*by, p).agg(F.max("date").alias("date"), (F.product(1 + F.col(value)) - 1).alias(value)).drop("_p")


def every_nth(df: DataFrame, cal: DataFrame, by: list[str], n: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over every n trade days, counted from the data's first."""
    seq = df.join(F.broadcast(cal.select("date", "seq")), "date")
    first = seq.agg(F.min("seq").alias("_first"))
    bucket = F.floor((F.col("seq") - F.col("_first")) / n).alias("bucket")
    return seq.crossJoin(F.broadcast(first)).groupBy(*by, bucket).agg(F.max("date").alias("date"), *(c.alias(k) for k, c in aggregates.items())).drop("bucket")


def resampled(df: DataFrame, by: list[str], freq: str, aggregates: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by, F.date_trunc(PERIODS[freq], "date").alias("_p")).agg(F.max("date").alias("date"), *(c.alias(k) for k, c in aggregates.items())).drop("_p")


def shifted_values(df: DataFrame, n: int, value: str, out: str) -> DataFrame:
    """The value n rows of the global date list before, per id; dates an id lacks count as well."""
    dates = df.select("date").distinct().withColumn("_seq", F.row_number().over(Window.orderBy("date")))
    known = df.join(dates, "date")
    old = known.select("id", (F.col("_seq") + n).alias("_seq"), F.col(value).alias(out))
    return known.join(old, ["id", "_seq"], "left").drop("_seq")


def filled_forward(dates: DataFrame, ids: DataFrame, df: DataFrame, values: list[str]) -> DataFrame:
    """Each date and id with the id's last row at or before the date."""
    return as_of(dates.select("date").distinct().crossJoin(ids.select("id").distinct()), df, "id", "date", values)
