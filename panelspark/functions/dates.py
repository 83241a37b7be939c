"""Report periods and date casts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_int(d: Column) -> Column:
    return F.to_date(d.cast("string"), "yyyyMMdd")


def to_int(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def from_excel(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def from_matlab(serial: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (serial - 719529).cast("int"))


def period_end(d: Column) -> Column:
    """Last day of the quarter that holds d."""
    return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))


def shifted(period: Column, years: int = 0, quarters: int = 0, quarter: int | None = None) -> Column:
    """A report period so many years and quarters back; with `quarter` that year's quarter end."""
    if quarter is not None:
        return F.last_day(F.make_date(F.year(period) - years, F.lit(3 * quarter), F.lit(1)))
    return F.last_day(F.add_months(F.trunc(period, "month"), -12 * years - 3 * quarters))


def min_report_date(d: Column) -> Column:
    """The period that must have been reported by d: until April last year's third quarter, until August the year, then the half, then the third quarter."""
    y, m = F.year(d), F.month(d)
    date = lambda year, month, day: F.make_date(year, F.lit(month), F.lit(day))
    return F.when(m <= 4, date(y - 1, 9, 30)).when(m <= 8, date(y - 1, 12, 31)).when(m <= 10, date(y, 6, 30)).otherwise(date(y, 9, 30))


def default_announcement(period: Column, adjusted: bool = False) -> Column:
    """Last day on which a period may be announced: end of April, August, October, next April; adjusted a year later."""
    months = F.when(F.quarter(period) == 1, 1).when(F.quarter(period) == 2, 2).when(F.quarter(period) == 3, 1).otherwise(4)
    return F.last_day(F.add_months(F.trunc(period, "month"), months + (12 if adjusted else 0)))


def report_periods(df: DataFrame, start: str, end: str, out: str = "period") -> DataFrame:
    """df with one row for every quarter end from start to end."""
    first = F.add_months(F.trunc(F.col(start), "quarter"), 2)
    return df.withColumn(out, F.explode(F.sequence(first, F.add_months(F.trunc(F.col(end), "quarter"), 2), F.expr("interval 3 months")))).withColumn(out, F.last_day(out)).where(F.col(out).between(F.col(start), F.col(end)))
