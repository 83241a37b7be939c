"""Funds: basic data with share classes, holdings, allocations, net asset values and managers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.align import matching, members_on

#: Letters that end the names of a fund's share classes.
CLASSES = "[ABCHRO]+$"


def fund_info(funds: DataFrame, equal: dict | None = None, between: dict | None = None, contains: dict | None = None, codes: list[str] | None = None, one_class: bool = False) -> DataFrame:
    """Funds by optional predicates; funds: code, name, size and others.

    codes: full codes, or trading codes (those of the first one's length count). one_class: of the classes of one fund, by
    name without their letters, the largest stays, the first by code of equal ones.
    """
    rows = matching(funds, equal, between, contains)
    if codes:
        rows = rows.where((F.substring("code", 1, 6) if len(codes[0]) == 6 else F.col("code")).isin(codes))
    if one_class:
        best = Window.partitionBy(F.regexp_replace("name", CLASSES, "")).orderBy(F.col("size").desc_nulls_last(), "code")
        rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return rows


def holders(holdings: DataFrame, funds: DataFrame, ticker: str, least: float = 0.0) -> DataFrame:
    """Funds that hold a stock at a ratio of at least so much, with their data, the largest holders first."""
    held = holdings.where((F.col("ticker") == ticker) & (F.col("ratio") >= least))
    return held.join(funds, held["id"] == funds["code"]).drop(funds["code"]).orderBy(F.col("ratio").desc(), "id")


def industry_allocation(holdings: DataFrame, industries: DataFrame, names: list[str], parts: int | None = None) -> DataFrame:
    """Weight of each industry in each fund's report, a column each; 0 where a report holds none of it.

    holdings: id, report_date, ticker, ratio; industries: ticker, industry. parts: reports are dealt over so many tasks before
    they are summed (None: as the session deals). The join keeps the parts of holdings that are dealt by ticker.
    """
    joined = holdings.join(industries, "ticker").select("id", "report_date", "industry", "ratio")
    if parts:
        joined = joined.repartition(parts, "id", "report_date")
    sums = [F.sum(F.when(F.col("industry") == n, F.col("ratio"))).alias(n) for n in names]
    return joined.groupBy("id", "report_date").agg(*sums).fillna(0.0, names)


def at_quarter_ends(reports: DataFrame, date: str = "report_date") -> DataFrame:
    """Rows dated at the end of a quarter."""
    return reports.where(F.col(date) == F.last_day(F.add_months(F.trunc(date, "quarter"), 2)))


def fund_values(values: DataFrame, ids: list | None, dates: tuple, fields: list[str]) -> DataFrame:
    """Net asset values and the like: some ids (None: all), a pair of dates (None: open), some fields."""
    return matching(values, {"id": ids} if ids is not None else None, {"date": dates}, fields=["date", "id", *fields])


def managers_on(dates: DataFrame, terms: DataFrame) -> DataFrame:
    """Who manages each fund on each date; terms: person, fund, entry_dt, removal_dt (null: still)."""
    return members_on(dates, terms).select("date", "fund", "person").distinct()


def manager_returns(dates: DataFrame, terms: DataFrame, returns: DataFrame, weight: Column | None = None) -> DataFrame:
    """Mean return of the funds that each person manages on each date; returns: date, fund, ret."""
    w = F.lit(1.0) if weight is None else weight
    rows = managers_on(dates, terms).join(returns, ["date", "fund"]).where("ret is not null")
    return rows.groupBy("date", "person").agg((F.sum(F.col("ret") * w) / F.sum(w)).alias("ret"), F.count("*").alias("funds"))
