"""Which securities there are on a date: listing age, special treatment, industry members, option contracts and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.align import KEYS, as_of, label_of


def flagged(panel: DataFrame, flag: str) -> DataFrame:
    """Keys at which a 0/1 column is 1."""
    return panel.where(F.col(flag) == 1).select(*KEYS)


def listed_shares(age: DataFrame, days: int = 0, dates: DataFrame | None = None, special: DataFrame | None = None, history: bool = False) -> DataFrame:
    """Keys listed for more than so many days, without those of `special`.

    age: date, id, age. history: an id's last known age counts on later dates too, so that delisted ones stay.
    """
    rows = age.where("age is not null")
    if dates is not None:
        wanted = dates.select("date").distinct()
        rows = as_of(wanted.crossJoin(rows.select("id").distinct()), rows, "id", "date", ["age"]) if history else rows.join(wanted, "date", "left_semi")
    rows = rows.where(F.col("age") > days).select(*KEYS)
    return rows.join(special, KEYS, "left_anti") if special is not None else rows


def industry_members(industry: DataFrame, names: str | list[str], label: str = "industry") -> DataFrame:
    """Keys with one of the industries, and which."""
    return industry.where(F.col(label).isin([names] if isinstance(names, str) else list(names))).select(*KEYS, label)


def members_of_dummies(dummies: DataFrame, names: list[str]) -> DataFrame:
    """Keys with the name of the 0/1 column that is 1; rows of zeros alone are left out."""
    return label_of(dummies, names, "industry").where("industry is not null").select(*KEYS, "industry")


def contracts_on(days: DataFrame, contracts: DataFrame, changes: DataFrame, exchange: str | None = None, underlying: str | None = None) -> DataFrame:
    """Contracts alive on each day under the code and name that they had then.

    contracts: code, trading_code, name, exchange_code, underlying_symbol, list_date, last_trade_date; changes: code,
    adj_date, ex_trading_code, ex_name, new_trading_code, new_name. The last change up to the day gives the new code, else
    the first one after it the former code, else the contract's own.
    """
    chosen = contracts
    if exchange is not None:
        chosen = chosen.where(F.col("exchange_code") == exchange)
    if underlying is not None:
        chosen = chosen.where(F.col("underlying_symbol") == underlying)
    # a day and a contract meet by the months in which the contract lives
    months = F.explode(F.sequence(F.trunc("list_date", "month"), F.trunc("last_trade_date", "month"), F.expr("interval 1 month")))
    alive = days.select("date").distinct().withColumn("_month", F.trunc("date", "month")).join(chosen.withColumn("_month", months), "_month").drop("_month")
    alive = alive.where(F.col("date").between(F.col("list_date"), F.col("last_trade_date")))
    after = as_of(alive, changes.withColumn("_change", F.date_sub("adj_date", 1)), "code", "date", ["ex_trading_code", "ex_name"], right_order="_change", forward=True)
    both = as_of(after, changes, "code", "date", ["new_trading_code", "new_name"], right_order="adj_date")
    names = {"trading_code": F.coalesce("new_trading_code", "ex_trading_code", "trading_code"), "name": F.coalesce("new_name", "ex_name", "name")}
    return both.withColumns(names).drop("new_trading_code", "new_name", "ex_trading_code", "ex_name")


def contract_of(listed: DataFrame, trading_code: str) -> DataFrame:
    """The one contract of each day that has a trading code; several on a day are an error."""
    found = listed.where(F.col("trading_code") == trading_code)
    one = found.groupBy("date").agg(F.count("*").alias("_n"), F.first(F.struct(*listed.columns)).alias("_r"))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit(f"several contracts have the trading code {trading_code}")).cast(dict(one.dtypes)["_r"]))
    return one.select(checked.alias("_r")).select("_r.*")


def daily_contracts(daily: DataFrame, dates: tuple | None = None, adjusted: bool | None = None, **equal) -> DataFrame:
    """Contracts' daily rows by optional predicates: a pair of dates, whether adjusted, and equal columns."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    tests += [F.col("is_adjusted") == int(adjusted)] if adjusted is not None else []
    tests += [F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date"))] if dates is not None else []
    for test in tests:
        daily = daily.where(test)
    return daily


def dominant(contracts: DataFrame, volume: str = "volume", by: str = "underlying_symbol") -> DataFrame:
    """The contract of the largest volume for each date and underlying, the first by code of equal ones."""
    best = F.min_by("code", F.struct((-F.col(volume)).alias("v"), F.col("code").alias("c")))
    return contracts.groupBy("date", by).agg(best.alias("code"))
