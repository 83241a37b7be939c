"""Security codes and dimension lookups as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.align import numbered


def trade_code(code: Column) -> Column:
    """Six digits of a code given as a number, a short text or a suffixed code."""
    return F.lpad(F.regexp_extract(code.cast("string"), "([0-9]+)", 1), 6, "0")


def wind_code(code: Column) -> Column:
    """Trade code with its exchange: those that begin with 6 are .SH, all others .SZ."""
    c = trade_code(code)
    return F.concat(c, F.when(c.startswith("6"), ".SH").otherwise(".SZ"))


def uqer_code(code: Column) -> Column:
    c = trade_code(code)
    return F.concat(c, F.when(c.startswith("6"), ".XSHG").otherwise(".XSHE"))


def tsl_code(code: Column) -> Column:
    c = trade_code(code)
    return F.concat(F.when(c.startswith("6"), "SH").otherwise("SZ"), c)


def int_code(code: Column) -> Column:
    return trade_code(code).cast("int")


def drop_suffix(code: Column) -> Column:
    return F.substring_index(code, ".", 1)


def is_a_share(code: Column) -> Column:
    return code.rlike("^[603]")


def parsed(code: Column, names: dict[str, str]) -> Column:
    """The name of a code, null where it is unknown; a dictionary the other way round gives codes of names."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.try_element_at(table, code)


def translated(df: DataFrame, column: str, dimension: DataFrame, source: str, target: str, out: str) -> DataFrame:
    """df with `out`, the dimension's target for column; unknown values stay null. Roman numeral two is optional in names."""
    plain = lambda c: F.regexp_replace(c, "Ⅱ", "")
    exact = dimension.select(F.col(source).alias("_exact"), F.col(target).alias("_first")).dropDuplicates(["_exact"])
    loose = dimension.groupBy(plain(F.col(source)).alias("_plain")).agg(F.min(target).alias("_second"))
    joined = df.join(exact, F.col(column) == F.col("_exact"), "left").join(loose, plain(F.col(column)) == F.col("_plain"), "left")
    return joined.withColumn(out, F.coalesce("_first", "_second")).drop("_exact", "_plain", "_first", "_second")


def new_keys(known: DataFrame, seen: DataFrame, name: str, key: str) -> DataFrame:
    """known plus the unseen names, numbered on after the largest key in the order of names."""
    fresh = seen.select(name).where(F.col(name).isNotNull()).distinct().join(known.select(name), name, "left_anti")
    top = known.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    after = numbered(fresh, [name], "_n").crossJoin(F.broadcast(top))  # top is one row
    return known.select(name, key).unionByName(after.select(name, (F.col("_top") + F.col("_n") + 1).cast("long").alias(key)))


def id_ranges(df: DataFrame, key: str, order: str) -> DataFrame:
    """First and last position of each run of equal keys along `order`, positions counted from 0."""
    rows = numbered(df.select(key, order), [order], "_pos")
    own = F.row_number().over(Window.partitionBy(key).orderBy("_pos"))
    return rows.withColumn("_island", F.col("_pos") - own).groupBy(key, "_island").agg(F.min("_pos").cast("int").alias("start"), F.max("_pos").cast("int").alias("end")).drop("_island")


def fixed_point(x: Column, digits: int = 4) -> Column:
    """Whole number of 10^-digits, cut off towards zero; null stays null."""
    scaled = x * 10**digits
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("long")
