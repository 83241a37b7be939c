"""More registered queries: stores, listings, funds, options' histories, calendars, regressions and timing."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import codes, dates, industries
from panelspark.functions import maths as mx
from panelspark.operators import align, calendar, filters, funds, listing, pit, portfolio, regress, rolling, timing
from panelspark.plans import universe
from panelspark.queries import CAL, KEYS, KNOWN, MEMBERS, METRICS, ORDER_CAL, PANEL, PRIOR, SERIES, SIGNALS, STATEMENTS, YEARS_BACK, as_of_keys, cal, order_cal, order_years, panel, query, read, rounded, series, signals, statements, weights
from panelspark.sources import clients
from panelspark.sources import store as stores

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
EVENTS = ["click", "error", "purchase", "signup", "view"]


def a_store(spark: SparkSession) -> stores.PanelStore:
    """A store of its own in the folder for checkpoints."""
    return stores.PanelStore(spark, f"{align.shared_folder(spark)}/store-{uuid.uuid4().hex}")


# --- scans ----------------------------------------------------------------------------------------------------------


@query(f"WITH {PANEL} SELECT date, lpad(CAST(id * 7919 % 1000000 AS VARCHAR), 6, '0') AS code, f3 FROM panel WHERE regexp_matches(lpad(CAST(id * 7919 % 1000000 AS VARCHAR), 6, '0'), '^[603]') AND f3 IS NOT NULL")
def s2_load_a_shares(spark, d):
    p = panel(spark, d).withColumn("code", codes.trade_code(F.col("id") * 7919 % 1000000))
    return align.matching(p, like={"code": "^[603]"}, fields=["date", "code", "f3"]).where("f3 is not null")


@query(f"WITH {PANEL} SELECT date, id, a.f1, b.f2 FROM (SELECT date, id, f1 FROM panel WHERE f3 IS NOT NULL) a FULL JOIN (SELECT date, id, f2 FROM panel WHERE f2 > 30) b USING (date, id)")
def s4_load_several(spark, d):
    st, p = a_store(spark), panel(spark, d)
    st.save("prices", p.where("f3 is not null").select("date", "id", "f1"))
    st.save("amounts", p.where("f2 > 30").select("date", "id", "f2"))
    return align.merged([st.load("prices"), st.load("amounts")])


@query(f"WITH {SERIES}, a AS (SELECT series AS name, value, CAST(date + 2 AS TIMESTAMP) + (CASE WHEN day(date) % 2 = 0 THEN 10 ELSE 16 END) * INTERVAL 1 HOUR AS ann FROM series) SELECT s.series AS name, s.date, ROUND(a.value, 6) AS value FROM series s ASOF LEFT JOIN a ON s.series = a.name AND CAST(s.date AS TIMESTAMP) + INTERVAL 15 HOUR >= a.ann")
def s6_macro_as_of_time(spark, d):
    s = series(spark, d).withColumnRenamed("series", "name")
    hour = F.when(F.day("date") % 2 == 0, 10).otherwise(16)
    macro = s.withColumn("ann_dt", F.date_add("date", 2).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour))
    return rounded(align.announced_by(s, macro, "15:00"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE regexp_matches(c_name, '[3-5]$')")
def s7_raw_rows_by_expression(spark, d):
    return align.matching(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), like={"name": "[3-5]$"})


@query(f"WITH {KEYS}, r AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, substr(max(o_orderpriority), 3) AS p FROM orders GROUP BY 1, 2) SELECT k.date, k.id, CAST(p = 'HIGH' AS TINYINT) AS \"HIGH\", CAST(p = 'URGENT' AS TINYINT) AS \"URGENT\" FROM keys k ASOF JOIN r ON k.id = r.id AND k.date >= r.date")
def s8_dummies_as_of(spark, d):
    r = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("date")).agg(F.substring(F.max("o_orderpriority"), 3, 20).alias("p"))
    return align.codes_as_of(as_of_keys(spark, d), r, "p", ["URGENT", "HIGH"])


@query(f"WITH {PANEL} SELECT date, id, f3 FROM panel WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND id IN (3, 5, 7, 14, 20, 33) AND f3 IS NOT NULL")
def s9_store_selection(spark, d):
    st = a_store(spark)
    st.save("panel", panel(spark, d))
    return st.load("panel", ["f3"], ("1996-01-01", "1998-12-31"), [3, 5, 7, 14, 20, 33], drop_empty=True)


@query(f"WITH {PANEL} SELECT date, id, f1 FROM panel WHERE id BETWEEN 20 AND 60")
def s10_key_range(spark, d):
    st = a_store(spark)
    st.save("panel", panel(spark, d))
    return align.matching(st.load("panel", ["f1"]), between={"id": (20, 60)})


@query(f"WITH {PANEL} SELECT date, id, f1, f2 FROM panel WHERE date >= DATE '1999-06-01'")
def s11_date_range(spark, d):
    st = a_store(spark)
    st.save("panel", panel(spark, d))
    return st.load("panel", ["f1", "f2"], ("1999-06-01", None))


@query(f"WITH {SERIES} SELECT date, " + ", ".join(f"ROUND(max(CASE WHEN series = '{e}' THEN value END), 6) AS {e}" for e in EVENTS[:3]) + f" FROM series WHERE series IN {tuple(EVENTS[:3])} GROUP BY date")
def s14_macro_side_by_side(spark, d):
    return rounded(align.wide(align.matching(series(spark, d), {"series": EVENTS[:3]}), "date", "series", "value", EVENTS[:3]))


@query("SELECT o_orderkey, o_custkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5, 6, 7, 8, 9) AND CAST(o_orderdate AS DATE) <= DATE '1998-12-31' AND o_orderkey < 900000000")
def s16_table_rows(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"))
    return align.matching(o, {"id": list(range(1, 10))}, {"date": (None, F.lit("1998-12-31").cast("date"))}).where("o_orderkey < 900000000")


@query(f"WITH {PANEL} SELECT date, industry AS id, ROUND(pow(sum(f2) / 1000 * sqrt(252e0) * 0.01e0, 2), 6) AS value FROM panel GROUP BY 1, 2")
def s18_risk_model_specific(spark, d):
    x = panel(spark, d).groupBy("date", "industry").agg((F.sum("f2") / 1000).alias("x")).groupBy("date").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("industry", "x")))).alias("specific"))
    none = F.lit(None).cast("string")
    rows = x.select("date", F.lit("all").alias("universe"), none.alias("exposures"), none.alias("returns"), none.alias("covariance"), "specific", none.alias("specific_returns"))
    return rounded(stores.risk_model(rows, "all")["specific"])


@query(f"WITH {STATEMENTS}, rev AS (SELECT *, lead(ann_dt) OVER (PARTITION BY id, period ORDER BY ann_dt) AS until FROM raw) SELECT r.id, r.period, r.ann_dt, CASE WHEN quarter(r.period) = 1 THEN r.value ELSE r.value - b.value END AS value FROM raw r LEFT JOIN rev b ON b.id = r.id AND b.period = last_day(r.period - INTERVAL 3 MONTH) AND b.ann_dt <= r.ann_dt AND (b.until IS NULL OR b.until > r.ann_dt)")
def s23_single_quarter(spark, d):
    return pit.single_quarter(statements(spark, d))


# --- sinks and catalog ----------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2")
def k3_keep_last(spark, d):
    o = read(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate")
    return stores.last_of(o, ["date", "id"], F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query("WITH k AS (SELECT * FROM (VALUES ('HOUSEHOLD', 3), ('BUILDING', 7)) t(c_mktsegment, code)), f AS (SELECT c_mktsegment, 7 + row_number() OVER (ORDER BY c_mktsegment) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM k))) SELECT c_custkey AS id, c_mktsegment, CAST(code AS BIGINT) AS code FROM customer LEFT JOIN (SELECT * FROM k UNION ALL SELECT * FROM f) USING (c_mktsegment)")
def k4_label_codes(spark, d):
    known = spark.createDataFrame([("HOUSEHOLD", 3), ("BUILDING", 7)], "c_mktsegment string, code long")
    rows, _ = stores.with_labels(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), known, "c_mktsegment")
    return rows


@query(f"WITH {PANEL}, old AS (SELECT date, id, f2 FROM panel WHERE f3 IS NOT NULL), new AS (SELECT date, id, f2 + 1 AS f2 FROM panel WHERE f2 > 40) SELECT * FROM new UNION ALL SELECT o.* FROM old o ANTI JOIN new n USING (date, id)")
def k6_upsert_by_key(spark, d):
    st, p = a_store(spark), panel(spark, d)
    st.save("a", p.where("f3 is not null").select("date", "id", "f2"))
    st.save("a", p.where("f2 > 40").select("date", "id", (F.col("f2") + 1).alias("f2")), "update")
    return st.load("a")


@query(f"WITH {PANEL} SELECT date, id, CASE WHEN date < DATE '1998-01-01' THEN f2 ELSE f2 * 2 END AS f2 FROM panel")
def k7_append_dates(spark, d):
    p = panel(spark, d).select("date", "id", "f2")
    return stores.PanelStore.merged(p.where("date < '1998-01-01'"), p.where("date >= '1997-06-01'").withColumn("f2", F.col("f2") * 2), "append")


@query(f"WITH {PANEL} SELECT date, id, f2, f3 FROM panel")
def k8_csv_round_trip(spark, d):
    st, p = a_store(spark), panel(spark, d).select("date", "id", "f2", "f3")
    stores.write_csv_dates(p, f"{st.root}-csv")
    return stores.read_csv_folders(spark, f"{st.root}-csv", "id long, f2 double, f3 double")


@query("SELECT DISTINCT o_custkey AS id, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal >= 0")
def k10_insert_missing(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", "c_acctbal")
    new = read(spark, d, "orders").select(F.col("o_custkey").alias("id")).join(c, "id").drop("c_acctbal")
    return stores.insert_missing(new, c.where("c_acctbal < 0"), ["id"])


@query(f"WITH {PANEL} SELECT 'first' AS name, min(date) AS first, max(date) AS last, 'f1,f2' AS columns, 'first_1' AS free FROM panel UNION ALL SELECT 'third', min(date), max(date), 'f3', 'third_1' FROM panel WHERE f3 IS NOT NULL")
def k12_catalog(spark, d):
    st, p = a_store(spark), panel(spark, d)
    st.save("first", p.select("date", "id", "f1", "f2"))
    st.save("second", p.where("f3 is not null").select("date", "id", "f3"))
    st.rename("second", "third")
    rows = [(n, *st.date_range(n), ",".join(st.columns(n)), st.free_name(n)) for n in st.names()]
    return spark.createDataFrame(rows, "name string, first date, last date, columns string, free string")


# --- filters --------------------------------------------------------------------------------------------------------


@query(f"WITH {PANEL} SELECT date, id, f1 FROM panel WHERE f2 > 40 AND f3 IS NOT NULL UNION ALL SELECT date, id, f1 FROM panel WHERE f2 < 5 AND NOT (f2 > 40 AND f3 IS NOT NULL)")
def f2_load_by_formula(spark, d):
    p = panel(spark, d)
    sets = [p.where(test).select("date", "id", F.lit(name).alias("index_id")) for name, test in (("BIG", "f2 > 40"), ("GAPS", "f3 is null"), ("SMALL", "f2 < 5"))]
    return universe.resolved(p.select("date", "id", "f1"), "(BIG - GAPS) + SMALL", universe.named(align.stacked_rows(sets)))


@query(f"WITH {PANEL} SELECT date, id FROM panel WHERE f2 < 5")
def f3_special_treatment(spark, d):
    return listing.flagged(panel(spark, d).withColumn("st", (F.col("f2") < 5).cast("int")), "st")


@query(f"WITH {PANEL}, a AS (SELECT date, id, date_diff('day', min(date) OVER (PARTITION BY id), date) AS age FROM panel), g AS (SELECT * FROM (SELECT DISTINCT date FROM panel), (SELECT DISTINCT id FROM panel)), h AS (SELECT g.date, g.id, a.age FROM g ASOF JOIN a ON g.id = a.id AND g.date >= a.date) SELECT date, id FROM h ANTI JOIN (SELECT date, id FROM panel WHERE f2 < 5) s USING (date, id) WHERE age > 365")
def f4_listed_shares(spark, d):
    p = panel(spark, d)
    age = p.withColumn("age", F.datediff("date", F.min("date").over(Window.partitionBy("id")))).select("date", "id", "age")
    return listing.listed_shares(age, 365, p.select("date"), p.where("f2 < 5").select("date", "id"), history=True)


FUNDS = "funds AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.OF' AS code, 'Fund ' || (p_partkey // 3) || substr('ABC', CAST(p_partkey % 3 AS INT) + 1, 1) AS name, p_brand AS company, p_retailprice AS size FROM part)"


def fund_table(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    name = F.concat(F.lit("Fund "), F.expr("cast(p_partkey div 3 as string)"), F.expr("substring('ABC', cast(p_partkey % 3 as int) + 1, 1)"))
    return p.select(F.concat(F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".OF")).alias("code"), name.alias("name"), F.col("p_brand").alias("company"), F.col("p_retailprice").alias("size"))


@query(f"WITH {FUNDS} SELECT code, name, company, size FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(name, '[ABCHRO]+$', '') ORDER BY size DESC NULLS LAST, code) AS n FROM funds WHERE size >= 905 AND contains(name, '1')) WHERE n = 1")
def f5_fund_info(spark, d):
    return funds.fund_info(fund_table(spark, d), between={"size": (905, None)}, contains={"name": "1"}, one_class=True)


@query(f"WITH {MEMBERS}, dd AS (SELECT last_day(CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-01-01', INTERVAL 1 MONTH)) AS DATE)) AS date) SELECT DISTINCT date, o_orderkey % 50 AS fund, id AS person FROM dd JOIN members ON entry_dt <= date AND (removal_dt IS NULL OR removal_dt >= date)")
def f7_managers(spark, d):
    return funds.managers_on(month_ends(spark), manager_terms(spark, d))


def month_ends(spark: SparkSession) -> DataFrame:
    return spark.sql("select explode(sequence(date'1995-01-31', date'1996-01-31', interval 1 month)) as date")


def manager_terms(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("person"), "o_orderkey", F.col("o_orderdate").cast("date").alias("entry_dt"))
    left = F.when(F.col("o_orderkey") % 4 != 0, F.date_add("entry_dt", (F.col("o_orderkey") % 90).cast("int")))
    return o.select("person", (F.col("o_orderkey") % 50).alias("fund"), "entry_dt", left.alias("removal_dt"))


@query(f"WITH {PANEL} SELECT date, id, industry FROM panel WHERE industry IN ('PROMO', 'SMALL')")
def f9_industry_members(spark, d):
    return listing.industry_members(panel(spark, d), ["PROMO", "SMALL"])


@query(f"WITH {PANEL} SELECT date, id, industry FROM panel WHERE industry IN ('LARGE', 'MEDIUM', 'SMALL')")
def f10_members_of_dummies(spark, d):
    names = ["LARGE", "MEDIUM", "SMALL"]
    return listing.members_of_dummies(align.one_hot(panel(spark, d), "industry", names).drop("industry"), names)


# --- joins ----------------------------------------------------------------------------------------------------------


@query(f"WITH {PANEL}, a AS (SELECT date, id FROM panel WHERE f3 IS NOT NULL), b AS (SELECT date, id FROM panel WHERE f2 > 30) SELECT 'union' AS axis, * FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def j2_axes(spark, d):
    p = panel(spark, d)
    frames = [p.where("f3 is not null"), p.where("f2 > 30")]
    named = lambda name, df: df.select(F.lit(name).alias("axis"), "date", "id")
    return named("union", align.key_union(frames)).unionByName(named("intersection", align.key_intersection(frames)))


CONTRACTS = """contracts AS (SELECT p_partkey AS code, 'T' || (p_partkey // 2) AS trading_code, p_name AS name, p_brand AS exchange_code, p_type AS underlying_symbol, CAST(DATE '1995-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE) AS list_date, CAST(DATE '1996-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS DATE) AS last_trade_date FROM part),
 changes AS (SELECT l_partkey AS code, CAST(l_shipdate AS DATE) AS adj_date, max(l_orderkey) AS k FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2), dd AS (SELECT CAST(unnest(generate_series(DATE '1995-02-15', DATE '1999-02-15', INTERVAL 1 MONTH)) AS DATE) AS date),
 alive AS (SELECT date, c.* FROM dd JOIN contracts c ON date BETWEEN list_date AND last_trade_date),
 names AS (SELECT a.date, a.code, a.underlying_symbol, coalesce('N' || b.k, 'X' || f.k, a.trading_code) AS trading_code FROM (alive a ASOF LEFT JOIN changes b ON a.code = b.code AND a.date >= b.adj_date) ASOF LEFT JOIN changes f ON a.code = f.code AND a.date < f.adj_date)"""


def contract_names(spark: SparkSession, d: str, **chosen) -> DataFrame:
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 1500).cast("int"))
    c = read(spark, d, "part").select(F.col("p_partkey").alias("code"), F.concat(F.lit("T"), F.expr("cast(p_partkey div 2 as string)")).alias("trading_code"), F.col("p_name").alias("name"), F.col("p_brand").alias("exchange_code"), F.col("p_type").alias("underlying_symbol"), start.alias("list_date"), F.date_add(start, 365).alias("last_trade_date"))
    k = read(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("code"), F.col("l_shipdate").cast("date").alias("adj_date")).agg(F.max("l_orderkey").cast("string").alias("k"))
    changes = k.select("code", "adj_date", F.concat(F.lit("X"), "k").alias("ex_trading_code"), F.lit(None).cast("string").alias("ex_name"), F.concat(F.lit("N"), "k").alias("new_trading_code"), F.lit(None).cast("string").alias("new_name"))
    days = spark.sql("select explode(sequence(date'1995-02-15', date'1999-02-15', interval 1 month)) as date")
    return listing.contracts_on(days, c, changes, **chosen)


@query(f"WITH {CONTRACTS} SELECT * FROM names")
def j6_option_history(spark, d):
    return contract_names(spark, d).select("date", "code", "underlying_symbol", "trading_code")


@query(f"WITH {CONTRACTS} SELECT date, code, trading_code FROM names WHERE underlying_symbol = 'PROMO' AND trading_code IN (SELECT min(trading_code) FROM names WHERE underlying_symbol = 'PROMO')")
def j7_contract_of_code(spark, d):
    names = contract_names(spark, d, underlying="PROMO")
    first = names.agg(F.min("trading_code").alias("t")).first()["t"]
    return listing.contract_of(names.select("date", "code", "trading_code"), first)


HOLDINGS = "h AS (SELECT l_suppkey AS id, last_day(CAST(date_trunc('quarter', l_shipdate) AS DATE) + INTERVAL 2 MONTH) AS report_date, CAST(l_partkey AS VARCHAR) AS ticker, sum(l_quantity) AS ratio FROM lineitem GROUP BY 1, 2, 3)"


def holdings(spark: SparkSession, d: str, parts: int | None = None) -> DataFrame:
    """What suppliers sold in each quarter; parts: dealt by ticker over so many tasks before it is summed."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), dates.period_end(F.col("l_shipdate").cast("date")).alias("report_date"), F.col("l_partkey").cast("string").alias("ticker"), "l_quantity")
    if parts:
        rows = rows.repartition(parts, "ticker")
    return rows.groupBy("id", "report_date", "ticker").agg(F.sum("l_quantity").alias("ratio"))


@query(f"WITH {HOLDINGS} SELECT h.*, s_name AS name FROM h JOIN supplier ON s_suppkey = id WHERE ticker = '7' AND ratio >= 10")
def j8_funds_by_stock(spark, d):
    f = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    return funds.holders(holdings(spark, d), f, "7", 10)


@query(f"WITH {HOLDINGS} SELECT id, report_date, " + ", ".join(f"coalesce(sum(CASE WHEN p_type = '{t}' THEN ratio END), 0) AS \"{t}\"" for t in TYPES) + " FROM h JOIN part ON CAST(p_partkey AS VARCHAR) = ticker GROUP BY 1, 2")
def j10_industry_allocation(spark, d):
    industry = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("ticker"), F.col("p_type").alias("industry"))
    parts = align.parts_of(read(spark, d, "lineitem"))
    return funds.industry_allocation(holdings(spark, d, parts), industry, TYPES, parts)


@query(f"WITH {PANEL} SELECT last_day(date) AS report_date, id, f2 FROM panel WHERE month(date) IN (3, 6, 9, 12)")
def j11_quarter_end_reports(spark, d):
    return funds.at_quarter_ends(panel(spark, d).select(F.last_day("date").alias("report_date"), "id", "f2"))


@query(f"""WITH {MEMBERS}, dd AS (SELECT last_day(CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-01-01', INTERVAL 1 MONTH)) AS DATE)) AS date), m AS (SELECT DISTINCT date, o_orderkey % 50 AS fund, id AS person FROM dd JOIN members ON entry_dt <= date AND (removal_dt IS NULL OR removal_dt >= date))
 SELECT date, person, ROUND(avg((fund - month(date)) / 100e0), 8) AS ret, count(*) AS funds FROM m GROUP BY 1, 2""")
def j11_manager_returns(spark, d):
    days = month_ends(spark)
    returns = days.crossJoin(spark.range(50).withColumnRenamed("id", "fund")).withColumn("ret", (F.col("fund") - F.month("date")) / 100)
    return rounded(funds.manager_returns(days, manager_terms(spark, d), returns), digits=8)


@query(f"WITH {PANEL} SELECT date, industry AS underlying_symbol, id AS code FROM (SELECT *, row_number() OVER (PARTITION BY date, industry ORDER BY f2 DESC, id) AS n FROM panel) WHERE n = 1")
def j13_dominant_contract(spark, d):
    return listing.dominant(panel(spark, d).select("date", F.col("industry").alias("underlying_symbol"), F.col("id").alias("code"), F.col("f2").alias("volume")))


@query("SELECT s_suppkey AS id, n_name || CASE WHEN s_nationkey % 2 = 1 THEN 'Ⅱ' ELSE '' END AS label, n_regionkey AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def j14_names_beside(spark, d):
    label = F.concat("n_name", F.when(F.col("s_nationkey") % 2 == 1, "Ⅱ").otherwise(""))
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), label.alias("label"))
    return codes.translated(s, "label", read(spark, d, "nation"), "n_name", "n_regionkey", "region")


@query("SELECT c_custkey AS id, c_mktsegment AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'C01' WHEN 'MACHINERY' THEN 'C02' END AS code FROM customer")
def v4_translated(spark, d):
    rules = spark.createDataFrame([("BUILDING", "C01"), ("MACHINERYⅡ", "C02")], "name string, code string")
    return codes.translated(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name")), "name", rules.withColumnRenamed("name", "n").withColumnRenamed("code", "c"), "n", "c", "code")


@query(f"WITH {PANEL} SELECT date, id, f1, NULL AS f3 FROM panel UNION ALL SELECT date, id, NULL, f3 FROM panel WHERE f3 IS NOT NULL")
def j15_append_rows(spark, d):
    p = panel(spark, d)
    return align.stacked_rows([p.select("date", "id", "f1"), p.where("f3 is not null").select("date", "id", "f3")])


@query(f"WITH {PANEL} SELECT date, id, f2, mv FROM panel")
def r4_fields(spark, d):
    return align.matching(panel(spark, d), fields=["date", "id", "f2", "mv"])


# --- point in time --------------------------------------------------------------------------------------------------

QUARTER_BACK = "last_day(l.period - INTERVAL 3 MONTH)"


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND(n.value + y.value - b.value, 4) AS value FROM latest l {PRIOR.format('n', QUARTER_BACK)} {PRIOR.format('y', 'make_date(year(l.period - INTERVAL 3 MONTH) - 1, 12, 31)')} {PRIOR.format('b', 'last_day(l.period - INTERVAL 15 MONTH)')}")
def p4_last_nperiod_ttm(spark, d):
    return rounded(pit.run("last_nperiod_ttm", as_of_keys(spark, d), statements(spark, d)), digits=4)


@query(f"WITH {KNOWN} SELECT l.date, l.id, n.value FROM latest l {PRIOR.format('n', 'make_date(year(l.period) - 1, 6, 30)')}")
def p5_last_nyear_quarter(spark, d):
    return pit.run("last_nyear", as_of_keys(spark, d), statements(spark, d), quarter=2)


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND((l.value - n.value) / nullif(abs(n.value), 0), 6) AS value FROM latest l {PRIOR.format('n', QUARTER_BACK)}")
def p9_quarterly_growth(spark, d):
    return rounded(pit.run("inc_rate_hb", as_of_keys(spark, d), statements(spark, d)))


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND((coalesce(n.value, l.value) + l.value) / 2, 4) AS value FROM latest l {PRIOR.format('n', YEARS_BACK.format(1))}")
def p10_yearly_mean(spark, d):
    return rounded(pit.run("ttm_avg", as_of_keys(spark, d), statements(spark, d)), digits=4)


@query("WITH r AS (SELECT o_custkey AS id, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1) SELECT id, a, b, period FROM (SELECT id, a, b, last_day(CAST(unnest(generate_series(CAST(date_trunc('quarter', a) AS DATE), b, INTERVAL 3 MONTH)) AS DATE) + INTERVAL 2 MONTH) AS period FROM r) WHERE period BETWEEN a AND b")
def p19_report_periods(spark, d):
    r = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return dates.report_periods(r, "a", "b")


@query(f"WITH {PANEL} SELECT date, id, ROUND(f1 / nullif(f3, 0), 4) AS ratio FROM panel")
def m3_ratio(spark, d):
    return rounded(panel(spark, d).select("date", "id", mx.ratio(F.col("f1"), F.col("f3")).alias("ratio")), digits=4)


# --- rolling, calendar, resampling ----------------------------------------------------------------------------------


@query(f"WITH {SERIES} SELECT series, date, ROUND(CASE WHEN count(*) OVER w = 5 THEN min(value) OVER w END, 6) AS low, ROUND(CASE WHEN count(*) OVER w = 5 THEN max(value) OVER w END, 6) AS high, ROUND(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 6) AS mean FROM series WINDOW w AS (PARTITION BY series ORDER BY date ROWS 4 PRECEDING)")
def t2_rolling_several(spark, d):
    r = rolling.rolling_all("value", 5, {"low": F.min, "high": F.max, "mean": F.avg}, "series")
    return rounded(series(spark, d).select("series", "date", r.alias("r")).select("series", "date", "r.*"))


def overfitting_sql(splits: list[tuple[int, list[int]]], blocks: int = 8) -> str:
    rows = ", ".join(f"({i}, {c})" for i, c in splits)
    return f"""WITH {SERIES}, dn AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM series)), ct AS (SELECT date, CAST(floor(n * {blocks} / (SELECT count(*) FROM dn)) AS INTEGER) AS block FROM dn),
 st AS (SELECT series AS id, block, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM series JOIN ct USING (date) GROUP BY 1, 2), sp(split, inside) AS (VALUES {rows}), su AS (SELECT split, list_contains(inside, block) AS side, id, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM st, sp GROUP BY 1, 2, 3),
 sh AS (SELECT split, side, id, ROUND(s / n / nullif(sqrt(greatest((q - s * s / n) / nullif(n - 1, 0), 0)), 0), 9) AS sharpe FROM su), wd AS (SELECT split, id, max(CASE WHEN side THEN sharpe END) AS i, max(CASE WHEN NOT side THEN sharpe END) AS o FROM sh GROUP BY 1, 2),
 rk AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY o NULLS FIRST) AS r, count(*) OVER (PARTITION BY split) AS c, row_number() OVER (PARTITION BY split ORDER BY i DESC NULLS LAST, id) AS f FROM wd) SELECT ROUND(avg(CASE WHEN 1 - r / c > 0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS pbo, count(*) AS splits FROM rk WHERE f = 1"""


@query(overfitting_sql([(i, list(c)) for i, c in enumerate(combinations(range(8), 4))]))
def t10_overfitting(spark, d):
    return rounded(rolling.overfitting(series(spark, d).withColumnRenamed("series", "id")))


@query(overfitting_sql(rolling.drawn_splits(8, 40, 7)))
def t11_overfitting_drawn(spark, d):
    return rounded(rolling.overfitting(series(spark, d).withColumnRenamed("series", "id"), draws=40, seed=7))


@query(f"WITH {ORDER_CAL}, st AS (SELECT unnest([interval 600 minute, interval 630 minute, interval 660 minute, interval 690 minute, interval 810 minute, interval 840 minute, interval 870 minute, interval 900 minute]) AS s) SELECT date, CAST(date AS TIMESTAMP) + s AS ts FROM td, st")
def c3_intraday_stamps(spark, d):
    return calendar.intraday(calendar.trade_days(order_cal(spark, d), *order_years(spark, d)), 30)


@query(f"WITH {CAL} SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, td.date AS trade_day FROM orders ASOF LEFT JOIN td ON CAST(o_orderdate AS DATE) >= td.date")
def c6_latest_trade_day(spark, d):
    return calendar.latest_trade_days(read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")), cal(spark))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') > '09:25:00' AND strftime(ts, '%H:%M:%S') < '15:00:00' AS within FROM events")
def c7_trading_time(spark, d):
    return read(spark, d, "events").select("event_id", calendar.trading_time(F.col("ts")).alias("within"))


@query(f"WITH {CAL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS b FROM orders) SELECT o_orderkey, a, b, count(td.date) AS days FROM o LEFT JOIN td ON td.date > a AND td.date <= b GROUP BY ALL")
def c8_days_between(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a")).withColumn("b", F.date_add("a", (F.col("o_orderkey") % 30).cast("int")))
    return calendar.days_between(o, cal(spark), "a", "b")


def _ends_sql(freq: str, end: str) -> str:
    return f"SELECT DISTINCT '{freq}' AS freq, {end} AS nominal FROM days"


ENDS = " UNION ALL ".join(_ends_sql(f, e) for f, e in (("w", "CAST(date_trunc('week', date) + INTERVAL 4 DAY AS DATE)"), ("m", "last_day(date)"), ("q", "last_day(CAST(date_trunc('quarter', date) AS DATE) + INTERVAL 2 MONTH)"), ("y", "make_date(year(date), 12, 31)")))


@query(f"WITH {ORDER_CAL}, n AS ({ENDS}) SELECT freq, nominal, td.date FROM (SELECT * FROM n WHERE nominal <= (SELECT max(date) FROM days)) n ASOF JOIN td ON n.nominal >= td.date")
def c9_period_ends(spark, d):
    c = order_cal(spark, d)
    return align.stacked_rows([calendar.period_ends(c, f).select(F.lit(f).alias("freq"), "nominal", "date") for f in "wmqy"])


@query(f"WITH {CAL} SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders SEMI JOIN td ON td.date = CAST(o_orderdate AS DATE) WHERE o_orderdate >= DATE '1996-02-01' AND o_orderdate < DATE '1997-05-02'")
def c11_dates_in_range(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return calendar.in_range(o, cal(spark), "1996-02-01", "1997-05-01")


@query(f"WITH {CAL}, sq AS (SELECT d.date, (SELECT count(*) FROM td WHERE td.date <= d.date) AS seq FROM days d), o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_custkey % 3 AS g FROM orders), s AS (SELECT o.*, seq, min(seq) OVER () AS f FROM o JOIN sq USING (date)) SELECT g, max(date) AS date, count(*) AS n FROM s GROUP BY g, (seq - f) // 5")
def rs2_every_five_days(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"), (F.col("o_custkey") % 3).alias("g"))
    return calendar.every_nth(o, cal(spark), ["g"], 5, {"n": F.count("*")})


@query(f"WITH {CAL}, m AS (SELECT date_trunc('month', date) AS p, max(date) AS d FROM td GROUP BY 1) SELECT o_orderkey, m.d AS date FROM orders JOIN m ON m.p = date_trunc('month', o_orderdate) + INTERVAL 2 MONTH")
def rs5_moved_months(spark, d):
    return calendar.moved_dates(read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date")), cal(spark), 2, "m")


@query(f"WITH {PANEL}, g AS (SELECT * FROM (SELECT DISTINCT date FROM panel), (SELECT DISTINCT id FROM panel)) SELECT g.date, g.id, p.f2 FROM g ASOF LEFT JOIN panel p ON g.id = p.id AND g.date >= p.date")
def rs6_filled_forward(spark, d):
    p = panel(spark, d).select("date", "id", "f2")
    return calendar.filled_forward(p.select("date"), p.select("id"), p, ["f2"])


@query(f"""WITH {CAL}, {PANEL}, p AS (SELECT date, industry AS id, sum(f2) AS q FROM panel GROUP BY 1, 2), r AS (SELECT date, id, ROUND(coalesce(q / lag(q) OVER (PARTITION BY id ORDER BY date) - 1, 0), 6) AS ret FROM p), f AS (SELECT id, min(date) AS d FROM r GROUP BY 1),
 b AS (SELECT (SELECT max(td.date) FROM td WHERE td.date < f.d) AS date, id, 0e0 AS ret FROM f), x AS (SELECT * FROM r UNION ALL SELECT * FROM b) SELECT date, id, ROUND(product(1 + ret) OVER (PARTITION BY id ORDER BY date), 6) AS nav FROM x""")
def rs7_nav_from_one(spark, d):
    _, returns = weights(spark, d)
    return rounded(rolling.with_base(returns, cal(spark)).select("date", "id", rolling.nav("ret").alias("nav")))


# --- scalars --------------------------------------------------------------------------------------------------------

NAMES = ", ".join(f"('{c}', '{n}')" for c, n in industries.CS.items())


@query(f"WITH n(code, name) AS (VALUES {NAMES}), c AS (SELECT p_partkey AS id, 'CI0050' || lpad(CAST(p_partkey % 32 AS VARCHAR), 2, '0') AS code FROM part) SELECT c.id, c.code, n.name, n.code AS back FROM c LEFT JOIN n USING (code)")
def v5_industry_names(spark, d):
    c = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("CI0050"), F.lpad((F.col("p_partkey") % 32).cast("string"), 2, "0")).alias("code"))
    c = c.withColumn("name", codes.parsed(F.col("code"), industries.CS))
    return c.withColumn("back", codes.parsed(F.col("name"), industries.reverse_of(industries.CS)))


@query("SELECT s_suppkey AS id, CAST(trunc(s_acctbal / 7 * 10000) AS BIGINT) AS coded FROM supplier")
def v8_fixed_point(spark, d):
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), codes.fixed_point(F.col("s_acctbal") / 7).alias("coded"))


# --- filters, regressions, portfolios, timing -----------------------------------------------------------------------


#: A festival a year: the day of January or February with most orders, the first of such days.
FESTIVALS = "f AS (SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day FROM (SELECT arg_min(d, (-n, d)) AS d FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders WHERE month(o_orderdate) <= 2 GROUP BY 1) GROUP BY year(d)))"


def festivals(spark: SparkSession, d: str) -> DataFrame:
    days = read(spark, d, "orders").where(F.month("o_orderdate") <= 2).groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("n"))
    best = days.groupBy(F.year("d").alias("year")).agg(F.min_by("d", F.struct(-F.col("n"), "d")).alias("d"))
    return best.select("year", F.month("d").alias("month"), F.dayofmonth("d").alias("day"))


@query(f"""WITH {FESTIVALS}, x AS (SELECT year, CAST(unnest(generate_series(make_date(year, month, day) - INTERVAL 10 DAY, make_date(year, month, day) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM f), s AS (SELECT year, month(d) AS month, count(*) / 18e0 AS share FROM x GROUP BY 1, 2),
 g AS (SELECT year, m AS month FROM f, (SELECT unnest([1, 2, 3]) AS m)), j AS (SELECT g.year, g.month, coalesce(share, 0) AS share FROM g LEFT JOIN s USING (year, month)) SELECT CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, ROUND(share - avg(share) OVER (PARTITION BY month), 8) AS value FROM j""")
def z7_festival_regressor(spark, d):
    return rounded(filters.festival_regressor(festivals(spark, d)), digits=8)


@query(f"WITH {PANEL}, s AS (SELECT industry AS series, date, sum(f2) AS value FROM panel GROUP BY 1, 2) SELECT series, date, value FROM s WHERE month(date) > 2 UNION ALL SELECT series, last_day(make_date(year(date), 2, 1)), avg(value) FROM s WHERE month(date) <= 2 GROUP BY series, year(date)")
def z8_merged_spring(spark, d):
    s = panel(spark, d).groupBy(F.col("industry").alias("series"), "date").agg(F.sum("f2").alias("value"))
    return filters.merged_spring(s)


@query(None)
def z5_changing_coefficients(spark, d):
    s = panel(spark, d).groupBy(F.col("industry").alias("series"), "date").agg(F.sum("f2").alias("y"), F.count("f3").cast("double").alias("x"))
    return rounded(filters.changing_coefficients(s, "y", ["x"], 3), digits=4)


@query(None)
def z9_rolling_adjustment(spark, d):
    s = panel(spark, d).groupBy(F.col("industry").alias("series"), "date").agg(F.sum("f2").alias("value"))
    return rounded(filters.rolling_adjusted(s, 36, 12))


@query(f"WITH {PANEL}, x AS (SELECT f1 / 1e4 AS y, f2 / 10 AS a, f3 * 10 AS b FROM panel WHERE f3 IS NOT NULL) SELECT ROUND(sum((a - b) * (y - b)) / sum((a - b) * (a - b)), 5) AS a, ROUND(1 - sum((a - b) * (y - b)) / sum((a - b) * (a - b)), 5) AS b FROM x")
def o1_restricted_regression(spark, d):
    x = panel(spark, d).select((F.col("f1") / 1e4).alias("y"), (F.col("f2") / 10).alias("a"), (F.col("f3") * 10).alias("b"))
    found = regress.restricted(x, "y", ["a", "b"], equal=([[1.0, 1.0]], [1.0]))
    return spark.createDataFrame([tuple(round(float(v), 5) for v in found)], "a double, b double")


@query(f"WITH {PANEL}, a AS (SELECT date, industry AS id, avg(f3) AS r FROM panel GROUP BY 1, 2) SELECT date, id, ROUND((r - avg(r) OVER (PARTITION BY date)) / 8, 4) AS active FROM a WHERE date < DATE '1998-01-01'")
def o2_optimised(spark, d):
    a = panel(spark, d).where("date < '1998-01-01'").groupBy("date", F.col("industry").alias("id")).agg(F.avg("f3").alias("r"))
    wide = [F.lit(v).alias(c) for c, v in (("wb", 0.0), ("w0", 0.0), ("wmin", -9.0), ("wmax", 9.0))]
    cov = a.select("date", F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(4.0).alias("cov"))
    return rounded(regress.optimised(a.select("*", *wide), cov, risk=1.0), digits=4).select("date", "id", "active")


@query(f"WITH {PANEL}, p AS (SELECT date, id, f2 / sum(f2) OVER (PARTITION BY date) AS weight, mv / sum(mv) OVER (PARTITION BY date) AS w0, f3 IS NULL AS no_buy, f2 > 40 AS no_sell FROM panel), b AS (SELECT *, (no_buy AND weight > w0) OR (no_sell AND weight < w0) AS blocked FROM p) SELECT date, id, ROUND(CASE WHEN blocked THEN w0 ELSE weight * (1 - sum(CASE WHEN blocked THEN w0 ELSE 0 END) OVER w) / nullif(sum(CASE WHEN blocked THEN 0 ELSE weight END) OVER w, 0) END, 8) AS w1 FROM b WINDOW w AS (PARTITION BY date)")
def b1_adjusted_trade(spark, d):
    p = align.shares(align.shares(panel(spark, d).withColumn("weight", F.col("f2")).withColumn("w0", F.col("mv")), "weight", "date"), "w0", "date")
    p = p.select("date", "id", "weight", "w0", F.col("f3").isNull().alias("no_buy"), (F.col("f2") > 40).alias("no_sell"))
    return rounded(portfolio.adjusted(p), digits=8).select("date", "id", "w1")


@query(f"WITH {PANEL} SELECT date, id, ROUND(coalesce(lead(f1) OVER w / nullif(f1, 0) - 1, 0), 6) AS ret FROM panel WINDOW w AS (PARTITION BY id ORDER BY date)")
def b4_open_returns(spark, d):
    return rounded(portfolio.price_returns(panel(spark, d).select("date", "id", F.col("f1").alias("open")), "open", at_open=True).select("date", "id", "ret"))


@query(f"WITH {SIGNALS} SELECT name, bool_and(signal IN (-1, 0, 1)) AS is_discrete FROM signals GROUP BY 1 UNION ALL SELECT 'raw ' || name, bool_and(benchmark IN (-1, 0, 1)) FROM signals GROUP BY 1")
def g1_discrete(spark, d):
    s = signals(spark, d)
    raw = s.select(F.concat(F.lit("raw "), "name").alias("name"), "date", F.col("benchmark").alias("signal"), "benchmark")
    return timing.discrete(s.unionByName(raw))


@query(f"WITH {SIGNALS} SELECT name, date, CAST(sign(benchmark) AS DOUBLE) AS signal FROM signals")
def g2_signs(spark, d):
    return timing.signs(signals(spark, d).withColumn("signal", F.col("benchmark"))).select("name", "date", "signal")


@query(f"WITH {SIGNALS} SELECT name, date, ROUND(signal * benchmark - abs(signal - coalesce(lag(signal) OVER (PARTITION BY name ORDER BY date), 0)) * 0.001e0, 8) AS value FROM signals")
def g4_long_short(spark, d):
    return rounded(timing.performance(signals(spark, d), 0.001).select("name", "date", "value"), digits=8)


@query(f"WITH {SIGNALS} SELECT name, signal, ROUND(avg(benchmark), 8) AS mean_return, ROUND(stddev_samp(benchmark), 8) AS std_return, count(benchmark) AS n FROM signals GROUP BY 1, 2")
def g6_by_score(spark, d):
    return rounded(timing.by_score(signals(spark, d)), digits=8)


@query(f"WITH {PANEL}, s AS (SELECT date AS snapshot, id, f2 FROM panel WHERE month(date) IN (2, 3, 8) AND f2 > 60), dd AS (SELECT DISTINCT date FROM panel), m AS (SELECT dd.date, x.snapshot FROM dd ASOF JOIN (SELECT DISTINCT snapshot FROM s) x ON dd.date >= x.snapshot) SELECT m.date, s.snapshot, s.id, s.f2 FROM m JOIN s USING (snapshot) WHERE m.date - s.snapshot < 62")
def s20_latest_weights(spark, d):
    p = panel(spark, d)
    snaps = p.where(F.month("date").isin(2, 3, 8) & (F.col("f2") > 60)).select(F.col("date").alias("snapshot"), "id", "f2")
    return clients.latest_within(p.select("date"), snaps, 62).select("date", "snapshot", "id", "f2")


@query(f"WITH {PANEL}, x AS (SELECT date, industry AS id, 'a' AS f, avg(f2) / 10 AS x FROM panel GROUP BY 1, 2 UNION ALL SELECT date, industry, 'b', count(f3) / 10e0 FROM panel GROUP BY 1, 2), c(f, g, v) AS (VALUES ('a', 'a', 0.0437e0), ('a', 'b', 0.0113e0), ('b', 'a', 0.0113e0), ('b', 'b', 0.0911e0)) SELECT p.date, p.id AS id1, q.id AS id2, ROUND(sum(p.x * c.v * q.x) + CASE WHEN p.id = q.id THEN 0.0225e0 ELSE 0 END, 3) AS cov FROM x p JOIN c ON c.f = p.f JOIN x q ON q.date = p.date AND q.f = c.g GROUP BY p.date, p.id, q.id")
def o2_factor_covariance(spark, d):
    g = panel(spark, d).groupBy("date", F.col("industry").alias("id")).agg((F.avg("f2") / 10).alias("a"), (F.count("f3") / 10).alias("b"))
    cov = spark.createDataFrame([("a", "a", 0.0437), ("a", "b", 0.0113), ("b", "a", 0.0113), ("b", "b", 0.0911)], "factor1 string, factor2 string, cov double")
    factors = g.select("date").distinct().crossJoin(F.broadcast(cov))  # four rows a date
    return rounded(regress.factor_covariance(g.unpivot(["date", "id"], ["a", "b"], "factor", "x"), factors, g.select("date", "id", F.lit(0.15).alias("sd"))), digits=3)


@query(f"WITH {SIGNALS}, v AS (SELECT name AS series, CAST(year(date) AS INTEGER) AS year, date, signal * benchmark AS value, benchmark FROM signals WHERE day(date) > 5), n AS (SELECT *, product(1 + value) OVER (PARTITION BY series, year ORDER BY date) AS nav FROM v), p AS (SELECT *, max(nav) OVER (PARTITION BY series, year ORDER BY date) AS peak FROM n) SELECT series, year, {METRICS} FROM p GROUP BY series, year")
def b5_yearly_report(spark, d):
    s = signals(spark, d).where(F.day("date") > 5).select(F.col("name").alias("series"), "date", (F.col("signal") * F.col("benchmark")).alias("value"), "benchmark")
    return rounded(portfolio.report(s, yearly=True))


TURNS = f"""{SIGNALS}, x AS (SELECT name AS series, date, signal AS turning, lag(signal) OVER (PARTITION BY name ORDER BY date) AS p FROM signals), a AS (SELECT series, date, turning, lag(date) OVER (PARTITION BY series ORDER BY date) AS before FROM x WHERE turning <> 0 AND turning IS DISTINCT FROM p),
 b AS (SELECT series, CAST(date + 2 AS DATE) AS day, CASE WHEN day(date) % 4 = 0 THEN -turning ELSE turning END AS turn FROM a), n AS (SELECT a.*, b.day, b.turn FROM a ASOF LEFT JOIN b ON a.series = b.series AND a.date >= b.day),
 m AS (SELECT n.*, c.day AS day2, c.turn AS turn2 FROM n ASOF LEFT JOIN b c ON n.series = c.series AND CAST(n.date + 2 AS DATE) >= c.day)"""


@query(f"WITH {TURNS}, o AS (SELECT *, CASE WHEN turning = turn AND date - day <= 4 AND (before IS NULL OR before < day) THEN day WHEN turning <> turn AND turning = turn2 THEN day2 END AS other FROM m) SELECT series, date, turning, other, turn IS NOT NULL AS known, CAST(date - other AS INTEGER) AS lead, other IS NOT NULL AS matched FROM o")
def z11_matched_turns(spark, d):
    s = signals(spark, d).withColumn("_p", F.lag("signal").over(Window.partitionBy("name").orderBy("date")))
    a = s.where("signal <> 0 and (_p is null or _p <> signal)").select(F.col("name").alias("series"), "date", F.col("signal").alias("turning"))
    b = a.withColumn("turning", F.when(F.day("date") % 4 == 0, -F.col("turning")).otherwise(F.col("turning"))).withColumn("date", F.date_add("date", 2))
    return filters.matched_turns(a, b, 4, 2)


@query(None)
def g9_unit_root(spark, d):
    return rounded(regress.adf(series(spark, d), 1), digits=5)


@query(None)
def t8_forward_regression(spark, d):
    return chosen(spark, d, True)


@query(None)
def t9_backward_regression(spark, d):
    return chosen(spark, d, False)


def chosen(spark: SparkSession, d: str, forward: bool) -> DataFrame:
    p = panel(spark, d).withColumn("noise", (F.xxhash64("id", "date") % 1000) / 1000)
    found = regress.selected(p, "f1", ["f2", "f3", "mv", "noise"], forward=forward)
    return spark.createDataFrame(list(enumerate(found)), "nth int, name string")
