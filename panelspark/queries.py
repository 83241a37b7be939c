"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions import codes, dates
from panelspark.functions import maths as mx
from panelspark.operators import align, calendar, cross, filters, options, pit, portfolio, rolling, timing
from panelspark.plans import universe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """df with doubles rounded, so that engines that add in another order agree."""
    chosen = names or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, digits) for c in chosen})


# --- fixtures -------------------------------------------------------------------------------------------------------


def panel(spark: SparkSession, d: str) -> DataFrame:
    """date (month), id (part), f1, f2, f3 (null for each seventh part), industry, mv."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    lines = read(spark, d, "lineitem")
    # dealt by id first: few lines share a month and a part, and the join below finds them where they are
    rows = lines.select(F.date_trunc("month", "l_shipdate").cast("date").alias("date"), F.col("l_partkey").alias("id"), "l_extendedprice", "l_quantity", "l_discount").repartition(align.parts_of(lines), "id")
    rows = rows.groupBy("date", "id").agg(money("l_extendedprice").alias("f1"), F.sum("l_quantity").alias("f2"), money("l_discount").alias("f3"))
    part = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("industry"), F.col("p_retailprice").alias("mv"))
    return rows.join(part, "id").withColumn("f3", F.when(F.col("id") % 7 != 0, F.col("f3"))).select("date", "id", "f1", "f2", "f3", "industry", "mv")


PANEL = """panel AS (SELECT date, id, f1, f2, CASE WHEN id % 7 <> 0 THEN f3 END AS f3, p_type AS industry, p_retailprice AS mv FROM (
 SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_partkey AS id, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS f1,
 SUM(l_quantity) AS f2, CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS f3 FROM lineitem GROUP BY 1, 2) JOIN part ON id = p_partkey)"""


def statements(spark: SparkSession, d: str) -> DataFrame:
    """id (customer), period (quarter end), ann_dt, value: cumulative order value in cents, announced 40 to 69 days later,
    each fifth customer's restated 100 days after that."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("od"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    q = o.groupBy("id", dates.period_end(F.col("od")).alias("period")).agg(F.sum("v").alias("v"))
    w = Window.partitionBy("id", F.year("period")).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    base = q.withColumn("value", F.sum("v").over(w).cast("double")).withColumn("ann_dt", F.date_add("period", (40 + F.col("id") % 30).cast("int")))
    again = base.where("id % 5 = 0").withColumn("value", F.col("value") + 100).withColumn("ann_dt", F.date_add("ann_dt", 100))
    return base.unionByName(again).select("id", "period", "ann_dt", "value")


STATEMENTS = """q AS (SELECT o_custkey AS id, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period,
 SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY 1, 2),
 b AS (SELECT id, period, CAST(SUM(v) OVER (PARTITION BY id, year(period) ORDER BY period) AS DOUBLE) AS value, CAST(period + CAST(40 + id % 30 AS INTEGER) AS DATE) AS ann_dt FROM q),
 raw AS (SELECT id, period, ann_dt, value FROM b UNION ALL SELECT id, period, ann_dt + 100, value + 100 FROM b WHERE id % 5 = 0)"""


def as_of_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each customer at the middle and the end of every year with orders."""
    o = read(spark, d, "orders")
    years = o.select(F.year("o_orderdate").alias("y")).distinct()
    days = years.select(F.explode(F.array(F.make_date("y", F.lit(6), F.lit(30)), F.make_date("y", F.lit(12), F.lit(31)))).alias("date"))
    return o.select(F.col("o_custkey").alias("id")).distinct().crossJoin(F.broadcast(days)).select("date", "id")  # two days a year


KEYS = """keys AS (SELECT * FROM (SELECT DISTINCT o_custkey AS id FROM orders), (SELECT DISTINCT unnest([make_date(y, 6, 30), make_date(y, 12, 31)]) AS date FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)))"""
KNOWN = f"""{STATEMENTS}, {KEYS},
 rev AS (SELECT *, lead(ann_dt) OVER (PARTITION BY id, period ORDER BY ann_dt) AS until FROM raw),
 known AS (SELECT k.date, k.id, r.period, r.ann_dt, r.value FROM keys k JOIN rev r ON r.id = k.id AND r.ann_dt <= k.date AND (r.until IS NULL OR r.until > k.date)),
 latest AS (SELECT k.date, k.id, l.period, l.value FROM keys k LEFT JOIN (SELECT date, id, unnest(max(struct_pack(a := ann_dt, period := period, value := value))) FROM known GROUP BY date, id) l USING (date, id))"""


def series(spark: SparkSession, d: str) -> DataFrame:
    """series (event type), date, value: mean value of each day's events, to the cent."""
    e = read(spark, d, "events").select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return e.where("v is not null").groupBy("series", "date").agg((F.sum("v") / (F.count("v") * 100.0)).alias("value"))


SERIES = """series AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, SUM(CAST(ROUND(value * 100) AS BIGINT)) / (COUNT(value) * 100e0) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def nations(spark: SparkSession, d: str) -> DataFrame:
    """Customers' balances by nation."""
    return read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Option quotes drawn from parts."""
    p = read(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 10).alias("s"), (F.col("p_retailprice") / 10 * (0.8 + (F.col("p_partkey") % 9) * 0.05)).alias("k"),
        F.lit(0.03).alias("r"), ((F.col("p_size") + 5) / 100.0).alias("t"), (0.1 + (F.col("p_partkey") % 7) * 0.05).alias("v"), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1).alias("cp"),
    )


QUOTES = """quotes AS (SELECT p_partkey AS id, p_retailprice / 10 AS s, p_retailprice / 10 * (0.8e0 + (p_partkey % 9) * 0.05e0) AS k, 0.03e0 AS r, (p_size + 5) / 100e0 AS t, 0.1e0 + (p_partkey % 7) * 0.05e0 AS v, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS cp FROM part)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    """name, date, signal (sign of the day's change), benchmark (next day's change in percent), by event type."""
    w = Window.partitionBy("series").orderBy("date")
    s = series(spark, d).withColumn("b", F.round((F.col("value") - F.lag("value").over(w)) / 1000, 8))
    return s.select(F.col("series").alias("name"), "date", F.signum(F.lag("b").over(w)).alias("signal"), F.col("b").alias("benchmark")).where("signal is not null")


SIGNALS = f"""{SERIES}, s1 AS (SELECT series, date, ROUND((value - lag(value) OVER (PARTITION BY series ORDER BY date)) / 1000, 8) AS b FROM series),
 signals AS (SELECT * FROM (SELECT series AS name, date, CAST(sign(lag(b) OVER (PARTITION BY series ORDER BY date)) AS DOUBLE) AS signal, b AS benchmark FROM s1) WHERE signal IS NOT NULL)"""


# --- cross-sections -------------------------------------------------------------------------------------------------

CLIP = "CASE WHEN f1 IS NOT NULL THEN least(greatest(f1, lo), hi) END"


@query(f"WITH {PANEL}, b AS (SELECT *, quantile_cont(f1, 0.1) OVER (PARTITION BY date) AS lo, quantile_cont(f1, 0.9) OVER (PARTITION BY date) AS hi FROM panel) SELECT date, id, ROUND({CLIP}, 6) AS f1_after_drop_outlier FROM b")
def x1_outliers_ratio(spark, d):
    return rounded(cross.outliers_by_ratio(panel(spark, d), "f1").select("date", "id", "f1_after_drop_outlier"))


@query(f"WITH {PANEL}, b AS (SELECT *, avg(f1) OVER w - 3 * stddev_samp(f1) OVER w AS lo, avg(f1) OVER w + 3 * stddev_samp(f1) OVER w AS hi FROM panel WINDOW w AS (PARTITION BY date)) SELECT date, id, ROUND(CASE WHEN f1 > lo AND f1 < hi THEN f1 END, 6) AS f1_after_drop_outlier FROM b")
def x2_outliers_deviation(spark, d):
    return rounded(cross.outliers_by_deviation(panel(spark, d), "f1", drop=True).select("date", "id", "f1_after_drop_outlier"))


@query(f"WITH {PANEL}, m AS (SELECT *, median(f1) OVER (PARTITION BY date) AS mid FROM panel), b AS (SELECT *, mid - 3 * median(abs(f1 - mid)) OVER (PARTITION BY date) AS lo, mid + 3 * median(abs(f1 - mid)) OVER (PARTITION BY date) AS hi FROM m) SELECT date, id, ROUND({CLIP}, 6) AS f1_after_drop_outlier FROM b")
def x3_outliers_mad(spark, d):
    return rounded(cross.outliers_by_mad(panel(spark, d), "f1").select("date", "id", "f1_after_drop_outlier"))


@query("""WITH c AS (SELECT c_nationkey AS nation, c_custkey AS id, c_acctbal AS x, median(c_acctbal) OVER (PARTITION BY c_nationkey) AS md, quantile_cont(c_acctbal, 0.25) OVER (PARTITION BY c_nationkey) AS q1, quantile_cont(c_acctbal, 0.75) OVER (PARTITION BY c_nationkey) AS q3 FROM customer),
 k AS (SELECT a.nation, median(((a.x - a.md) - (a.md - b.x)) / (a.x - b.x)) AS mc FROM c a JOIN c b ON a.nation = b.nation AND a.x > a.md AND b.x < b.md GROUP BY 1),
 b AS (SELECT c.*, q1 - 1.5 * exp((CASE WHEN mc >= 0 THEN -3.5 ELSE -4 END) * mc) * (q3 - q1) AS lo, q3 + 1.5 * exp((CASE WHEN mc >= 0 THEN 4 ELSE 3.5 END) * mc) * (q3 - q1) AS hi FROM c LEFT JOIN k USING (nation))
 SELECT nation, id, ROUND(CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END, 5) AS x_after_drop_outlier FROM b""")
def x4_outliers_box(spark, d):
    return rounded(cross.outliers_by_box(nations(spark, d), "x", "nation").select("nation", "id", "x_after_drop_outlier"), digits=5)


@query(f"""WITH {PANEL}, z AS (SELECT *, (f1 - avg(f1) OVER w) / nullif(stddev_samp(f1) OVER w, 0) AS z FROM panel WINDOW w AS (PARTITION BY date)), m AS (SELECT *, max(z) OVER (PARTITION BY date) AS hi, min(z) OVER (PARTITION BY date) AS lo FROM z),
 s AS (SELECT *, greatest(0, least(1, 0.5 / nullif(hi - 3, 0))) AS u, greatest(0, least(1, 0.5 / nullif(-lo - 3, 0))) AS n FROM m) SELECT date, id, ROUND(CASE WHEN z > 3 THEN 3 * (1 - u) + z * u WHEN z < -3 THEN -3 * (1 - n) + z * n ELSE z END, 6) AS f1_after_drop_outlier FROM s""")
def x5_outliers_squeeze(spark, d):
    return rounded(cross.outliers_by_squeeze(panel(spark, d), "f1").select("date", "id", "f1_after_drop_outlier"))


@query(f"""WITH {PANEL}, m AS (SELECT *, sum(f3 * mv) OVER w / nullif(sum(CASE WHEN f3 IS NOT NULL THEN mv END) OVER w, 0) AS mean, avg(f3) OVER w AS plain FROM panel WINDOW w AS (PARTITION BY date)),
 s AS (SELECT *, sum((f3 - plain) * (f3 - plain) * mv) OVER w / nullif(sum(CASE WHEN f3 IS NOT NULL THEN mv END) OVER w, 0) AS sq FROM m WINDOW w AS (PARTITION BY date)) SELECT date, id, ROUND(CASE WHEN sq = 0 THEN CASE WHEN f3 IS NOT NULL THEN 0 END ELSE (f3 - mean) / sqrt(sq) END, 6) AS f3_std FROM s""")
def x7_standard(spark, d):
    return rounded(cross.standardised(panel(spark, d), "f3", mean_weight="mv", std_weight="mv").select("date", "id", "f3_std"))


@query(f"""WITH {PANEL}, r AS (SELECT date, id, CASE WHEN f3 IS NOT NULL THEN dense_rank() OVER (PARTITION BY date ORDER BY f3 NULLS LAST) END AS rk FROM panel), p AS (SELECT *, 1e-6 + (rk - 1) * (1 - 2e-6) / nullif(max(rk) OVER (PARTITION BY date) - 1, 0) AS p FROM r),
 q AS (SELECT *, {mx.normal_quantile_sql("p")} AS q FROM p) SELECT date, id, ROUND((q - avg(q) OVER w) / nullif(stddev_pop(q) OVER w, 0), 6) AS f3_qt FROM q WINDOW w AS (PARTITION BY date)""")
def x8_standard_by_rank(spark, d):
    return rounded(cross.standardised_by_rank(panel(spark, d), "f3").select("date", "id", "f3_qt"))


@query(f"""WITH {PANEL}, g AS (SELECT date, sum(f2 * f2) a, sum(f2 * f3) b, sum(f3 * f3) c, sum(f2 * f1) u, sum(f3 * f1) v FROM panel WHERE f3 IS NOT NULL GROUP BY date)
 SELECT p.date, p.id, ROUND(f1 - ((c * u - b * v) / (a * c - b * b) * f2 + (a * v - b * u) / (a * c - b * b) * f3), 4) AS f1_resid FROM panel p LEFT JOIN g USING (date)""")
def x10_orthogonalise(spark, d):
    return rounded(cross.orthogonalised(panel(spark, d), "f1", ["f2", "f3"]).select("date", "id", "f1_resid"), digits=4)


@query(f"""WITH {PANEL}, p AS (SELECT *, ln(mv / 1e4) AS x, min(industry) OVER (PARTITION BY date) AS first FROM panel), t AS (SELECT *, f1 - CASE WHEN industry = first THEN 0 ELSE avg(f1) OVER (PARTITION BY date, industry) END AS ty, x - CASE WHEN industry = first THEN 0 ELSE avg(x) OVER (PARTITION BY date, industry) END AS tx FROM p)
 SELECT date, id, ROUND(ty - sum(tx * ty) OVER w / nullif(sum(tx * tx) OVER w, 0) * tx, 4) AS f1_neutral FROM t WINDOW w AS (PARTITION BY date)""")
def x11_neutralise(spark, d):
    return rounded(cross.neutralised(panel(spark, d), "f1", "mv", "industry").select("date", "id", "f1_neutral"), digits=4)


@query(None)
def x12_symmetric_orthogonal(spark, d):
    p = panel(spark, d).withColumns({f: F.col(f) / s for f, s in (("f1", 1e4), ("f2", 10), ("f3", 0.1))})
    return rounded(cross.symmetric_orthogonal(p, ["f1", "f2", "f3"]).select("date", "id", "f1_orth", "f2_orth", "f3_orth"))


@query(f"""WITH {PANEL}, m AS (SELECT *, avg(CASE WHEN f3 IS NOT NULL THEN f2 END) OVER w AS mx, avg(f3) OVER w AS my FROM panel WINDOW w AS (PARTITION BY date)), s AS (SELECT *, sum((f2 - mx) * (f3 - my)) OVER w AS sxy, sum(CASE WHEN f3 IS NOT NULL THEN (f2 - mx) * (f2 - mx) END) OVER w AS sxx FROM m WINDOW w AS (PARTITION BY date))
 SELECT date, id, ROUND(coalesce(f3, my + sxy / nullif(sxx, 0) * (f2 - mx)), 6) AS f3 FROM s""")
def x13_fill_by_regression(spark, d):
    return rounded(cross.filled_by_line(panel(spark, d), "f3", "f2").select("date", "id", "f3"))


@query(f"WITH {PANEL} SELECT date, id, ROUND(coalesce(f3, quantile_cont(f3, 0.4) OVER (PARTITION BY date, industry)), 6) AS f3 FROM panel")
def x14_fill_by_quantile(spark, d):
    return rounded(cross.filled_by_group(panel(spark, d), "f3", ["date", "industry"], 0.4).select("date", "id", "f3"))


@query(f"WITH {PANEL} SELECT date, id, ROUND((f1 * 0.2e0 + f2 * 0.3e0 + coalesce(f3 * 0.5e0, 0)) / (0.5e0 + CASE WHEN f3 IS NOT NULL THEN 0.5e0 ELSE 0 END), 6) AS combined FROM panel")
def x15_combine(spark, d):
    return rounded(cross.combined(panel(spark, d), ["f1", "f2", "f3"], [0.2, 0.3, 0.5]).select("date", "id", "combined"))


PAIRS = " UNION ALL ".join(f"SELECT date, '{a}' AS \"left\", '{b}' AS \"right\", {a} AS x, {b} AS y FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in [("f1", "f1"), ("f1", "f2"), ("f1", "f3"), ("f2", "f2"), ("f2", "f3"), ("f3", "f3")])


@query(f"""WITH {PANEL}, p AS ({PAIRS}), r AS (SELECT date, "left", "right", rank() OVER (PARTITION BY date, "left", "right" ORDER BY x) + (count(*) OVER (PARTITION BY date, "left", "right", x) - 1) / 2e0 AS x, rank() OVER (PARTITION BY date, "left", "right" ORDER BY y) + (count(*) OVER (PARTITION BY date, "left", "right", y) - 1) / 2e0 AS y FROM p) SELECT date, "left", "right", ROUND(corr(x, y), 6) AS corr FROM r GROUP BY ALL""")
def x16_rank_correlation(spark, d):
    return rounded(cross.correlations(panel(spark, d), ["f1", "f2", "f3"]))


@query(f"WITH {PANEL} SELECT date, industry, ROUND(sum(f3 * sqrt(mv)) / nullif(sum(CASE WHEN f3 IS NOT NULL THEN sqrt(mv) END), 0), 6) AS industry_return FROM panel GROUP BY 1, 2")
def x17_industry_return(spark, d):
    return rounded(cross.industry_return(panel(spark, d), "f3", "mv", "industry"))


# --- scans, filters, joins, sets ------------------------------------------------------------------------------------


@query(f"WITH {PANEL} SELECT date, id, f2 FROM panel WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' AND id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)")
def s1_load_factor(spark, d):
    return align.matching(panel(spark, d), {"id": [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]}, {"date": (F.lit("1995-01-01").cast("date"), F.lit("1995-12-31").cast("date"))}, fields=["date", "id", "f2"])


@query(f"WITH {PANEL} SELECT d.date, i.id, p.f1, p.f2 FROM (SELECT DISTINCT date FROM panel) d CROSS JOIN (SELECT p_partkey AS id FROM part) i LEFT JOIN panel p ON p.date = d.date AND p.id = i.id")
def s5_dense_grid(spark, d):
    p = panel(spark, d)
    ids = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return align.dense_grid(p, ids, [p.select("date", "id", "f1", "f2")])


@query("""WITH RECURSIVE t AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region), a AS (SELECT node, parent AS ancestor, 1 AS depth FROM t UNION ALL SELECT a.node, t.parent, a.depth + 1 FROM a JOIN t ON t.node = a.ancestor) SELECT node, ancestor, depth FROM a""")
def s15_tree_path(spark, d):
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent"))
    return align.ancestors(n.unionByName(r), "node", "parent")


@query("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 1000 AND contains(c_name, '1')")
def f6_optional_predicates(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), "c_name")
    return align.matching(c, {"segment": ["BUILDING", "MACHINERY"]}, {"balance": (1000, None)}, {"c_name": "1"}, ["id", "segment", "balance"])


ORDERED = "ordered AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS id, CAST(count(*) AS DOUBLE) AS f2, CAST(max(o_orderkey) AS DOUBLE) AS f3 FROM orders GROUP BY 1, 2)"


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """date (month), id (customer), f2 and f3: another panel, some of whose keys the first one has."""
    o = read(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("id"))
    return o.agg(F.count("*").cast("double").alias("f2"), F.max("o_orderkey").cast("double").alias("f3"))


@query(f"WITH {PANEL}, {ORDERED} SELECT date, id, a.f1, b.f2 FROM panel a FULL JOIN ordered b USING (date, id)")
def j3_merge_outer(spark, d):
    return align.merged([panel(spark, d).select("date", "id", "f1"), ordered(spark, d).select("date", "id", "f2")])


@query(f"WITH {PANEL}, {ORDERED} SELECT a.date, a.id, a.f1 FROM panel a SEMI JOIN ordered b USING (date, id)")
def j1_align_inner(spark, d):
    return align.aligned([panel(spark, d).select("date", "id", "f1"), ordered(spark, d)], "inner")[0]


@query(f"""WITH {STATEMENTS}, k AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders), day AS (SELECT id, ann_dt, unnest(max(struct_pack(period := period, value := value))) FROM raw GROUP BY id, ann_dt)
 SELECT k.o_orderkey, k.id, k.date, r.period, r.value FROM k ASOF LEFT JOIN day r ON k.id = r.id AND k.date >= r.ann_dt""")
def j4_as_of(spark, d):
    k = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"))
    day = statements(spark, d).groupBy("id", "ann_dt").agg(F.max(F.struct("period", "value")).alias("r")).select("id", "ann_dt", "r.*")
    return align.as_of(k, day, "id", "date", ["period", "value"], right_order="ann_dt")


MEMBERS = "members AS (SELECT o_orderkey, o_custkey AS id, CAST(o_orderdate AS DATE) AS entry_dt, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) END AS removal_dt FROM orders)"


@query(f"WITH {MEMBERS}, dd AS (SELECT last_day(CAST(unnest(generate_series(DATE '1995-01-01', DATE '1996-01-01', INTERVAL 1 MONTH)) AS DATE)) AS date) SELECT date, count(*) AS members, count(DISTINCT id) AS ids FROM dd JOIN members ON entry_dt <= date AND (removal_dt IS NULL OR removal_dt >= date) GROUP BY date")
def j5_interval_members(spark, d):
    m = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("entry_dt"))
    m = m.withColumn("removal_dt", F.when(F.col("o_orderkey") % 4 != 0, F.date_add("entry_dt", (F.col("o_orderkey") % 90).cast("int"))))
    days = spark.sql("select explode(sequence(date'1995-01-31', date'1996-01-31', interval 1 month)) as date")
    return align.members_on(days, m).groupBy("date").agg(F.count("*").alias("members"), F.countDistinct("id").alias("ids"))


@query(f"WITH {PANEL}, s AS (SELECT * FROM panel WHERE month(date) IN (3, 9) AND f2 > 60), dd AS (SELECT DISTINCT date FROM panel), m AS (SELECT dd.date, x.snapshot FROM dd ASOF JOIN (SELECT DISTINCT date AS snapshot FROM s) x ON dd.date >= x.snapshot) SELECT m.date, m.snapshot, s.id, s.f2 FROM m JOIN s ON s.date = m.snapshot")
def j12_snapshot_weights(spark, d):
    p = panel(spark, d)
    snaps = p.where(F.month("date").isin(3, 9) & (F.col("f2") > 60)).select(F.col("date").alias("snapshot"), "id", "f2")
    return align.snapshot_as_of(p.select("date"), snaps).select("date", "snapshot", "id", "f2")


@query(f"WITH {PANEL} SELECT date, id, ROUND(f2 / sum(f2) OVER (PARTITION BY date), 8) AS f2 FROM panel")
def j9_scaled_weights(spark, d):
    return rounded(align.shares(panel(spark, d).select("date", "id", "f2"), "f2", "date"), digits=8)


SEGMENTS = "m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, o_custkey AS id, c_mktsegment AS index_id, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey), keyed AS (SELECT DISTINCT index_id, date, id FROM m UNION SELECT DISTINCT o_orderpriority, date, id FROM m)"


@query(f"WITH {SEGMENTS} (SELECT date, id FROM keyed WHERE index_id = 'BUILDING' UNION SELECT date, id FROM keyed WHERE index_id = 'MACHINERY') EXCEPT SELECT a.date, a.id FROM keyed a SEMI JOIN (SELECT date, id FROM keyed WHERE index_id = '1-URGENT') b USING (date, id) WHERE a.index_id = 'BUILDING'")
def so2_universe_formula(spark, d):
    m = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.date_trunc("month", "o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("id"), "c_mktsegment", "o_orderpriority")
    keyed = m.select(F.col("c_mktsegment").alias("index_id"), "date", "id").unionByName(m.select(F.regexp_replace("o_orderpriority", "-", "_").alias("index_id"), "date", "id")).distinct()
    return universe.from_formula("(BUILDING + MACHINERY) - BUILDING * 1_URGENT", universe.named(keyed)).frame


@query(f"WITH {PANEL} SELECT date, id, 'f1' AS factor, f1 AS value FROM panel WHERE f1 IS NOT NULL UNION ALL SELECT date, id, 'f3', f3 FROM panel WHERE f3 IS NOT NULL")
def r1_stack(spark, d):
    return align.long(panel(spark, d), ["date", "id"], ["f1", "f3"])


@query("SELECT c_custkey AS id, CAST(c_mktsegment = 'BUILDING' AS TINYINT) AS \"BUILDING\", CAST(c_mktsegment = 'FURNITURE' AS TINYINT) AS \"FURNITURE\", CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_mktsegment END AS label FROM customer")
def r2_one_hot(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE"]
    return align.label_of(align.one_hot(c, "c_mktsegment", names, drop_first=True), names[1:]).drop("c_mktsegment")


@query(f"WITH {PANEL}, {ORDERED} SELECT date, id, o.f1, coalesce(n.f3, o.f3) AS f3, n.f2 FROM panel o FULL JOIN ordered n USING (date, id)")
def k2_overlay(spark, d):
    from panelspark.sources.store import PanelStore

    return PanelStore.merged(panel(spark, d).select("date", "id", "f1", "f3"), ordered(spark, d), "overlay")


@query(f"WITH {PANEL}, {ORDERED} SELECT date, id, f2 FROM ordered UNION ALL SELECT o.date, o.id, o.f2 FROM panel o ANTI JOIN ordered n USING (date, id)")
def k1_upsert(spark, d):
    from panelspark.sources.store import PanelStore

    return PanelStore.merged(panel(spark, d).select("date", "id", "f2"), ordered(spark, d).select("date", "id", "f2"), "update")


# --- point in time --------------------------------------------------------------------------------------------------

PRIOR = "LEFT JOIN known {0} ON {0}.date = l.date AND {0}.id = l.id AND {0}.period = {1}"
YEAR_END = "make_date(year(l.period) - {0}, 12, 31)"
YEARS_BACK = "last_day(l.period - INTERVAL {0} YEAR)"


@query(f"WITH {KNOWN} SELECT date, id, period, value FROM latest")
def p1_latest_period(spark, d):
    return pit.run("latest_period", as_of_keys(spark, d), statements(spark, d))


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND(l.value + y.value - b.value, 4) AS value FROM latest l {PRIOR.format('y', YEAR_END.format(1))} {PRIOR.format('b', YEARS_BACK.format(1))}")
def p2_ttm(spark, d):
    return rounded(pit.run("ttm", as_of_keys(spark, d), statements(spark, d)), digits=4)


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND(n.value + y.value - b.value, 4) AS value FROM latest l {PRIOR.format('n', YEARS_BACK.format(1))} {PRIOR.format('y', YEAR_END.format(2))} {PRIOR.format('b', YEARS_BACK.format(2))}")
def p3_last_nyear_ttm(spark, d):
    return rounded(pit.run("last_nyear_ttm", as_of_keys(spark, d), statements(spark, d)), digits=4)


@query(f"WITH {KNOWN} SELECT l.date, l.id, n.value FROM latest l {PRIOR.format('n', 'last_day(l.period - INTERVAL 3 MONTH)')}")
def p7_last_nperiod(spark, d):
    return pit.run("last_nperiod", as_of_keys(spark, d), statements(spark, d))


@query(f"WITH {KNOWN}, r AS (SELECT *, row_number() OVER (PARTITION BY date, id ORDER BY ann_dt DESC, period DESC) AS nth FROM known) SELECT date, id, CAST(nth AS INTEGER) AS nth, period, value FROM r WHERE nth <= 3")
def p6_last_periods(spark, d):
    return pit.run("last_nyears", as_of_keys(spark, d), statements(spark, d), n=3)


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND((l.value - n.value) / nullif(abs(n.value), 0), 6) AS value FROM latest l {PRIOR.format('n', YEARS_BACK.format(1))}")
def p8_yearly_growth(spark, d):
    return rounded(pit.run("inc_rate_tb", as_of_keys(spark, d), statements(spark, d)))


@query(f"WITH {KNOWN} SELECT l.date, l.id, ROUND((coalesce(n.value, l.value) + l.value) / 2, 4) AS value FROM latest l {PRIOR.format('n', 'last_day(l.period - INTERVAL 3 MONTH)')}")
def p11_quarter_mean(spark, d):
    return rounded(pit.run("sq_avg", as_of_keys(spark, d), statements(spark, d)), digits=4)


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 4 THEN make_date(year(o_orderdate) - 1, 9, 30) WHEN month(o_orderdate) <= 8 THEN make_date(year(o_orderdate) - 1, 12, 31) WHEN month(o_orderdate) <= 10 THEN make_date(year(o_orderdate), 6, 30) ELSE make_date(year(o_orderdate), 9, 30) END AS due, last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS period, CASE quarter(o_orderdate) WHEN 1 THEN make_date(year(o_orderdate), 4, 30) WHEN 2 THEN make_date(year(o_orderdate), 8, 31) WHEN 3 THEN make_date(year(o_orderdate), 10, 31) ELSE make_date(year(o_orderdate) + 1, 4, 30) END AS announced FROM orders")
def p17_report_dates(spark, d):
    o = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", dates.min_report_date(o).alias("due"), dates.period_end(o).alias("period"), dates.default_announcement(dates.period_end(o)).alias("announced"))


# --- rolling, calendar, resampling ----------------------------------------------------------------------------------


@query(f"WITH {SERIES} SELECT series, date, ROUND(CASE WHEN count(*) OVER w = 20 THEN avg(value) OVER w END, 6) AS mean, ROUND(CASE WHEN count(*) OVER w = 20 THEN stddev_samp(value) OVER w END, 6) AS std FROM series WINDOW w AS (PARTITION BY series ORDER BY date ROWS 19 PRECEDING)")
def t1_rolling(spark, d):
    s = series(spark, d)
    return rounded(s.select("series", "date", rolling.rolling("value", 20, F.avg, "series").alias("mean"), rolling.rolling("value", 20, F.stddev_samp, "series").alias("std")))


@query(f"WITH {SERIES}, a AS (SELECT *, pow(0.5e0, (row_number() OVER (PARTITION BY series ORDER BY date DESC) - 1) / 10e0) AS w FROM series) SELECT series, date, ROUND(w / sum(w) OVER (PARTITION BY series), 9) AS weight FROM a")
def t3_half_life(spark, d):
    return rounded(rolling.half_life_weights(series(spark, d), 10, "series").select("series", "date", "weight"), digits=9)


@query(f"WITH {SIGNALS} SELECT name, date, ROUND(product(1 + benchmark) OVER (PARTITION BY name ORDER BY date), 6) AS nav FROM signals")
def t4_nav(spark, d):
    return rounded(signals(spark, d).select("name", "date", rolling.nav("benchmark", "name").alias("nav")))


@query(f"WITH {PANEL}, w AS (SELECT *, mv / sum(mv) OVER (PARTITION BY date) AS w FROM panel) SELECT date, ROUND(sum(f1 * f2 * w) - sum(f1 * w) * sum(f2 * w), 2) AS cov, ROUND((sum(f1 * f2 * w) - sum(f1 * w) * sum(f2 * w)) / sqrt((sum(f1 * f1 * w) - sum(f1 * w) ** 2) * (sum(f2 * f2 * w) - sum(f2 * w) ** 2)), 6) AS corr FROM w GROUP BY date HAVING count(*) > 2")
def t5_weighted_covariance(spark, d):
    p = align.shares(panel(spark, d).withColumn("w", F.col("mv")), "w", "date")
    p = p.groupBy("date").agg(rolling.weighted_covariance("f1", "f2", "w").alias("cov"), rolling.weighted_correlation("f1", "f2", "w").alias("corr"), F.count("*").alias("n")).where("n > 2").drop("n")
    return rounded(rounded(p, "cov", digits=2), "corr")


@query(f"WITH {SERIES}, a AS (SELECT *, list(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS xs, min(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS lo, max(value) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS hi FROM series) SELECT series, date, ROUND(CASE WHEN len(xs) = 30 THEN len(list_filter(xs, lambda v: v <= value)) / 30e0 END, 6) AS share, ROUND(CASE WHEN len(xs) = 30 THEN greatest(0, least(1, (value - lo) / nullif(hi - lo, 0))) END, 6) AS place FROM a")
def t7_percentile(spark, d):
    return rounded(series(spark, d).select("series", "date", rolling.percentile_of("value", 30, "series").alias("share"), rolling.position_of("value", 30, "series").alias("place")))


CAL = "days AS (SELECT CAST(unnest(generate_series(DATE '1992-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS date), cal AS (SELECT date, isodow(date) < 6 AND NOT (month(date) = 1 AND day(date) = 1) AS is_td FROM days), td AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM cal WHERE is_td)"


def cal(spark: SparkSession) -> DataFrame:
    holidays = spark.sql("select make_date(y, 1, 1) as date from (select explode(sequence(1992, 2001)) as y)")
    return calendar.calendar(spark, "1992-01-01", "2001-12-31", holidays)


#: The calendar of the years in which there are orders.
ORDER_CAL = CAL.replace("DATE '1992-01-01'", "make_date((SELECT min(year(o_orderdate)) FROM orders), 1, 1)").replace("DATE '2001-12-31'", "make_date((SELECT max(year(o_orderdate)) FROM orders), 12, 31)")


def order_years(spark: SparkSession, d: str) -> tuple[str, str]:
    r = read(spark, d, "orders").agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    return f"{r[0]}-01-01", f"{r[1]}-12-31"


def order_cal(spark: SparkSession, d: str) -> DataFrame:
    holidays = read(spark, d, "orders").select(F.make_date(F.year("o_orderdate"), F.lit(1), F.lit(1)).alias("date")).distinct()
    return calendar.calendar(spark, *order_years(spark, d), holidays)


@query(f"WITH {ORDER_CAL} SELECT date FROM (SELECT max(date) AS date FROM cal WHERE is_td GROUP BY date_trunc('month', date))")
def c2_month_ends(spark, d):
    return calendar.trade_days(order_cal(spark, d), *order_years(spark, d), "m")


@query(f"WITH {CAL}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, (SELECT count(*) FROM td WHERE td.date <= CAST(o_orderdate AS DATE)) AS seq FROM orders) SELECT o_orderkey, o.date, a.date AS later, b.date AS earlier FROM o LEFT JOIN td a ON a.seq = o.seq + 3 LEFT JOIN td b ON b.seq = CASE WHEN EXISTS (SELECT 1 FROM td WHERE td.date = o.date) THEN o.seq - 2 ELSE o.seq - 1 END")
def c4_trade_day_offset(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    c = cal(spark)
    return calendar.shifted_days(calendar.shifted_days(o, c, 3, out="later"), c, -2, out="earlier").select("o_orderkey", "date", "later", "earlier")


@query(f"WITH {ORDER_CAL}, w AS (SELECT date, lag(date) OVER (ORDER BY date) AS p, lead(date) OVER (ORDER BY date) AS n FROM td) SELECT date, coalesce(date_trunc('week', date) <> date_trunc('week', p), true) AS first_w, coalesce(date_trunc('quarter', date) <> date_trunc('quarter', n), true) AS last_q FROM w")
def c5_period_flags(spark, d):
    return calendar.period_flags(order_cal(spark, d)).select("date", "first_w", "last_q")


@query(f"WITH {ORDER_CAL}, m AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM days), n AS (SELECT month, CAST(month + CAST((10 - isodow(month)) % 7 + 21 AS INTEGER) AS DATE) AS nominal FROM m) SELECT month, nominal, (SELECT min(date) FROM td WHERE td.date >= nominal) AS expiry FROM n")
def c10_expiry(spark, d):
    return calendar.expiry_days(order_cal(spark, d)).select("month", "nominal", "expiry")


@query(f"WITH {SIGNALS} SELECT name, max(date) AS date, ROUND(product(1 + benchmark) - 1, 8) AS benchmark FROM signals GROUP BY name, date_trunc('week', date)")
def rs1_weekly_returns(spark, d):
    return rounded(calendar.compounded(signals(spark, d), "benchmark", ["name"], "w").select("name", "date", "benchmark"), digits=8)


@query(f"WITH {PANEL} SELECT industry, max(date) AS date, sum(f2) AS total, count(f3) AS n FROM panel GROUP BY industry, date_trunc('quarter', date)")
def rs3_quarterly(spark, d):
    return calendar.resampled(panel(spark, d), ["industry"], "q", {"total": F.sum("f2"), "n": F.count("f3")})


@query(f"WITH {PANEL}, dd AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM (SELECT DISTINCT date FROM panel)), k AS (SELECT p.date, id, f2, seq FROM panel p JOIN dd USING (date)) SELECT a.date, a.id, a.f2, b.f2 AS before FROM k a LEFT JOIN k b ON a.id = b.id AND b.seq = a.seq - 2")
def rs4_date_shift(spark, d):
    return calendar.shifted_values(panel(spark, d).select("date", "id", "f2"), 2, "f2", "before")


# --- scalars --------------------------------------------------------------------------------------------------------

CODE = "lpad(CAST(p_partkey * 7919 % 1000000 AS VARCHAR), 6, '0')"


@query(f"WITH c AS (SELECT p_partkey AS id, {CODE} AS code FROM part) SELECT id, code, code || CASE WHEN code LIKE '6%' THEN '.SH' ELSE '.SZ' END AS wind, code || CASE WHEN code LIKE '6%' THEN '.XSHG' ELSE '.XSHE' END AS uqer, CASE WHEN code LIKE '6%' THEN 'SH' ELSE 'SZ' END || code AS tsl, CAST(code AS INTEGER) AS number, regexp_matches(code, '^[603]') AS is_a FROM c")
def v1_codes(spark, d):
    raw = F.col("p_partkey") * 7919 % 1000000
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), codes.trade_code(raw).alias("code"), codes.wind_code(raw).alias("wind"), codes.uqer_code(raw).alias("uqer"), codes.tsl_code(raw).alias("tsl"), codes.int_code(codes.wind_code(raw)).alias("number"), codes.is_a_share(codes.trade_code(raw)).alias("is_a"))


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS d, CAST(o_orderdate AS DATE) AS back, CAST(DATE '1899-12-30' + CAST(o_orderkey % 40000 AS INTEGER) AS DATE) AS excel FROM orders")
def v3_date_casts(spark, d):
    o = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select("o_orderkey", dates.to_int(o).alias("d"), dates.from_int(dates.to_int(o)).alias("back"), dates.from_excel(F.col("o_orderkey") % 40000).alias("excel"))


@query("WITH k AS (SELECT n_name, n_nationkey AS code FROM nation WHERE n_nationkey < 10), f AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS n FROM nation WHERE n_nationkey >= 10) SELECT n_name, CAST(code AS BIGINT) AS code FROM k UNION ALL SELECT n_name, CAST(9 + n AS BIGINT) FROM f")
def v6_new_keys(spark, d):
    n = read(spark, d, "nation")
    return codes.new_keys(n.where("n_nationkey < 10").select("n_name", F.col("n_nationkey").cast("long").alias("code")), n, "n_name", "code")


@query("WITH a AS (SELECT c_mktsegment AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS own FROM customer) SELECT k, CAST(min(pos) AS INTEGER) AS \"start\", CAST(max(pos) AS INTEGER) AS \"end\" FROM a GROUP BY k, pos - own")
def v7_id_ranges(spark, d):
    return codes.id_ranges(read(spark, d, "customer").select(F.col("c_mktsegment").alias("k"), "c_custkey"), "k", "c_custkey")


# --- filters --------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {SERIES}, o AS (SELECT series, date, value, row_number() OVER (PARTITION BY series ORDER BY date) AS n FROM series), e AS (SELECT series, date, value, n, value AS y FROM o WHERE n = 1 UNION ALL SELECT o.series, o.date, o.value, o.n, (1 - 2 / 11e0) * e.y + 2 / 11e0 * o.value FROM e JOIN o ON o.series = e.series AND o.n = e.n + 1) SELECT series, date, value, ROUND(y, 6) AS ewma FROM e")
def z1_ewma(spark, d):
    return rounded(filters.ewma(series(spark, d), window=10), "ewma")


@query(f"""WITH RECURSIVE {SERIES}, o AS (SELECT series, date, value, row_number() OVER (PARTITION BY series ORDER BY date) AS n FROM series),
 e AS (SELECT series, date, value, n, value AS x1, value AS y, value AS y1 FROM o WHERE n = 1 UNION ALL SELECT o.series, o.date, o.value, o.n, e.value, (2 / 7e0 - 1 / 49e0) * o.value + (2 / 49e0) * e.value - (2 / 7e0 - 3 / 49e0) * e.x1 + 2 * (5 / 7e0) * e.y - (25 / 49e0) * e.y1, e.y FROM e JOIN o ON o.series = e.series AND o.n = e.n + 1) SELECT series, date, value, ROUND(y, 6) AS llt FROM e""")
def z2_llt(spark, d):
    return rounded(filters.llt(series(spark, d)), "llt")


@query(None)
def z3_hp_cycle(spark, d):
    monthly = calendar.resampled(series(spark, d), ["series"], "w", {"value": F.avg("value")})
    return rounded(filters.hp_cycle(monthly, "Q", 8))


@query(None)
def z4_kalman(spark, d):
    return rounded(filters.kalman(series(spark, d), 3))


@query(None)
def z10_turning_points(spark, d):
    return filters.turning_points(series(spark, d))


# --- portfolio, timing, options -------------------------------------------------------------------------------------


def weights(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Quarterly target weights and monthly returns of the first nations' supply, as a small market."""
    p = panel(spark, d).groupBy("date", "industry").agg(F.sum("f2").alias("q"))
    w = Window.partitionBy("industry").orderBy("date")
    returns = p.select("date", F.col("industry").alias("id"), F.round(F.coalesce(F.col("q") / F.lag("q").over(w) - 1, F.lit(0.0)), 6).alias("ret"))
    return p.where(F.month("date") % 3 == 1).select("date", F.col("industry").alias("id"), F.col("q").alias("weight")), returns


@query(f"""WITH {PANEL}, p AS (SELECT date, industry AS id, sum(f2) AS q FROM panel GROUP BY 1, 2), r AS (SELECT date, id, ROUND(coalesce(q / lag(q) OVER (PARTITION BY id ORDER BY date) - 1, 0), 6) AS ret FROM p), t AS (SELECT date, id, q / sum(q) OVER (PARTITION BY date) AS w1 FROM p WHERE month(date) % 3 = 1),
 b AS (SELECT date AS begin, lead(date) OVER (ORDER BY date) AS until, row_number() OVER (ORDER BY date) AS nth FROM (SELECT DISTINCT date FROM t)), c AS (SELECT nth, begin, until, id, w1 FROM t JOIN b ON b.begin = t.date),
 g AS (SELECT c.nth, c.id, c.begin, r.date, r.ret, c.w1 * product(1 + r.ret) OVER (PARTITION BY c.nth, c.id ORDER BY r.date) AS fin FROM c JOIN r ON r.id = c.id AND r.date >= c.begin AND (c.until IS NULL OR r.date < c.until)),
 h AS (SELECT *, fin / (1 + ret) AS st FROM g), x AS (SELECT *, st / sum(st) OVER (PARTITION BY date) AS w, fin / sum(fin) OVER (PARTITION BY date) AS after FROM h),
 l AS (SELECT nth + 1 AS nth, id, after AS w0 FROM x WHERE date = (SELECT max(y.date) FROM x y WHERE y.nth = x.nth)), tu AS (SELECT nth, sum(abs(coalesce(w1, 0) - coalesce(w0, 0))) AS turnover FROM c FULL JOIN l USING (nth, id) GROUP BY nth),
 dly AS (SELECT date, nth, sum(w * ret) AS value, min(date) OVER (PARTITION BY nth) AS f FROM x GROUP BY date, nth) SELECT date, ROUND(value - 0.001e0 * CASE WHEN date = f THEN turnover ELSE 0 END, 6) AS value, ROUND(CASE WHEN date = f THEN turnover ELSE 0 END, 6) AS turnover FROM dly JOIN tu USING (nth)""")
def b2_portfolio_returns(spark, d):
    targets, returns = weights(spark, d)
    return rounded(portfolio.held_returns(targets, returns, 0.001))


@query(None)
def b3_backtest_blocked(spark, d):
    targets, returns = weights(spark, d)
    name = F.lit("all").alias("portfolio")
    status = returns.select(name, "date", "id", (F.col("ret") > 0.15).alias("no_buy"), (F.col("ret") < -0.15).alias("no_sell"))
    return rounded(portfolio.backtest(targets.select(name, "*"), returns.select(name, "*"), status, 0.001))


METRICS = """ROUND(product(1 + value) - 1, 6) AS total_return, ROUND(pow(product(1 + value), 252e0 / count(value)) - 1, 6) AS annual_return, ROUND(pow(product(1 + benchmark), 252e0 / count(value)) - 1, 6) AS benchmark_return,
 ROUND(stddev_samp(value) * sqrt(252), 6) AS volatility, ROUND(least(0, min(nav / greatest(1, peak) - 1)), 6) AS max_drawdown, ROUND(avg(value - 0.02e0 / 252) / nullif(stddev_samp(value), 0) * sqrt(252), 6) AS sharpe, ROUND(stddev_samp(value - benchmark) * sqrt(252), 6) AS tracking_error, ROUND(avg(value - benchmark) * 252 / nullif(stddev_samp(value - benchmark) * sqrt(252), 0), 6) AS information_ratio"""


@query(f"WITH {SIGNALS}, v AS (SELECT name AS series, date, signal * benchmark AS value, benchmark FROM signals), n AS (SELECT *, product(1 + value) OVER (PARTITION BY series ORDER BY date) AS nav FROM v), p AS (SELECT *, max(nav) OVER (PARTITION BY series ORDER BY date) AS peak FROM n) SELECT series, {METRICS} FROM p GROUP BY series")
def b6_report(spark, d):
    s = signals(spark, d).select(F.col("name").alias("series"), "date", (F.col("signal") * F.col("benchmark")).alias("value"), "benchmark")
    return rounded(portfolio.report(s))


@query(f"""WITH {SIGNALS} SELECT name, CAST(year(date) AS INTEGER) AS year, CAST(sum(CAST(signal > 0 AS INT)) AS BIGINT) AS ups, CAST(sum(CAST(signal < 0 AS INT)) AS BIGINT) AS downs, CAST(sum(CAST(signal = 0 AS INT)) AS BIGINT) AS flats, ROUND(coalesce(sum(CAST(signal <> 0 AND signal = sign(benchmark) AS INT)) / nullif(sum(CAST(signal <> 0 AS INT)), 0), 0), 6) AS win_rate, ROUND(coalesce(sum(CAST(signal > 0 AND benchmark > 0 AS INT)) / nullif(sum(CAST(signal > 0 AS INT)), 0), 0), 6) AS win_rate_up, ROUND(coalesce(sum(CAST(signal < 0 AND benchmark < 0 AS INT)) / nullif(sum(CAST(signal < 0 AS INT)), 0), 0), 6) AS win_rate_down, ROUND(-avg(CASE WHEN signal * benchmark > 0 THEN signal * benchmark END) / nullif(avg(CASE WHEN signal * benchmark < 0 THEN signal * benchmark END), 0), 6) AS gain_to_loss FROM signals GROUP BY GROUPING SETS ((name, CAST(year(date) AS INTEGER)), (name))""")
def g3_win_rates(spark, d):
    return rounded(timing.win_rates(signals(spark, d)))


@query(f"WITH {SIGNALS}, s AS (SELECT *, greatest(signal, 0) AS s FROM signals) SELECT name, date, ROUND(s * benchmark - abs(s - coalesce(lag(s) OVER (PARTITION BY name ORDER BY date), 0)) * 0.001e0, 8) AS value FROM s")
def g5_long_only(spark, d):
    return rounded(timing.performance(signals(spark, d), 0.001, short=False).select("name", "date", "value"), digits=8)


THIRDS = "t AS (SELECT *, CASE WHEN factor <= lo THEN 1 WHEN factor <= hi THEN 2 ELSE 3 END AS third FROM q), a AS (SELECT name, count(CASE WHEN third = 1 THEN 1 END) AS n1, count(CASE WHEN third = 2 THEN 1 END) AS n2, count(CASE WHEN third = 3 THEN 1 END) AS n3, avg(CASE WHEN third = 1 THEN forward END) AS m1, avg(CASE WHEN third = 2 THEN forward END) AS m2, avg(CASE WHEN third = 3 THEN forward END) AS m3, var_samp(CASE WHEN third = 1 THEN forward END) AS v1, var_samp(CASE WHEN third = 3 THEN forward END) AS v3 FROM t GROUP BY name) SELECT name, n1, n2, n3, ROUND(m1, 8) AS m1, ROUND(m2, 8) AS m2, ROUND(m3, 8) AS m3, ROUND((m1 - m3) / nullif(sqrt(((n1 - 1) * v1 + (n3 - 1) * v3) / nullif(n1 + n3 - 2, 0) * (1 / nullif(n1, 0) + 1 / nullif(n3, 0))), 0), 5) AS t FROM a"
FORWARD = "f AS (SELECT name, date, lag(benchmark) OVER w AS factor, CASE WHEN count(*) OVER a = 3 THEN product(1 + benchmark) OVER a - 1 END AS forward FROM signals WINDOW w AS (PARTITION BY name ORDER BY date), a AS (PARTITION BY name ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))"


@query(f"WITH {SIGNALS}, {FORWARD}, q AS (SELECT *, quantile_cont(factor, 1 / 3e0) OVER (PARTITION BY name) AS lo, quantile_cont(factor, 2 / 3e0) OVER (PARTITION BY name) AS hi FROM f WHERE factor IS NOT NULL AND forward IS NOT NULL), {THIRDS}")
def g7_terciles(spark, d):
    s = signals(spark, d).withColumn("signal", F.col("benchmark"))
    return rounded(rounded(timing.terciles(s, 3), "m1", "m2", "m3", digits=8), "t", digits=5)


@query(f"WITH {SIGNALS}, {FORWARD}, q0 AS (SELECT *, quantile_cont(factor, 1 / 3e0) OVER w AS lo, quantile_cont(factor, 2 / 3e0) OVER w AS hi, count(factor) OVER w AS c FROM f WINDOW w AS (PARTITION BY name ORDER BY date ROWS 9 PRECEDING)), q AS (SELECT * FROM q0 WHERE c = 10 AND forward IS NOT NULL), {THIRDS}")
def g8_rolling_terciles(spark, d):
    s = signals(spark, d).withColumn("signal", F.col("benchmark"))
    return rounded(rounded(timing.rolling_terciles(s, 10, 3), "m1", "m2", "m3", digits=8), "t", digits=5)


def _bs_sql() -> str:
    cdf = mx.normal_cdf_sql
    return f"""WITH {QUOTES}, a AS (SELECT *, (ln(s / k) + (r + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM quotes), b AS (SELECT *, d1 - v * sqrt(t) AS d2, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM a)
 SELECT id, ROUND(cp * (s * {cdf("(cp * d1)")} - k * {cdf("(cp * d2)")} * exp(-r * t)), 6) + 0e0 AS price, ROUND(cp * {cdf("(cp * d1)")} * s * 0.01e0, 6) + 0e0 AS delta, ROUND(pdf / (s * v * sqrt(t)) * s * s * 1e-4, 6) + 0e0 AS gamma, ROUND((-s * pdf * v / (2 * sqrt(t)) - cp * r * k * exp(-r * t) * {cdf("(cp * d2)")}) / 240, 6) + 0e0 AS theta, ROUND(s * pdf * sqrt(t) / 100, 6) + 0e0 AS vega FROM b"""


@query(_bs_sql())
def q3_bs_greeks(spark, d):
    s, k, r, t, v, cp = (F.col(c) for c in ("s", "k", "r", "t", "v", "cp"))
    q = quotes(spark, d)
    return rounded(q.select("id", *(c.alias(n) for n, c in options.bs_greeks(s, k, r, t, v, cp).items())))


@query(None)
def q4_bs_implied(spark, d):
    s, k, r, t, v, cp = (F.col(c) for c in ("s", "k", "r", "t", "v", "cp"))
    q = quotes(spark, d).withColumn("price", options.bs_price_in_batches(s, k, r, t, v, cp))
    return q.select("id", F.round("v", 4).alias("v"), options.bs_implied(s, k, r, t, F.col("price"), cp).alias("implied"))


@query(f"WITH {QUOTES}, a AS (SELECT *, (ln(s / k) + v * v / 2 * t) / (v * sqrt(t)) AS d1 FROM quotes) SELECT id, ROUND(cp * exp(-r * t) * (s * {mx.normal_cdf_sql('(cp * d1)')} - k * {mx.normal_cdf_sql('(cp * (d1 - v * sqrt(t)))')}), 6) AS price FROM a")
def q5_black_price(spark, d):
    s, k, r, t, v, cp = (F.col(c) for c in ("s", "k", "r", "t", "v", "cp"))
    return rounded(quotes(spark, d).select("id", options.black_price(s, k, r, t, v, cp).alias("price")))


@query(None)
def q7_tree_greeks(spark, d):
    s, k, t, v, cp = (F.col(c) for c in ("s", "k", "t", "v", "cp"))
    return rounded(quotes(spark, d).select("id", *(c.alias(n) for n, c in options.tree_greeks(s, k, t, v, cp).items())))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS \"start\", event_type, count(value) AS n, ROUND(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def st1_windowed_events(spark, d):
    from panelspark.streaming.windows import windowed

    w = windowed(read(spark, d, "events"), "ts", "event_type", "value", "6 hours", "1 hour")
    return rounded(w.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", digits=4)


from panelspark import queries_more, queries_scale  # noqa: E402, F401  # registers the others
