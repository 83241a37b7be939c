"""Operators whose results SQL doesn't give, against plain numpy or known values."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.functions import dates, maths
from panelspark.operators import align, calendar, cross, filters, options, portfolio, regress, rolling
from panelspark.plans import universe
from panelspark.sources import clients, tables
from panelspark.sources.store import PanelStore, last_of, read_csv_dates, risk_model, write_csv_dates
from panelspark.streaming import windows

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_medcouple_equals_all_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 40, 101):
        x = np.round(rng.exponential(size=n), 2)
        mid = np.median(x) if n else 0
        h = [((a - mid) - (mid - b)) / (a - b) for a in x[x > mid] for b in x[x < mid]]
        assert cross.medcouple(x) == pytest.approx(np.median(h) if h else 0.0, abs=1e-12)


def test_symmetric_orthogonal_has_unit_scatter(spark):
    rng = np.random.default_rng(2)
    rows = [(D(2020, 1, 1 + i % 2), i, *map(float, rng.normal(size=2))) for i in range(60)]
    df = spark.createDataFrame(rows, "date date, id long, a double, b double")
    out = cross.symmetric_orthogonal(df, ["a", "b"]).toPandas()
    for _, g in out.groupby("date"):
        m = g[["a_orth", "b_orth"]].to_numpy()
        assert np.allclose(m.T @ m, np.eye(2), atol=1e-9)


def test_normal_functions(spark):
    from statistics import NormalDist

    for x in (-38.0, -8.0, -1.5, 0.0, 0.3, 7.5):
        assert one(spark, maths.normal_cdf(F.lit(x))) == pytest.approx(NormalDist().cdf(x), abs=1e-13)
    for p in (1e-6, 0.01, 0.5, 0.97, 1 - 1e-6):
        assert one(spark, maths.normal_quantile(F.lit(p))) == pytest.approx(NormalDist().inv_cdf(p), rel=2e-9, abs=1e-9)
    assert one(spark, maths.normal_quantile(F.lit(0.0))) is None


def test_periods(spark):
    p = F.lit("2010-12-31").cast("date")
    assert one(spark, dates.shifted(p, years=2)) == D(2008, 12, 31)
    assert one(spark, dates.shifted(p, quarters=2)) == D(2010, 6, 30)
    assert one(spark, dates.shifted(p, years=1, quarter=1)) == D(2009, 3, 31)


def test_trade_day_offsets(spark):
    cal = calendar.calendar(spark, "2017-08-01", "2017-09-30")
    day = spark.createDataFrame([(D(2017, 8, 18),)], "date date")
    shift = lambda n, inclusive: calendar.shifted_days(day, cal, n, inclusive=inclusive).first()["shifted"]
    assert [shift(1, False), shift(1, True), shift(2, True), shift(-1, True), shift(-2, True)] == [D(2017, 8, 21), D(2017, 8, 18), D(2017, 8, 21), D(2017, 8, 18), D(2017, 8, 17)]
    assert calendar.intraday(day, 30).count() == 8


def test_universe_formula(spark):
    rows = [("a", D(2020, 1, 1), i) for i in range(6)] + [("b", D(2020, 1, 1), i) for i in range(3, 9)] + [("c", D(2020, 1, 1), i) for i in (0, 4)]
    of = universe.named(spark.createDataFrame(rows, "index_id string, date date, id long"))
    ids = lambda f: sorted(r["id"] for r in universe.from_formula(f, of).frame.collect())
    assert ids("a + b") == list(range(9))
    assert ids("a - b * c") == [0, 1, 2, 3, 5]
    assert ids("(a - b) * c") == [0]
    for bad in ("", "a +", "(a", "a b", "a)"):
        with pytest.raises(ValueError):
            universe.from_formula(bad, of)


def test_hp_trend_solves_its_equations():
    x = np.cumsum(np.random.default_rng(3).normal(size=30))
    d = np.diff(np.eye(30), 2, axis=0)
    assert np.allclose(filters.hp_trend(x, 1600.0), np.linalg.solve(np.eye(30) + 1600 * d.T @ d, x))


def test_turning_points_of_a_wave():
    x = np.sin(np.arange(200) * 2 * math.pi / 50)
    s = filters.turning(x)
    assert set(np.flatnonzero(s == 1)) <= {12, 13, 62, 63, 112, 113, 162, 163} and (s == 1).sum() == 4
    kinds = s[s != 0]
    assert (kinds[1:] != kinds[:-1]).all()


def test_festival_regressor_has_no_mean(spark):
    f = spark.createDataFrame([(2020, 1, 25), (2021, 2, 12), (2022, 2, 1)], "year int, month int, day int")
    out = filters.festival_regressor(f).toPandas()
    assert len(out) == 9 and np.allclose(out.groupby("month").value.mean(), 0)


def test_quadratic_programme_meets_its_conditions():
    x = regress.quadratic(np.eye(3), -np.array([3.0, 1.0, -2.0]), np.vstack([np.eye(3), np.ones((1, 3))]), np.array([0.0, 0, 0, 1]), np.array([0.8, 1, 1, 1]))
    assert np.allclose(x, [0.8, 0.2, 0.0], atol=1e-6)
    with pytest.raises(ValueError):
        regress.quadratic(np.eye(1), np.zeros(1), np.array([[1.0], [1.0]]), np.array([0.0, 2.0]), np.array([1.0, 3.0]))


def test_restricted_and_selected_regression(spark):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(3, 300))
    y = 2 * a - b + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, a, b, c, strict=True)], "y double, a double, b double, c double")
    free = regress.restricted(df, "y", ["a", "b", "c"])
    assert np.allclose(free, [2, -1, 0], atol=0.05)
    held = regress.restricted(df, "y", ["a", "b", "c"], equal=([[1, 1, 1]], [0.5]))
    assert held.sum() == pytest.approx(0.5, abs=1e-5)
    assert set(regress.selected(df, "y", ["a", "b", "c"], 1e-6)) == {"a", "b"}
    assert regress.selected(df, "y", ["a", "b", "c"], 1e-6, forward=False) == ["a", "b"]
    assert regress.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_option_parity_and_implied(spark):
    s, k, r, t, v = (F.lit(x) for x in (100.0, 95.0, 0.03, 0.5, 0.2))
    call, put = (one(spark, options.bs_price(s, k, r, t, v, F.lit(cp))) for cp in (1, -1))
    assert call - put == pytest.approx(100 - 95 * math.exp(-0.015), abs=1e-10)
    assert one(spark, options.bs_implied(s, k, r, t, F.lit(call), F.lit(1))) == pytest.approx(0.2)
    tree, flat = one(spark, options.tree_price(s, s, t, v, F.lit(1))), one(spark, options.black_price(s, s, F.lit(0.0), t, v, F.lit(1)))
    assert tree == pytest.approx(flat, rel=0.03)


def test_implied_volatility_of_batches(spark):
    """Many rows at once, with missing figures and prices without a volatility; no function is called step by step a row."""
    rows = [(i, 80.0 + i % 41, 100.0, 0.03, 0.25 + i % 5 / 4, 0.1 + i % 7 / 20, 1 if i % 2 else -1) for i in range(3000)]
    q = spark.createDataFrame(rows, "id int, s double, k double, r double, t double, v double, cp int")
    s, k, r, t, v, cp = (F.col(c) for c in ("s", "k", "r", "t", "v", "cp"))
    price = F.when(F.col("id") % 100 == 7, -1.0).when(F.col("id") % 100 != 8, options.bs_price_in_batches(s, k, r, t, v, cp))
    df = q.withColumn("plain", options.bs_price(s, k, r, t, v, cp)).withColumn("price", price).withColumn("found", options.bs_implied(s, k, r, t, F.col("price"), cp)).withColumn("black", options.black_implied(s, k, r, t, options.black_price(s, k, r, t, v, cp), cp))
    assert "aggregate(" not in df._jdf.queryExecution().executedPlan().toString()
    for x in df.collect():
        kind = x["id"] % 100
        assert x["found"] is None if kind == 8 else x["found"] == 0 if kind == 7 else x["price"] == pytest.approx(x["plain"], abs=1e-12)
        if kind not in (7, 8) and 90 < x["s"] < 110:
            assert x["found"] == pytest.approx(x["v"], abs=1e-4) and x["black"] == pytest.approx(x["v"], abs=1e-4)


def test_tree_of_batches_equals_a_walk(spark):
    """All greeks come from one walk over the tree a batch, equal to a tree walked place by place."""
    rows = [(i, 90.0 + i % 21, 100.0, 0.25 + i % 5 / 4, 0.1 + i % 7 / 20, 1 if i % 2 else -1) for i in range(60)] + [(99, 95.0, 100.0, 0.5, None, 1)]
    q = spark.createDataFrame(rows, "id int, s double, k double, t double, v double, cp int")

    def walk(s, k, t, v, cp, n=15):
        step = v * math.sqrt(t / n)
        up = math.exp(step)
        p = (1 - 1 / up) / (up - 1 / up)
        worth = lambda i, j: max(0.0, cp * (s * math.exp(step * (2 * j - i)) - k))
        values, levels = [worth(n, j) for j in range(n + 1)], {}
        for i in range(n - 1, -1, -1):
            values = levels[i] = [max(p * values[j + 1] + (1 - p) * values[j], worth(i, j)) for j in range(i + 1)]
        return levels

    df = q.select("*", *(c.alias(n) for n, c in options.tree_greeks(*(F.col(c) for c in ("s", "k", "t", "v", "cp"))).items()))
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for x in df.collect():
        if x["v"] is None:
            assert x["price"] is x["gamma"] is None
            continue
        a, b = walk(x["s"], x["k"], x["t"], x["v"], x["cp"]), walk(x["s"], x["k"], x["t"], x["v"] * 1.001, x["cp"])
        up = math.exp(x["v"] * math.sqrt(x["t"] / 15))
        assert x["price"] == pytest.approx(a[0][0], abs=1e-12) and x["delta"] == pytest.approx((a[1][1] - a[1][0]) / (x["s"] * up - x["s"] / up), abs=1e-10)
        assert x["vega"] == pytest.approx((b[0][0] - a[0][0]) / (x["v"] * 0.001) / 100, abs=1e-9) and x["theta"] == pytest.approx((a[2][1] - a[0][0]) / (2 * x["t"] / 15) / 240, abs=1e-12)


def test_blocked_backtest_equals_the_free_one_without_blocks(spark):
    days = [D(2020, 1, d) for d in range(1, 9)]
    rng = np.random.default_rng(5)
    ret = spark.createDataFrame([(d, i, float(rng.normal() / 50)) for d in days for i in ("a", "b")], "date date, id string, ret double")
    target = spark.createDataFrame([(days[0], "a", 1.0), (days[0], "b", 3.0), (days[4], "a", 1.0), (days[4], "b", 1.0)], "date date, id string, weight double")
    free = portfolio.held_returns(target, ret, 0.001).orderBy("date").toPandas()
    name = F.lit("p").alias("portfolio")
    status = ret.select(name, "date", "id", F.lit(False).alias("no_buy"), F.lit(False).alias("no_sell"))
    blocked = portfolio.backtest(target.select(name, "*"), ret.select(name, "*"), status, 0.001).orderBy("date").toPandas()
    assert np.allclose(free.value, blocked.value) and np.allclose(free.turnover, blocked.turnover)
    none = portfolio.backtest(target.select(name, "*"), ret.select(name, "*"), status.where("false"), 0.001)
    assert none.count() == 8 and none.agg(F.sum(F.abs("value"))).first()[0] == 0


def test_backtest_equals_a_walk_over_days(spark):
    rng = np.random.default_rng(5)
    days = pd.to_datetime("2020-01-01") + pd.to_timedelta(range(60), "D")
    ret = pd.DataFrame(rng.normal(0, 0.02, (60, 5)), days, list("abcde"))
    goal = pd.DataFrame(rng.random((6, 5)), days[[3, 12, 13, 30, 45, 59]], list("abcde"))
    goal = goal.div(goal.sum(axis=1), axis=0)
    buy, sell = (pd.DataFrame(rng.random((60, 5)) < 0.3, days, list("abcde")) for _ in range(2))
    w, expected = np.zeros(5), []
    for i, day in enumerate(days):
        if i < 3:
            continue
        turnover = 0.0
        if day in goal.index:
            g = goal.loc[day].to_numpy()
            blocked = (buy.loc[day].to_numpy() & (g > w)) | (sell.loc[day].to_numpy() & (g < w))
            new = np.where(blocked, w, g * ((1 - w[blocked].sum()) / g[~blocked].sum() if g[~blocked].sum() else 0.0))
            turnover, w = np.abs(new - w).sum(), new
        r = ret.loc[day].to_numpy()
        expected.append((day.date(), w @ r - 0.001 * turnover, turnover))
        grown = w * (1 + r)
        w = grown / grown.sum() * w.sum() if grown.sum() else grown
    long = lambda f, name: [("p", d.date(), c, f.loc[d, c].item()) for d in f.index for c in f.columns]
    targets = spark.createDataFrame(long(goal, "weight"), "portfolio string, date date, id string, weight double")
    returns = spark.createDataFrame(long(ret, "ret"), "portfolio string, date date, id string, ret double")
    flags = [(p, d, c, x, y) for (p, d, c, x), (*_, y) in zip(long(buy, "b"), long(sell, "s"), strict=True)]
    status = spark.createDataFrame(flags, "portfolio string, date date, id string, no_buy boolean, no_sell boolean")
    got = {r["date"]: r for r in portfolio.backtest(targets, returns, status, 0.001).collect()}
    assert len(got) == len(expected)
    assert all(got[d]["value"] == pytest.approx(v) and got[d]["turnover"] == pytest.approx(t) for d, v, t in expected)


def test_overfitting_of_noise_and_skill(spark):
    rng = np.random.default_rng(6)
    rows = [(D(2020, 1, 1) + dt.timedelta(d), f"s{i}", float(rng.normal() / 100 + (0.02 if i == 0 else 0))) for d in range(80) for i in range(5)]
    r = rolling.overfitting(spark.createDataFrame(rows, "date date, id string, value double"), 6).first()
    assert r["pbo"] == 0.0 and r["splits"] == 20


def test_store(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    schema = "date date, id string, f double"
    a = spark.createDataFrame([(D(2020, 1, 1), "x", 1.0), (D(2020, 1, 1), "y", float("nan")), (D(2021, 1, 1), "x", 3.0)], schema)
    store.save("n", a, attributes={"unit": "cent"})
    store.save("n", spark.createDataFrame([(D(2020, 1, 1), "x", None), (D(2020, 1, 2), "x", 9.0)], schema), "overlay")
    rows = {(r["date"], r["id"]): r["f"] for r in store.load("n").collect()}
    assert rows == {(D(2020, 1, 1), "x"): 1.0, (D(2020, 1, 1), "y"): None, (D(2021, 1, 1), "x"): 3.0, (D(2020, 1, 2), "x"): 9.0}
    store.save("n", spark.createDataFrame([(D(2020, 1, 1), "x", 5.0), (D(2022, 1, 1), "x", 6.0)], schema), "append")
    assert store.load("n", dates=(D(2020, 1, 1), D(2020, 1, 1)), ids=["x"]).first()["f"] == 1.0
    assert store.date_range("n") == (D(2020, 1, 1), D(2022, 1, 1)) and store.names() == ["n"] and store.attributes("n") == {"unit": "cent"}
    index = spark.createDataFrame([(D(2020, 1, 1), "z")], "date date, id string")
    assert store.load("n", index=index).first()["f"] is None
    assert store.columns("n") == ["f"] and store.free_name("n") == "n_1"
    store.rename("n", "m")
    store.delete("m")
    assert store.names() == []
    with pytest.raises(TypeError):
        store.save("bad", spark.createDataFrame([(D(2020, 1, 1), "x", [1])], "date date, id string, f array<int>"))


def test_store_rewrites_touched_years_alone(spark, tmp_path):
    store = PanelStore(spark, str(tmp_path / "s"))
    rows = [(D(2019 + i // 3, 1 + i % 3, 5), i % 2, float(i)) for i in range(9)]
    store.save("p", spark.createDataFrame(rows, "date date, id int, x double"))
    before = store._meta("p")["parts"]
    store.save("p", spark.createDataFrame([(D(2020, 1, 5), 1, 50.0, "n")], "date date, id int, x double, y string"), "update")
    after = store._meta("p")["parts"]
    assert {y for y in after if after[y] != before[y]} == {"2020"}
    got = {(r["date"], r["id"]): (r["x"], r["y"]) for r in store.load("p").collect()}
    assert len(got) == 9 and got[D(2020, 1, 5), 1] == (50.0, "n") and got[D(2019, 1, 5), 0] == (0.0, None)
    assert store.load("p", dates=("2021-01-01", None)).count() == 3 == store.load("p", dates=["2019-01-05", "2019-02-05", "2019-03-05"]).count()
    store.clean("p")
    assert store.load("p").count() == 9


def test_tables_and_sheets(spark, tmp_path):
    tables.create(spark, "ddl_one", "id long, name string", path=str(tmp_path / "one"))
    with pytest.raises(ValueError):
        tables.create(spark, "ddl_one", "id long")
    tables.create(spark, "ddl_one", "id long", if_exists="keep")
    tables.insert(spark, "ddl_one", spark.createDataFrame([("a", 1)], "name string, id long"))
    tables.add_columns(spark, "ddl_one", "x double")
    tables.rename(spark, "ddl_one", "ddl_two")
    assert tables.exists(spark, "ddl_two") and not tables.exists(spark, "ddl_one") and "ddl_two" in tables.names(spark)
    assert spark.table("ddl_two").collect()[0].asDict() == {"id": 1, "name": "a", "x": None}
    tables.drop_columns(spark, "ddl_two", ["name"], path=str(tmp_path / "two"))
    assert spark.table("ddl_two").columns == ["id", "x"]
    tables.drop(spark, "ddl_two")
    tables.write_sheets({"s": spark.range(3)}, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/s"), header=True).count() == 3


def test_clients_are_paged_and_limited(spark):
    def client():
        import pandas as pd

        return lambda day, offset, limit: pd.DataFrame({"day": day, "n": range(offset, min(offset + limit, 7 * day))})

    calls = spark.createDataFrame([(0,), (1,), (2,), (3,)], "day int")
    got = clients.fetched(calls, client, "day int, n int", cap=7).groupBy("day").count().collect()
    assert {r["day"]: r["count"] for r in got} == {1: 7, 2: 14, 3: 21}
    pauses = []
    limiter = clients.Limiter(2, 5.0, pauses.append)
    for _ in range(5):
        limiter()
    assert pauses == [5.0, 5.0]


def test_csv_by_date(spark, tmp_path):
    (tmp_path / "20200102.csv").write_bytes("id,名\n000001,平安\n".encode("gbk"))
    df = read_csv_dates(spark, str(tmp_path), "id string, name string")
    assert [tuple(r) for r in df.collect()] == [("000001", "平安", D(2020, 1, 2))]
    write_csv_dates(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1


def test_risk_model_and_last_row(spark):
    rows = spark.createDataFrame([(D(2020, 1, 1), "u", '{"a": {"size": 1.5}}', '{"size": 0.1}', '{"size": {"size": 2.0}}', '{"a": 3.0}', '{"a": 5.0}')], "date date, universe string, exposures string, returns string, covariance string, specific string, specific_returns string")
    m = risk_model(rows, "u")
    assert m["covariance"].first()["value"] == pytest.approx(2 * 252e-4) and m["specific_returns"].first()["value"] == 0.05
    assert last_of(spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), ["k"]).first()["v"] == 3


def test_streams(spark, tmp_path):
    ts = dt.datetime(2020, 1, 1)
    rows = [(ts + dt.timedelta(minutes=7 * i), "k", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "ts timestamp, key string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed(stream, "ts", "key", "value", "1 hour", "10 minutes").writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {tuple(r) for r in windows.windowed(df, "ts", "key", "value", "1 hour", "10 minutes").collect()}
    assert {tuple(r) for r in spark.table("w").collect()} <= batch and spark.table("w").count() >= 1
    q = windows.ewma(stream, "key", "value", "ts", 3).writeStream.format("memory").queryName("e").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    y = 0.0
    for i in range(1, 20):
        y = 0.5 * y + 0.5 * i
    assert spark.table("e").collect()[-1]["ewma"] == pytest.approx(y)


def test_ancestors_reach_the_root_of_deep_trees(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "node long, parent long")
    found = {(r["node"], r["ancestor"], r["depth"]) for r in align.ancestors(chain, "node", "parent").collect()}
    assert found == {(i, j, j - i) for i in range(20) for j in range(i + 1, 21)}
    with pytest.raises(ValueError, match="cycle"):
        align.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"), "node", "parent")
