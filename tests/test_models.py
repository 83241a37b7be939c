"""Unit-root tests, optimal portfolios and expanding filters against plain or published values."""

import datetime as dt
import time

import numpy as np
import pytest

from panelspark.operators import filters, optimiser, unitroot


@pytest.mark.parametrize("kind,points", [("ct", {-3.96: 0.01, -3.41: 0.05, -3.12: 0.10}), ("c", {-3.43: 0.01, -2.86: 0.05, -2.57: 0.10}), ("n", {-2.58: 0.01, -1.95: 0.05, -1.62: 0.10})])
def test_p_values_of_published_critical_points(kind, points):
    for t, p in points.items():
        assert unitroot.p_value(t, kind) == pytest.approx(p, rel=0.06)
    grid = np.linspace(-8, 2, 400)
    values = [unitroot.p_value(t, kind) for t in grid]
    assert all(a <= b + 2e-3 for a, b in zip(values, values[1:], strict=False)) and values[0] < 1e-6
    assert unitroot.p_value(-30, kind) == 0.0 and unitroot.p_value(3, kind) > 0.98


@pytest.mark.parametrize("kind", ["n", "c", "ct"])
def test_lag_of_least_information_on_equal_rows(kind):
    rng = np.random.default_rng(1)
    for _ in range(6):
        e = rng.normal(size=130)
        x = np.cumsum(e + 0.7 * np.concatenate([[0], e[:-1]])) if rng.random() < 0.5 else e
        aic = []
        for k in range(9):
            m, y = unitroot.design(x, k, kind, 8)
            b, *_ = np.linalg.lstsq(m, y, rcond=None)
            n = len(y)
            aic.append(n * (np.log(2 * np.pi) + np.log(((y - m @ b) ** 2).sum() / n) + 1) + 2 * m.shape[1])
        assert unitroot.chosen_lag(x, 8, kind) == int(np.argmin(aic))
        t, _, used, n = unitroot.tested(x, kind, 3)
        assert used == 3 and n == 126 and t == pytest.approx(unitroot.statistic(x, 3, kind)[0])


def test_unit_root_of_series(spark):
    rng = np.random.default_rng(2)
    made = {"walk": np.cumsum(rng.normal(size=200)), "noise": rng.normal(size=200), "flat": np.ones(50), "short": np.arange(4.0)}
    rows = [(s, i, float(v)) for s, x in made.items() for i, v in enumerate(x)] + [("noise", 500, None), ("noise", 501, float("nan"))]
    got = {r["series"]: r for r in unitroot.unit_root(spark.createDataFrame(rows, "series string, date int, value double")).collect()}
    assert got["noise"]["p"] < 0.01 and got["flat"]["t"] is got["short"]["p"] is None
    assert tuple(got["walk"])[1:] == pytest.approx(unitroot.tested(made["walk"]))
    assert got["noise"]["n"] == 199 - got["noise"]["lags"]


@pytest.mark.parametrize("kind", ["n", "c", "ct"])
def test_one_walk_in_twenty_is_rejected_at_five_percent(kind):
    rng = np.random.default_rng(3)
    p = [unitroot.tested(np.cumsum(rng.normal(size=250)), kind, 0)[1] for _ in range(600)]
    assert 0.03 < np.mean(np.array(p) < 0.05) < 0.075 and 0.4 < np.mean(np.array(p) < 0.5) < 0.6


def problem(rng, n, k):
    columns, own = rng.normal(0, 0.1, (n, k)), rng.uniform(0.05, 0.3, n)
    wb = np.where(rng.random(n) < 0.5, rng.random(n), 0)
    wb /= wb.sum()
    w0 = rng.random(n)
    w0 /= w0.sum()
    return rng.normal(0, 0.05, n), columns, own**2, wb, w0


@pytest.mark.parametrize("n,k", [(30, 3), (200, 10)])
def test_optimum_meets_its_conditions_with_binding_limits(n, k):
    rng = np.random.default_rng(n)
    r, columns, own, wb, w0 = problem(rng, n, k)
    low, high, base, cost = -wb, 3 / n - wb, w0 - wb, np.full(n, 0.002)
    tilt, sector = rng.normal(size=n), (np.arange(n) % 3 == 0).astype(float)
    rows, least, most = np.vstack([np.ones(n), tilt, sector]), np.array([0.0, -np.inf, 0.05]), np.array([0.0, 0.02, 0.05])
    x, price, row_price = optimiser.solved(r, columns, own, base, cost, low, high, rows, least, most)
    assert (x >= low - 1e-8).all() and (x <= high + 1e-8).all() and abs(x.sum()) < 1e-7 and sector @ x == pytest.approx(0.05, abs=1e-7) and tilt @ x <= 0.02 + 1e-7
    slope = -r + 2 * columns @ (columns.T @ x) + 2 * own * x + rows.T @ row_price  # of what is made small, but for trading and ends
    traded, at_low, at_high = np.abs(x - base) > 1e-6, x < low + 1e-7, x > high - 1e-7
    free = traded & ~at_low & ~at_high
    assert np.abs(slope + cost * np.sign(x - base))[free].max() < 1e-6
    assert (slope + cost * np.sign(x - base))[at_low & traded].min(initial=1) > -1e-6 and (slope + cost * np.sign(x - base))[at_high & traded].max(initial=-1) < 1e-6
    assert (np.abs(slope)[~traded & ~at_low & ~at_high] < cost[0] + 1e-6).all()
    assert at_high.any() and at_low.any() and row_price[1] >= -1e-9 and (row_price[1] < 1e-7 or tilt @ x == pytest.approx(0.02, abs=1e-6))
    assert np.abs(slope + price).max() < 1e-6


def test_optimum_of_two_thousand_ids_in_seconds_and_no_optimum():
    rng = np.random.default_rng(7)
    n = 2000
    r, columns, own, wb, w0 = problem(rng, n, 20)
    began = time.perf_counter()
    x, price, row_price = optimiser.solved(r, columns, own, w0 - wb, np.full(n, 0.001), -wb, 0.003 - wb, np.ones((1, n)), np.zeros(1), np.zeros(1))
    assert time.perf_counter() - began < 30 and abs(x.sum()) < 1e-6
    assert np.abs(-r + 2 * columns @ (columns.T @ x) + 2 * own * x + row_price[0] + price).max() < 1e-6
    assert optimiser.solved(r, columns, own, w0 - wb, np.zeros(n), -wb, 0.0001 - wb, np.ones((1, n)), np.zeros(1), np.zeros(1)) is None


def test_optimised_dates_side_by_side(spark):
    """Equal to the general programme on the whole covariance; a date whose limits can't be met gives no rows."""
    from panelspark.operators import regress

    rng = np.random.default_rng(8)
    days, n = [dt.date(2020, 1, d) for d in (1, 2, 3)], 12
    assets, exposures, factors, rows, limits, want = [], [], [], [], [], {}
    for d in days:
        r, _, own, wb, w0 = problem(rng, n, 2)
        load, half = rng.normal(size=(n, 2)), rng.normal(size=(2, 2)) * 0.1
        cov = half @ half.T
        top = 0.2 if d != days[2] else 0.01  # too little for all
        assets += [(d, f"i{i:02d}", *map(float, (r[i], wb[i], w0[i], 0.001, 0.0, top, own[i] ** 0.5))) for i in range(n)]
        exposures += [(d, f"i{i:02d}", f"f{j}", float(load[i, j])) for i in range(n) for j in range(2)]
        factors += [(d, f"f{i}", f"f{j}", float(cov[i, j])) for i in range(2) for j in range(2)]
        rows += [(d, "odd", f"i{i:02d}", 1.0) for i in range(1, n, 2)]
        limits += [(d, "odd", -0.01, None)]
        want[d] = (r, load @ cov @ load.T + np.diag(own), wb, w0)
    frame = spark.createDataFrame
    made = optimiser.parts(frame(exposures, "date date, id string, factor string, x double"), frame(factors, "date date, factor1 string, factor2 string, cov double"), frame(rows, "date date, name string, id string, x double"), frame(limits, "date date, name string, low double, high double"))
    a = frame(assets, "date date, id string, r double, wb double, w0 double, cost double, wmin double, wmax double, own double")
    out = optimiser.optimised(a, made, 2.0, 0.0, 0.7).toPandas()
    assert set(out.date) == set(days[:2])
    for d in days[:2]:
        r, v, wb, w0 = want[d]
        both, base = np.hstack([np.eye(n), -np.eye(n)]), w0 - wb
        odd, inside = np.zeros(n), (wb != 0).astype(float)
        odd[1::2] = 1
        rules = np.vstack([np.eye(2 * n), both, both.sum(0), odd @ both, inside @ both])
        low = np.concatenate([np.zeros(2 * n), -wb - base, [-base.sum(), -0.01 - odd @ base, 0.7 - inside @ (wb + base)]])
        high = np.concatenate([np.full(2 * n, np.inf), 0.2 - wb - base, [-base.sum(), np.inf, np.inf]])
        x = base + both @ regress.quadratic(4 * both.T @ v @ both, both.T @ (4 * v @ base - r) + 0.001, rules, low, high, tol=1e-9)
        mine = out[out.date == d].sort_values("id")
        value = lambda y: r @ y - 0.001 * np.abs(y - base).sum() - 2 * y @ v @ y  # noqa: B023, E731
        assert value(mine.active.to_numpy()) == pytest.approx(value(x), abs=1e-7)
        assert mine.variance.iloc[0] == pytest.approx(mine.active @ v @ mine.active) and mine.gain.iloc[0] == pytest.approx(r @ mine.active)


def test_expanding_trend_in_one_pass():
    rng = np.random.default_rng(9)
    for n in (1, 3, 4, 5, 6, 60):
        x = np.cumsum(rng.normal(size=n))
        for lamb in (6.25, 1600.0, 129600.0):
            assert filters.hp_last(x, lamb) == pytest.approx([filters.hp_trend(x[: i + 1], lamb)[-1] for i in range(n)], abs=1e-6)
    began = time.perf_counter()
    filters.hp_last(rng.normal(size=20_000), 1600.0)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("kind, lags", [("n", None), ("c", None), ("ct", None), ("ct", 2)])
def test_unit_roots_together_equal_those_alone(kind, lags):
    rng = np.random.default_rng(12)
    for size in (2, 7, 9, 30, 84):
        x = np.concatenate([np.cumsum(rng.normal(size=(20, size)), axis=1), rng.normal(size=(20, size)), np.ones((1, size))])
        for got, row in zip(unitroot.tested_together(x, kind, lags), x, strict=True):
            want = unitroot.tested(row, kind, lags)
            assert got is want is None or got == pytest.approx(want, rel=1e-7, abs=1e-9)


def test_unit_root_takes_many_series_a_call(spark):
    df = spark.createDataFrame([(i, t, None if t == i else float((t * 7 + i) % 5)) for i in range(30) for t in range(20)] + [(99, 1, None), (None, 1, 2.0)], "series int, date int, value double")
    tested = unitroot.unit_root(df)
    assert "MapInPandas" in tested._jdf.queryExecution().executedPlan().toString()
    got = {r["series"]: r for r in tested.collect()}
    assert len(got) == 32 and got[99]["t"] is got[None]["t"] is None and got[3]["n"] is not None
