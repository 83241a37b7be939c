"""Seasonal adjustment: its averages against plain sums and published weights, and parts that were put together."""

import datetime as dt

import numpy as np
import pytest

from panelspark.operators import seasonal


def test_henderson_weights():
    published = [-0.01935, -0.02786, 0.0, 0.06549, 0.14736, 0.21434, 0.24006]
    assert seasonal.henderson(13)[:7] == pytest.approx(published, abs=1e-5)
    t = np.arange(60.0)
    cubic = 2 - t + 0.3 * t**2 - 0.01 * t**3
    for terms in (9, 13, 23):
        w = seasonal.henderson(terms)
        assert w.sum() == pytest.approx(1) and np.allclose(w, w[::-1])
        assert seasonal.trend(cubic, terms, 3.5)[12:-12] == pytest.approx(cubic[12:-12])
        for known in range(terms // 2 + 1, terms):
            assert seasonal.musgrave(w, known, 3.5).sum() == pytest.approx(1)
    assert np.allclose(seasonal.trend(np.full(40, 7.0), 13, 3.5), 7.0) and np.allclose(seasonal.trend(np.full(5, 7.0), 13, 3.5), 7.0)


def test_trend_ends_are_mirrored_and_equal_plain_sums():
    x = np.random.default_rng(1).normal(size=30)
    assert seasonal.trend(x, 13, 3.5) == pytest.approx(seasonal.trend(x[::-1], 13, 3.5)[::-1])
    w, out = seasonal.henderson(13), seasonal.trend(x, 13, 3.5)
    assert out[10] == pytest.approx(sum(w[j] * x[10 - 6 + j] for j in range(13)))
    # the last point: least squares of a line with the given noise leave these weights
    tail = seasonal.musgrave(w, 7, 3.5)
    assert out[-1] == pytest.approx(sum(tail[j] * x[23 + j] for j in range(7)))


@pytest.mark.parametrize("size", [3, 5])
def test_seasonal_average_equals_nested_means(size):
    x = np.random.default_rng(2).normal(size=12 * 11 + 5)
    out = seasonal.seasonal_average(x, 12, size)
    for t in range(len(x)):
        of, i = x[t % 12 :: 12], t // 12
        reach = 1 + size // 2
        if reach <= i < len(of) - reach:
            inner = [np.mean(of[k - size // 2 : k + size // 2 + 1]) for k in (i - 1, i, i + 1)]
            assert out[t] == pytest.approx(np.mean(inner))
    last = x[4::12]  # months with an end of their own
    ends = {3: (11, 11, 5), 5: (17, 17, 17, 9)}[size]
    assert out[4::12][-1] == pytest.approx(np.dot(ends, last[::-1][: len(ends)]) / sum(ends))
    assert out[4::12][0] == pytest.approx(np.dot(ends, last[: len(ends)]) / sum(ends))
    assert np.allclose(seasonal.seasonal_average(np.full(20, 3.0), 12, size), 3.0)


def test_centred_mean_and_norm():
    x = np.random.default_rng(3).normal(size=50)
    out = seasonal.centred_mean(x, 12)
    assert out[20] == pytest.approx((x[14] / 2 + x[15:26].sum() + x[26] / 2) / 12) and np.isnan(out[:6]).all() and np.isnan(out[-6:]).all()
    s = np.tile(np.arange(12.0), 5)
    assert seasonal.normalised(s, 12, False)[:12].sum() == pytest.approx(0) and seasonal.normalised(s + 1, 12, True)[:12].mean() == pytest.approx(1, abs=0.1)


@pytest.mark.parametrize("product", [False, True])
def test_parts_are_found_again(product):
    rng, t = np.random.default_rng(4), np.arange(144)
    smooth, wave = 100 + 0.4 * t + 8 * np.sin(t / 25), np.tile(np.array([-9, -6, 2, 4, 7, 3, -2, -5, 1, 6, 2, -3.0]), 12)
    noise = rng.normal(0, 1.0, 144)
    noise[70] += 12  # an outlier that neither trend nor seasons take up
    x = smooth * (1 + wave / 100) * (1 + noise / 100) if product else smooth + wave + noise
    got = seasonal.adjusted(x, 12, product)
    season = (got["seasonal"] - 1) * 100 if product else got["seasonal"]
    assert np.abs(season - wave).max() < 2 and np.abs(got["trend"] - smooth).max() < 3
    assert np.abs(got["irregular"] - (1 if product else 0)).argmax() == 70
    whole = got["trend"] * got["seasonal"] * got["irregular"] if product else got["trend"] + got["seasonal"] + got["irregular"]
    assert whole == pytest.approx(x)
    plain = seasonal.adjusted(np.arange(20.0), 12)
    assert (plain["seasonal"] == 0).all() and (plain["adjusted"] == np.arange(20.0)).all()


def test_covariance_of_moving_averages_and_effects():
    rng = np.random.default_rng(5)
    a, b, n = 0.6, 0.4, 40
    step = np.eye(n + 13)
    made = sum(w * step[13 - k : 13 - k + n] for k, w in ((0, 1), (1, -a), (12, -b), (13, a * b)))  # each value as a mix of noises
    assert seasonal.covariance(n, a, b, 12) == pytest.approx(made @ made.T)
    x = rng.random(150) * (np.arange(150) % 12 < 3)
    for level in (np.cumsum(rng.normal(0, 0.2, 150)), rng.normal(0, 0.2, 150)):
        y = 3.0 * x + level + np.tile(np.arange(12.0), 13)[:150]
        coefficient, plain, _ = seasonal.effects(y, x[:, None])
        assert coefficient[0] == pytest.approx(3.0, abs=0.25) and -1 < plain <= 1


def test_adjusted_series_side_by_side(spark):
    rng = np.random.default_rng(6)
    rows, parts = [], {}
    for s in ("a", "b", "short"):
        n = 20 if s == "short" else 120
        x = 50 + 0.2 * np.arange(n) + 5 * np.sin(np.arange(n) * np.pi / 6) + rng.normal(0, 0.3, n)
        feast = (rng.random(n) * (np.arange(n) % 12 < 2)) if s != "short" else np.zeros(n)
        parts[s] = x
        rows += [(s, dt.date(2000 + i // 12, 1 + i % 12, 1), float(x[i] + 10 * feast[i]), float(feast[i])) for i in range(n)] + [(s, dt.date(1990, 1, 1), None, 0.0)]
    df = spark.createDataFrame(rows, "series string, date date, value double, feast double").repartition(4)
    out = seasonal.seasonally_adjusted(df, 12, False, ["feast"]).toPandas().sort_values(["series", "date"])
    assert len(out) == 260
    for s in ("a", "b"):
        mine = out[out.series == s]
        assert np.abs(mine.effect + mine.adjusted + mine.seasonal - mine.value).max() < 1e-9
        assert np.abs(mine.value - mine.effect - parts[s]).max() < 1.0
    rolled = seasonal.rolling_adjusted(df, 60).toPandas().sort_values(["series", "date"])
    a = rolled[rolled.series == "a"].reset_index(drop=True)
    assert a.adjusted.isna().sum() == 59 and a.adjusted[80] == pytest.approx(seasonal.adjusted(a.value.to_numpy()[21:81])["adjusted"][-1])
    assert seasonal.seasonally_adjusted(df.where("false"), 12).count() == 0
