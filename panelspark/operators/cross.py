"""Cross-sectional operators: every date's rows are one group.

All take a panel and column names and add or replace columns; nulls stay null unless said otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.maths import normal_quantile
from panelspark.operators.align import as_table, parts_of

#: Steps from one power of two to the next in which ranks are counted apart.
STEPS = 1024


def _over(by: str | list[str]):
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def limited(df: DataFrame, x: str, low: Column, high: Column, drop: bool = False) -> DataFrame:
    """df with x clipped to [low, high], or with `drop` null unless strictly inside."""
    v = F.col(x)
    inside = F.when((v > low) & (v < high), v)
    clipped = F.when(v.isNotNull(), F.least(F.greatest(v, low), high))
    return df.withColumn(f"{x}_after_drop_outlier", inside if drop else clipped)


def outliers_by_ratio(df: DataFrame, x: str, by: str = "date", ratio: float = 0.1, drop: bool = False) -> DataFrame:
    # bounds are aggregated and joined: a window would hold all rows of a date for each
    bounds = df.groupBy(F.col(by).alias("_by")).agg(F.percentile(x, F.array(F.lit(ratio), F.lit(1 - ratio))).alias("_q"))
    rows = df.join(bounds, F.col(by).eqNullSafe(F.col("_by")), "left")
    return limited(rows, x, F.get("_q", F.lit(0)), F.get("_q", F.lit(1)), drop).drop("_by", "_q")


def outliers_by_deviation(df: DataFrame, x: str, by: str = "date", alpha: float = 3.0, drop: bool = False) -> DataFrame:
    mean, sd = F.avg(x).over(_over(by)), F.stddev_samp(x).over(_over(by))
    return limited(df, x, mean - alpha * sd, mean + alpha * sd, drop)


def outliers_by_mad(df: DataFrame, x: str, by: str = "date", alpha: float = 3.0, drop: bool = False) -> DataFrame:
    df = df.withColumn("_mid", F.median(x).over(_over(by)))
    df = df.withColumn("_mad", F.median(F.abs(F.col(x) - F.col("_mid"))).over(_over(by)))
    return limited(df, x, F.col("_mid") - alpha * F.col("_mad"), F.col("_mid") + alpha * F.col("_mad"), drop).drop("_mid", "_mad")


def medcouple(values: np.ndarray) -> float:
    """Median of the kernel over all pairs of a value above and one below the median; 0 if there is no pair.

    The kernel falls along both sorted sides, so the pairs above a bound are counted by bisection, never listed.
    """
    mid = np.median(values) if len(values) else 0.0
    up, down = np.sort(values[values > mid])[::-1] - mid, mid - np.sort(values[values < mid])
    if not len(up) or not len(down):
        return 0.0
    total = len(up) * len(down)

    def kth(k: int) -> float:
        """The k-th smallest (from 1): bisect the ratio up/down, of which the kernel is (r - 1) / (r + 1)."""
        low, high = -1.0, 1.0
        rising = np.sort(down)
        for _ in range(80):
            bound = (low + high) / 2
            # h <= bound  <=>  up * (1 - bound) <= down * (1 + bound)
            n = len(rising) * len(up) - np.searchsorted(rising, up * (1 - bound) / (1 + bound), side="left").sum() if bound > -1 else 0
            low, high = (low, bound) if n >= k else (bound, high)
        return high

    return (kth((total + 1) // 2) + kth(total // 2 + 1)) / 2


def outliers_by_box(df: DataFrame, x: str, by: str = "date", drop: bool = False) -> DataFrame:
    """Box-plot bounds adjusted for skewness by the medcouple, which is computed per group over its sorted values."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_by": [pdf["_by"].iloc[0]], "_mc": [medcouple(pdf["_x"].dropna().to_numpy(float))]})

    narrow = df.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x"))
    kind = dict(narrow.dtypes)["_by"]
    skew = narrow.groupBy("_by").applyInPandas(one, f"_by {kind}, _mc double")
    q1, q3 = (F.percentile(x, F.lit(r)).over(_over(by)) for r in (0.25, 0.75))
    df = df.join(skew, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("_q1", q1).withColumn("_q3", q3)
    right, mc, iqr = F.col("_mc") >= 0, F.col("_mc"), F.col("_q3") - F.col("_q1")
    low = F.col("_q1") - 1.5 * F.exp(F.when(right, -3.5).otherwise(-4.0) * mc) * iqr
    high = F.col("_q3") + 1.5 * F.exp(F.when(right, 4.0).otherwise(3.5) * mc) * iqr
    return limited(df, x, low, high, drop).drop("_by", "_mc", "_q1", "_q3")


def outliers_by_squeeze(df: DataFrame, x: str, by: str = "date") -> DataFrame:
    """z-scores beyond 3 are drawn in so that the largest comes to at most 3.5; likewise below -3."""
    mean, sd = F.avg(x).over(_over(by)), F.stddev_samp(x).over(_over(by))
    df = df.withColumn("_z", (F.col(x) - mean) / F.nullif(sd, F.lit(0.0)))
    z, top, bottom = F.col("_z"), F.max("_z").over(_over(by)), F.min("_z").over(_over(by))
    pull = lambda far: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 / F.nullif(far - 3, F.lit(0.0))))
    up, down = pull(top), pull(-bottom)
    out = F.when(z > 3, 3 * (1 - up) + z * up).when(z < -3, -3 * (1 - down) + z * down).otherwise(z)
    return df.withColumn(f"{x}_after_drop_outlier", out).drop("_z")


def standardised(df: DataFrame, x: str, by: str = "date", mean_weight: str | None = None, std_weight: str | None = None, out: str | None = None) -> DataFrame:
    """z-scores; spread 0 gives 0, weights that sum to 0 give null. The spread is about the unweighted mean."""
    w, v = _over(by), F.col(x)
    plain = F.avg(v).over(w)
    given = lambda c: F.when(v.isNotNull(), F.col(c) if c else F.lit(1.0))
    mean = F.sum(v * given(mean_weight)).over(w) / F.nullif(F.sum(given(mean_weight)).over(w), F.lit(0.0))
    df = df.withColumn("_mean", mean).withColumn("_dev", v - plain)
    square = F.sum(F.col("_dev") * F.col("_dev") * given(std_weight)).over(w) / F.nullif(F.sum(given(std_weight)).over(w), F.lit(0.0))
    z = F.when(square == 0, F.when(v.isNotNull(), 0.0)).otherwise((v - F.col("_mean")) / F.sqrt(square))
    return df.withColumn(out or f"{x}_std", z).drop("_mean", "_dev")


def standardised_by_rank(df: DataFrame, x: str, by: str = "date", out: str | None = None) -> DataFrame:
    """Distinct values spread evenly over (0, 1), as normal quantiles, as z-scores; one distinct value gives null."""
    out, n, q = out or f"{x}_qt", F.col("_n"), F.col("_q")
    values = df.where(F.col(x).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(x).alias("_x")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_by")
    ranked = values.withColumn("_rank", F.row_number().over(w.orderBy("_x"))).withColumn("_most", F.count("*").over(w))
    p = 1e-6 + (F.col("_rank") - 1) * (1 - 2e-6) / F.nullif(F.col("_most") - 1, F.lit(0))
    ranked = ranked.withColumn("_q", normal_quantile(p)).withColumn("_mean", F.sum(n * q).over(w) / F.sum(n).over(w))
    spread = F.sqrt(F.sum(n * (q - F.col("_mean")) * (q - F.col("_mean"))).over(w) / F.sum(n).over(w))
    ranked = ranked.select("_by", "_x", ((q - F.col("_mean")) / F.nullif(spread, F.lit(0.0))).alias(out))
    return df.join(ranked, F.col(by).eqNullSafe(F.col("_by")) & (F.col(x) == F.col("_x")), "left").drop("_by", "_x")


def combined(df: DataFrame, factors: list[str], weights: list[float], out: str = "combined") -> DataFrame:
    """Weighted mean over the factors that are there; null if none is."""
    top = sum((F.coalesce(F.col(f) * w, F.lit(0.0)) for f, w in zip(factors, weights, strict=True)), F.lit(0.0))
    bottom = sum((F.when(F.col(f).isNotNull(), w).otherwise(0.0) for f, w in zip(factors, weights, strict=True)), F.lit(0.0))
    return df.withColumn(out, top / F.nullif(bottom, F.lit(0.0)))


def filled_by_group(df: DataFrame, x: str, group: list[str], quantile: float | None = None, out: str | None = None) -> DataFrame:
    """Nulls of x replaced by the group's mean, or its quantile."""
    w = _over(group)
    return df.withColumn(out or x, F.coalesce(F.col(x), F.avg(x).over(w) if quantile is None else F.percentile(x, F.lit(quantile)).over(w)))


def filled_by_line(df: DataFrame, y: str, x: str, by: str | list[str] = "date", out: str | None = None) -> DataFrame:
    """Nulls of y replaced by the group's least-squares line over x."""
    w, both = _over(by), F.col(y).isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    mx, my = F.avg(a).over(w), F.avg(b).over(w)
    df = df.withColumn("_mx", mx).withColumn("_my", my)
    sxy = F.sum((a - F.col("_mx")) * (b - F.col("_my"))).over(w)
    sxx = F.sum((a - F.col("_mx")) * (a - F.col("_mx"))).over(w)
    line = F.col("_my") + sxy / F.nullif(sxx, F.lit(0.0)) * (F.col(x) - F.col("_mx"))
    return df.withColumn(out or y, F.coalesce(F.col(y), line)).drop("_mx", "_my")


def gram_betas(df: DataFrame, y: str, xs: list[str], by: str = "date") -> DataFrame:
    """Least-squares coefficients of y on xs per group: sums in Spark, one small solve a group."""
    complete = df.where(" and ".join(f"`{c}` is not null" for c in [y, *xs]))
    cells = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    sums = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"_g{i}_{j}") for i, j in cells] + [F.sum(F.col(x) * F.col(y)).alias(f"_r{i}") for i, x in enumerate(xs)]
    gram = complete.groupBy(by).agg(*sums)
    kind, k = dict(gram.dtypes)[by], len(xs)

    def solve(batches):
        for pdf in batches:
            g = np.zeros((len(pdf), k, k))
            for i, j in cells:
                g[:, i, j] = g[:, j, i] = pdf[f"_g{i}_{j}"]
            r = pdf[[f"_r{i}" for i in range(k)]].to_numpy(float)
            beta = np.array([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(g, r, strict=True)]).reshape(-1, k)
            yield pd.DataFrame({by: pdf[by]} | {f"_b{i}": beta[:, i] for i in range(k)})

    return gram.mapInPandas(solve, f"{by} {kind}, " + ", ".join(f"_b{i} double" for i in range(k)))


def orthogonalised(df: DataFrame, y: str, xs: list[str], by: str = "date", constant: bool = False, out: str | None = None) -> DataFrame:
    """Residual of y on xs per group, no constant unless asked for; rows without all values get null."""
    names = list(xs)
    if constant:
        df, names = df.withColumn("_one", F.lit(1.0)), [*xs, "_one"]
    joined = df.join(gram_betas(df, y, names, by), by, "left")
    fit = sum((F.col(f"_b{i}") * F.col(x) for i, x in enumerate(names)), F.lit(0.0))
    return joined.withColumn(out or f"{y}_resid", F.col(y) - fit).drop(*(f"_b{i}" for i in range(len(names))), "_one")


def neutralised(df: DataFrame, y: str, size: str, industry: str, by: str = "date", out: str | None = None) -> DataFrame:
    """Residual of y on industry dummies (the first by name left out) and log size, without a constant.

    Demeaning within industries, but not in the one left out, leaves one regressor (Frisch-Waugh).
    """
    w, cell = _over(by), _over([by, industry])
    ok = F.col(y).isNotNull() & (F.col(size) > 0) & F.col(industry).isNotNull()
    df = df.withColumn("_y", F.when(ok, F.col(y))).withColumn("_x", F.when(ok, F.log(F.col(size) / 1e4)))
    first = F.col(industry) == F.min(F.when(ok, F.col(industry))).over(w)
    df = df.withColumn("_ty", F.col("_y") - F.when(first, 0.0).otherwise(F.avg("_y").over(cell))).withColumn("_tx", F.col("_x") - F.when(first, 0.0).otherwise(F.avg("_x").over(cell)))
    beta = F.sum(F.col("_tx") * F.col("_ty")).over(w) / F.nullif(F.sum(F.col("_tx") * F.col("_tx")).over(w), F.lit(0.0))
    return df.withColumn(out or f"{y}_neutral", F.col("_ty") - beta * F.col("_tx")).drop("_y", "_x", "_ty", "_tx")


def symmetric_orthogonal(df: DataFrame, factors: list[str], by: str = "date") -> DataFrame:
    """Factors times the inverse root of their scatter matrix; nulls are the date's mean. Sums in Spark, one root a date."""
    w = _over(by)
    for f in factors:
        df = df.withColumn(f, F.coalesce(F.col(f), F.avg(f).over(w)))
    k = len(factors)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    gram = df.groupBy(by).agg(*(F.sum(F.col(factors[i]) * F.col(factors[j])).alias(f"_g{i}_{j}") for i, j in cells))
    kind = dict(gram.dtypes)[by]

    def root(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), k, k))
            for i, j in cells:
                m[:, i, j] = m[:, j, i] = pdf[f"_g{i}_{j}"]
            m = np.nan_to_num(m)
            values, vectors = np.linalg.eigh(m)
            inverse = (vectors * np.where(values > 1e-12 * values.max(axis=1, keepdims=True), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)[:, None, :]) @ vectors.transpose(0, 2, 1)
            yield pd.DataFrame({by: pdf[by]} | {f"_s{i}_{j}": inverse[:, i, j] for i in range(k) for j in range(k)})

    roots = gram.mapInPandas(root, f"{by} {kind}, " + ", ".join(f"_s{i}_{j} double" for i in range(k) for j in range(k)))
    joined = df.join(roots, by, "left")
    new = {f"{f}_orth": sum((F.col(g) * F.col(f"_s{i}_{j}") for i, g in enumerate(factors)), F.lit(0.0)) for j, f in enumerate(factors)}
    return joined.withColumns(new).drop(*(f"_s{i}_{j}" for i in range(k) for j in range(k)))


def step_of(x: str) -> Column:
    """A whole number that never falls as x rises, by the sign and the power of two of x in steps; nan comes last, as in sorting."""
    v = F.col(x).cast("double")
    size = F.floor(F.greatest(F.least(F.log2(F.abs(v)), F.lit(1024.0)), F.lit(-1080.0)) * STEPS) + 1100 * STEPS
    return F.when(F.isnan(v), 4096 * STEPS).when(v == 0, 0).otherwise(F.when(v < 0, -size).otherwise(size))


def average_ranks(rows: DataFrame, source: DataFrame, x: str, keys: list[str], parts: int) -> DataFrame:
    """rows with x as its rank among the rows of the keys, ties sharing the mean rank.

    Rows are ranked within a step of x, so that a key's rows are spread over tasks, and moved on by the number of rows in the
    steps before. source: the same rows, from which steps are counted. Equal values, and those that lie closer than a
    step, are in one task.
    """
    step = F.struct(*keys, step_of(x).alias("_step")).alias("_at")
    sizes = source.groupBy(step).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(F.col("_at")[k] for k in keys)).orderBy(F.col("_at")["_step"]).rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_moved"))
    order = Window.partitionBy("_at").orderBy(x)
    rank = F.rank().over(order) + (F.count("*").over(order.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
    ranked = rows.withColumn("_at", step).repartition(parts, "_at").withColumn("_rank", rank)
    return ranked.join(moved, "_at").withColumn(x, F.col("_rank") + F.col("_moved")).drop("_at", "_rank", "_moved")


def correlations(df: DataFrame, factors: list[str], by: str = "date", method: str = "spearman") -> DataFrame:
    """by, left, right, corr of every two factors, over the rows that have both."""
    df = as_table(df.select(by, *factors))  # else the panel would be made anew for every use below
    # a factor's correlation with itself is 1 (nan if it is constant), ranked or not
    alone = df.unpivot([by], factors, "left", "x").where("x is not null").groupBy(by, "left").agg(F.corr("x", "x").alias("corr"))
    alone = alone.select(by, "left", F.col("left").alias("right"), "corr")
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    if not pairs:
        return alone
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("_pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)))).alias("p")
    rows = source = df.select(by, sides).select(by, "p.*").where("x is not null and y is not null")
    if method == "spearman":
        for side in "x", "y":
            rows = average_ranks(rows, source, side, [by, "_pair"], parts_of(df, len(pairs)))
    found = rows.groupBy(by, "_pair").agg(F.corr("x", "y").alias("corr"))
    names = (F.get(F.array(*(F.lit(p[k]) for p in pairs)), F.col("_pair")).alias(n) for k, n in enumerate(("left", "right")))
    return found.select(by, *names, "corr").unionByName(alone)


def industry_return(df: DataFrame, ret: str, mv: str, industry: str, by: str = "date") -> DataFrame:
    """Returns of industries, weighted by the root of market value."""
    w = F.sqrt(F.when(F.col(ret).isNotNull(), F.col(mv)))
    return df.groupBy(by, industry).agg((F.sum(F.col(ret) * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("industry_return"))
