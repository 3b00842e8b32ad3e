import numpy as np
import pandas as pd
import pytest

from eventspark.operators import smoothing as sm


def series(spark, *ys):
    rows = [(name, i, float(v)) for name, y in ys for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "s string, k bigint, y double")


def column(df, name):
    pdf = df.toPandas()
    return pdf[pdf["s"] == name].sort_values("k")["smooth"].to_numpy()


def test_ema_golden(spark):
    got = column(sm.ema(series(spark, ("a", [1, 2, 3])), "s", "k", "y", 0.02), "a")
    assert np.allclose(got, [1, 1.02, 1.0596])


@pytest.mark.parametrize("alpha", [0.002, 0.02, 0.5, 0.97, 1.0])
def test_ema_equals_recursion(spark, alpha):
    y = np.random.default_rng(0).normal(5, 3, 3000)
    got = column(sm.ema(series(spark, ("a", y), ("b", -y[:40])), "s", "k", "y", alpha), "a")
    expected = pd.Series(y).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    assert np.allclose(got, expected, rtol=1e-11, atol=1e-12)


@pytest.mark.parametrize("method", ["mean", "median", "median_then_mean"])
def test_rolling_in_small_chunks(spark, method):
    y = np.random.default_rng(1).normal(size=400)
    got = column(sm.rolling(series(spark, ("a", y), ("b", y[:7])), "s", "k", "y", 11, method, chunk=32), "a")
    s = pd.Series(y)
    if method == "mean":
        expected = s.rolling(11, center=True, min_periods=1).mean()
    else:
        expected = s.rolling(11, center=True, min_periods=1).median()
        if method == "median_then_mean":
            expected = expected.rolling(11, center=True, min_periods=1).mean()
    assert np.allclose(got, expected)


def savgol_whole(y, window, poly):
    """Each point by a fit of its own window; the ends by the fit of the first and last window."""
    half, n = window // 2, len(y)
    out = np.empty(n)
    for i in range(n):
        start = min(max(i - half, 0), n - window)
        places = np.arange(window) - half
        out[i] = np.polyval(np.polyfit(places, y[start:start + window], poly), i - start - half)
    return out


def test_savgol_in_small_chunks(spark):
    y = np.random.default_rng(4).normal(size=333).cumsum()
    df = series(spark, ("a", y), ("short", y[:9]))
    out = sm.savgol(df, "s", "k", "y", 20, 3, chunk=40)  # an even window becomes 21
    assert np.allclose(column(out, "a"), savgol_whole(y, 21, 3))
    assert np.allclose(column(out, "short"), y[:9])


def test_bin_average(spark):
    got = sm.bin_average(series(spark, ("a", [1, 2, 3, 4, 5, 6, 100])), "s", "k", ["y"], 3).orderBy("group").collect()
    assert [r.y for r in got] == [2, 5]


def test_ema_keeps_a_nan_and_a_huge_start(spark):
    y = np.ones(400)
    y[3] = np.nan
    z = np.ones(120)
    z[0] = 1e30
    got = sm.ema(series(spark, ("a", y), ("b", z)), "s", "k", "y", 0.5).toPandas().sort_values("k")
    a, b = (got[got["s"] == n]["smooth"].to_numpy() for n in "ab")
    assert np.isfinite(a[:3]).all() and np.isnan(a[3:]).all()
    assert np.allclose(b, pd.Series(z).ewm(alpha=0.5, adjust=False).mean(), rtol=1e-9)


def test_ema_over_several_runs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sm, "CHUNK", 7)
    y = np.random.default_rng(4).normal(5, 3, 900)
    got = column(sm.ema(series(spark, ("a", y)), "s", "k", "y", 0.3), "a")
    assert np.allclose(got, pd.Series(y).ewm(alpha=0.3, adjust=False).mean(), rtol=1e-11)


def test_rolling_mean_skips_nan(spark):
    y = [1.0, 1.0, float("nan"), 1.0, 1.0]
    assert np.allclose(column(sm.rolling(series(spark, ("a", y)), "s", "k", "y", 3, "mean"), "a"), 1.0)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_ema_over_range_partitions(spark, monkeypatch, parts):
    from eventspark.operators import ordering

    monkeypatch.setattr(ordering, "PARTITIONS", parts)
    rng = np.random.default_rng(parts)
    data = {name: rng.normal(size=n) for name, n in (("a", 200), ("b", 1), ("c", 60), ("d", 3), ("e", 300))}
    data["c"][7], data["e"][250] = float("nan"), float("inf")
    got = sm.ema(series(spark, *[(k, list(v)) for k, v in data.items()]), "s", "k", "y", 0.3).toPandas().sort_values(["s", "k"])
    for name, x in data.items():
        want, y = [], None
        for v in x:
            y = v if y is None else 0.3 * v + 0.7 * y
            want.append(y)
        np.testing.assert_allclose(got.loc[got["s"] == name, "smooth"].to_numpy(), want, rtol=1e-12)
