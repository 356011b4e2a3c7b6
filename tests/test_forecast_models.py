"""The forecasting models: exact likelihood, sparse slope changes, bands that widen, short and constant series."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import autoregression as ar
from meterlake.operators import forecast


def _simulated(phi, n, s, seed=0):
    rng = np.random.default_rng(seed)
    d = np.zeros((s, n + 200))
    for t in range(len(phi), n + 200):
        d[:, t] = sum(c * d[:, t - 1 - i] for i, c in enumerate(phi)) + rng.normal(size=s)
    return d[:, 200:]


def _dense(phi, sigma2, y):
    """Log density of the days that are known, from the whole covariance matrix."""
    n = len(y)
    psi = np.zeros(4000)
    psi[0] = 1
    for j in range(1, 4000):
        psi[j] = sum(c * psi[j - 1 - i] for i, c in enumerate(phi) if j - 1 - i >= 0)
    gamma = [sigma2 * float(psi[: 4000 - k] @ psi[k:]) for k in range(n)]
    cov = np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])
    known = ~np.isnan(y)
    cov, y = cov[np.ix_(known, known)], y[known]
    sign, logdet = np.linalg.slogdet(cov)
    return -0.5 * (len(y) * math.log(2 * math.pi) + logdet + y @ np.linalg.solve(cov, y))


PHI = (0.4, -0.3, 0.2, 0.1, -0.2)


@pytest.mark.parametrize("gaps", [False, True])
def test_likelihood_is_the_dense_gaussian_one(gaps):
    y = _simulated(PHI, 60, 3)
    if gaps:
        y[0, [0, 7, 8, 30]] = y[2, 59] = np.nan
    phi = ar.from_partial(np.tanh(np.array([[0.3, -0.5, 0.1, 0.4, -0.2]] * 3)))
    squares, logs, n = ar.Likelihood(y, 5).parts(phi, np.arange(3))
    got = ar.Likelihood(y, 5)(phi, np.arange(3))
    for k in range(3):
        assert math.isclose(got[k], _dense(phi[k], squares[k] / n[k], y[k]), rel_tol=1e-9)


def test_fit_is_a_maximum_and_finds_the_coefficients():
    y = _simulated(PHI, 3000, 2)
    phi, sigma2, loglik = ar.fit(y, 5)
    assert np.abs(phi - PHI).max() < 0.08 and np.abs(sigma2 - 1).max() < 0.1
    like = ar.Likelihood(y, 5)
    rng = np.random.default_rng(1)
    for _ in range(40):
        assert (like(phi + rng.normal(size=(2, 5)) * 0.01, np.arange(2)) <= loglik + 1e-6).all()
    short = _simulated(PHI, 8, 50)
    phi, sigma2, loglik = ar.fit(short, 5)
    assert np.isfinite(loglik).all() and all(np.abs(np.linalg.eigvals(m)).max() < 1 for m in ar.companion(phi))


def test_constant_series():
    phi, sigma2, _ = ar.fit(np.zeros((2, 40)), 5)
    assert not phi.any() and not sigma2.any()


def _frame(spark):
    rng = np.random.default_rng(3)
    day = lambda i: dt.date(2021, 1, 1) + dt.timedelta(days=i)
    rows = [("long", day(i), float(v)) for i, v in enumerate(np.cumsum(_simulated(PHI, 120, 1)[0]) + 50)]
    rows += [("short", day(i), float(i)) for i in range(6)] + [("flat", day(i), 4.0) for i in range(40)]
    rows += [(None, day(i), float(v)) for i, v in enumerate(rng.normal(size=60))]
    return spark.createDataFrame(rows, "k string, ds date, y double")


def test_every_series_has_a_row_and_short_ones_a_reason(spark):
    train = _frame(spark)
    steps = train.select("k").distinct().withColumn("_steps", F.lit(9))
    fits = {r["k"]: r for r in forecast.fit_arima(train, steps, ["k"]).collect()}
    assert set(fits) == {"long", "short", "flat", None}
    assert fits["short"]["reason"] == forecast.TOO_SHORT and fits["short"]["phi"] is None and fits["short"]["n_days"] == 6
    assert all(fits[k]["reason"] is None for k in ("long", "flat", None))
    got = forecast.forecast_arima(train, steps, ["k"])
    assert {(r["k"], r["count"]) for r in got.groupBy("k").count().collect()} == {("long", 9), ("flat", 9), (None, 9)}
    flat = got.where("k = 'flat'").collect()
    assert all(r["yhat"] == r["yhat_lower"] == r["yhat_upper"] == 4.0 for r in flat)
    width = [r["yhat_upper"] - r["yhat_lower"] for r in got.where("k = 'long'").orderBy("ds").collect()]
    assert all(b > a for a, b in zip(width, width[1:], strict=False))


def test_forecast_mean_follows_the_recursion(spark):
    train = _frame(spark).where("k = 'long'")
    one = train.select("k").distinct().withColumn("_steps", F.lit(3))
    r = forecast.fit_arima(train, one, ["k"]).first()
    y = [x["y"] for x in train.orderBy("ds").collect()]
    for f in r["forecast"]:
        d = np.diff(y)[::-1][:5]
        y.append(y[-1] + float(np.dot(r["phi"], d)))
        assert math.isclose(f["yhat"], y[-1], rel_tol=1e-9)


def test_sparse_changes_satisfy_their_conditions():
    """Slope changes of an absolute penalty: the gradient is at the penalty where they are not zero, below it elsewhere, and zero for all other features."""
    rng = np.random.default_rng(5)
    n, changes = 400, slice(2, 2 + forecast.N_CHANGEPOINTS)
    t = np.linspace(0, 1, n)
    cps = np.arange(1, 26) / 31
    season = [f(2 * math.pi * k * np.arange(n) / 7) for k in (1, 2, 3) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones(n), t, *[np.maximum(t - s, 0) for s in cps], *season])
    y = 0.3 + 0.5 * t - 1.2 * np.maximum(t - cps[9], 0) + 0.05 * season[0] + rng.normal(size=n) * 0.02
    beta, sigma = forecast.sparse_coefficients(x.T @ x, x.T @ y, float(y @ y), n, changes, 0.05, 0.01, rounds=50)
    gradient = x.T @ (y - x @ beta)
    penalty = sigma * sigma / 0.05
    own, delta = gradient[changes], beta[changes]
    assert (np.abs(own) <= penalty * (1 + 1e-3) + 1e-9).all()
    assert np.allclose(own[delta != 0], penalty * np.sign(delta[delta != 0]), rtol=1e-3)
    assert np.abs(gradient[:2]).max() < 1e-6 and np.allclose(gradient[27:], 0.01 * beta[27:], atol=1e-6)
    assert 1 <= (np.abs(delta) > 1e-3).sum() <= 6 and abs(delta[8:12].sum() + 1.2) < 0.25 and abs(sigma - 0.02) < 0.004


def test_band_of_the_additive_model_widens(spark):
    """Where the trend has bent before, it may bend again: the band grows with every step ahead. A straight trend keeps the residuals' band."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1000):
        noise = float(rng.normal())
        rows += [("bent", dt.date(2019, 1, 1) + dt.timedelta(days=i), 10 + 0.1 * i - 0.2 * max(i - 450, 0) + noise), ("straight", dt.date(2019, 1, 1) + dt.timedelta(days=i), 10 + 0.1 * i + noise)]
    split = spark.createDataFrame(rows, "k string, ds date, y double").withColumn("is_train", F.lit(True))
    steps = spark.createDataFrame([("bent", 60), ("straight", 60)], "k string, _steps int")
    out = forecast.forecast_additive(split, steps, ["k"]).orderBy("k", "ds").collect()
    width = [r["yhat_upper"] - r["yhat_lower"] for r in out if r["k"] == "bent"]
    straight = [r["yhat_upper"] - r["yhat_lower"] for r in out if r["k"] == "straight"]
    assert len(width) == 1060 and max(width[:1000]) - min(width[:1000]) < 1e-9
    assert all(b > a for a, b in zip(width[1000:], width[1001:], strict=False)) and width[-1] > 1.001 * width[0]
    assert straight[-1] - straight[0] < width[-1] - width[0]


def test_runs_with_series_that_are_too_short(spark):
    chain = forecast.run_forecasts(_frame(spark).select("k", F.col("ds").cast("timestamp_ntz").alias("ts"), (F.col("y") * 60).alias("kw")), ["k"], horizon=7)
    assert chain["metrics"].count() == 3 and set(r["k"] for r in chain["arima"].select("k").distinct().collect()) == {"long", "flat", None}
