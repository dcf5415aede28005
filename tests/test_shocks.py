"""ARIMA by conditional likelihood against a plain fit, in one block and over many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import shocks
from tablewright.operators import timeseries as ts


def residuals(z, beta, p, q):
    """Shock after shock."""
    e = np.zeros(len(z))
    for t in range(p, len(z)):
        e[t] = z[t] - beta[0] - sum(beta[1 + i] * z[t - 1 - i] for i in range(p)) - sum(beta[1 + p + j] * e[t - 1 - j] for j in range(q) if t - 1 - j >= p)
    return e[p:]


def plain(z, beta, p, q):
    """Gauss-Newton with derivatives by differences and halved steps."""
    beta = np.array(beta, float)
    for _ in range(100):
        e = residuals(z, beta, p, q)
        g = np.stack([(residuals(z, beta + h, p, q) - residuals(z, beta - h, p, q)) / 2e-6 for h in np.eye(len(beta)) * 1e-6], axis=1)
        step, size = np.linalg.lstsq(g, -e, rcond=None)[0], 1.0
        while size > 1e-12 and (residuals(z, beta + size * step, p, q) ** 2).sum() > (e**2).sum():
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-11:
            break
    return beta, (residuals(z, beta, p, q) ** 2).sum()


def simulated(n, phi, theta, c, seed):
    rng = np.random.default_rng(seed)
    e, z = rng.normal(size=n), np.zeros(n)
    for t in range(n):
        z[t] = c + e[t] + sum(f * z[t - 1 - i] for i, f in enumerate(phi) if t > i) + sum(f * e[t - 1 - i] for i, f in enumerate(theta) if t > i)
    return z


def test_recursion_in_runs():
    rng = np.random.default_rng(91)
    for n, theta in ((1, [0.5]), (7, [0.4, -0.3]), (200, [1.1, -0.4, 0.2]), (3, [0.1, 0.2, 0.3, 0.4])):
        u, past, theta = rng.normal(size=(n, 3)), rng.normal(size=(len(theta), 3)), np.array(theta)
        v = list(past[::-1])
        for t in range(n):
            v.append(u[t] - sum(theta[j] * v[len(theta) + t - 1 - j] for j in range(len(theta))))
        np.testing.assert_allclose(shocks.recur(u, theta, past), v[len(theta) :], rtol=1e-9, atol=1e-12)


def test_derivatives_match_differences():
    z = simulated(60, [0.5], [0.3, 0.2], 1.0, 92)
    beta, rows = np.array([0.9, 0.4, 0.35, 0.1]), np.stack([z[1:], z[:-1]], axis=1)
    e, g = shocks.shocks(rows, beta, 1, 2, np.zeros((2, 5)))
    np.testing.assert_allclose(e, residuals(z, beta, 1, 2))
    for k in range(4):
        h = np.eye(4)[k] * 1e-6
        np.testing.assert_allclose(g[:, k], (residuals(z, beta + h, 1, 2) - residuals(z, beta - h, 1, 2)) / 2e-6, atol=1e-6)


@pytest.mark.parametrize("order, block_rows", [((1, 0, 1), 65_536), ((2, 1, 2), 65_536), ((1, 1, 1), 64), ((0, 0, 2), 50)])
def test_arima_equals_a_plain_fit(spark, order, block_rows):
    """Two series of different lengths, one of them without a key."""
    p, d, q = order
    model = {2: ([0.5, -0.3], [0.4, 0.2]), 1: ([0.6], [0.4]), 0: ([], [])}
    rows, want = [], {}
    for key, n in (("a", 400), (None, 250)):
        z = simulated(n, model[p][0], model[q][1], 0.3, 93 + n)
        y = np.cumsum(z) if d else z
        rows += [(key, i, i, float(v)) for i, v in enumerate(y)]
        z = np.diff(y, d)
        beta, sse = plain(z, [0.3, *model[p][0], *model[q][1]], p, q)
        m = len(z) - p
        want[key] = (m, beta, m * (np.log(2 * np.pi * sse / m) + 1) + 2 * (p + q + 2), residuals(z, beta, p, q), y)
    s = spark.createDataFrame(rows, "k string, t long, idx long, y double").repartition(3)
    got = {r.k: r for r in ts.arima(s, p, d, q, 3, ["k"], block_rows=block_rows).filter("step = 1").collect()}
    assert set(got) == set(want)
    for key, (m, beta, aic, e, y) in want.items():
        r = got[key]
        assert r.n == m and r.aic == pytest.approx(aic, rel=1e-6)
        np.testing.assert_allclose([r.intercept, *r.coefficients], beta, rtol=1e-6, atol=1e-6)
        z = np.diff(y, d)
        ahead = beta[0] + sum(beta[1 + i] * z[-1 - i] for i in range(p)) + sum(beta[1 + p + j] * e[-1 - j] for j in range(q))
        assert r.forecast == pytest.approx(ahead + (y[-1] if d else 0), rel=1e-6, abs=1e-6)


def test_short_and_empty_series(spark):
    s = spark.createDataFrame([(i, i, float(i % 3)) for i in range(2)], "t long, idx long, y double")
    assert ts.arima(s, 1, 1, 1, 3).collect() == []
    assert ts.arima(s.limit(0), 1, 0, 0, 3).collect() == []
    flat = spark.createDataFrame([(i, i, 4.0) for i in range(40)], "t long, idx long, y double")
    assert [round(r.forecast, 6) for r in ts.arima(flat, 1, 0, 0, 2).orderBy("step").collect()] == [4.0, 4.0]
