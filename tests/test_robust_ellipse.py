"""The robust ellipse under heavy contamination, against a plain single start."""

import math

import numpy as np
import pytest

from tablewright.operators import anomaly


def single_start(x, share, steps=100):
    """Concentration from the ellipse of all rows."""
    n, d = x.shape
    mean, cov = x.mean(axis=0), np.cov(x.T, bias=True).reshape(d, d)
    for _ in range(steps):
        far = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
        near = x[far <= np.quantile(far, share)]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True).reshape(d, d)
    return np.linalg.slogdet(cov)[1]


def contaminated(n=1000, share=0.4, d=3):
    rng = np.random.default_rng(121)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0] * np.array([1.0, 2.0, 0.5])[:d]
    clean = rng.normal(size=(n - int(n * share), d)) @ turn.T
    strange = rng.normal(size=(int(n * share), d)) * 0.4 + 9
    return np.r_[clean, strange], len(clean)


@pytest.mark.parametrize("share", [0.4, 0.05])
def test_clean_ellipse_is_found(spark, share):
    x, clean = contaminated(share=share)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(4)
    mean, cov, logdet = anomaly.robust_ellipse(df.select("x"), 3)
    n, d = x.shape
    assert logdet <= single_start(x, max((n + d + 1) / 2 / n, 0.5)) + 1e-6
    assert np.abs(mean - x[:clean].mean(axis=0)).max() < 0.6
    shape = lambda c: c / np.exp(np.linalg.slogdet(c)[1] / d)
    assert np.abs(np.linalg.solve(shape(np.cov(x[:clean].T)), shape(cov)) - np.eye(d)).max() < 0.5


def test_labels_under_contamination(spark):
    x, clean = contaminated()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(4)
    got = anomaly.elliptic_envelope(df, "id", contamination=0.4).toPandas().set_index("id").sort_index()
    assert (got["label"].to_numpy()[clean:] == -1).all() and (got["label"].to_numpy()[:clean] == 1).mean() > 0.98
    # Reweighted distances of the clean rows are those of their own ellipse.
    own = x[:clean] - x[:clean].mean(axis=0)
    want = np.einsum("ij,jk,ik->i", own, np.linalg.inv(np.cov(own.T)), own)
    assert np.corrcoef(got["score"].to_numpy()[:clean], want)[0, 1] > 0.98


def test_quantile_of_chi_square():
    for df, tail, want in ((1, 0.025, 5.023886187), (3, 0.5, 2.365973884), (10, 0.025, 20.48317735)):
        assert math.isclose(anomaly._chi2_upper(tail, df), want, rel_tol=1e-8)


def test_degenerate_rows(spark):
    flat = spark.createDataFrame([(i, 1.0, float(i % 2)) for i in range(12)], "id long, a double, b double")
    assert anomaly.elliptic_envelope(flat, "id").count() == 12
