"""Searches over tiles: imputation from gappy donors and density clusters, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clustering, neighbours, tiles


def gaps_filled(x, k):
    """Every gap from all rows that have the column, equal distances sharing the last places."""
    n, d = x.shape
    out = x.copy()
    for i in range(n):
        for c in np.flatnonzero(np.isnan(x[i])):
            found = []
            for j in range(n):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, c]) and both.any():
                    found.append((d * ((x[i] - x[j])[both] ** 2).sum() / both.sum(), x[j, c]))
            left, total, took = k, 0.0, 0
            for far in sorted({f for f, _ in found}):
                own = [v for f, v in found if f == far]
                use = min(left, len(own))
                total, took, left = total + use * np.mean(own), took + use, left - use
            with np.errstate(invalid="ignore"):
                out[i, c] = total / took if took else np.nanmean(x[:, c])
    return out


def gappy(kind, n=160, d=6):
    rng = np.random.default_rng(71)
    x = rng.normal(size=(n, d)) if kind != "whole numbers" else rng.integers(0, 4, (n, d)).astype(float)
    if kind == "clustered":
        x += rng.integers(0, 5, (n, 1)) * 8
    x[rng.random(x.shape) < (0.55 if kind == "no complete row" else 0.2)] = np.nan
    if kind == "no complete row":
        x[np.arange(n), rng.integers(0, d, n)] = np.nan
    x[:3] = np.nan
    x[3, 1:] = np.nan
    x[4:30] = x[4]
    return x


def filled(spark, x, k, leaf):
    names = [f"v{i}" for i in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    got = neighbours.knn_impute(df, names, k, leaf)
    assert got.columns == df.columns
    return np.array([[np.nan if v is None else v for v in r[1:]] for r in sorted(got.collect())])


@pytest.mark.parametrize("kind, leaf, ks", [("scattered", 12, (5,)), ("clustered", 12, (1,)), ("whole numbers", 12, (5,)), ("no complete row", 4096, (1, 5))])
def test_imputation_from_gappy_donors(spark, kind, leaf, ks):
    x = gappy(kind)
    for k in ks:
        np.testing.assert_allclose(filled(spark, x, k, leaf), gaps_filled(x, k), rtol=1e-9, atol=1e-12)


def test_imputation_of_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert neighbours.knn_impute(empty, ["a", "b"]).collect() == []
    none = spark.createDataFrame([(None, None), (None, None)], "a double, b double")
    assert [tuple(r) for r in neighbours.knn_impute(none, ["a", "b"]).collect()] == [(None, None)] * 2
    one = spark.createDataFrame([(1.0, None), (None, 5.0), (float("nan"), 6.0)], "a double, b double")
    assert sorted(tuple(r) for r in neighbours.knn_impute(one, ["a", "b"]).collect()) == [(1.0, 5.0), (1.0, 5.5), (1.0, 6.0)]


def test_few_pairs_of_tiles_meet(spark):
    """Far clusters never meet: what is compared follows the clusters, not the square of the rows."""
    rng = np.random.default_rng(72)
    x = rng.normal(size=(800, 3)) * 0.01 + rng.integers(0, 20, (800, 1)) * 10
    x[::4, 2] = np.nan
    rows = [(i, 1, [float(v) for v in r]) for i, r in enumerate(x)]
    points = spark.createDataFrame(rows, "id long, w long, x array<double>")
    donors = tiles.tiled(points, 3, 16)
    asking = donors.filter(F.exists("x", lambda v: F.isnan(v)))
    there, here = tiles.boxes(donors), tiles.boxes(asking)
    limits = here.withColumn("limits", F.array(*[F.lit(1.0)] * 3))
    met = tiles.box_pairs(limits, there, (here.count(), there.count()), neighbours._visits(3)).count()
    assert 0 < met < 0.2 * here.count() * there.count()


def test_bounds_by_sets_of_columns():
    """The least and largest mean over all allowed sets of columns, against all of them."""
    rng = np.random.default_rng(73)
    v, must, may = rng.random((60, 5)), rng.random((60, 5)) < 0.3, rng.random((60, 5)) < 0.7
    may |= must
    for sign in (1, -1):
        got = neighbours._least_mean(v, must, may, sign)
        for r in range(60):
            sets = [s for s in range(1, 32) if all(s >> c & 1 or not must[r, c] for c in range(5)) and all(may[r, c] or not s >> c & 1 for c in range(5))]
            means = [np.mean([v[r, c] for c in range(5) if s >> c & 1]) for s in sets]
            assert np.isinf(got[r]) if not sets else got[r] == pytest.approx(sign * min(sign * m for m in means))


def density(z, eps, least):
    """Clusters by their least core row; a border row joins the first it touches."""
    near = np.sqrt(((z[:, None] - z) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = np.full(len(z), -1)
    for n, i in enumerate(np.flatnonzero(core)):
        if label[i] < 0:
            todo, label[i] = [i], label.max() + 1
            while todo:
                for m in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[m] = label[i]
                    todo.append(m)
    for i in np.flatnonzero(~core):
        touched = label[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    return label, core


@pytest.mark.parametrize("d, eps, leaf", [(1, 0.02, 8), (2, 0.3, 8), (8, 1.6, 4096), (40, 7.2, 16)])
def test_density_clusters(spark, d, eps, leaf):
    """Tight crowds whose tiles lie wholly within reach, copies, borders between clusters, and noise; in any order of the rows."""
    rng = np.random.default_rng(74 + d)
    x = rng.normal(size=(150, d))
    x = np.r_[x, rng.normal(size=(60, d)) * 0.01 + x[0] + 0.1, np.repeat(x[5:6], 30, axis=0), rng.normal(size=(60, d)) * 0.3 + 2]
    x = x[rng.permutation(len(x))]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    names = [f"v{i}" for i in range(d)]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in names))
    want, core = density(z, eps, 6)
    assert 0 < core.sum() < len(x) and (want < 0).any()
    got = sorted(map(tuple, clustering.dbscan(df.orderBy(F.desc("id")).repartition(3), "id", names, eps, 6, with_core=True, leaf=leaf).collect()))
    assert [g[1] for g in got] == want.tolist() and [g[2] for g in got] == core.tolist()


def test_density_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, x array<double>")
    assert clustering.density_labels(empty, "id", 0.5, 2).collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)] + [(9, [5.0, 5.0])], "id long, x array<double>")
    got = clustering.density_labels(same, "id", 0.5, 3)
    assert sorted((r.id, r.cluster, r.is_core) for r in got.collect()) == [(0, 0, True), (1, 0, True), (2, 0, True), (9, -1, False)]
    assert clustering.density_metrics(got) == {"k": 1, "n_noise": 1, "noise_ratio": 0.25, "silhouette": None}


def test_groups_of_links():
    rng = np.random.default_rng(75)
    a, b = rng.integers(0, 200, (2, 120))
    label = tiles.joined(tiles.joined(np.arange(200), a[:50], b[:50]), a[50:], b[50:])
    want = np.arange(200)
    for _ in range(200):
        for i, j in zip(a, b):
            want[i] = want[j] = min(want[i], want[j])
    assert label.tolist() == want.tolist()


def test_nearest_rows_read_their_donors_as_a_stream(spark, monkeypatch):
    """Many columns, where boxes rule out nothing: blocks of few queries, donors a batch at a time, no group of all donors in a task."""
    monkeypatch.setattr(neighbours, "ASKING", (32, 64))
    rng = np.random.default_rng(5)
    x, w = rng.normal(size=(500, 12)), rng.integers(1, 4, 500)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], int(w[i])) for i in range(500)], "did long, x array<double>, w long").checkpoint()
    found = neighbours.nearest_rows(rows.select(F.col("did").alias("qid"), "x"), rows, 6, same=True, leaf=50)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    got = {}
    for r in found.collect():
        assert abs(r.distance - d[r.qid, r.did]) < 1e-12
        got.setdefault(r.qid, []).extend([r.distance] * r.weight)
    for i in range(500):
        np.testing.assert_allclose(sorted(got[i]), np.sort(np.delete(np.repeat(d[i], w), w[:i].sum()))[:6], atol=1e-9)


def test_density_in_many_columns_takes_larger_tiles(spark, monkeypatch):
    """Where every tile meets every other, tiles grow, and the clusters stay."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(240, 10)) + rng.integers(0, 2, (240, 1)) * 4
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    used, cut = [], clustering.tiled
    monkeypatch.setattr(clustering, "tiled", lambda points, width, leaf: used.append(leaf) or cut(points, width, leaf))
    got = []
    for crowded in (10**9, 4):
        monkeypatch.setattr(clustering, "CROWDED", crowded)
        got.append(sorted((r.id, r.cluster, r.is_core) for r in clustering.density_labels(rows, "id", 4.0, 5, leaf=12).collect()))
    assert got[0] == got[1] and used == [12, 12, 60] and len({c for _, c, _ in got[0]}) > 1


def test_density_of_one_crowd_compares_few_tiles(spark, monkeypatch):
    """Where boxes rule out nothing but all is one cluster, each tile meets itself and one other, not all others; few points are asked for further."""
    rng = np.random.default_rng(19)
    x = np.r_[rng.normal(size=(300, 20)), rng.normal(size=(4, 20)) * 0.2 + 6]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    met, run = [], clustering.compare
    monkeypatch.setattr(clustering, "compare", lambda left, right, pairs, fn, schema: met.append((left.count() / left.select("tile").distinct().count(), pairs.count())) or run(left, right, pairs, fn, schema))
    want, core = density(x, 6.5, 8)
    got = sorted((r.id, r.cluster, r.is_core) for r in clustering.density_labels(rows, "id", 6.5, 8, leaf=4).collect())
    assert [g[1] for g in got] == want.tolist() and [g[2] for g in got] == core.tolist()
    tiles = rows.count() / 4
    assert len(met) >= 3 and sum(pairs for _, pairs in met) < 12 * tiles < tiles * tiles / 4


def test_within_of_many_columns_decides_ties_exactly():
    """Single products are trusted only where rounding cannot decide."""
    rng = np.random.default_rng(21)
    x, y = rng.normal(size=(60, 64)), rng.normal(size=(80, 64)) + 1
    far = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))
    for radius in [*far.ravel()[:40], 11.0, 0.01]:
        want = np.array([((a - y) ** 2).sum(axis=1) <= radius * radius for a in x])
        np.testing.assert_array_equal(tiles.within(x, y, radius), want)
