"""Operators with their own distributed algorithm, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import anomaly, clustering, lineage, neighbours, reduction
from tablewright.operators import timeseries as ts
from tablewright.sources.ingest import ingest
from tablewright.streaming import events


def _points(n, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    x = np.r_[rng.normal(size=(n, 2)), rng.normal(loc=4, scale=0.3, size=(n // 3, 2))]
    if copies:
        x = np.r_[x, np.repeat(x[:1], copies, axis=0)]
    return x


def test_knn_is_exact_with_copies(spark):
    x = _points(300, copies=150)
    rows = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "did string, x array<double>")
    unique = rows.groupBy("x").agg(F.min("did").alias("did"), F.count(F.lit(1)).alias("w"))
    got = neighbours.knn(rows.select(F.col("did").alias("qid"), "x"), unique, 7)
    table = got.groupBy("qid").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("distance")).alias("d")).toPandas().set_index("qid")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, :7].sum(axis=1)
    assert (table["w"] == 7).all() and len(table) == len(x)
    np.testing.assert_allclose(table.loc[[str(i) for i in range(len(x))], "d"], want, atol=1e-9)


def test_dbscan_matches_brute_force(spark):
    x = _points(150, 3, copies=60)
    frame = pd.DataFrame({"id": range(len(x)), "x": x[:, 0], "y": x[:, 1]})
    got = clustering.dbscan(ingest(spark, frame), "id", ["x", "y"], 0.3, 5).toPandas().set_index("id")["cluster"]
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    near = np.sqrt(((z[:, None] - z) ** 2).sum(axis=2)) <= 0.3
    core = near.sum(axis=1) >= 5
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & (label < 0)):
                    label[m] = i
                    if core[m]:
                        todo.append(m)
    mine = got.loc[range(len(x))].to_numpy()
    assert ((mine == -1) == (label == -1)).all()
    pairs = {(a, b) for a, b in zip(mine[core], label[core])}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).filter("u <> 120")
    got = clustering.components(edges, spark.range(n).select(F.col("id").alias("node")))
    assert {(r["component"], r["count"]) for r in got.groupBy("component").count().collect()} == {(0, 121), (121, 79)}


def test_planted_anomalies_are_found(spark):
    rng = np.random.default_rng(42)
    x = np.r_[rng.normal(size=(100, 3)), rng.normal(5, 0.5, size=(10, 3))]
    frame = pd.DataFrame(x, columns=["x1", "x2", "x3"]).assign(id=range(110))
    for method in (anomaly.isolation_forest, anomaly.elliptic_envelope, anomaly.one_class_svm, anomaly.local_outliers):
        out = method(ingest(spark, frame), "id").filter("label = -1").toPandas()
        if method is not anomaly.local_outliers:
            assert (out["id"] >= 100).sum() >= 6, method.__name__
        assert 5 <= len(out) <= 16


@pytest.mark.parametrize("n", [97, 96, 100])
def test_fourier_of_any_length(spark, n, monkeypatch):
    y = np.random.default_rng(n).normal(size=n)
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "idx long, y double")
    monkeypatch.setattr(ts, "BLOCK_ROWS", 1 if n == 97 else 65_536)  # a prime length takes the convolution
    got = ts.fourier(s, n).orderBy("k").toPandas()
    want = np.fft.fft(y)
    np.testing.assert_allclose(got["re"], want.real, atol=1e-8)
    np.testing.assert_allclose(got["im"], want.imag, atol=1e-8)


def test_blocks_do_not_change_frames(spark):
    y = np.random.default_rng(5).normal(size=500)
    s = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(y)], "t long, idx long, y double")
    w = lambda rows: ts.framed(s, lambda w: {"a": ts._over_frame(F.avg("y"), w, -3, 3, 7)}, 3, 3, block_rows=rows).orderBy("idx").toPandas()["a"]
    pd.testing.assert_series_equal(w(16), w(10_000))
    want = pd.Series(y).rolling(7, center=True).mean()
    np.testing.assert_allclose(w(16), want)


def test_arima_follows_a_trend(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(0.5 + rng.normal(scale=0.1, size=300))
    s = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(y)], "t long, idx long, y double")
    out = ts.arima(s, steps=5).orderBy("step").toPandas()
    assert abs(out["forecast"].iloc[-1] - (y[-1] + 2.5)) < 0.6
    assert (out["lower"] < out["forecast"]).all() and (out["forecast"] < out["upper"]).all()


def test_stationarity_tells_noise_from_walk(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=300)
    rows = [("noise", i, i, float(v)) for i, v in enumerate(noise)] + [("walk", i, i, float(v)) for i, v in enumerate(np.cumsum(noise))]
    s = spark.createDataFrame(rows, "k string, t long, idx long, y double")
    got = {r["k"]: r["is_stationary"] for r in ts.stationarity(s, by=["k"]).collect()}
    assert got == {"noise": True, "walk": False}


def test_lags_of_a_series_are_its_own(spark):
    """A short series beside a long one does not change the long one's lags or rows."""
    rng = np.random.default_rng(4)
    rows = [("long", i, i, float(v)) for i, v in enumerate(rng.normal(size=200))]
    short = [("short", i, i, float(v)) for i, v in enumerate(rng.normal(size=8))]
    pick = lambda rows: [tuple(r) for r in ts.stationarity(spark.createDataFrame(rows, "k string, t long, idx long, y double"), by=["k"]).filter("k = 'long'").select("n", "lags", "statistic").collect()]
    alone, beside = pick(rows), pick(rows + short)
    assert alone[0][:2] == beside[0][:2] and alone[0][2] == pytest.approx(beside[0][2]) and alone[0][0] == 200 - 15 - 1


@pytest.mark.parametrize("minutes", [0.5, 3, 200])
def test_cooldown_across_partitions(spark, minutes):
    rng = np.random.default_rng(9)
    hot = np.sort(rng.integers(0, 6000, 900))
    rows = [("hot", int(v), i) for i, v in enumerate(hot)] + [(f"r{i % 5}", int(v), 1000 + i) for i, v in enumerate(rng.integers(0, 6000, 100))]
    df = spark.createDataFrame(rows, "rule_id string, s long, alert_id long").select("rule_id", F.timestamp_seconds("s").alias("ts"), "alert_id")
    got = {r["alert_id"] for r in events.cooldown_batch(df, minutes).collect()}
    want, last = set(), {}
    for rule, s, a in sorted(rows):
        if rule not in last or s - last[rule] >= minutes * 60:
            want.add(a)
            last[rule] = s
    assert got == want


def test_trace_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "t")], "source string, target string, transformation string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in lineage.trace(edges, start).collect()} == {("b", 1), ("c", 2), ("d", 3)}
    paths = {r["path"]: r["circular"] for r in lineage.lineage_paths(edges, "a").collect()}
    assert paths["a>b>c>a"] and not paths["a>b>c>d"]


def test_ica_recovers_sources(spark):
    t = np.linspace(0, 8, 1000)
    src = np.c_[np.sin(2 * t), np.sign(np.sin(3 * t))]
    x = src @ np.array([[1.0, 0.5], [0.4, 1.0]])
    frame = pd.DataFrame({"id": range(1000), "a": x[:, 0], "b": x[:, 1]})
    out = reduction.ica(ingest(spark, frame), "id", components=2).orderBy("id").toPandas()
    c = np.abs(np.corrcoef(np.c_[out[["component_1", "component_2"]], src].T)[:2, 2:])
    assert c.max(axis=1).min() > 0.95


def test_kmeans_starts_share_their_passes(spark, monkeypatch):
    """All starts step in the same passes, over spread rows, and end where Spark's own fits end."""
    from pyspark.ml.clustering import KMeans

    from tablewright import session
    from tablewright.operators.features import scaled

    monkeypatch.setattr(session, "PASS_ROWS", 100)
    x = _points(300, 11)
    frame = pd.DataFrame({"a": x[:, 0], "b": x[:, 1]})
    features = session.spread(scaled(ingest(spark, frame).coalesce(1)).select("features"))
    assert features.rdd.getNumPartitions() == 4
    passes, sums = [], clustering._lloyd_sums
    monkeypatch.setattr(clustering, "_lloyd_sums", lambda blocks, held: passes.append(len(held)) or sums(blocks, held))
    found, inertia = clustering.kmeans_fits(features, [3], starts=3)[3]
    fits = [KMeans(featuresCol="features", k=3, seed=clustering.SEED + i, maxIter=300).fit(features) for i in range(3)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    np.testing.assert_allclose(inertia, best.summary.trainingCost, rtol=1e-6)
    np.testing.assert_allclose(found, best.clusterCenters(), atol=1e-6)
    assert passes[0] == 3 and len(passes) == max(m.summary.numIter for m in fits)
