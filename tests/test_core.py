"""Ranks, quantiles and modes: both physical forms against pandas, with skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import stats
from tablewright.operators.quantiles import modes, quantiles, with_quantiles
from tablewright.operators.ranks import average_ranks, row_index, running_total
from tablewright.operators.relational import keep_one
from tablewright.sources.ingest import ingest


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(42)
    n = 3000
    v = rng.lognormal(size=n).round(3)
    v[: n // 3] = 1.25  # one value holds a third of the rows
    return pd.DataFrame({"id": np.arange(n), "g": rng.choice(list("abc"), n), "v": v, "w": rng.normal(size=n).round(1)})


@pytest.mark.parametrize("force", [False, True])
def test_quantiles_are_exact(spark, frame, force):
    ps = [0.0, 0.01, 0.25, 0.333, 0.5, 0.99, 1.0]
    df = ingest(spark, frame)
    got = {r["column"]: r["q"] for r in quantiles(df, ["v", "w"], ps, force_distributed=force).collect()}
    for c in ("v", "w"):
        np.testing.assert_allclose(got[c], frame[c].quantile(ps).to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("accuracy", [100, 50_000])
def test_grouped_quantiles(spark, frame, force, accuracy):
    rows = quantiles(ingest(spark, frame), ["v"], [0.1, 0.5], ["g"], force, accuracy).collect()
    want = frame.groupby("g")["v"].quantile([0.1, 0.5]).unstack()
    for r in rows:
        np.testing.assert_allclose(r["q"], want.loc[r["g"]].to_numpy(), rtol=1e-12)


def test_quantiles_of_few_and_no_rows(spark):
    one = spark.createDataFrame([(1.0,)], "v double")
    assert quantiles(one, ["v"], [0.5], force_distributed=True).first()["q"] == [1.0]
    none = spark.createDataFrame([(None,)], "v double")
    assert with_quantiles(none, ["v"], [0.5], force_distributed=True).first()["q_v"] is None


@pytest.mark.parametrize("force", [False, True])
def test_running_total_and_index(spark, frame, force):
    df = ingest(spark, frame)
    out = running_total(df, ["v", "id"], {"s": F.col("id")}, ["g"], force).toPandas().sort_values(["g", "v", "id"])
    want = frame.sort_values(["g", "v", "id"])
    assert (out["s"].to_numpy() == want.groupby("g")["id"].cumsum().to_numpy()).all()
    idx = row_index(df, ["id"], force_distributed=force).toPandas()
    assert (idx["idx"] == idx["id"]).all()


@pytest.mark.parametrize("force", [False, True])
def test_average_ranks(spark, frame, force):
    counts = ingest(spark, frame).groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    got = average_ranks(counts, force_distributed=force).toPandas().set_index("value")["rank"]
    want = frame.assign(r=frame["v"].rank()).groupby("v")["r"].first()
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)


@pytest.mark.parametrize("form", ["distributed", "local_form"])
def test_rank_correlations(spark, frame, form, request):
    request.getfixturevalue(form)
    small = frame.iloc[900:1300].assign(u=lambda d: (d["v"] * 2 + d["w"]).round(0))
    df = ingest(spark, small)
    assert stats.spearman_pair(df, "v", "u").first()["r"] == pytest.approx(small["v"].rank().corr(small["u"].rank()))
    x, y = small["v"].to_numpy(), small["u"].to_numpy()
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    tau = (sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum())
    assert stats.kendall_pair(df, "v", "u").first()["r"] == pytest.approx(tau)


def test_modes_take_the_smallest_of_ties(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b"), (1, "a"), (3, None)], "n int, s string")
    got = {r["column"]: (r["mode"], r["mode_count"]) for r in modes(df, ["n", "s"]).collect()}
    assert got == {"n": ("1", 2), "s": ("a", 2)}


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 3, "z"), (1, 0, None)], "k int, o int, s string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(keep_one(df, ["k"], ["o"])) == [(1, 0, None), (2, 3, "z")]
    assert rows(keep_one(df, ["k"], ["o"], "last")) == [(1, 2, "y"), (2, 3, "z")]
    assert rows(keep_one(df, ["k"], ["o"], False)) == [(2, 3, "z")]


def test_null_groups_are_groups(spark):
    """Every grouped operator keeps the group of the null key, in both forms."""
    from tablewright.operators import quantiles, stats
    from tablewright.session import SMALL_BYTES_KEY

    rows = [(i, float(i % 100), [None, "a"][i % 2], i) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v double, g string, x long")
    results = []
    for limit in ("0", str(2**62)):
        spark.conf.set(SMALL_BYTES_KEY, limit)
        try:
            q = {r.g: list(r.q) for r in quantiles.quantiles(df, ["v"], [0.25, 0.5, 0.75], ["g"]).collect()}
            h = {(r.g, r.bin): r["count"] for r in stats.histogram(df, ["v"], 4, ["g"]).collect()}
        finally:
            spark.conf.unset(SMALL_BYTES_KEY)
        assert set(q) == {None, "a"} and sum(h[k] for k in h if k[0] is None) == 200
        results.append((q, h))
    assert results[0] == results[1]


def test_match_joins_null_keys(spark):
    from tablewright.session import match

    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 3), ("a", 4)], "k string, w int")
    assert sorted((r.v, r.w) for r in match(left, right, ["k"]).collect()) == [(1, 3), (2, 4)]


def test_masking_never_leaves_values_clear(spark):
    from pyspark.sql import functions as F

    from tablewright.functions.masking import mask_value

    df = spark.createDataFrame([("123456789",)], "c string")
    row = df.select(*[mask_value(F.col("c"), k).alias(k) for k in ("email", "phone", "card")]).first()
    assert all(v != "123456789" for v in row)


def test_lineage_has_no_hop_limit(spark):
    from tablewright.operators import lineage

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "t") for i in range(20)], "source string, target string, transformation string")
    start = spark.createDataFrame([("n0",)], "node string")
    assert lineage.trace(chain, start).count() == 20
