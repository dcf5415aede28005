"""Work that runs side by side: independent chains of jobs, and pairs of tiles."""

import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from tablewright.operators import clustering
from tablewright.operators.tiles import compare
from tablewright.session import stage, together


def test_calls_run_at_the_same_time(spark):
    meet = threading.Barrier(3, timeout=60)

    def call(k):
        meet.wait()
        return spark.range(k).count()

    assert together(spark, [lambda k=k: call(k) for k in (3, 1, 2)]) == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1 // 0, lambda: 1])


def test_pairs_of_small_tiles_are_spread_over_tasks(spark):
    """A few rows a tile are few bytes, which Spark puts into one task if it may choose."""
    tiles = stage(spark.range(64).select((F.col("id") % 16).alias("tile"), "id", F.lit(1).cast("long").alias("w"), F.array(F.col("id").cast("double")).alias("x")))
    pairs = stage(spark.range(256).select((F.col("id") % 16).alias("a"), F.expr("id div 16").alias("b")))

    def where(left, right):
        return pa.table({"task": [TaskContext.get().partitionId()], "n": [len(left) * len(right)]})

    got = compare(tiles, tiles, pairs, where, "task long, n long").toPandas()
    assert len(got) == 256 and set(got["n"]) == {16}
    assert got["task"].nunique() > 64


def test_methods_side_by_side_are_those_one_by_one(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in (0.0, 3.0, 6.0)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    got = {(r["method"], r["metric"]): r["value"] for r in clustering.compare_methods(df, ["a", "b"], 3).collect()}
    features = clustering.spread(clustering.scaled(df, ["a", "b"]).select("features"))
    for method, fit in clustering.METHODS.items():
        for name, value in fit(features, 3)[2].items():
            if name != "k" and value is not None:
                assert got[method, name] == pytest.approx(float(value), rel=1e-9), (method, name)
    assert got["dbscan", "n_noise"] <= 2
