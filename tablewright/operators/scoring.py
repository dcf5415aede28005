"""Batch scoring with saved pipelines or foreign models."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import present_double, quoted, require


def _prepared(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require(df, features)
    return df.withColumns({c: F.coalesce(present_double(df, c), F.lit(0.0)) for c in features})


def score(df: DataFrame, model: PipelineModel | str, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Prediction, class probabilities and confidence of every row, gaps read as 0."""
    if isinstance(model, str):
        model = PipelineModel.load(model)
    done = model.transform(_prepared(df, features))
    cols = [quoted(c) for c in keep]
    if "prediction" in done.columns:
        cols.append(F.col("prediction"))
    if "probability" in done.columns:
        p = vector_to_array("probability")
        cols += [p.alias("probabilities"), F.array_max(p).alias("confidence")]
    return done.select(*cols)


def score_foreign(df: DataFrame, model: Any, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The same for any object with ``predict`` or ``transform``, in Arrow batches.

    The model travels to each executor once as a broadcast value.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        for frame in frames:
            m = shared.value
            x = frame[list(features)].to_numpy()
            out = frame[list(keep)].copy()
            out["prediction"] = m.predict(x) if hasattr(m, "predict") else m.transform(x)
            if hasattr(m, "predict_proba"):
                p = m.predict_proba(x)
                out["confidence"] = p.max(axis=1)
            else:
                out["confidence"] = None
            yield out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["prediction double", "confidence double"])
    return _prepared(df, features).select(*[quoted(c) for c in dict.fromkeys([*keep, *features])]).mapInPandas(run, schema)


def score_summary(scored: DataFrame) -> DataFrame:
    """Rows and mean confidence per prediction."""
    return scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("mean_confidence"))
