"""User functions over batches of rows.

Spark's partitions and Arrow batches take the place of hand-made chunks: the
function sees record batches, never the whole table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """Apply a row-wise function to every Arrow batch. A failing batch fails the job."""

    def run(batches):
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def map_sources(
    sources: Mapping[str, DataFrame], fn: Callable[[pd.DataFrame, str], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Apply a function to the batches of several sources; it is told the source's name."""

    def runner(name: str):
        def run(frames):
            for frame in frames:
                yield fn(frame, name)

        return run

    parts = [df.mapInPandas(runner(name), schema) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def merge_batches(
    df: DataFrame,
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    keys: Sequence[str],
    merges: Mapping[str, Callable[[Column], Column]],
) -> DataFrame:
    """Reduce every batch to a few rows, then merge those rows per key with aggregates.

    The fold's binary step becomes a commutative aggregate (sum, min, max, ...),
    so Spark can merge partial results in any order and before the shuffle.
    """

    def run(frames):
        for frame in frames:
            yield partial(frame)

    reduced = df.mapInPandas(run, schema)
    return reduced.groupBy(*keys).agg(*[merge(F.col(c)).alias(c) for c, merge in merges.items()])
