"""Bring in-memory values and tables into Spark as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, so that every operator sees one kind of missing."""
    floats = {
        f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def ingest(spark: SparkSession, data: Any, schema: T.StructType | str | None = None) -> DataFrame:
    """Accept a DataFrame, None, pandas, Arrow, a dict of columns or rows of dicts."""
    if isinstance(data, DataFrame):
        return data
    if data is None:
        return spark.createDataFrame([], schema or T.StructType([]))
    if isinstance(data, pd.DataFrame):
        if data.empty and schema is None and len(data.columns) == 0:
            return spark.createDataFrame([], T.StructType([]))
        return nan_to_null(spark.createDataFrame(data, schema))
    if hasattr(data, "read_all"):
        data = data.read_all()
    if isinstance(data, pa.Table):
        return nan_to_null(spark.createDataFrame(data, schema))
    if isinstance(data, Mapping):
        return nan_to_null(spark.createDataFrame(pa.table(dict(data)), schema))
    if isinstance(data, Iterable):
        rows = list(data)
        if not rows:
            return spark.createDataFrame([], schema or T.StructType([]))
        return nan_to_null(spark.createDataFrame(pa.Table.from_pylist(rows), schema))
    raise TypeError(f"cannot read a table from {type(data).__name__}")


def is_table(data: Any, required: Iterable[str] = ()) -> bool:
    """True for a DataFrame that has all ``required`` columns."""
    return isinstance(data, DataFrame) and all(c in data.columns for c in required)


def with_provenance(df: DataFrame, source: str, query: str | None = None) -> DataFrame:
    """Record where rows came from in ``_source`` and ``_query``."""
    return df.withColumns({"_source": F.lit(source), "_query": F.lit(query).cast("string")})
