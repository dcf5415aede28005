"""Named sources and named tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.columns import absent
from tablewright.sources.ingest import with_provenance


class UnknownSource(KeyError):
    """No source is registered under the name."""


class SourceRegistry:
    """Name to reader; a reader is ``SparkSession -> DataFrame``."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, reader: Callable[..., DataFrame], overwrite: bool = False) -> None:
        if name in self._readers and not overwrite:
            raise ValueError(f"source {name!r} is registered already")
        self._readers[name] = reader

    def get(self, name: str) -> Callable[..., DataFrame]:
        if name not in self._readers:
            raise UnknownSource(name)
        return self._readers[name]

    def names(self) -> list[str]:
        return sorted(self._readers)

    def run(self, spark: SparkSession, name: str, query: str | None = None, **params: Any) -> DataFrame:
        """Read a source and tag its rows with their origin."""
        return with_provenance(self.get(name)(spark, **params), name, query)


class TableSpace:
    """Registered tables for SQL and joins; closes by dropping its views."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name)
        self._tables[name] = df

    def unregister(self, name: str) -> None:
        if name not in self._tables:
            raise UnknownSource(name)
        self.spark.catalog.dropTempView(name)
        del self._tables[name]

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise UnknownSource(name)
        return self._tables[name]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def sql(self, text: str, params: Mapping[str, Any] | None = None) -> DataFrame:
        return self.spark.sql(text, args=dict(params) if params else None)

    def clear(self) -> None:
        for name in list(self._tables):
            self.unregister(name)

    def __enter__(self) -> "TableSpace":
        return self

    def __exit__(self, *exc: object) -> None:
        self.clear()


def column_catalog(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column: table, position, type, rows and missing values."""
    out = None
    for name, df in tables.items():
        counts = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(absent(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
        )
        rows = counts.select(
            F.lit(name).alias("table_name"),
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(i).alias("position"),
                            F.lit(f.name).alias("column_name"),
                            F.lit(f.dataType.simpleString()).alias("data_type"),
                            F.col("n").alias("row_count"),
                            F.col(f"m{i}").alias("missing_count"),
                        )
                        for i, f in enumerate(df.schema.fields)
                    ]
                )
            ),
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no tables given")
    return out
