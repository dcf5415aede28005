"""Union of differently shaped sources into one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import absent, quoted, rows_of
from tablewright.operators.convert import converted
from tablewright.operators.schema import common_type, normalise_names


def unify(
    sources: Mapping[str, DataFrame],
    mapping: Mapping[str, Mapping[str, str]] | None = None,
    strategy: str = "union",
    merge: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None,
    source_column: str | None = None,
) -> DataFrame:
    """Map names, agree on types, fill gaps with nulls, concatenate.

    ``union`` keeps every column, ``intersection`` the common ones, ``custom``
    hands the mapped sources to ``merge``. Rows are never compared or moved.
    """
    named = {
        s: df.withColumnsRenamed(dict((mapping or {}).get(s, {}))) for s, df in sources.items()
    }
    if strategy == "custom":
        if merge is None:
            raise ValueError("the custom strategy needs a merge function")
        return merge(named)
    if strategy not in ("union", "intersection"):
        raise ValueError(f"unknown strategy: {strategy}")
    types: dict[str, T.DataType] = {}
    for df in named.values():
        for f in df.schema.fields:
            types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else common_type(f.dataType, f.dataType)
    names = list(types)
    if strategy == "intersection":
        names = [n for n in names if all(n in df.columns for df in named.values())]
    parts = []
    for s, df in named.items():
        cols = [
            (converted(df, n, types[n]) if n in df.columns else F.lit(None).cast(types[n])).alias(n) for n in names
        ]
        if source_column:
            cols.append(F.lit(s).alias(source_column))
        parts.append(df.select(*cols))
    return reduce(DataFrame.unionByName, parts)


def integrate(sources: Mapping[str, DataFrame], mapping: Mapping[str, Mapping[str, str]] | None = None, strategy: str = "union") -> DataFrame:
    """Normalise names, then unify; rows carry their source."""
    mapped = {s: df.withColumnsRenamed(dict((mapping or {}).get(s, {}))) for s, df in sources.items()}
    return unify({s: normalise_names(df) for s, df in mapped.items()}, None, strategy, source_column="_source")


def validate_unified(df: DataFrame) -> DataFrame:
    """Missing count and ratio per column, and the table's score on every row."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(absent(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    )
    ratios = [F.coalesce(F.try_divide(F.col(f"m{i}"), F.col("n")), F.lit(0.0)) for i in range(len(df.columns))]
    score = F.greatest(F.lit(0.0), F.lit(1.0) - sum(ratios[1:], ratios[0]) / len(ratios))
    return rows_of(
        row,
        [
            {
                "column": F.lit(c),
                "missing_count": F.col(f"m{i}"),
                "missing_ratio": ratios[i],
                "quality_score": score,
            }
            for i, c in enumerate(df.columns)
        ],
    )


def source_summary(df: DataFrame, source_column: str = "_source") -> DataFrame:
    """Rows per source of a unified table, with how many columns hold any value."""
    data = [c for c in df.columns if c != source_column]
    return (
        df.groupBy(source_column)
        .agg(F.count(F.lit(1)).alias("row_count"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(data)])
        .select(
            F.col(source_column).alias("source"),
            "row_count",
            sum([(F.col(f"n{i}") > 0).cast("int") for i in range(len(data))], F.lit(0)).alias("filled_columns"),
        )
    )
