"""Column selection helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns of ``df``, or those of ``columns`` that are numeric."""
    if columns is not None:
        require(df, columns)
    wanted = df.columns if columns is None else columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in wanted if isinstance(kinds[c], T.NumericType)]


def string_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    wanted = df.columns if columns is None else columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [c for c in wanted if isinstance(kinds[c], T.StringType)]


def absent(df: DataFrame, name: str) -> Column:
    """Missing test: null, and NaN for floating columns."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into null."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def tall(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Unpivot numeric columns to ``(keep..., column, value)``, missing dropped."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), present_double(df, c).alias("value"))
                for c in columns
            ]
        )
    ).alias("cell")
    return (
        df.select(*[quoted(k) for k in keep], cells)
        .select(*[quoted(k) for k in keep], "cell.column", "cell.value")
        .filter(F.col("value").isNotNull())
    )


def rows_of(row: DataFrame, records: Sequence[dict[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn wide aggregate columns into tidy rows.

    ``records`` holds one dict per output row, mapping output column to an
    expression over ``row``; ``keep`` columns are repeated on every output row.
    """
    packed = F.explode(
        F.array(*[F.struct(*[v.alias(k) for k, v in rec.items()]) for rec in records])
    ).alias("r")
    return row.select(*[quoted(k) for k in keep], packed).select(*[quoted(k) for k in keep], "r.*")
