"""Cleaning steps and pipelines of steps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import absent, numeric_columns, present_double, quoted, string_columns
from tablewright.operators.outliers import bounds
from tablewright.operators.quantiles import with_quantiles
from tablewright.operators.ranks import running_total
from tablewright.operators.relational import keep_one
from tablewright.operators.stats import duplicate_count
from tablewright.session import attach, beside, is_small, stage


def remove_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", order: Sequence[str] | None = None) -> DataFrame:
    if subset is None and keep in ("first", "last"):
        return df.dropDuplicates()
    return keep_one(df, subset, order, keep)


def remove_missing_rows(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop rows whose share of missing values is above the threshold."""
    gaps = sum([absent(df, c).cast("int") for c in df.columns[1:]], absent(df, df.columns[0]).cast("int"))
    return df.filter(gaps / len(df.columns) <= threshold)


def remove_missing_columns(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop columns with too many gaps. The schema depends on one aggregate row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(absent(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    gone = [c for i, c in enumerate(df.columns) if row["n"] and row[f"m{i}"] / row["n"] > threshold]
    return df.drop(*gone) if gone else df


def impute(df: DataFrame, strategy: str = "mean", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill gaps with the column's mean, exact median or most frequent value.

    Mean and median touch numeric columns, mode any column.
    """
    if strategy == "knn":
        from tablewright.operators.neighbours import knn_impute

        return knn_impute(df, columns)
    if strategy == "mode":
        columns = list(columns or df.columns)
        fills = {}
        from tablewright.operators.quantiles import modes

        found = modes(df, columns).groupBy().agg(
            *[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"v{i}") for i, c in enumerate(columns)]
        )
        out = attach(df, stage(found))
        for i, c in enumerate(columns):
            fills[c] = F.when(absent(df, c), F.col(f"_s.v{i}").try_cast(df.schema[c].dataType)).otherwise(quoted(c))
        return out.withColumns(fills).drop("_s")
    columns = numeric_columns(df, columns)
    if not columns:
        return df
    if strategy == "mean":
        row = df.agg(*[F.avg(present_double(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    elif strategy == "median":
        row = with_quantiles(df, columns, (0.5,)).select(*[F.col(f"`q_{c}`")[0].alias(f"v{i}") for i, c in enumerate(columns)])
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    out = attach(df, stage(row))
    return out.withColumns(
        {c: F.coalesce(present_double(df, c), F.col(f"_s.v{i}")) for i, c in enumerate(columns)}
    ).drop("_s")


def remove_outliers(df: DataFrame, method: str = "iqr", columns: Sequence[str] | None = None) -> DataFrame:
    """Column after column: bounds of the rows left so far, then the cut.

    Missing values go with the outliers. z-scores must be strictly below 3. The
    one-row bounds are checkpointed, so a later column's plan reads them instead
    of containing the plans of all columns before it.
    """
    for c in numeric_columns(df, columns):
        v = present_double(df, c)
        if method == "iqr":
            limit = attach(df, stage(bounds(df, [c], "iqr")), "_b")
            df = limit.filter((v >= F.col("_b.lo0")) & (v <= F.col("_b.hi0"))).drop("_b")
        elif method == "zscore":
            row = df.agg(F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
            df = attach(df, stage(row), "_b").filter(F.abs(F.try_divide(v - F.col("_b.m"), F.col("_b.s"))) < 3).drop("_b")
        else:
            raise ValueError(f"unknown method: {method}")
    return df


def standardise(df: DataFrame, columns: Sequence[str] | None = None, method: str = "standard") -> DataFrame:
    """Zero mean and unit sample deviation, or 0..1; a constant column becomes null."""
    columns = numeric_columns(df, columns)
    if not columns:
        return df
    shift, scale = {
        "standard": (F.avg, F.stddev_samp),
        "minmax": (F.min, lambda v: F.max(v) - F.min(v)),
    }[method]
    row = df.agg(
        *[shift(present_double(df, c)).alias(f"a{i}") for i, c in enumerate(columns)],
        *[scale(present_double(df, c)).alias(f"b{i}") for i, c in enumerate(columns)],
    )
    return (
        attach(df, stage(row))
        .withColumns(
            {c: F.try_divide(present_double(df, c) - F.col(f"_s.a{i}"), F.col(f"_s.b{i}")) for i, c in enumerate(columns)}
        )
        .drop("_s")
    )


def encode_labels(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text to its place among the sorted distinct values; missing counts as ``None``.

    The code table has one row per distinct value. It is broadcast only when
    its size is known to be small; otherwise Spark joins on the value and
    splits hot ones at run time.
    """
    for c in string_columns(df, columns):
        text = F.coalesce(quoted(c), F.lit("None"))
        codes = running_total(
            df.select(text.alias("_v")).distinct(), ["_v"], {"_code": F.lit(1).cast("long")}
        ).select("_v", (F.col("_code") - 1).alias("_code"))
        side = F.broadcast(codes) if is_small(df.select(quoted(c))) else codes
        # Missing values have one code, read once; as a join key they would be one hot value.
        none = codes.filter(F.col("_v") == "None").agg(F.max("_code").alias("n")).select("n").scalar()
        placed = df.withColumn("_v", F.coalesce(quoted(c), F.concat(F.lit("\0"), F.xxhash64(F.struct("*")).cast("string"))))
        code = F.when(quoted(c).isNull(), none).otherwise(F.col("_code"))
        df = placed.join(side, "_v", "left").withColumn(c, code).drop("_v", "_code").select(*df.columns)
    return df


def encode_onehot(df: DataFrame, columns: Sequence[str] | None = None, max_values: int = 1000) -> DataFrame:
    """One 0/1 column per value, named ``<column>_<value>``.

    The schema depends on the data, so the distinct values are read on the
    driver; more than ``max_values`` is an error, not a silent cut.
    """
    for c in string_columns(df, columns):
        values = [r[0] for r in df.select(quoted(c)).distinct().filter(quoted(c).isNotNull()).limit(max_values + 1).collect()]
        if len(values) > max_values:
            raise ValueError(f"{c} has more than {max_values} values")
        df = df.withColumns({f"{c}_{v}": F.coalesce((quoted(c) == v).cast("int"), F.lit(0)) for v in sorted(values)}).drop(c)
    return df


def encode_onehot_long(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The same encoding for any number of values: rows ``(key, feature, value)`` of the ones; zeros are left out."""
    columns = string_columns(df, [c for c in (columns or df.columns) if c != key])
    ones = F.array(*[F.when(quoted(c).isNotNull(), F.concat(F.lit(f"{c}_"), quoted(c))) for c in columns])
    return df.select(quoted(key), F.explode(F.filter(ones, lambda x: x.isNotNull())).alias("feature")).withColumn("value", F.lit(1))


def cleanliness(df: DataFrame) -> DataFrame:
    """One row: rows, columns and 1 - missing share - duplicate share, within 0..1."""
    gaps = sum([F.count_if(absent(df, c)) for c in df.columns[1:]], F.count_if(absent(df, df.columns[0])))
    missing = beside(duplicate_count(df), df.agg(gaps.alias("gaps")))
    score = 1 - F.try_divide(F.col("gaps"), F.col("row_count") * len(df.columns)) - F.try_divide("duplicate_rows", "row_count")
    return missing.select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), F.lit(0.0)).alias("quality"),
    )


@dataclass
class Step:
    name: str
    function: Callable[..., DataFrame]
    parameters: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True


STEPS: dict[str, Callable[..., DataFrame]] = {
    "remove_duplicates": remove_duplicates,
    "remove_missing_rows": remove_missing_rows,
    "remove_missing_columns": remove_missing_columns,
    "impute_missing": impute,
    "remove_outliers": remove_outliers,
    "encode_labels": encode_labels,
    "encode_onehot": encode_onehot,
    "standardize_columns": standardise,
}


class Cleaner:
    """An ordered list of cleaning steps over one table."""

    def __init__(self, steps: Sequence[Step] = ()) -> None:
        self.steps = list(steps)

    @classmethod
    def default(cls) -> "Cleaner":
        names = [
            ("remove_duplicates", {"keep": "first"}),
            ("remove_missing_rows", {"threshold": 0.5}),
            ("remove_missing_columns", {"threshold": 0.5}),
            ("impute_missing", {"strategy": "mean"}),
            ("remove_outliers", {"method": "iqr"}),
            ("encode_labels", {}),
            ("standardize_columns", {"method": "standard"}),
        ]
        return cls([Step(n, STEPS[n], p) for n, p in names])

    @classmethod
    def configured(cls, config: Sequence[Mapping[str, Any]]) -> "Cleaner":
        """Steps from ``{"name", "parameters", "enabled"}`` records; names must be known."""
        return cls([Step(c["name"], STEPS[c["name"]], dict(c.get("parameters", {})), c.get("enabled", True)) for c in config])

    def add(self, name: str, function: Callable[..., DataFrame] | None = None, **parameters: Any) -> "Cleaner":
        self.steps.append(Step(name, function or STEPS[name], parameters))
        return self

    def remove(self, name: str) -> bool:
        before = len(self.steps)
        self.steps = [s for s in self.steps if s.name != name]
        return len(self.steps) < before

    def enable(self, name: str, on: bool = True) -> bool:
        found = [s for s in self.steps if s.name == name]
        for s in found:
            s.enabled = on
        return bool(found)

    def summary(self) -> dict[str, Any]:
        return {
            "total": len(self.steps),
            "enabled": sum(s.enabled for s in self.steps),
            "steps": [{"name": s.name, "enabled": s.enabled, "parameters": s.parameters} for s in self.steps],
        }

    def stages(self, df: DataFrame) -> list[tuple[str, DataFrame]]:
        """The table before and after every enabled step, as lazy plans."""
        out = [("input", df)]
        for s in self.steps:
            if s.enabled:
                df = s.function(df, **s.parameters)
                out.append((s.name, df))
        return out

    def clean(self, df: DataFrame) -> DataFrame:
        return self.stages(df)[-1][1]

    def report(self, df: DataFrame) -> DataFrame:
        """Rows, columns and quality of the table after each step."""
        parts = [
            cleanliness(stage).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "*")
            for i, (name, stage) in enumerate(self.stages(df))
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
