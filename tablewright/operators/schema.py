"""Names, types and mappings: decisions made on schemas, not on rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted
from tablewright.session import plan_bytes

# Fixed names of logical types.
TYPE_NAMES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "integer": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float32": "float", "float64": "double", "float": "double", "double": "double",
    "string": "string", "str": "string", "text": "string", "varchar": "string", "object": "string", "category": "string",
    "bool": "boolean", "boolean": "boolean",
    "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "date": "date", "time": "bigint",
    "json": "string", "array": "array<string>", "blob": "binary",
}


class TypeMap:
    """Logical type names to Spark type names, open for additions."""

    def __init__(self) -> None:
        self._names = dict(TYPE_NAMES)

    def add(self, name: str, spark_type: str) -> None:
        self._names[name.lower()] = spark_type

    def resolve(self, name: str) -> str:
        return self._names.get(name.lower(), name)


def normal_name(name: str) -> str:
    text = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", name.lower())).strip("_")
    return text or "column"


def normal_names(names: Sequence[str]) -> list[str]:
    """Normalised names, made unique by a numeric suffix."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = fresh = normal_name(name)
        i = 1
        while fresh in taken:
            fresh, i = f"{base}_{i}", i + 1
        taken.add(fresh)
        out.append(fresh)
    return out


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normal_names(df.columns))


def canonical_type(t: T.DataType) -> T.DataType:
    """Widest form of a type family; decimals, times and nested types stay."""
    if isinstance(t, T.IntegralType):
        return T.LongType()
    if isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType):
        return T.DoubleType()
    return t


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Common type of two columns: string over double over long over boolean."""
    order = [T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()]

    def place(t: T.DataType) -> int:
        c = canonical_type(t)
        return order.index(c) if c in order else -1

    if canonical_type(a) == canonical_type(b):
        return canonical_type(a)
    return canonical_type(a) if place(a) >= place(b) else canonical_type(b)


# Fixed names of value transforms.
VALUE_TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "uppercase": F.upper,
    "lowercase": F.lower,
    "trim": F.trim,
    "abs": F.abs,
    "round": lambda c: F.bround(c, 0),
}


@dataclass
class ColumnMap:
    source: str
    target: str
    data_type: str
    required: bool = True
    default: object = None
    transform: str | None = None


@dataclass
class SchemaMap:
    """How one source's columns become the target's columns."""

    source_name: str
    columns: list[ColumnMap] = field(default_factory=list)

    def summary(self) -> dict[str, int]:
        return {
            "total": len(self.columns),
            "required": sum(c.required for c in self.columns),
            "optional": sum(not c.required for c in self.columns),
            "transformed": sum(c.transform is not None for c in self.columns),
        }


def match_column(name: str, targets: Sequence[str], aliases: Mapping[str, str] | None = None) -> str | None:
    """Target with the same name, then containing or contained, then by alias."""
    low = name.lower()
    for test in (lambda t: t == low, lambda t: low in t or t in low):
        for t in targets:
            if test(t.lower()):
                return t
    alias = (aliases or {}).get(name, "").lower()
    return next((t for t in targets if alias and t.lower() == alias), None)


def make_mapping(
    source_name: str,
    source: T.StructType,
    target: T.StructType | None = None,
    rules: Mapping[str, str] | None = None,
    auto_match: bool = True,
    aliases: Mapping[str, str] | None = None,
) -> SchemaMap:
    """Explicit rules first, then name matching; no target means normalised names."""
    rules = dict(rules or {})
    out = SchemaMap(source_name)
    if target is None:
        names = normal_names([rules.get(f.name, f.name) for f in source.fields])
        for f, n in zip(source.fields, names):
            out.columns.append(ColumnMap(f.name, n, canonical_type(f.dataType).simpleString()))
        return out
    kinds = {f.name: f.dataType.simpleString() for f in target.fields}
    for f in source.fields:
        to = rules.get(f.name)
        if to is None and auto_match:
            to = match_column(f.name, list(kinds), aliases)
        if to in kinds:
            out.columns.append(ColumnMap(f.name, to, kinds[to]))
    return out


def apply_mapping(df: DataFrame, mapping: SchemaMap) -> DataFrame:
    """One projection: cast, default, transform; absent sources give the default."""
    cols = []
    for m in mapping.columns:
        default = F.lit(m.default).cast(m.data_type)
        c = quoted(m.source).try_cast(m.data_type) if m.source in df.columns else default
        if m.default is not None:
            c = F.coalesce(c, default)
        if m.transform is not None:
            c = VALUE_TRANSFORMS[m.transform](c)
        cols.append(c.alias(m.target))
    return df.select(*cols)


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as rows."""
    return spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema.fields)],
        "position int, column_name string, data_type string, nullable boolean",
    )


def table_info(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and the plan's estimated bytes."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(plan_bytes(df)).alias("estimated_bytes")
    )


def compare_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full join of two schema tables on the column name, one verdict per column."""
    left = a.select("column_name", F.col("data_type").alias("type_left"), F.col("nullable").alias("null_left"))
    right = b.select("column_name", F.col("data_type").alias("type_right"), F.col("nullable").alias("null_right"))
    verdict = (
        F.when(F.col("type_left").isNull(), "only_right")
        .when(F.col("type_right").isNull(), "only_left")
        .when(F.col("type_left") != F.col("type_right"), "type_differs")
        .when(F.col("null_left") != F.col("null_right"), "nullability_differs")
        .otherwise("same")
    )
    return left.join(right, "column_name", "full").select("column_name", "type_left", "type_right", verdict.alias("verdict"))


def detect_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Narrowest type that holds every value of each (text or typed) column.

    One aggregate for all columns: counts of values that read as boolean, long
    and double, with the long range. Booleans are tested before whole numbers.
    """
    columns = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(columns):
        text = quoted(c).cast("string")
        whole = text.try_cast("bigint")
        aggs += [
            F.count(text).alias(f"n{i}"),
            F.count_if(F.lower(text).isin("true", "false")).alias(f"b{i}"),
            F.count(F.when(text.rlike(r"^[+-]?\d+$"), whole)).alias(f"w{i}"),
            F.count(text.try_cast("double")).alias(f"d{i}"),
            F.min(whole).alias(f"lo{i}"),
            F.max(whole).alias(f"hi{i}"),
        ]
    row = df.agg(*aggs)
    cells = []
    for i, c in enumerate(columns):
        n, lo, hi = F.col(f"n{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        whole = F.when(
            lo >= 0,
            F.when(hi < 2**8, "uint8").when(hi < 2**16, "uint16").when(hi < 2**32, "uint32").otherwise("uint64"),
        ).otherwise(
            F.when((lo >= -(2**7)) & (hi < 2**7), "int8")
            .when((lo >= -(2**15)) & (hi < 2**15), "int16")
            .when((lo >= -(2**31)) & (hi < 2**31), "int32")
            .otherwise("int64")
        )
        found = (
            F.when(n == 0, "string")
            .when(F.col(f"b{i}") == n, "bool")
            .when(F.col(f"w{i}") == n, whole)
            .when(F.col(f"d{i}") == n, "float64")
            .otherwise("string")
        )
        cells.append(F.struct(F.lit(c).alias("column"), n.alias("non_null"), found.alias("detected_type")))
    return row.select(F.inline(F.array(*cells)))


def narrow_numbers(df: DataFrame, columns: Sequence[str], floats: bool = False) -> DataFrame:
    """Cast numeric columns to the narrowest type that holds them.

    The output schema depends on the data, so one aggregate row (a handful of
    values per column) is read on the driver.
    """
    found = {r["column"]: r["detected_type"] for r in detect_types(df, columns).collect()}
    casts = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            casts[c] = quoted(c).cast(TYPE_NAMES[found[c]])
        elif floats and isinstance(kind, T.DoubleType):
            casts[c] = quoted(c).cast("float")
    return df.withColumns(casts) if casts else df


def tag_columns(df: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """Put a sensitivity label on every column's metadata.

    A caller rule (regular expression on the name) wins; names that speak of
    e-mail, phone or social security numbers are confidential personal data;
    everything else is internal.
    """
    for name in df.columns:
        label, tags = "internal", []
        for pattern, wanted in (rules or {}).items():
            if re.search(pattern, name, re.IGNORECASE):
                label = wanted
                break
        else:
            if re.search(r"email|phone|ssn", name, re.IGNORECASE):
                label, tags = "confidential", ["pii"]
        df = df.withMetadata(name, {**df.schema[name].metadata, "sensitivity": label, "tags": tags})
    return df
