"""Projection, filter, join and ordering operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted, require

JOIN_TYPES = ("inner", "left", "right", "full")


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, columns)
    return df.select(*[quoted(c) for c in columns])


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist; with none of them, the table as it is."""
    found = [c for c in columns if c in df.columns]
    return df.select(*[quoted(c) for c in found]) if found else df


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Any SQL predicate over the columns."""
    return df.filter(F.expr(condition))


def filter_compare(df: DataFrame, condition: str) -> DataFrame:
    """``column op value`` with the value read in the column's own type."""
    parts = condition.split(maxsplit=2)
    if len(parts) != 3:
        raise ValueError("expected: column operator value")
    name, op, text = parts
    require(df, [name])
    value = F.lit(text.strip().strip("'\"")).cast(df.schema[name].dataType)
    c = quoted(name)
    tests = {">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value, "==": c == value, "!=": c != value}
    if op not in tests:
        raise ValueError(f"unknown operator: {op}")
    return df.filter(tests[op])


def mask_columns(df: DataFrame, columns: Sequence[str], keep_shape: bool = False) -> DataFrame:
    """Hide values: a constant, or the letter/digit pattern with ``keep_shape``."""
    found = [c for c in columns if c in df.columns]
    hidden = {
        c: (F.mask(quoted(c).cast("string")) if keep_shape else F.lit("***")) for c in found
    }
    return df.withColumns(hidden) if hidden else df


def transform_chain(df: DataFrame, steps: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Fold typed steps over the table; an unknown step is an error."""
    from tablewright.operators.convert import convert_columns

    for step in steps:
        kind = step["type"]
        if kind == "column_rename":
            df = rename(df, step["mapping"])
        elif kind == "column_filter":
            df = keep_columns(df, step["columns"])
        elif kind == "row_filter":
            df = filter_compare(df, step["condition"])
        elif kind == "column_type_conversion":
            df = convert_columns(df, step["types"])
        else:
            raise ValueError(f"unknown transformation: {kind}")
    return df


def _distinct_names(left: Sequence[str], right: Sequence[str]) -> list[str]:
    taken, out = set(left), []
    for name in right:
        fresh, i = name, 1
        while fresh in taken:
            fresh, i = f"{name}_{i}", i + 1
        taken.add(fresh)
        out.append(fresh)
    return out


def multi_join(
    tables: Mapping[str, DataFrame],
    conditions: Sequence[str],
    kinds: Sequence[str] | None = None,
) -> DataFrame:
    """Join tables left to right on SQL conditions that name every table seen so far.

    The whole chain stays one logical plan, so Catalyst may reorder it and pick
    broadcast, hash or sort-merge per step. Repeated names get a suffix.
    """
    names = list(tables)
    kinds = list(kinds) if kinds else ["inner"] * len(conditions)
    if len(names) < 2 or len(conditions) != len(names) - 1 or len(kinds) != len(conditions):
        raise ValueError("n tables need n-1 conditions and n-1 join types")
    for kind in kinds:
        if kind.lower() not in JOIN_TYPES:
            raise ValueError(f"unknown join type: {kind}")
    joined = tables[names[0]].alias(names[0])
    picked: list[Column] = [F.col(f"{names[0]}.`{c}`") for c in tables[names[0]].columns]
    outputs = list(tables[names[0]].columns)
    for name, condition, kind in zip(names[1:], conditions, kinds):
        right = tables[name]
        joined = joined.join(right.alias(name), F.expr(condition), kind.lower())
        fresh = _distinct_names(outputs, right.columns)
        picked += [F.col(f"{name}.`{c}`").alias(n) for c, n in zip(right.columns, fresh)]
        outputs += fresh
    return joined.select(*picked)


def join_tables(left: tuple[str, DataFrame], right: tuple[str, DataFrame], condition: str, kind: str = "inner") -> DataFrame:
    return multi_join(dict([left, right]), [condition], [kind])


def keep_one(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """Drop duplicates: whole rows, or first/last/none per ``subset`` in ``order``.

    The kept row is a min/max of a struct, which combines before the shuffle, so
    a key with very many copies never gathers in one task.
    """
    if subset is None:
        if keep is False:
            return df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
        return df.dropDuplicates()
    require(df, subset)
    rest = [c for c in df.columns if c not in subset]
    if not rest:
        return keep_one(df, None, None, keep)
    order = list(order or [])
    front = [c for c in order if c in rest]
    fields = [quoted(c) for c in [*front, *[c for c in rest if c not in front]]]
    pick = F.max if keep == "last" else F.min
    grouped = df.groupBy(*[quoted(c) for c in subset]).agg(
        pick(F.struct(*fields)).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    if keep is False:
        grouped = grouped.filter("_n = 1")
    return grouped.select(*[quoted(c) if c in subset else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*[quoted(o) for o in order]) if order else df).limit(n)


def top_groups(df: DataFrame, group: str, value: str, k: int = 10) -> DataFrame:
    """The ``k`` groups with the largest sum."""
    return (
        df.groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(value).alias("total"),
            F.avg(value).alias("mean"),
            F.min(value).alias("low"),
            F.max(value).alias("high"),
        )
        .orderBy(F.desc("total"), F.asc(group))
        .limit(k)
    )


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key; a combinable maximum, not a sort per key."""
    return keep_one(df, [key], order, "last")


def first_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int = 10) -> DataFrame:
    """First ``k`` rows of each group. Spark limits each partition before it shuffles."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("row_number", F.row_number().over(w)).filter(F.col("row_number") <= k)


def filter_entities(df: DataFrame, rule: str) -> DataFrame:
    """Segment extraction by a SQL rule."""
    return df.filter(F.expr(rule))


def similar_entities(
    df: DataFrame, key: str, vector: str, profile: DataFrame, k: int | None = 10, threshold: float | None = None
) -> DataFrame:
    """Entities by cosine similarity to one profile vector (column ``profile``).

    The profile is a single row, read as a scalar subquery; ranking keeps a
    bounded top list per task. ``threshold`` filters instead of ranking.
    """
    from tablewright.session import attach

    df = attach(df, profile, "_p")
    p = F.col("_p.profile")
    dot = F.aggregate(F.zip_with(quoted(vector), p, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda x, y: x + y)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")))
    scored = df.select(quoted(key), F.try_divide(dot, norm(quoted(vector)) * norm(p)).alias("similarity"))
    if threshold is not None:
        return scored.filter(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), F.asc(key)).limit(k)


def mean_vector(df: DataFrame, vector: str) -> DataFrame:
    """Elementwise mean of a vector column as one row ``profile``."""
    return (
        df.select(F.posexplode(vector).alias("i", "x"))
        .groupBy("i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("profile"))
    )
