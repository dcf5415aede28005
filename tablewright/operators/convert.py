"""Typed column conversion: a rule table from type pairs to expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted

# Fixed words for truth values.
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")

# Fixed date directives and their Java counterparts.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%z": "XX",
}


def java_pattern(strftime: str) -> str:
    out = strftime
    for directive, java in DIRECTIVES.items():
        out = out.replace(directive, java)
    return out


def parse_timestamp(c: Column, format: str = "%Y-%m-%d %H:%M:%S") -> Column:
    return F.try_to_timestamp(c, F.lit(java_pattern(format))).cast("timestamp_ntz")


def parse_date(c: Column, format: str = "%Y-%m-%d") -> Column:
    return F.try_to_timestamp(c, F.lit(java_pattern(format))).cast("date")


def parse_bool(c: Column, true_words=TRUE_WORDS, false_words=FALSE_WORDS) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*[w.lower() for w in true_words]), True).when(
        low.isin(*[w.lower() for w in false_words]), False
    )


def number_to_bool(c: Column) -> Column:
    return c != 0


Rule = Callable[..., Column]


def _family(t: T.DataType) -> str:
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(t, T.IntegralType):
        return "int"
    if isinstance(t, T.NumericType):
        return "float"
    return t.typeName()


RULES: dict[tuple[str, str], Rule] = {
    ("string", "timestamp"): parse_timestamp,
    ("string", "date"): parse_date,
    ("string", "boolean"): parse_bool,
    ("timestamp", "date"): lambda c: F.to_date(c),
    ("int", "boolean"): number_to_bool,
    ("float", "boolean"): number_to_bool,
}


def add_rule(source: str, target: str, rule: Rule) -> None:
    """Register a conversion between two type families."""
    RULES[(source, target)] = rule


def _target(t: str | T.DataType) -> T.DataType:
    return T._parse_datatype_string(t) if isinstance(t, str) else t


def conversion_kind(source: T.DataType, target: str | T.DataType) -> str:
    """``same``, ``rule`` (a registered rule applies) or ``cast``."""
    target = _target(target)
    if source == target:
        return "same"
    return "rule" if (_family(source), _family(target)) in RULES else "cast"


def converted(df: DataFrame, name: str, target: str | T.DataType, on_error: str = "null", **params: Any) -> Column:
    """Conversion expression for one column.

    ``null`` turns unreadable values into nulls one by one; ``raise`` fails the
    job on the first of them.
    """
    c, source, to = quoted(name), df.schema[name].dataType, _target(target)
    kind = conversion_kind(source, to)
    if kind == "same":
        return c
    if kind == "rule":
        out = RULES[(_family(source), _family(to))](c, **params)
        out = out if _family(to) == "boolean" else out.try_cast(to)
    else:
        out = c.try_cast(to)
    if on_error == "raise":
        return F.when(
            c.isNotNull() & out.isNull(),
            F.raise_error(F.concat(F.lit(f"cannot convert {name}: "), c.cast("string"))).cast(to),
        ).otherwise(out)
    return out


def convert_columns(
    df: DataFrame,
    types: Mapping[str, str | T.DataType],
    on_error: str = "null",
    params: Mapping[str, Mapping[str, Any]] | None = None,
) -> DataFrame:
    """Convert several columns in one projection.

    ``skip`` keeps a column as it was when any of its values cannot be read;
    that needs one probing aggregate over all converted columns.
    """
    params = params or {}
    outs = {n: converted(df, n, t, "raise" if on_error == "raise" else "null", **params.get(n, {})) for n, t in types.items()}
    if on_error == "skip":
        bad = failures(df, types, params).first()
        outs = {n: c for n, c in outs.items() if bad[n] == 0}
    return df.withColumns(outs) if outs else df


def failures(df: DataFrame, types: Mapping[str, str | T.DataType], params: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """One row: per column, how many values would not convert."""
    params = params or {}
    return df.agg(
        *[
            F.count_if(quoted(n).isNotNull() & converted(df, n, t, **params.get(n, {})).isNull()).alias(n)
            for n, t in types.items()
        ]
    )


def conform(df: DataFrame, schema: T.StructType, sources: Mapping[str, str] | None = None, on_error: str = "null") -> DataFrame:
    """Project to a target schema; ``sources`` maps target to source names."""
    sources = sources or {}
    cols = []
    for f in schema.fields:
        name = sources.get(f.name, f.name)
        if name in df.columns:
            cols.append(converted(df, name, f.dataType, on_error).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)
