"""PostgreSQL and MySQL scans through Spark's JDBC reader."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

DIALECTS = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", "org.postgresql.Driver", 5432),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", "com.mysql.cj.jdbc.Driver", 3306),
}


def sql_literal(value: Any, dialect: str = "postgres") -> str:
    """A value as an SQL literal; MySQL reads backslashes in strings as escapes, so they are doubled there."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    text = str(value)
    if "\0" in text:
        raise ValueError("a literal cannot hold a zero byte")
    if dialect == "mysql":
        text = text.replace("\\", "\\\\")
    return "'" + text.replace("'", "''") + "'"


# Quoted text and comments, where marks are ordinary characters, or a mark.
_TOKENS = re.compile(r"""'(?:[^'\\]|''|\\.)*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?P<mark>%s|\$\d+)""", re.DOTALL)


def bind(query: str, params: Mapping[str, Any] | Sequence[Any] | None, dialect: str = "postgres") -> str:
    """Replace ``$1``/``%s`` marks outside quotes and comments, in the order of ``params``, by SQL literals."""
    if not params:
        return query
    values = list(params.values()) if isinstance(params, Mapping) else list(params)
    marks = [m["mark"] for m in _TOKENS.finditer(query) if m["mark"]]
    numbered = any(m != "%s" for m in marks)
    if not numbered and len(marks) != len(values):
        raise ValueError("number of parameters differs from number of marks")
    following = iter(values)

    def literal(m: re.Match) -> str:
        if not m["mark"] or numbered and m["mark"] == "%s":
            return m[0]
        return sql_literal(values[int(m["mark"][1:]) - 1] if numbered else next(following), dialect)

    return _TOKENS.sub(literal, query)


def jdbc_options(
    dialect: str,
    host: str,
    database: str,
    query: str,
    params: Mapping[str, Any] | Sequence[Any] | None = None,
    port: int | None = None,
    user: str | None = None,
    password: str | None = None,
    fetch_size: int = 10_000,
    partition: tuple[str, Any, Any, int] | None = None,
) -> dict[str, str]:
    """Reader options for one query.

    ``partition`` is ``(column, lower, upper, count)`` and makes Spark read the
    query as ``count`` parallel range scans; without it the scan is one task.
    """
    if not query or not query.strip():
        raise ValueError("query must not be empty")
    url, driver, default_port = DIALECTS[dialect]
    options = {
        "url": url.format(host=host, port=port or default_port, database=database),
        "driver": driver,
        "fetchsize": str(fetch_size),
    }
    text = bind(query, params, dialect).strip().rstrip(";")
    if partition is None:
        options["query"] = text
    else:
        column, lower, upper, count = partition
        options["dbtable"] = f"({text}) AS q"
        options["partitionColumn"] = column
        options["lowerBound"] = str(lower)
        options["upperBound"] = str(upper)
        options["numPartitions"] = str(count)
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    return options


def read_jdbc(spark: SparkSession, dialect: str, **kwargs: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(dialect, **kwargs)).load()


def read_jdbc_columns(spark: SparkSession, dialect: str, **connection: Any) -> DataFrame:
    """Columns of a database from its information schema."""
    extra = ", is_nullable, column_default, column_key" if dialect == "mysql" else ""
    skip = "('information_schema','mysql','performance_schema','sys')" if dialect == "mysql" else "('pg_catalog','information_schema')"
    return read_jdbc(
        spark,
        dialect,
        query=(
            f"SELECT table_schema, table_name, column_name, data_type{extra} "
            f"FROM information_schema.columns WHERE table_schema NOT IN {skip}"
        ),
        **connection,
    )
