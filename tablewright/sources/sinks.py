"""Exports, append-only logs and JSON text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.columns import quoted

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("actor", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


def export(df: DataFrame, kind: str, path: str | None = None, max_rows: int = 1_000_000) -> Any:
    """Arrow and pandas come back as objects, up to ``max_rows`` rows (more is an error); files need a path."""
    if kind in ("arrow", "pandas"):
        if df.limit(max_rows + 1).count() > max_rows:
            raise ValueError(f"more than {max_rows} rows; export to files instead")
        return df.toArrow() if kind == "arrow" else df.toPandas()
    if kind not in ("csv", "parquet", "json"):
        raise ValueError(f"unknown export format: {kind}")
    if path is None:
        raise ValueError(f"{kind} export needs a path")
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", "true").csv(path)
    else:
        getattr(writer, kind)(path)
    return path


def _json_value(field: T.StructField) -> Column:
    c, t = quoted(field.name), field.dataType
    if isinstance(t, T.DecimalType):
        return c.cast("long") if t.scale == 0 else c.cast("double")
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(t, T.BinaryType):
        text = F.try_validate_utf8(c.cast("string"))
        return F.coalesce(text, F.lower(F.hex(c)))
    return c


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON document with portable value forms."""
    packed = F.struct(*[_json_value(f).alias(f.name) for f in df.schema.fields])
    return df.select(F.to_json(packed, {"ignoreNullFields": "false"}).alias(name))


def audit_rows(df: DataFrame, timestamp: Column, actor: Column, action: Column, metadata: Column) -> DataFrame:
    """Rows in audit-log form with the day they belong to."""
    return df.select(
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        actor.cast("string").alias("actor"),
        action.cast("string").alias("action"),
        metadata.cast("string").alias("metadata"),
        timestamp.cast("date").alias("event_date"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows as JSON lines, one folder per day."""
    rows.write.mode("append").partitionBy("event_date").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField("event_date", T.DateType())])
    return spark.read.schema(schema).json(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def save_document(df: DataFrame, path: str) -> None:
    """Save a catalog, contract, alert or report table as JSON lines."""
    df.write.mode("overwrite").json(path)


def load_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Read a saved table back with its declared schema; no inference pass."""
    return spark.read.schema(schema).json(path)
