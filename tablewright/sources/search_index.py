"""Search-index (Elasticsearch) scans and hit flattening."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = "org.elasticsearch.spark.sql"


def search_body(query: str) -> dict[str, Any]:
    """A JSON query document as is; plain text becomes a match over all fields."""
    if not query or not query.strip():
        raise ValueError("query must not be empty")
    try:
        body = json.loads(query)
    except json.JSONDecodeError:
        return {"query": {"match": {"_all": query}}}
    return body


def paging(params: Mapping[str, Any] | None) -> tuple[str, int | None, int]:
    """``(index, size, from)`` with the defaults ``_all``, all hits and 0."""
    params = params or {}
    try:
        return str(params.get("index", "_all")), None if params.get("size") is None else int(params["size"]), int(params.get("from", 0))
    except (TypeError, ValueError) as exc:
        raise ValueError("size and from must be whole numbers") from exc


def read_index(spark: SparkSession, nodes: str, query: str, params: Mapping[str, Any] | None = None) -> DataFrame:
    """Scan through the public Hadoop connector; it must be on the classpath.

    All hits come, unless ``size`` or ``from`` asks for a page; pages need
    ``sort``, a list of columns, as a scan has no order of its own.
    """
    index, size, start = paging(params)
    order = list((params or {}).get("sort", ()))
    if (size is not None or start) and not order:
        raise ValueError("a page needs the columns to sort by")
    hits = (
        spark.read.format(FORMAT)
        .option("es.nodes", nodes)
        .option("es.resource", index)
        .option("es.query", json.dumps(search_body(query)))
        .option("es.read.metadata", "true")
        .load()
    )
    if not order:
        return hits
    ordered = hits.orderBy(*order).offset(start)
    return ordered if size is None else ordered.limit(size)


def flatten_hits(df: DataFrame, source: Column, source_type: T.StructType, doc_id: Column, index: Column, score: Column) -> DataFrame:
    """One row per hit: ``_id, _index, _score`` and the fields of the source document."""
    hit = df.select(
        doc_id.cast("string").alias("_id"),
        index.alias("_index"),
        F.coalesce(score.cast("double"), F.lit(0.0)).alias("_score"),
        F.from_json(source, source_type).alias("_source"),
    )
    return hit.select("_id", "_index", "_score", "_source.*")


def page(df: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """Rows ``start .. start+size-1`` in ``order``; Spark keeps a bounded top list."""
    return df.orderBy(*order).offset(start).limit(size)
