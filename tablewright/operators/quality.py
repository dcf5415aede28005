"""Data-quality scores, findings and threshold alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.labels import compare
from tablewright.operators.columns import absent, numeric_columns, present_double, quoted, rows_of, string_columns
from tablewright.operators.outliers import outlier_stats
from tablewright.operators.quantiles import with_quantiles
from tablewright.operators.stats import duplicate_count, missing_counts
from tablewright.session import attach, beside

# Fixed patterns of the format checks.
NUMBER_TEXT = r"^-?\d+\.?\d*$"
EMAIL_TEXT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_TEXT = r"^[\d\s\-\+\(\)]+$"

# Fixed weights of the scores.
REPORT_WEIGHTS = {"missing": 0.4, "outlier": 0.3, "consistency": 0.3}
OVERALL_WEIGHTS = {"completeness": 0.3, "accuracy": 0.3, "consistency": 0.2, "validity": 0.2}


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _mean(cols: Sequence[Column], empty: float = 1.0) -> Column:
    return sum(cols[1:], cols[0]) / F.lit(float(len(cols))) if cols else F.lit(empty)


# --- consistency and the report -----------------------------------------------------


def consistency(df: DataFrame) -> DataFrame:
    """Duplicate rows, and text columns that mix number text with other text."""
    names = string_columns(df)
    mixed = [
        F.when(
            (F.count_if(quoted(c).rlike(NUMBER_TEXT)) > 0) & (F.count_if(~quoted(c).rlike(NUMBER_TEXT)) > 0), 1
        ).otherwise(0)
        for c in names
    ]
    issues = df.agg((sum(mixed[1:], mixed[0]) if mixed else F.lit(0)).cast("long").alias("mixed_columns"))
    return beside(duplicate_count(df), issues).select(
        "row_count",
        "duplicate_rows",
        _ratio(F.col("duplicate_rows"), F.col("row_count")).alias("duplicate_ratio"),
        "unique_rows",
        _ratio(F.col("unique_rows"), F.col("row_count")).alias("unique_ratio"),
        "mixed_columns",
    )


def component_scores(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing, outlier and consistency scores (0..100) and their weighted sum.

    A declared column type cannot hold values of another type, so only mixed
    text columns cost points (10 each).
    """
    missing = missing_counts(df, columns).agg((F.avg("complete_ratio") * 100).alias("missing_score"))
    numbers = numeric_columns(df, columns)
    dup = consistency(df)
    score = F.greatest(F.lit(0.0), 100.0 - F.col("duplicate_ratio") * 20 - F.col("mixed_columns") * 10)
    if numbers:
        spread = outlier_stats(df, numbers).agg(F.greatest(F.lit(0.0), 100.0 - F.avg("outlier_ratio") * 100).alias("outlier_score"))
        row = beside(dup, missing, spread)
    else:
        row = beside(dup, missing).withColumn("outlier_score", F.lit(100.0))
    row = row.select(
        "missing_score",
        "outlier_score",
        score.alias("consistency_score"),
        "duplicate_ratio",
        "mixed_columns",
    )
    return row.withColumn(
        "overall_score",
        F.col("missing_score") * REPORT_WEIGHTS["missing"]
        + F.col("outlier_score") * REPORT_WEIGHTS["outlier"]
        + F.col("consistency_score") * REPORT_WEIGHTS["consistency"],
    )


def report_findings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(severity, code, column)``: what to look at, and what is critical."""
    def cuts(part: DataFrame, ratio: str, code: str, warn: float, critical: float) -> DataFrame:
        level = F.inline(
            F.filter(
                F.array(
                    F.when(F.col(ratio) > warn, F.struct(F.lit("recommendation").alias("severity"), F.lit(code).alias("code"))),
                    F.when(F.col(ratio) > critical, F.struct(F.lit("critical").alias("severity"), F.lit(code).alias("code"))),
                ),
                lambda s: s.isNotNull(),
            )
        )
        return part.select("column", level).select("severity", "code", "column")

    table = consistency(df).withColumn("column", F.lit("*"))
    parts = [
        cuts(missing_counts(df, columns), "missing_ratio", "missing_values", 0.1, 0.5),
        cuts(table, "duplicate_ratio", "duplicate_rows", 0.1, 0.5),
        table.filter("mixed_columns > 0").select(F.lit("recommendation").alias("severity"), F.lit("mixed_types").alias("code"), "column"),
    ]
    numbers = numeric_columns(df, columns)
    if numbers:
        parts.append(cuts(outlier_stats(df, numbers), "outlier_ratio", "outliers", 0.05, 0.2))
    return reduce(DataFrame.unionByName, parts)


# --- comprehensive metrics -------------------------------------------------------------


def completeness(df: DataFrame) -> DataFrame:
    """One row: missing cells over all cells."""
    cells = sum([F.count_if(absent(df, c)) for c in df.columns[1:]], F.count_if(absent(df, df.columns[0])))
    row = df.agg(cells.alias("missing_cells"), (F.count(F.lit(1)) * len(df.columns)).alias("total_cells"))
    ratio = _ratio(F.col("missing_cells"), F.col("total_cells"))
    return row.select("missing_cells", "total_cells", ratio.alias("missing_ratio"), (1 - ratio).alias("completeness"))


def _type_scores(df: DataFrame) -> list[Column]:
    """Aggregates: share of text values that are not number text; 1 for other columns."""
    out = []
    for c in df.columns:
        if c in string_columns(df):
            out.append(F.coalesce(1 - F.avg(quoted(c).rlike(NUMBER_TEXT).cast("double")), F.lit(1.0)))
        else:
            out.append(F.lit(1.0))
    return out


def _format_scores(df: DataFrame) -> list[Column]:
    out = []
    for c in df.columns:
        low = c.lower()
        pattern = EMAIL_TEXT if "email" in low else PHONE_TEXT if "phone" in low else None
        if pattern and c in string_columns(df):
            out.append(F.coalesce(F.avg(quoted(c).rlike(pattern).cast("double")), F.lit(1.0)))
        else:
            out.append(F.lit(1.0))
    return out


def value_consistency(df: DataFrame, id_columns: Sequence[str] | None = None) -> DataFrame:
    """Share of keys with one value only, over every (id column, other column) pair.

    Whether a key has two different values needs only its smallest and largest,
    so each id column costs one combinable aggregation and no distinct sets.
    """
    ids = [c for c in df.columns if "id" in c.lower()] if id_columns is None else list(id_columns)
    scores = []
    for key in ids:
        others = [c for c in df.columns if c != key]
        if not others:
            continue
        per = df.filter(~absent(df, key)).groupBy(key).agg(
            *[(F.min(quoted(c)) != F.max(quoted(c))).alias(f"x{i}") for i, c in enumerate(others)]
        )
        row = per.agg(
            *[(1 - F.avg(F.coalesce(F.col(f"x{i}"), F.lit(False)).cast("double"))).alias(f"s{i}") for i in range(len(others))]
        )
        scores.append(
            rows_of(
                row,
                [
                    {"id_column": F.lit(key), "column": F.lit(c), "score": F.col(f"s{i}")}
                    for i, c in enumerate(others)
                ],
            )
        )
    if not scores:
        return df.limit(0).select(
            F.lit(None).cast("string").alias("id_column"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("double").alias("score")
        )
    return reduce(DataFrame.unionByName, scores)


def range_violations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: negative ages and counts, values far outside the 1%..99% span."""
    columns = numeric_columns(df, columns)
    if not columns:
        return df.agg(F.lit(0).cast("long").alias("violations"), F.lit(0).cast("long").alias("checks"), F.lit(0.0).alias("violation_ratio"))
    row = with_quantiles(df, columns, (0.01, 0.99))
    spans = []
    for i, c in enumerate(columns):
        q = F.col(f"`q_{c}`")
        spans += [(q[0] - 3 * (q[1] - q[0])).alias(f"lo{i}"), (q[1] + 3 * (q[1] - q[0])).alias(f"hi{i}")]
    seen = attach(df.select(*[quoted(c) for c in columns]), row.select(*spans), "_b")
    signed = [c for c in columns if "age" in c.lower() or "count" in c.lower()]
    bad = [F.count_if(present_double(df, c) < 0) for c in signed]
    bad += [
        F.count_if((present_double(df, c) > F.col(f"_b.hi{i}")) | (present_double(df, c) < F.col(f"_b.lo{i}")))
        for i, c in enumerate(columns)
    ]
    checks = F.count(F.lit(1)) * (len(columns) + len(signed))
    total = seen.agg(sum(bad[1:], bad[0]).alias("violations"), checks.alias("checks"))
    return total.withColumn("violation_ratio", _ratio(F.col("violations"), F.col("checks")))


def quality_metrics(df: DataFrame, constraints: Mapping[str, Mapping[str, Any]] | None = None) -> DataFrame:
    """One row with every dimension and the overall score.

    ``constraints`` maps a column to ``min``, ``max`` and ``pattern``. Four scans
    at most: cell checks, range checks, duplicates, and one per id column.
    """
    bounds, formats = [], []
    for c, rules in (constraints or {}).items():
        if c not in df.columns:
            continue
        if "min" in rules:
            bounds.append(F.count_if(quoted(c) < F.lit(rules["min"])))
        if "max" in rules:
            bounds.append(F.count_if(quoted(c) > F.lit(rules["max"])))
        if "pattern" in rules:
            text = F.coalesce(quoted(c).cast("string"), F.lit("None"))
            formats.append(F.count_if(~text.rlike(f"^(?:{rules['pattern']})")))
    zero = F.lit(0).cast("long")
    cells = df.agg(
        sum([F.count_if(absent(df, c)) for c in df.columns[1:]], F.count_if(absent(df, df.columns[0]))).alias("missing_cells"),
        F.count(F.lit(1)).alias("row_count"),
        _mean(_type_scores(df)).alias("type_consistency"),
        _mean(_format_scores(df)).alias("format_consistency"),
        (sum(bounds[1:], bounds[0]) if bounds else zero).alias("constraint_violations"),
        (sum(formats[1:], formats[0]) if formats else zero).alias("format_violations"),
    )
    values = value_consistency(df).agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("value_consistency"))
    ranges = range_violations(df).select(F.col("violation_ratio").alias("range_violation_ratio"))
    copies = duplicate_count(df).select("duplicate_rows")
    n, width = F.col("row_count"), len(df.columns)
    row = beside(cells, values, ranges, copies)
    row = row.withColumn("duplicate_ratio", _ratio(F.col("duplicate_rows"), n)).drop("duplicate_rows")
    row = row.withColumn("range_violations", F.floor(F.col("range_violation_ratio") * n))
    row = row.withColumns(
        {
            "missing_ratio": _ratio(F.col("missing_cells"), n * width),
            "completeness": 1 - _ratio(F.col("missing_cells"), n * width),
            "accuracy": _unit(1 - (F.col("duplicate_ratio") + (1 - F.col("type_consistency")) + F.col("range_violation_ratio"))),
            "consistency": (F.col("type_consistency") + F.col("value_consistency") + F.col("format_consistency")) / 3,
            "validity": _unit(
                1 - _ratio(F.col("constraint_violations") + F.col("format_violations") + F.col("range_violations"), n * width)
            ),
        }
    )
    return row.withColumn("overall_score", sum((F.col(k) * w for k, w in OVERALL_WEIGHTS.items()), F.lit(0.0)))


def quality_advice(metrics: DataFrame) -> DataFrame:
    """Advice codes for a metrics row; ``good`` when nothing stands out."""
    rules = [
        ("improve_completeness", F.col("completeness") < 0.8),
        ("improve_accuracy", F.col("accuracy") < 0.8),
        ("improve_consistency", F.col("consistency") < 0.8),
        ("improve_validity", F.col("validity") < 0.8),
        ("high_missing_ratio", F.col("missing_ratio") > 0.2),
        ("high_duplicate_ratio", F.col("duplicate_ratio") > 0.1),
    ]
    if "outlier_ratio" in metrics.columns:
        rules.append(("high_outlier_ratio", F.col("outlier_ratio") > 0.1))
    codes = F.filter(F.array(*[F.when(test, F.lit(code)) for code, test in rules]), lambda c: c.isNotNull())
    return metrics.select(codes.alias("c")).select(
        F.explode(F.when(F.size("c") == 0, F.array(F.lit("good"))).otherwise(F.col("c"))).alias("advice")
    )


# --- alerts -------------------------------------------------------------------------------

# Fixed thresholds: metric, operator that raises the alert, limit.
DEFAULT_THRESHOLDS = [
    ("completeness", "lt", 0.8),
    ("accuracy", "lt", 0.8),
    ("consistency", "lt", 0.8),
    ("validity", "lt", 0.8),
    ("overall_score", "lt", 0.8),
    ("missing_ratio", "gt", 0.5),
    ("duplicate_ratio", "gt", 0.1),
    ("outlier_ratio", "gt", 0.1),
]


def metric_rows(snapshots: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to ``(keys..., metric, value)``."""
    return rows_of(snapshots, [{"metric": F.lit(m), "value": quoted(m).cast("double")} for m in metrics], keys)


def threshold_alerts(metrics: DataFrame, thresholds: Sequence[tuple[str, str, float]] | DataFrame = DEFAULT_THRESHOLDS) -> DataFrame:
    """Metric rows that break a threshold: ``metric, value, op, limit`` and the keys.

    Thresholds given in code become one expression; a threshold table is joined
    on the metric name.
    """
    if isinstance(thresholds, DataFrame):
        joined = metrics.join(thresholds, "metric")
        return joined.filter(compare(F.col("op"), F.col("value"), F.col("limit")))
    rules = F.filter(
        F.array(
            *[F.struct(F.lit(m).alias("for"), F.lit(op).alias("op"), F.lit(float(v)).alias("limit")) for m, op, v in thresholds]
        ),
        lambda r: r["for"] == F.col("metric"),
    )
    return (
        metrics.withColumn("_r", F.explode(rules))
        .select(*metrics.columns, F.col("_r.op").alias("op"), F.col("_r.limit").alias("limit"))
        .filter(compare(F.col("op"), F.col("value"), F.col("limit")))
    )


def find_alerts(alerts: DataFrame, now: Column, severity: str | None = None, acknowledged: bool | None = None, hours: int | None = None) -> DataFrame:
    """Alerts by severity, state and age, newest first."""
    if severity is not None:
        alerts = alerts.filter(F.col("severity") == severity)
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == acknowledged)
    if hours is not None:
        alerts = alerts.filter(F.col("checked_at") >= now - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return alerts.orderBy(F.desc("checked_at"), "alert_id")


def acknowledge(alerts: DataFrame, seen: DataFrame) -> DataFrame:
    """Mark the alerts whose ``alert_id`` is in ``seen``."""
    marks = seen.select("alert_id").distinct().withColumn("_m", F.lit(True))
    return alerts.join(marks, "alert_id", "left").select(
        *[c for c in alerts.columns if c != "acknowledged"],
        (F.col("acknowledged") | F.coalesce("_m", F.lit(False))).alias("acknowledged"),
    )
