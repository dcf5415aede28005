"""One-call analysis of a table: every section as an unevaluated frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import charts, quality, stats
from tablewright.operators.columns import numeric_columns
from tablewright.operators.unify import unify


@dataclass
class Settings:
    """Which sections to build."""

    statistics: bool = True
    correlation: bool = True
    distribution: bool = True
    quality: bool = True
    charts: bool = False
    quality_threshold: float = 0.8
    columns: Sequence[str] | None = None
    constraints: dict[str, dict[str, Any]] | None = None


PRESETS = {
    "quick": Settings(correlation=False, distribution=False, quality=False),
    "comprehensive": Settings(charts=True),
    "quality": Settings(correlation=False, distribution=False),
    "visual": Settings(quality=False, charts=True),
}


def analyze(data: DataFrame | dict[str, DataFrame], settings: Settings | str = "comprehensive") -> dict[str, DataFrame]:
    """Sections by name. Several sources are unified first; nothing runs here."""
    s = PRESETS[settings] if isinstance(settings, str) else settings
    df = unify(data) if isinstance(data, dict) else data
    numbers = numeric_columns(df, s.columns)
    out = {"summary": stats.table_summary(df), "columns": stats.column_report(df)}
    if s.statistics and numbers:
        out["statistics"] = stats.descriptive(df, numbers)
    if s.correlation and len(numbers) > 1:
        out["correlation"] = stats.correlation(df, numbers)
    if s.distribution and numbers:
        out["distribution"] = stats.distribution(df, numbers)
    if s.quality:
        metrics = quality.quality_metrics(df, s.constraints)
        out["quality"] = metrics
        out["advice"] = quality.quality_advice(metrics)
        out["warnings"] = metrics.filter(F.col("overall_score") < s.quality_threshold).select(
            F.lit("low_quality").alias("warning"), "overall_score"
        )
    if s.charts:
        out |= {f"chart_{k}": v for k, v in charts.dashboard(df).items()}
    return out


def _long(frame: DataFrame, section: str, label: str | None) -> DataFrame:
    numbers = [n for n, t in frame.dtypes if t in ("double", "bigint", "int", "float") and n != label]
    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in numbers]))
    name = F.lit("*") if label is None else F.col(label)
    return frame.select(F.lit(section).alias("section"), name.alias("column"), cells)


def flat_report(df: DataFrame, settings: Settings | str = "comprehensive") -> DataFrame:
    """The numeric sections of an analysis as ``(section, column, metric, value)``."""
    parts = analyze(df, settings)
    keyed = {"statistics": "column", "distribution": "column"}
    rows = [_long(parts[n], n, keyed.get(n)) for n in ("summary", "statistics", "distribution", "quality") if n in parts]
    if "correlation" in parts:
        pair = parts["correlation"].select(F.concat_ws("|", "column1", "column2").alias("pair"), "r")
        rows.append(_long(pair, "correlation", "pair"))
    return reduce(DataFrame.unionByName, rows)


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics and quality scores of a table in one tidy frame."""
    scores = quality.component_scores(df, columns)
    return stats.summary_report(df, columns).unionByName(_long(scores, "quality", None))
