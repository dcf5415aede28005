"""Word labels put on numbers. Thresholds are fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def banded(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose upper bound lies above ``value``; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in bands:
        out = out.when(value < bound, label)
    return out.otherwise(otherwise)


def skew_label(skew: Column) -> Column:
    return banded(F.abs(skew), [(0.5, "symmetric"), (1.0, "moderately_skewed")], "highly_skewed")


def kurtosis_label(kurt: Column) -> Column:
    return banded(kurt, [(-1.0, "flat"), (1.0, "normal_peak")], "peaked")


def correlation_label(r: Column) -> Column:
    return banded(
        F.abs(r),
        [(0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")],
        "very_strong",
    )


def strength_band(r: Column) -> Column:
    """Two-band strength used by the plain correlation report."""
    a = F.abs(r)
    return F.when(a > 0.7, "strong").when(a > 0.3, "moderate").otherwise("weak")


def effect_label(d: Column) -> Column:
    return banded(F.abs(d), [(0.2, "small"), (0.5, "medium"), (0.8, "large")], "very_large")


def effect_label_short(d: Column) -> Column:
    return banded(F.abs(d), [(0.2, "small"), (0.5, "medium")], "large")


def distribution_class(skew: Column, kurt: Column) -> Column:
    return (
        F.when((F.abs(skew) < 0.5) & (F.abs(kurt) < 1), "near_normal")
        .when(skew > 1, "right_skewed")
        .when(skew < -1, "left_skewed")
        .when(kurt > 3, "heavy_tailed")
        .when(kurt < -1, "light_tailed")
        .otherwise("mixed")
    )


def compare(op: Column, left: Column, right: Column) -> Column:
    """Apply a comparison named by data (gt/lt/eq/gte/lte); unknown names fail the test."""
    return (
        F.when(op == "gt", left > right)
        .when(op == "lt", left < right)
        .when(op == "eq", left == right)
        .when(op == "gte", left >= right)
        .when(op == "lte", left <= right)
        .otherwise(F.lit(False))
    )
