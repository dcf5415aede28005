"""Per-column and per-row outlier rules, votes and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import numeric_columns, present_double, quoted, rows_of
from tablewright.operators.quantiles import with_quantiles
from tablewright.operators.relational import first_per_group
from tablewright.operators.stats import descriptive
from tablewright.session import attach

DEFAULT_THRESHOLD = {"iqr": 1.5, "zscore": 3.0}


def bounds(df: DataFrame, columns: Sequence[str], method: str = "iqr", threshold: float | None = None, sample: bool = True) -> DataFrame:
    """One row with ``lo_i`` and ``hi_i`` per column, beyond which a value is an outlier.

    A z-score limit is the same test as a distance from the mean; with no
    spread there are no outliers.
    """
    if method not in DEFAULT_THRESHOLD:
        raise ValueError(f"unknown method: {method}")
    k = DEFAULT_THRESHOLD[method] if threshold is None else threshold
    if method == "iqr":
        row = with_quantiles(df, columns, (0.25, 0.75))
        out = []
        for i, c in enumerate(columns):
            q = F.col(f"`q_{c}`")
            out += [(q[0] - k * (q[1] - q[0])).alias(f"lo{i}"), (q[1] + k * (q[1] - q[0])).alias(f"hi{i}")]
        return row.select(*out)
    spread = F.stddev_samp if sample else F.stddev_pop
    row = df.agg(
        *[F.avg(present_double(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[spread(present_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    reach = lambda i: F.when(F.col(f"s{i}") > 0, k * F.col(f"s{i}")).otherwise(F.lit(float("inf")))
    return row.select(
        *[(F.col(f"m{i}") - reach(i)).alias(f"lo{i}") for i in range(len(columns))],
        *[(F.col(f"m{i}") + reach(i)).alias(f"hi{i}") for i in range(len(columns))],
    )


def flag(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float | None = None, sample: bool = True) -> DataFrame:
    """Add ``<column>_outlier`` for each column; missing values are never outliers."""
    columns = numeric_columns(df, columns)
    with_bounds = attach(df, bounds(df, columns, method, threshold, sample), "_b")
    tests = {}
    for i, c in enumerate(columns):
        v = present_double(df, c)
        tests[f"{c}_outlier"] = F.coalesce((v < F.col(f"_b.lo{i}")) | (v > F.col(f"_b.hi{i}")), F.lit(False))
    return with_bounds.withColumns(tests).drop("_b")


def outlier_stats(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """Values, outliers, ratio and bounds per column; z-scores report no bounds."""
    columns = numeric_columns(df, columns)
    limit = bounds(df, columns, method, threshold)
    seen = attach(df.select(*[quoted(c) for c in columns]), limit, "_b")
    aggs = []
    for i, c in enumerate(columns):
        v = present_double(df, c)
        lo, hi = F.col(f"_b.lo{i}"), F.col(f"_b.hi{i}")
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if((v < lo) | (v > hi)).alias(f"o{i}"),
            F.max(lo).alias(f"lo{i}"),
            F.max(hi).alias(f"hi{i}"),
        ]
    none = F.lit(None).cast("double")
    return rows_of(
        seen.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "total_values": F.col(f"n{i}"),
                "outlier_count": F.col(f"o{i}"),
                "outlier_ratio": F.coalesce(F.try_divide(F.col(f"o{i}"), F.col(f"n{i}")), F.lit(0.0)),
                "lower_bound": F.col(f"lo{i}") if method == "iqr" else none,
                "upper_bound": F.col(f"hi{i}") if method == "iqr" else none,
            }
            for i, c in enumerate(columns)
        ],
    )


def outlier_rows(df: DataFrame, key: str, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float | None = None, per_column: int | None = None) -> DataFrame:
    """Flagged cells as ``(column, key, value)``, all of them or the first few per column."""
    columns = numeric_columns(df, columns)
    limits = attach(df.select(quoted(key), *[quoted(c) for c in columns if c != key]), bounds(df, columns, method, threshold), "_b")
    cells = F.inline(
        F.filter(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        present_double(df, c).alias("value"),
                        ((present_double(df, c) < F.col(f"_b.lo{i}")) | (present_double(df, c) > F.col(f"_b.hi{i}"))).alias("out"),
                    )
                    for i, c in enumerate(columns)
                ]
            ),
            lambda s: s["out"],
        )
    )
    found = limits.select(quoted(key), cells).drop("out").select("column", quoted(key), "value")
    if per_column is None:
        return found
    return first_per_group(found, "column", [F.asc(key)], per_column)


def row_zscore(df: DataFrame, key: str, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """Largest |z| over the columns (missing read as 0), label -1 beyond the limit."""
    columns = [c for c in numeric_columns(df, columns) if c != key]
    filled = df.select(quoted(key), *[F.coalesce(present_double(df, c), F.lit(0.0)).alias(c) for c in columns])
    stats = filled.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_samp(quoted(c)).alias(f"s{i}") for i, c in enumerate(columns)],
    )
    z = [
        F.abs(F.try_divide(quoted(c) - F.col(f"_s.m{i}"), F.col(f"_s.s{i}"))) for i, c in enumerate(columns)
    ]
    score = z[0] if len(z) == 1 else F.greatest(*z)
    scored = attach(filled, stats).select(quoted(key), score.alias("score"))
    return scored.withColumn("label", F.when(F.col("score") > threshold, -1).otherwise(1))


def anomaly_stats(scored: DataFrame) -> DataFrame:
    """Counts, ratio and score range of any ``(key, score, label)`` frame."""
    bad = F.count_if(F.col("label") == -1)
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        bad.alias("anomalies"),
        F.count_if(F.col("label") == 1).alias("normal"),
        F.try_divide(bad, F.count(F.lit(1))).alias("anomaly_ratio"),
        F.avg("score").alias("mean_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )


def vote(labelled: Mapping[str, DataFrame], key: str, voting_threshold: float = 0.5) -> DataFrame:
    """Votes per row over several ``(key, label)`` frames and the joint decision.

    The frames are stacked and counted per key: one shuffle whatever their number.
    """
    parts = [df.select(quoted(key), (F.col("label") == -1).cast("int").alias("v")) for df in labelled.values()]
    n = len(parts)
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy(key)
        .agg(F.sum("v").alias("votes"))
        .withColumn("label", F.when((F.col("votes") > 0) & (F.col("votes") >= voting_threshold * n), -1).otherwise(1))
    )


def vote_summary(votes: DataFrame, methods: int) -> DataFrame:
    out = F.col("label") == -1
    return votes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(out).alias("outliers"),
        F.try_divide(F.count_if(out), F.count(F.lit(1))).alias("outlier_ratio"),
        F.coalesce(F.avg(F.when(out, F.col("votes"))) / methods, F.lit(0.0)).alias("confidence"),
    )


def flagged_summary(df: DataFrame, flagged: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """Descriptive statistics of the flagged rows only."""
    return descriptive(df.filter(flagged), columns).select("column", "count", "mean", "std", "min", "max")


def compare_methods(labelled: Mapping[str, DataFrame]) -> DataFrame:
    """Outlier counts of several methods side by side."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == -1).alias("outliers")).select(
            F.lit(name).alias("method"), "total", "outliers", F.try_divide("outliers", "total").alias("outlier_ratio")
        )
        for name, df in labelled.items()
    ]
    return reduce(DataFrame.unionByName, parts)
