"""Quality over time: snapshots, their trend, forecast and alerts.

A snapshot table has ``dataset``, ``checked_at`` and one column per metric; windows run
within a dataset, whose history is short (one row per check).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.columns import rows_of

METRICS = ("completeness", "accuracy", "consistency", "validity", "overall_score")
BAND = 0.01


def direction(slope: Column) -> Column:
    return F.when(slope > BAND, "improving").when(slope < -BAND, "declining").otherwise("stable")


def strength(slope: Column) -> Column:
    """Ten times the slope within -1..1, zero inside the stable band."""
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), slope * 10))
    return F.when(F.abs(slope) > BAND, clipped).otherwise(0.0)


def _numbered(snapshots: DataFrame) -> DataFrame:
    w = Window.partitionBy("dataset").orderBy("checked_at")
    return snapshots.withColumn("i", F.row_number().over(w) - 1)


def snapshot_trend(snapshots: DataFrame, score: str = "overall_score") -> DataFrame:
    """Direction at each snapshot from the three snapshots before it."""
    before = Window.partitionBy("dataset").orderBy("checked_at").rowsBetween(-3, -1)
    slope = F.when(F.count(score).over(before) >= 2, F.regr_slope(F.col(score), F.col("i")).over(before))
    out = _numbered(snapshots).withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    return out.select("dataset", "checked_at", score, direction(F.col("slope")).alias("direction"), strength(F.col("slope")).alias("trend_score"))


def overall_trend(snapshots: DataFrame, since: Column | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean slope of the metrics over the recent history of each dataset."""
    recent = snapshots.filter(F.col("checked_at") >= since) if since is not None else snapshots
    slopes = [F.regr_slope(F.col(m), F.col("i")) for m in metrics]
    row = _numbered(recent).groupBy("dataset").agg(F.count(F.lit(1)).alias("snapshots"), (sum(slopes[1:], slopes[0]) / len(slopes)).alias("slope"))
    enough = F.col("snapshots") >= 2
    return row.select(
        "dataset",
        "snapshots",
        F.when(enough, direction(F.col("slope"))).otherwise("insufficient_data").alias("direction"),
        F.when(enough, strength(F.col("slope"))).otherwise(0.0).alias("trend_strength"),
    )


def forecast(snapshots: DataFrame, steps: int = 7, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Quadratic fit of each metric, extended ``steps`` ahead and kept within 0..1."""
    from tablewright.operators.timeseries import quadratic_fit, quadratic_value

    tall = rows_of(_numbered(snapshots), [{"metric": F.lit(m), "y": F.col(m)} for m in metrics], ["dataset", "i"])
    fit = quadratic_fit(tall, "i", "y", ["dataset", "metric"]).filter("n >= 3")
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    value = quadratic_value(F.col("n") - 1 + F.col("step"))
    return ahead.select("dataset", "metric", "step", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("predicted"))


def trend_alerts(snapshots: DataFrame, score: str = "overall_score", threshold: float = 0.8) -> DataFrame:
    """Sharp drop, steady decline and lasting low quality, judged on the last five."""
    back = Window.partitionBy("dataset").orderBy(F.desc("checked_at"))
    last = snapshots.withColumn("r", F.row_number().over(back)).filter("r <= 5")
    w = Window.partitionBy("dataset").orderBy("checked_at")
    steps = last.withColumn("change", F.col(score) - F.lag(score).over(w))
    row = steps.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("r") == 1, F.col("change"))).alias("last_change"),
        F.max("change").alias("largest_change"),
        F.count_if(F.col(score) < threshold).alias("low"),
    )
    found = F.filter(
        F.array(
            F.when((F.col("n") >= 2) & (F.col("last_change") < -0.1), F.lit("sharp_drop")),
            F.when((F.col("n") >= 3) & (F.col("largest_change") < 0), F.lit("steady_decline")),
            F.when(F.col("low") >= 3, F.lit("lasting_low")),
        ),
        lambda c: c.isNotNull(),
    )
    return row.select("dataset", F.explode(found).alias("alert"))


def dashboard(snapshots: DataFrame, score: str = "overall_score") -> DataFrame:
    """Latest score, mean, best, worst and count per dataset."""
    return snapshots.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("snapshots"),
        F.max_by(score, "checked_at").alias("latest"),
        F.max("checked_at").alias("latest_at"),
        F.avg(score).alias("mean"),
        F.max(score).alias("best"),
        F.min(score).alias("worst"),
    )


def trend_advice(snapshots: DataFrame, metrics: Sequence[str] = METRICS, threshold: float = 0.8) -> DataFrame:
    """Metrics of each dataset's latest snapshot that are below the threshold."""
    latest = snapshots.groupBy("dataset").agg(F.max_by(F.struct(*metrics), "checked_at").alias("m")).select("dataset", "m.*")
    return rows_of(latest, [{"metric": F.lit(m), "value": F.col(m)} for m in metrics], ["dataset"]).filter(F.col("value") < threshold)
