"""Global order without a global window: running totals, row numbers, ranks.

Every operator here has one exact result and two physical forms. Below the
size limit of ``session.is_small`` a plain window does the job. Above it the
rows are range-partitioned by the full order (so a hot group is spread over
many tasks), the numbered partitions are fixed by a checkpoint, and each
partition adds the total of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.columns import quoted
from tablewright.session import is_small, stage


def running_total(
    df: DataFrame,
    order: Sequence[str],
    amounts: dict[str, Column],
    by: Sequence[str] = (),
    force_distributed: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``amounts`` in ``order`` within ``by``.

    Rows must be unique in ``(by, order)`` where the sums are to be
    deterministic; callers aggregate to distinct values first.
    """
    keys = [quoted(b) for b in by]
    first_rows = (Window.unboundedPreceding, Window.currentRow)
    if not force_distributed and is_small(df):
        w = Window.partitionBy(*keys).orderBy(*[quoted(o) for o in order]).rowsBetween(*first_rows)
        return df.select("*", *[F.sum(a).over(w).alias(n) for n, a in amounts.items()])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(
        df.select("*", *[a.alias(f"_a_{n}") for n, a in amounts.items()])
        .repartitionByRange(parts, *keys, *[quoted(o) for o in order])
        .withColumn("_part", F.spark_partition_id())
    )
    # At most (range partitions + groups) rows: each group spans a run of partitions.
    totals = placed.groupBy(*by, "_part").agg(
        *[F.sum(f"_a_{n}").alias(f"_t_{n}") for n in amounts]
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[quoted(b).alias(f"_k_{b}") for b in by],
        F.col("_part").alias("_k_part"),
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in amounts],
    )
    match = F.col("_part") == F.col("_k_part")
    for b in by:
        match = match & quoted(b).eqNullSafe(F.col(f"`_k_{b}`"))
    local = (
        Window.partitionBy(*keys, "_part")
        .orderBy(*[quoted(o) for o in order])
        .rowsBetween(*first_rows)
    )
    return (
        placed.join(offsets, match)
        .select(
            *[quoted(c) for c in df.columns],
            *[
                (F.col(f"_o_{n}") + F.sum(f"_a_{n}").over(local)).alias(n)
                for n in amounts
            ],
        )
    )


def row_index(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "idx",
    force_distributed: bool = False,
) -> DataFrame:
    """Number rows 0..n-1 in ``order`` within ``by``."""
    one = {name: F.lit(1).cast("long")}
    numbered = running_total(df, order, one, by, force_distributed)
    return numbered.withColumn(name, F.col(name) - 1)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., value, n)``; a hot value collapses before the shuffle."""
    return df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(
    counts: DataFrame,
    value: str = "value",
    n: str = "n",
    by: Sequence[str] = (),
    force_distributed: bool = False,
) -> DataFrame:
    """Average rank of each distinct value from its count: (less) + (equal + 1) / 2."""
    total = running_total(counts, [value], {"_upto": F.col(n)}, by, force_distributed)
    return total.withColumn("rank", F.col("_upto") - F.col(n) + (F.col(n) + 1) / 2.0).drop("_upto")
