"""Exact linear-interpolation quantiles and modes at any size.

Small inputs use Spark's ``percentile``, which keeps a value-to-count map per
group. Large inputs narrow first: a mergeable sketch brackets each wanted rank
to a sliver of the rows, one more scan counts what lies below the bracket and
keeps the distinct values inside it, and the exact order statistics are read
off that sliver. The sketch's rank error is a hard bound, so the bracket always
holds the answer; the plan raises an error rather than return a wrong value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.columns import present_double, quoted
from tablewright.session import beside, is_small, join_groups, match, stage

SKETCH_ACCURACY = 50_000


def percentile_of(value: Column, probabilities: Sequence[float]) -> Column:
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities]))


def _sketch(df: DataFrame, columns: Sequence[str], edges: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """``(by..., _ci, _e)``: approximate edges per column number."""
    if by:
        return _tall(df, columns, by).groupBy(*by, "_ci").agg(F.percentile_approx("_v", list(edges), accuracy).alias("_e"))
    row = df.agg(*[F.percentile_approx(present_double(df, c), list(edges), accuracy).alias(f"e{i}") for i, c in enumerate(columns)])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("_ci"), F.col(f"e{i}").alias("_e")) for i in range(len(columns))]))
    ).filter("_e IS NOT NULL")


def _tall(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per non-missing cell, columns by number."""
    cells = F.inline(
        F.array(*[F.struct(F.lit(i).alias("_ci"), present_double(df, c).alias("_v")) for i, c in enumerate(columns)])
    )
    return df.select(*[quoted(k) for k in by], cells).filter("_v IS NOT NULL")


def _bracketed(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """``(by..., _ci, q)`` in two scans whose shuffles do not grow with the rows.

    The sketch gives a bracket for every probability. The second scan puts each
    value into a segment between brackets; segments outside keep a count and
    their ends, segments inside a bracket their distinct values. These pieces, a
    sliver of the rows, are checkpointed: the steps after them read one and the
    same version, and neither scan is repeated.
    """
    keys = [*by, "_ci"]
    eps = 2.0 / accuracy
    ps = sorted(set(map(float, probabilities)))
    edges = [e for p in ps for e in (max(0.0, p - eps), min(1.0, p + eps))]
    sketch = _sketch(df, columns, edges, by, accuracy)
    cells = _tall(df, columns, by)
    # Without groups there is one row per column, so its size is bounded and the rows never move.
    cells = join_groups(cells, sketch, keys) if by else cells.join(F.broadcast(sketch), keys)
    v = F.col("_v")
    begun = sum(((F.col("_e")[2 * j] <= v).cast("int") for j in range(len(ps))), F.lit(0))
    over = sum(((F.col("_e")[2 * j + 1] < v).cast("int") for j in range(len(ps))), F.lit(0))
    pieces = stage(
        cells.select(*keys, "_v", begun.alias("_b"), over.alias("_o"))
        .select(*keys, "_v", (F.col("_b") + F.col("_o")).alias("_seg"), F.when(F.col("_b") > F.col("_o"), F.col("_v")).alias("_in"))
        .groupBy(*keys, "_seg", "_in")
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    totals = pieces.groupBy(*keys, "_seg").agg(F.sum("_c").alias("_t"))
    earlier = Window.partitionBy(*[quoted(k) for k in keys]).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[quoted(k) for k in keys])
    offsets = totals.select(
        *keys, "_seg", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"), F.sum("_t").over(whole).alias("_n")
    )
    inside = Window.partitionBy(*[quoted(k) for k in keys], "_seg").orderBy("_in").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (
        match(pieces.withColumn("_run", F.sum("_c").over(inside)), offsets, [*keys, "_seg"], small=not by)
        .withColumn("_end", F.col("_off") + F.col("_run"))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at(rank: Column) -> Column:
        here = (F.col("_start") <= rank) & (rank < F.col("_end"))
        exact = (
            F.when(F.col("_in").isNotNull(), F.col("_in"))
            .when(rank == F.col("_end") - 1, F.col("_max"))
            .when(rank == F.col("_start"), F.col("_min"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        )
        return F.max(F.when(here, exact))

    place = lambda p: (F.col("_n") - 1) * F.lit(p)
    found = spans.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(place(p))).alias(f"a{j}") for j, p in enumerate(ps)],
        *[at(F.ceil(place(p))).alias(f"b{j}") for j, p in enumerate(ps)],
    )

    def value(p: float) -> Column:
        j = ps.index(float(p))
        part = place(float(p)) - F.floor(place(float(p)))
        return F.col(f"a{j}") + part * (F.col(f"b{j}") - F.col(f"a{j}"))

    return found.select(*keys, F.array(*[value(p) for p in probabilities]).alias("q"))


def _in_one_task(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> bool:
    """Whether Spark's value-to-count map stays small enough for one reducer."""
    return is_small(df.select(*[quoted(c) for c in dict.fromkeys([*by, *columns])]), 1 / 16)


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    force_distributed: bool = False,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """One row per ``(by..., column)`` with the array ``q`` in probability order."""
    if not force_distributed and _in_one_task(df, columns, by):
        wide = df.groupBy(*by).agg(
            *[percentile_of(present_double(df, c), probabilities).alias(f"q{i}") for i, c in enumerate(columns)]
        )
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"q{i}").alias("q")) for i, c in enumerate(columns)]
        return wide.select(*by, F.inline(F.array(*cells)))
    found = _bracketed(df, columns, probabilities, by, accuracy)
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(*by, names[F.col("_ci")].alias("column"), "q")


def with_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    aggregates: Sequence[Column] = (),
    by: Sequence[str] = (),
    force_distributed: bool = False,
) -> DataFrame:
    """Aggregates and quantile arrays in one row per group.

    Output: ``by...``, the given aggregates, and ``q_<column>`` arrays. The
    aggregates run apart from the quantiles: beside a value-to-count map they
    would lose their generated code.
    """
    if not force_distributed and _in_one_task(df, columns, by):
        wide = df.groupBy(*by).agg(
            *[percentile_of(present_double(df, c), probabilities).alias(f"q_{c}") for c in columns]
        )
    else:
        found = _bracketed(df, columns, probabilities, by, SKETCH_ACCURACY)
        wide = found.groupBy(*by).agg(
            *[F.max(F.when(F.col("_ci") == i, F.struct("q"))).getField("q").alias(f"q_{c}") for i, c in enumerate(columns)]
        )
    if not aggregates:
        return wide
    base = df.groupBy(*by).agg(*aggregates)
    if not by:
        return beside(base, wide)
    renamed = wide.select(*[quoted(b).alias(f"_k_{b}") for b in by], *[F.col(f"`q_{c}`") for c in columns])
    match = None
    for b in by:
        one = quoted(b).eqNullSafe(F.col(f"`_k_{b}`"))
        match = one if match is None else match & one
    return base.join(renamed, match, "left").drop(*[f"_k_{b}" for b in by])


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column as text, smallest of ties; counts, not maps."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = None
    for kind in dict.fromkeys(kinds[c].simpleString() for c in columns):
        same = [c for c in columns if kinds[c].simpleString() == kind]
        cells = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in same])
        ).alias("cell")
        top = (
            df.select(cells)
            .select("cell.*")
            .filter(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("column")
            .agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("value"))).alias("m"))
            .select("column", F.col("m.value").cast("string").alias("mode"), (-F.col("m.neg")).alias("mode_count"))
        )
        out = top if out is None else out.unionByName(top)
    return out
