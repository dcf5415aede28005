"""The rows behind each kind of chart: small, aggregated, ready to draw."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import probability
from tablewright.operators import stats
from tablewright.operators.columns import numeric_columns, present_double, quoted, string_columns
from tablewright.operators.quantiles import quantiles, with_quantiles
from tablewright.operators.ranks import running_total
from tablewright.session import attach, join_groups, scalars


def bar(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Counts per category, or the sum of ``y``."""
    value = F.count(F.lit(1)).cast("double") if y is None else F.sum(present_double(df, y))
    return df.filter(quoted(x).isNotNull()).groupBy(x).agg(value.alias("value"))


def grouped_bar(df: DataFrame, x: str, y: str, hue: str) -> DataFrame:
    return df.groupBy(x, hue).agg(F.avg(present_double(df, y)).alias("mean"))


def line(df: DataFrame, x: str, ys: Sequence[str], hue: str | None = None) -> DataFrame:
    keys = [*([hue] if hue else []), x]
    return df.select(*[quoted(k) for k in keys], *[quoted(y) for y in ys]).orderBy(*[quoted(k) for k in keys])


def multi_series(df: DataFrame, time: str, series: Sequence[str]) -> DataFrame:
    """``(time, series, value)`` sorted by time."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("series"), present_double(df, c).alias("value")) for c in series]))
    return df.select(quoted(time), cells).orderBy(time, "series")


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """The points, or a random share of them for drawing."""
    points = df.select(*[quoted(c) for c in [x, y, *([hue] if hue else [])]]).dropna(subset=[x, y])
    return points if fraction is None else points.sample(fraction=fraction, seed=seed)


def _bin(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / bins
    return F.when(width > 0, F.least(F.floor((value - lo) / width), F.lit(bins - 1))).otherwise(0).cast("int")


def density_grid(df: DataFrame, x: str, y: str, bins: int = 20, hue: str | None = None) -> DataFrame:
    """Counts of points on a bins x bins grid; the drawable form of any scatter."""
    points = df.select(present_double(df, x).alias("x"), present_double(df, y).alias("y"), *([quoted(hue)] if hue else [])).filter(
        "x IS NOT NULL AND y IS NOT NULL"
    )
    edges = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    s = attach(points, edges)
    keys = [_bin(F.col("x"), F.col("_s.x0"), F.col("_s.x1"), bins).alias("x_bin"), _bin(F.col("y"), F.col("_s.y0"), F.col("_s.y1"), bins).alias("y_bin")]
    return s.groupBy(*keys, *([hue] if hue else [])).agg(F.count(F.lit(1)).alias("n"))


def scatter_matrix(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """Density grids of every pair of numeric columns, one pass."""
    columns = numeric_columns(df, columns)
    edges = df.agg(*[f(present_double(df, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    s = attach(df, edges)
    binned = [_bin(present_double(df, c), F.col(f"_s.lo{i}"), F.col(f"_s.hi{i}"), bins) for i, c in enumerate(columns)]
    cells = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(columns[i]).alias("x"),
                    F.lit(columns[j]).alias("y"),
                    F.when(present_double(df, columns[i]).isNotNull() & present_double(df, columns[j]).isNotNull(), binned[i]).alias("x_bin"),
                    binned[j].alias("y_bin"),
                )
                for i in range(len(columns))
                for j in range(i + 1, len(columns))
            ]
        )
    )
    return s.select(cells).filter("x_bin IS NOT NULL").groupBy("x", "y", "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 30, hue: str | None = None) -> DataFrame:
    return stats.histogram(df, [column], bins, [hue] if hue else [])


def _fenced(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The values of each group beside its count, quartiles and fences."""
    rows = df.select(*[quoted(k) for k in keys], present_double(df, value).alias("v")).filter("v IS NOT NULL")
    q = with_quantiles(rows, ["v"], (0.25, 0.5, 0.75), [F.count(F.lit(1)).alias("n")], keys)
    iqr = F.col("q_v")[2] - F.col("q_v")[0]
    fences = q.select(*keys, "n", F.col("q_v").alias("q"), (F.col("q_v")[0] - 1.5 * iqr).alias("lo"), (F.col("q_v")[2] + 1.5 * iqr).alias("hi"))
    return join_groups(rows, fences, keys) if keys else attach(rows, fences).select("v", "_s.*")


def box_fliers(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The values beyond the fences of their group, one row each."""
    keys = list(by)
    outside = (F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))
    return _fenced(df, value, keys).filter(outside).select(*[quoted(k) for k in keys], F.col("v").alias("value"))


def box(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 IQR, and the flier count; see ``box_fliers`` for the values."""
    keys = list(by)
    joined = _fenced(df, value, keys)
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return joined.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.col("q")[0]).alias("q1"),
        F.max(F.col("q")[1]).alias("median"),
        F.max(F.col("q")[2]).alias("q3"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("fliers"),
    )


def heatmap(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    return stats.correlation_matrix(df, columns, method)


def pivot_heatmap(df: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Mean of ``value`` for every (y, x) cell that occurs."""
    return df.groupBy(y, x).agg(F.avg(present_double(df, value)).alias("mean"))


def pivot_table(df: DataFrame, x: str, y: str, value: str, x_values: Sequence) -> DataFrame:
    """The same as a table with one column per listed ``x`` value."""
    return df.groupBy(y).pivot(x, list(x_values)).agg(F.avg(present_double(df, value)))


def pie(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    parts = bar(df, category, value)
    total = scalars(parts.agg(F.sum("value").alias("t"))).getField("t")
    return parts.select(category, "value", F.try_divide(F.col("value") * 100, total).alias("percent"))


def _hermite_terms(error: float) -> int:
    """Terms after which what is left of the series, within half a bandwidth of the centre, stays below ``error``."""
    k, term = 0, 1.09
    while 2 * term > error:  # each further term is less than half the one before
        k += 1
        term *= 0.5 / math.sqrt(k)
    return max(k, 1)


def density(df: DataFrame, column: str, points: int = 100, error: float = 1e-12) -> DataFrame:
    """Gaussian kernel density on an even grid (violin and density plots).

    A fast Gauss transform: rows are summed into cells one bandwidth wide, each
    kept as moments about its centre, and a grid point reads a truncated Hermite
    series of every cell within reach. Series and reach leave out at most
    ``error`` times the kernel's peak, 1 / (bandwidth * sqrt(2 pi)). After one
    aggregation the work depends on the cells, not on the number of rows. A
    column of one value, or with a single row, has null densities.
    """
    if points < 2 or not 0 < error < 1:
        raise ValueError("density takes two points or more and an error between 0 and 1")
    terms, reach = _hermite_terms(error / 2), math.sqrt(2 * math.log(2 / error))
    rows = df.select(present_double(df, column).alias("v")).filter("v IS NOT NULL")
    base = rows.agg(F.count("v").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    lo, last = F.col("_s.lo"), points - 1
    width = F.col("_s.s") * F.pow(F.col("_s.n").cast("double"), -0.2)
    centre = lo + (F.col("cell") + 0.5) * F.col("bw")
    cell = F.coalesce(F.floor(F.try_divide(F.col("v") - lo, F.col("bw"))), F.lit(0))
    s = attach(rows, base).withColumn("bw", width).withColumn("cell", cell)
    s = s.withColumn("t", F.try_divide(F.col("v") - centre, F.col("bw") * math.sqrt(2)))
    moments = [F.sum(F.pow("t", F.lit(float(k))) / float(math.factorial(k))) for k in range(terms)]
    fine = attach(s.groupBy("cell").agg(F.array(*moments).alias("m")), base).withColumn("bw", width)
    step = (F.col("_s.hi") - lo) / last
    low = F.ceil(F.try_divide(centre - (reach + 0.5) * F.col("bw") - lo, step))
    high = F.floor(F.try_divide(centre + (reach + 0.5) * F.col("bw") - lo, step))
    near = F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit(last)))
    # the first cell always holds a row: it names every point, also those out of all reach
    seen = F.when(F.col("cell") == 0, F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).when((low <= last) & (high >= 0) & (low <= high), near)
    placed = fine.withColumn("i", F.explode(seen)).withColumn("x", lo + (F.col("_s.hi") - lo) * F.col("i") / last)
    placed = placed.withColumn("y", F.try_divide(F.col("x") - centre, F.col("bw") * math.sqrt(2)))
    zero, one = F.lit(0.0), F.lit(1.0)
    start = F.struct(zero.alias("a"), one.alias("b"), zero.alias("k"), zero.alias("sum"))

    def more(acc: Column, moment: Column) -> Column:
        after = 2 * F.col("y") * acc["b"] - 2 * acc["k"] * acc["a"]
        return F.struct(acc["b"].alias("a"), after.alias("b"), (acc["k"] + 1).alias("k"), (acc["sum"] + moment * acc["b"]).alias("sum"))

    series = F.aggregate("m", start, more, lambda acc: acc["sum"]) * F.exp(-F.col("y") * F.col("y"))
    weight = F.sum(F.when(F.abs("y") * math.sqrt(2) > reach + 1, zero).otherwise(series))
    peak = F.max("_s.n") * F.max("bw") * math.sqrt(2 * math.pi)
    return placed.groupBy(F.col("i").cast("int").alias("i")).agg(F.max("x").alias("x"), F.try_divide(weight, peak).alias("density"))


def qq(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Sample quantiles beside normal ones at evenly placed probabilities."""
    probabilities = [(i + 0.5) / points for i in range(points)]
    rows = df.select(present_double(df, column).alias("v"))
    q = quantiles(rows, ["v"], probabilities).select(F.posexplode("q").alias("i", "sample"))
    return q.select(
        "i", ((F.col("i") + 0.5) / points).alias("probability"), "sample", probability.normal_quantile_of((F.col("i") + 0.5) / points).alias("theoretical")
    )


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    counts = df.select(present_double(df, column).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = scalars(counts.agg(F.sum("n").alias("t"))).getField("t")
    return running_total(counts, ["value"], {"upto": F.col("n")}).select("value", "n", (F.col("upto") / total).alias("ecdf"))


def plot_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, spread, shape and quartiles shown next to plots."""
    d = stats.descriptive(df, columns).select("column", "mean", "std", "q25", "q50", "q75")
    return d.join(stats.distribution(df, columns).select("column", "skewness", "kurtosis"), "column")


def dashboard(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Default charts of all columns, or of ``columns``.

    The first of each kind has the plain name (``histogram``, ``box``, ``bar``),
    the others their column's name behind it; all pairs share ``scatter``.
    """
    numbers, words = numeric_columns(df, columns), string_columns(df, columns)
    out = {"columns": stats.column_report(df), "summary": stats.table_summary(df)}
    for i, c in enumerate(numbers):
        out["histogram" if i == 0 else f"histogram {c}"] = histogram(df, c)
        out["box" if i == 0 else f"box {c}"] = box(df, c)
    for i, c in enumerate(words):
        out["bar" if i == 0 else f"bar {c}"] = bar(df, c)
    if len(numbers) > 1:
        out["scatter"] = scatter_matrix(df, numbers)
        out["heatmap"] = heatmap(df, numbers)
    return out


KINDS = {
    "bar": bar,
    "grouped_bar": grouped_bar,
    "line": line,
    "scatter": scatter,
    "density_grid": density_grid,
    "scatter_matrix": scatter_matrix,
    "histogram": histogram,
    "box": box,
    "heatmap": heatmap,
    "pivot_heatmap": pivot_heatmap,
    "pie": pie,
    "violin": density,
    "density": density,
    "qq": qq,
    "ecdf": ecdf,
    "time_series": multi_series,
}


def chart(kind: str, df: DataFrame, *args, **kwargs) -> DataFrame:
    """Chart rows by kind."""
    if kind not in KINDS:
        raise ValueError(f"unknown chart: {kind}")
    return KINDS[kind](df, *args, **kwargs)


def chart_board(df: DataFrame, configs: Sequence[dict]) -> DataFrame:
    """Several aggregated charts stacked as ``(chart, json)`` rows."""
    parts = []
    for config in configs:
        options = {k: v for k, v in config.items() if k not in ("kind", "title")}
        rows = chart(config["kind"], df, **options)
        parts.append(rows.select(F.lit(config.get("title", config["kind"])).alias("chart"), F.to_json(F.struct("*")).alias("row")))
    return reduce(DataFrame.unionByName, parts)
