"""Time-series operators on (time, value) tables, one or many series at once.

A series is numbered 0..n-1 in time order. Frames that look at neighbouring
rows run on blocks of consecutive rows; each block also receives the few rows
before and after it that its frames reach into, so a very long series is many
independent tasks and never one sorted partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import probability
from tablewright.operators import shocks
from tablewright.operators.columns import present_double, quoted
from tablewright.operators.outliers import flag
from tablewright.operators.ranks import row_index
from tablewright.session import attach, join_groups, match, stage

BLOCK_ROWS = 65_536


def series(df: DataFrame, time: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., t, y, idx)`` in time order, missing values dropped."""
    rows = df.select(*[quoted(b) for b in by], quoted(time).alias("t"), present_double(df, value).alias("y")).filter(
        "y IS NOT NULL"
    )
    return row_index(rows, ["t", "y"], by)


def blocks(s: DataFrame, before: int, after: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_block`` and ``_home``; edge rows are repeated in the neighbouring block."""
    size = max(block_rows, 2 * (before + after), 1)
    own = F.floor(F.col("idx") / size)
    place = F.col("idx") % size
    spots = F.filter(
        F.array(
            F.struct(own.alias("block"), F.lit(True).alias("home")),
            F.when(place >= size - before, F.struct((own + 1).alias("block"), F.lit(False).alias("home"))),
            F.when(place < after, F.struct((own - 1).alias("block"), F.lit(False).alias("home"))),
        ),
        lambda b: b.isNotNull(),
    )
    return s.withColumn("_p", F.explode(spots)).select("*", F.col("_p.block").alias("_block"), F.col("_p.home").alias("_home")).drop("_p")


def framed(s: DataFrame, outputs, before: int, after: int, by: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Evaluate window expressions that reach ``before`` rows back and ``after`` ahead.

    ``outputs`` is a function from the block window to ``{name: Column}``.
    """
    w = Window.partitionBy(*[quoted(b) for b in by], "_block").orderBy("idx")
    placed = blocks(s, before, after, block_rows)
    return placed.select("*", *[c.alias(n) for n, c in outputs(w).items()]).filter("_home").drop("_block", "_home")


def _over_frame(expr: Column, w, low: int, high: int, rows: int) -> Column:
    """Aggregate over a row frame, null where the frame is cut off by the series' end."""
    frame = w.rowsBetween(low, high)
    return F.when(F.count("y").over(frame) == rows, expr.over(frame))


def moving_average(s: DataFrame, window: int, by: Sequence[str] = (), name: str = "average") -> DataFrame:
    """Centred moving average; an even window reaches one row further back."""
    back, ahead = window // 2, (window - 1) // 2
    return framed(s, lambda w: {name: _over_frame(F.avg("y"), w, -back, ahead, window)}, back, ahead, by)


def decompose(s: DataFrame, period: int, model: str = "additive", by: Sequence[str] = ()) -> DataFrame:
    """``trend``, ``seasonal`` and ``residual`` of every row.

    Trend is the centred moving average over one period (half weights at the
    ends for an even period); seasonal the centred mean per phase.
    """
    half = period // 2
    additive = model == "additive"
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model: {model}")

    def trend(w):
        if period % 2:
            return {"trend": _over_frame(F.avg("y"), w, -half, half, period)}
        inner = F.sum("y").over(w.rowsBetween(-half + 1, half - 1))
        ends = (F.lag("y", half).over(w) + F.lead("y", half).over(w)) / 2.0
        return {"trend": (inner + ends) / period}

    rows = framed(s, trend, half, half, by).withColumn("phase", F.col("idx") % period)
    gap = F.col("y") - F.col("trend") if additive else F.try_divide("y", "trend")
    means = rows.groupBy(*by, "phase").agg(F.avg(gap).alias("m"))
    if by:
        centre = means.groupBy(*by).agg(F.avg("m").alias("c"))
        means = match(means, centre, list(by))
        rows = join_groups(rows, means, [*by, "phase"], "left")
        m, c = F.col("m"), F.col("c")
    else:
        table = means.agg(F.map_from_entries(F.collect_list(F.struct("phase", "m"))).alias("by_phase"), F.avg("m").alias("c"))
        rows = attach(rows, table)
        m, c = F.col("_s.by_phase")[F.col("phase")], F.col("_s.c")
    seasonal = m - c if additive else F.try_divide(m, c)
    rest = F.col("y") - F.col("seasonal") - F.col("trend") if additive else F.try_divide(F.col("y"), F.col("seasonal") * F.col("trend"))
    return rows.withColumn("seasonal", seasonal).withColumn("residual", rest).select(
        *by, "t", "y", "idx", "phase", "trend", "seasonal", "residual"
    )


def decomposition_strength(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend, seasonal and residual strength of a decomposition."""
    v = F.var_samp("y")
    part = lambda c: F.when(v > 0, F.greatest(F.lit(0.0), 1 - F.var_samp(F.col("y") - F.col(c)) / v)).otherwise(0.0)
    return parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        part("trend").alias("trend_strength"),
        part("seasonal").alias("seasonal_strength"),
        F.when(v > 0, F.least(F.lit(1.0), F.var_samp("residual") / v)).otherwise(0.0).alias("residual_strength"),
    )


# --- trend ----------------------------------------------------------------------------


def linear_trend(s: DataFrame, by: Sequence[str] = (), value: str = "y") -> DataFrame:
    """Least squares on the row number with R2, standard error and direction."""
    y, x = F.col(value), F.col("idx").cast("double")
    fit = s.filter(y.isNotNull()).groupBy(*by).agg(
        F.count(y).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.avg(x).alias("mean_x"),
    )
    r2 = F.coalesce("r2", F.lit(0.0))
    return fit.withColumns(
        {
            "std_err": F.sqrt(F.try_divide((1 - r2) * F.col("syy"), F.col("sxx") * (F.col("n") - 2))),
            "direction": F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat"),
        }
    )


def trend_significance(fit: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p-value of the slope and a direction that is flat unless significant."""
    p = probability.t_p_value(F.try_divide("slope", "std_err"), (F.col("n") - 2).cast("double"))
    return fit.withColumn("p_value", p).withColumn(
        "trend", F.when(F.col("p_value") < alpha, F.when(F.col("slope") > 0, "up").otherwise("down")).otherwise("flat")
    )


def trend_line(s: DataFrame, fit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    if by:
        rows = join_groups(s, fit.select(*by, "slope", "intercept"), list(by))
        return rows.select(*by, "t", "idx", (F.col("slope") * F.col("idx") + F.col("intercept")).alias("trend"))
    rows = attach(s, fit.select("slope", "intercept"))
    return rows.select("t", "idx", (F.col("_s.slope") * F.col("idx") + F.col("_s.intercept")).alias("trend"))


def quadratic_fit(s: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Degree-2 least squares for x = 0..n-1, from one aggregation.

    x is shifted to its middle, where the odd moments vanish and the even ones
    are known from n, which leaves three sums over y.
    """
    v, u = F.col(y), F.col(x).cast("double")
    sums = s.filter(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("var"), F.covar_pop(u, v).alias("cuv"), F.covar_pop(u * u, v).alias("cuuv")
    )
    n = F.col("n").cast("double")
    mid = (n - 1) / 2.0
    s2 = (n * n - 1) / 12.0
    s4 = (3 * n * n * n * n - 10 * n * n + 7) / 240.0
    # Covariance of y with (x - mid)^2 follows from those with x^2 and x.
    c2 = F.col("cuuv") - 2 * mid * F.col("cuv")
    a2 = F.try_divide(c2, s4 - s2 * s2)
    a1 = F.try_divide(F.col("cuv"), s2)
    a0 = F.col("m") - a2 * s2
    explained = a1 * F.col("cuv") + a2 * c2
    return sums.select(
        *by,
        "n",
        (a0 - a1 * mid + a2 * mid * mid).alias("c0"),
        (a1 - 2 * a2 * mid).alias("c1"),
        a2.alias("c2"),
        F.coalesce(F.try_divide(explained, F.col("var")), F.lit(0.0)).alias("r2"),
    )


def quadratic_value(x: Column) -> Column:
    return F.col("c0") + F.col("c1") * x + F.col("c2") * x * x


def moving_average_trend(s: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Direction from the means of the first and second half of the moving average.

    The window is a quarter of the series, between 2 and 7 rows; every window
    that may apply is computed in one frame pass and each series picks its own.
    """
    sizes = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    window = F.greatest(F.lit(2), F.least(F.lit(7), F.floor(F.col("n") / 4)))
    sizes = sizes.select(*by, "n", window.cast("int").alias("window"))

    def averages(w):
        return {f"a{k}": _over_frame(F.avg("y"), w, -(k // 2), (k - 1) // 2, k) for k in range(2, 8)}

    rows = framed(s, averages, 3, 3, by)
    if by:
        rows = join_groups(rows, sizes, list(by))
        n, k = F.col("n"), F.col("window")
    else:
        rows = attach(rows, sizes)
        n, k = F.col("_s.n"), F.col("_s.window")
    chosen = F.element_at(F.array(*[F.col(f"a{i}") for i in range(2, 8)]), k - 1)
    halves = rows.groupBy(*by).agg(
        F.max(n).alias("n"),
        F.max(k).alias("window"),
        F.avg(F.when(F.col("idx") < F.floor(n / 2), chosen)).alias("first_half"),
        F.avg(F.when(F.col("idx") >= F.floor(n / 2), chosen)).alias("second_half"),
        F.count(chosen).alias("averages"),
    )
    a, b = F.col("first_half"), F.col("second_half")
    way = F.when(F.col("averages") < 2, "unknown").when(b > a, "up").when(b < a, "down").otherwise("flat")
    return halves.select(*by, "n", "window", "first_half", "second_half", way.alias("direction"))


# --- seasonality ---------------------------------------------------------------------------


def autocorrelation(s: DataFrame, max_lag: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., lag, acf)`` for lags 0..min(max_lag, n // 2)."""
    means = s.groupBy(*by).agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    if by:
        centred = join_groups(s, means, list(by)).withColumn("y", F.col("y") - F.col("m"))
    else:
        centred = attach(s, means).withColumn("y", F.col("y") - F.col("_s.m")).withColumn("n", F.col("_s.n")).drop("_s")
    shifted = framed(centred, lambda w: {f"l{k}": F.lag("y", k).over(w) for k in range(1, max_lag + 1)}, max_lag, 0, by)
    sums = shifted.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sum(F.col("y") * F.col("y")).alias("s0"),
        *[F.sum(F.col("y") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)],
    )
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"s{k}"), F.col("s0")).alias("acf")) for k in range(max_lag + 1)])
    return sums.select(*by, F.floor(F.col("n") / 2).alias("limit"), F.inline(cells)).filter("lag <= limit").drop("limit")


def seasonal_period(s: DataFrame, max_lag: int = 12, by: Sequence[str] = ()) -> DataFrame:
    """Lag of the highest local peak of the autocorrelation, 1 if there is none."""
    acf = autocorrelation(s, max_lag, by)
    w = Window.partitionBy(*[quoted(b) for b in by]).orderBy("lag") if by else Window.partitionBy(F.lit(0)).orderBy("lag")
    marked = acf.select("*", F.lag("acf").over(w).alias("left"), F.lead("acf").over(w).alias("right"))
    peak = (F.col("acf") > F.col("left")) & (F.col("acf") > F.col("right"))
    best = F.max_by(F.when(peak, F.col("lag")), F.when(peak, F.struct("acf", -F.col("lag"))))
    return marked.groupBy(*by).agg(F.coalesce(best, F.lit(1)).alias("period"))


def phase_means(s: DataFrame, period: int, by: Sequence[str] = ()) -> DataFrame:
    return s.groupBy(*by, (F.col("idx") % period).alias("phase")).agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n"))


def seasonal_strength(s: DataFrame, period: int, by: Sequence[str] = ()) -> DataFrame:
    """Spread of the phase means over their mean size, with a label."""
    row = phase_means(s, period, by).groupBy(*by).agg(F.stddev_pop("mean").alias("std"), F.avg(F.abs("mean")).alias("size"))
    label = F.when(F.col("std") > F.col("size") * 0.2, "strong").when(F.col("std") > F.col("size") * 0.1, "moderate").otherwise("weak")
    return row.select(
        *by, F.lit(period).alias("period"), "std", F.coalesce(F.try_divide("std", "size"), F.lit(0.0)).alias("strength"), label.alias("pattern")
    )


_COMPLEX = T.StructType([T.StructField("k", T.LongType()), T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def _split(n: int) -> int:
    return next((d for d in range(math.isqrt(n), 0, -1) if n % d == 0), 1)


def _transform(x: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of ``(k, re, im)`` with n = n1 * n2 points.

    Two rounds of short transforms with a twist between them: n2 groups of n1
    points, then n1 groups of n2 points. No task sees more than one such group.
    """
    n1 = _split(n)
    n2 = n // n1
    sign = 1.0 if inverse else -1.0

    def short(values: np.ndarray) -> np.ndarray:
        return np.fft.ifft(values) * len(values) if inverse else np.fft.fft(values)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["g"].iloc[0])
        z = np.zeros(n1, dtype=complex)
        z[(pdf["k"].to_numpy() // n2)] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        c = np.arange(n1)
        out = short(z) * np.exp(sign * 2j * np.pi * ((b * c) % n) / n)
        return pd.DataFrame({"k": c * n2 + b, "re": out.real, "im": out.imag})

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        c = int(pdf["g"].iloc[0])
        z = np.zeros(n2, dtype=complex)
        z[(pdf["k"].to_numpy() % n2)] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        out = short(z) / (n if inverse else 1)
        return pd.DataFrame({"k": c + n1 * np.arange(n2), "re": out.real, "im": out.imag})

    half = x.withColumn("g", F.col("k") % n2).groupBy("g").applyInPandas(first, _COMPLEX)
    return half.withColumn("g", F.floor(F.col("k") / n2)).groupBy("g").applyInPandas(second, _COMPLEX)


def _chirp(k: Column, n: int) -> Column:
    return F.lit(math.pi / n) * ((k * k) % (2 * n))


def fourier(s: DataFrame, n: int) -> DataFrame:
    """Transform of a series of any length n: ``(k, re, im)``.

    Lengths without a fitting divisor are turned into a convolution of
    power-of-two length (Bluestein), so the groups stay near the square root.
    """
    x = s.select(F.col("idx").alias("k"), F.col("y").alias("re"), F.lit(0.0).alias("im"))
    if n <= BLOCK_ROWS or _split(n) * BLOCK_ROWS >= n:
        return _transform(x, n)
    m = 1 << (2 * n - 1).bit_length()
    angle = _chirp(F.col("k"), n)
    a = x.select("k", (F.col("re") * F.cos(angle)).alias("re"), (-F.col("re") * F.sin(angle)).alias("im"))
    taps = s.sparkSession.range(n).select(F.col("id").alias("k")).select("k", F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    b = taps.unionByName(taps.filter("k > 0").select((F.lit(m) - F.col("k")).alias("k"), "re", "im"))
    fa, fb = _transform(a, m), _transform(b, m).select("k", F.col("re").alias("re2"), F.col("im").alias("im2"))
    product = fa.join(fb, "k").select(
        "k",
        (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"),
        (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"),
    )
    back = _transform(product, m, inverse=True).filter(F.col("k") < n)
    return back.select(
        "k",
        (F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle)).alias("re"),
        (F.col("im") * F.cos(angle) - F.col("re") * F.sin(angle)).alias("im"),
    )


def dominant_period(s: DataFrame) -> DataFrame:
    """Strongest non-constant frequency of one series and its strength.

    The transform's shape depends on the length, so the rows are counted first.
    """
    s = stage(s)
    n = s.count()
    if n < 4:
        raise ValueError("a periodogram needs at least 4 rows")
    spectrum = fourier(s, n).filter(F.col("k") < n // 2).select("k", F.hypot("re", "im").alias("size"))
    row = spectrum.agg(
        F.max_by(F.when(F.col("k") > 0, F.col("k")), F.when(F.col("k") > 0, F.struct("size", -F.col("k")))).alias("frequency"),
        F.max(F.when(F.col("k") > 0, F.col("size"))).alias("magnitude"),
        F.avg("size").alias("mean_magnitude"),
    )
    strength = F.try_divide("magnitude", "mean_magnitude")
    return row.select(
        F.lit(n).cast("long").alias("n"),
        (F.col("frequency") / n).alias("frequency"),
        (F.lit(float(n)) / F.col("frequency")).alias("period"),
        strength.alias("strength"),
        (strength > 1).alias("is_seasonal"),
    )


# --- forecasts --------------------------------------------------------------------------


def linear_forecast(s: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Extension of the linear trend with a band built on the slope's standard error."""
    fit = linear_trend(s, by).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x = F.col("n") - 1 + F.col("step")
    spread = F.col("std_err") * F.sqrt(1 + 1 / F.col("n") + F.pow(x - F.col("mean_x"), 2) / F.col("sxx"))
    value = F.col("slope") * x + F.col("intercept")
    return fit.select(*by, "step", value.alias("forecast"), (value - 1.96 * spread).alias("lower"), (value + 1.96 * spread).alias("upper"))


def exponential_forecast(s: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """Linear fit of log(y + 1), extended and transformed back."""
    fit = linear_trend(s.withColumn("y", F.log1p("y")), by).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    x = F.col("n") - 1 + F.col("step")
    return fit.select(*by, "step", F.expm1(F.col("slope") * x + F.col("intercept")).alias("forecast"), "r2")


def least_squares(rows: DataFrame, target: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Regression from means and covariances: any number of rows, one row out per group.

    Output: ``n``, ``intercept``, ``coefficients``, ``std_errors``, ``sse``, ``y_mean``.
    """
    k = len(features)
    names = [*features, target]
    full = rows.dropna(subset=names)
    covs = [F.covar_pop(quoted(names[i]).cast("double"), quoted(names[j]).cast("double")) for i in range(k + 1) for j in range(i, k + 1)]
    row = full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(quoted(c).cast("double")) for c in names]).alias("means"), F.array(*covs).alias("covs")
    )
    kind = "struct<intercept:double,coefficients:array<double>,std_errors:array<double>,sse:double,y_mean:double>"

    def solve(n: pd.Series, means: pd.Series, covs: pd.Series) -> pd.DataFrame:
        out = []
        for count, mean, cov in zip(n, means, covs):
            full = np.zeros((k + 1, k + 1))
            full[np.triu_indices(k + 1)] = np.asarray(cov, dtype=float)
            full = full + np.triu(full, 1).T
            inverse = np.linalg.pinv(full[:k, :k], hermitian=True) if k else np.zeros((0, 0))
            beta = inverse @ full[:k, k]
            mean = np.asarray(mean, dtype=float)
            sse = max(0.0, count * (full[k, k] - beta @ full[:k, k]))
            free = count - k - 1
            errors = np.sqrt(np.clip(np.diag(inverse), 0, None) / count * sse / free) if free > 0 else np.full(k, np.nan)
            out.append((float(mean[k] - beta @ mean[:k]), beta.tolist(), errors.tolist(), float(sse), float(mean[k])))
        return pd.DataFrame(out, columns=["intercept", "coefficients", "std_errors", "sse", "y_mean"])

    solver = F.pandas_udf(solve, kind)
    return row.withColumn("f", solver("n", "means", "covs")).select(*by, "n", "f.*")


# Fixed critical values and p-value surface of the unit-root test with a constant
# (MacKinnon 1994, 2010).
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}
P_SMALL = (2.1659, 1.4412, 0.038269)
P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
TAU_MIN, TAU_STAR, TAU_MAX = -18.83, -1.61, 2.74


def stationarity(s: DataFrame, lags: int | None = None, by: Sequence[str] = (), max_lags: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test of each series.

    The change of y is regressed on its last level and last changes; with
    ``lags`` unset the number of changes is the one with the lowest AIC among
    0..max_lags over the rows that have them all; ``max_lags`` unset is 12 times
    the fourth root of a hundredth of the series' own length, and at most what
    leaves the regression rows to spare.
    """
    n = F.count(F.lit(1))
    own = F.greatest(F.lit(0), F.least(F.ceil(12.0 * F.pow(n / 100.0, 0.25)), F.floor(n / 2) - 2))
    fixed = max_lags if lags is None else lags
    limits = stage(s.groupBy(*by).agg((own if fixed is None else F.lit(fixed)).cast("int").alias("_most")))
    most = limits.agg(F.max("_most")).first()[0] or 0

    def shift(w):
        out = {"dy": F.col("y") - F.lag("y", 1).over(w), "level": F.lag("y", 1).over(w)}
        for j in range(1, most + 1):
            out[f"d{j}"] = F.lag("y", j).over(w) - F.lag("y", j + 1).over(w)
        return out

    rows = framed(s, shift, most + 1, 0, by)
    rows = join_groups(rows, limits, list(by)) if by else rows.withColumn("_most", F.lit(most))
    rows = rows.filter(F.col("idx") > F.col("_most"))
    best = None
    for j in [lags] if lags is not None else range(most + 1):
        fit = least_squares(rows.filter(F.col("_most") >= j), "dy", ["level", *[f"d{i}" for i in range(1, j + 1)]], by)
        n = F.col("n").cast("double")
        part = fit.select(
            *by,
            "n",
            F.lit(j).alias("lags"),
            F.try_divide(F.col("coefficients")[0], F.col("std_errors")[0]).alias("statistic"),
            (n * F.log(F.col("sse") / n) + 2.0 * (j + 2)).alias("aic"),
        )
        best = part if best is None else best.unionByName(part)
    chosen = best.groupBy(*by).agg(F.min_by(F.struct("n", "lags", "statistic", "aic"), F.struct("aic", "lags")).alias("b")).select(*by, "b.*")
    tau, n = F.col("statistic"), F.col("n").cast("double")
    poly = lambda c: sum((F.lit(v) * F.pow(tau, i) for i, v in enumerate(c)), F.lit(0.0))
    surface = F.when(tau <= TAU_STAR, poly(P_SMALL)).otherwise(poly(P_LARGE))
    p = F.when(tau > TAU_MAX, 1.0).when(tau < TAU_MIN, 0.0).otherwise(probability.normal_cdf_of(surface))
    limits = {
        f"critical_{k.rstrip('%')}": F.lit(a) + F.lit(b) / n + F.lit(c) / (n * n) + F.lit(d) / (n * n * n)
        for k, (a, b, c, d) in CRITICAL.items()
    }
    return chosen.withColumn("p_value", p).withColumns(limits).withColumn("is_stationary", F.col("p_value") < 0.05)


def arima(s: DataFrame, p: int = 1, d: int = 1, q: int = 1, steps: int = 10, by: Sequence[str] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """ARIMA(p, d, q) by conditional likelihood, with forecasts.

    The parameters are those with the least squared shocks, given the first p
    differenced values and zero shocks before them; :mod:`shocks` finds them over
    blocks of rows, so a long series is many tasks. Two regressions (on a long
    autoregression's residuals) say where to start. ``n`` counts the shocks; only
    the last few values of each series enter the forecast recursion. A series too
    short for the start has no forecast.
    """
    if p < 0 or d < 0 or q < 0 or p + q == 0:
        raise ValueError("p, d, q must not be negative and p + q must be positive")
    long = max(p + q + 4, 6) if q else p
    keys = list(by)
    one = keys or ["_g"]
    base = s if keys else s.withColumn("_g", F.lit(0))
    reach = long + max(p, q) + d

    def differenced(w):
        def diff(k: int, lag: int) -> Column:
            return F.lag("y", lag).over(w) if k == 0 else diff(k - 1, lag) - diff(k - 1, lag + 1)

        out = {f"z{j}": diff(d, j) for j in range(long + max(p, q) + 1)}
        return out | {f"y{j}": F.lag("y", j).over(w) for j in range(1, d)}

    rows = stage(framed(base, differenced, reach, 0, one, block_rows).filter(F.col("idx") >= d))
    whole = rows
    if q:
        stage1 = least_squares(rows, "z0", [f"z{j}" for j in range(1, long + 1)], one).select(
            *one, F.col("intercept").alias("_c"), F.col("coefficients").alias("_a")
        )
        rows = join_groups(rows, stage1, one)

        def shock(j: int) -> Column:
            fit = sum((F.col("_a")[i] * F.col(f"z{i + 1 + j}") for i in range(long)), F.col("_c"))
            return F.col(f"z{j}") - fit

        rows = rows.withColumns({f"e{j}": shock(j) for j in range(q + 1)}).drop("_c", "_a")
    terms = [f"z{j}" for j in range(1, p + 1)] + [f"e{j}" for j in range(1, q + 1)]
    # One text a series, null keys included.
    named = F.to_json(F.struct(*[quoted(c) for c in one]), {"ignoreNullFields": "false"})
    start = least_squares(rows, "z0", terms, one).filter("n > 0").select(*one, named.alias("s"), F.concat(F.array("intercept"), "coefficients").alias("beta"))
    start = stage(start)
    placed = whole.filter(F.col("idx") >= d + p).select(named.alias("s"), (F.col("idx") - d - p).alias("place"), F.array(*[F.col(f"z{j}") for j in range(p + 1)]).alias("z"))
    found = shocks.fit(placed, start.select("s", "beta"), p, q, block_rows)
    ends = whole.groupBy(*one).agg(
        F.max_by(F.array(*[F.col(f"z{j}") for j in range(max(p, 1))]), "idx").alias("recent"),
        F.max_by(F.array("y", *[F.col(f"y{j}") for j in range(1, d)]), "idx").alias("tail"),
    )
    model = match(start.select(*one, "s").join(found.withColumnRenamed("recent", "shocks"), "s"), ends, list(one))
    model = model.withColumns({"intercept": F.col("beta")[0], "coefficients": F.slice("beta", 2, p + q)})
    n, k = F.col("n").cast("double"), p + q + 1
    model = model.withColumns(
        {
            "sigma2": F.col("sse") / n,
            "log_likelihood": -n / 2 * (F.log(F.lit(2 * math.pi) * F.col("sse") / n) + 1),
            "aic": n * (F.log(F.lit(2 * math.pi) * F.col("sse") / n) + 1) + 2.0 * (k + 1),
            "bic": n * (F.log(F.lit(2 * math.pi) * F.col("sse") / n) + 1) + F.log(n) * (k + 1),
            "rmse": F.sqrt(F.col("sse") / n),
        }
    )

    def ahead(
        intercept: pd.Series, coefficients: pd.Series, recent: pd.Series, shocks: pd.Series, tail: pd.Series, sigma2: pd.Series
    ) -> pd.DataFrame:
        out = []
        for c, beta, z, e, last, s2 in zip(intercept, coefficients, recent, shocks, tail, sigma2):
            beta = np.asarray(beta, dtype=float)
            z, e = list(map(float, z)), [float(v) if v is not None else 0.0 for v in e]
            phi, theta = beta[:p], beta[p:]
            ys = [float(v) for v in last]
            values = []
            for _ in range(steps):
                nxt = c + sum(phi[i] * z[i] for i in range(p)) + sum(theta[i] * e[i] for i in range(q))
                z, e = [nxt, *z], [0.0, *e]
                if d == 0:
                    level = nxt
                else:
                    level = nxt + sum((-1) ** (i + 1) * math.comb(d, i) * ys[i - 1] for i in range(1, d + 1))
                ys = [level, *ys]
                values.append(level)
            # Response of the level to a unit shock, for the width of the band.
            psi = [1.0]
            for h in range(1, steps):
                v = sum(phi[i] * psi[h - 1 - i] for i in range(min(p, h))) + (theta[h - 1] if h <= q else 0.0)
                psi.append(v)
            for _ in range(d):
                psi = list(np.cumsum(psi))
            band = 1.96 * np.sqrt(s2 * np.cumsum(np.square(psi)))
            out.append((values, [v - b for v, b in zip(values, band)], [v + b for v, b in zip(values, band)]))
        return pd.DataFrame(out, columns=["forecast", "lower", "upper"])

    run = F.pandas_udf(ahead, "struct<forecast:array<double>,lower:array<double>,upper:array<double>>")
    done = model.withColumn("f", run("intercept", "coefficients", "recent", "shocks", "tail", "sigma2"))
    return done.select(
        *by,
        "n",
        "intercept",
        "coefficients",
        "log_likelihood",
        "aic",
        "bic",
        "rmse",
        F.posexplode(F.arrays_zip("f.forecast", "f.lower", "f.upper")).alias("step", "v"),
    ).select(*by, "n", "intercept", "coefficients", "log_likelihood", "aic", "bic", "rmse", (F.col("step") + 1).alias("step"), "v.*")


def seasonal_regression(s: DataFrame, steps: int = 30, by: Sequence[str] = (), weekly: int = 3, yearly: int = 3) -> DataFrame:
    """Daily model of trend plus weekly and yearly waves: fit errors and forecasts.

    Wave pairs are plain columns of the day number; the fit is one covariance
    aggregation over all series.
    """
    keys = list(by) or ["_g"]
    rows = s if by else s.withColumn("_g", F.lit(0))
    waves = [(7.0, i) for i in range(1, weekly + 1)] + [(365.25, i) for i in range(1, yearly + 1)]

    def design(day: Column) -> list[Column]:
        out = [day / 365.25]
        for length, i in waves:
            out += [F.sin(F.lit(2 * math.pi * i / length) * day), F.cos(F.lit(2 * math.pi * i / length) * day)]
        return out

    names = [f"x{i}" for i in range(1 + 2 * len(waves))]
    day = F.date_diff(F.col("t").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    table = rows.withColumn("day", day)
    table = table.withColumns(dict(zip(names, design(F.col("day")))))
    fit = least_squares(table, "y", names, keys).select(*keys, "intercept", "coefficients")
    predict = lambda cols: sum((F.col("coefficients")[i] * c for i, c in enumerate(cols)), F.col("intercept"))
    fitted = join_groups(table, fit, keys).withColumn("fitted", predict([F.col(n) for n in names]))
    miss = F.col("y") - F.col("fitted")
    errors = fitted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("day").alias("last_day"),
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(miss, F.col("y")))) * 100).alias("mape"),
    )
    ahead = match(errors, fit, list(keys)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = ahead.withColumn("day", F.col("last_day") + F.col("step"))
    return ahead.select(
        *by,
        "n",
        "mae",
        "rmse",
        "mape",
        "step",
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date"),
        predict(design(F.col("day"))).alias("forecast"),
    )


# --- anomalies -----------------------------------------------------------------------------


def anomalies(s: DataFrame, method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """Rows of one series beyond the limits; z-scores use the population deviation.

    ``isolation_forest`` takes the ``threshold`` share (0.1 by default) of rows
    that a forest over the one column isolates soonest; rows need a key then,
    their first column.
    """
    if method == "isolation_forest":
        from tablewright.operators.anomaly import isolation_forest

        key = s.columns[0]
        strange = isolation_forest(s, key, ["y"], threshold or 0.1).filter("label = -1").select(key)
        return s.join(strange, key, "left_semi")
    marked = flag(s, ["y"], method, threshold, sample=False)
    return marked.filter("y_outlier").drop("y_outlier")
