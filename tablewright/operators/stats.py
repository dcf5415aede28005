"""Descriptive statistics, correlation, histograms and regression."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import labels
from tablewright.operators.columns import absent, numeric_columns, present_double, quoted, rows_of, string_columns, tall
from tablewright.operators.quantiles import modes, with_quantiles
from tablewright.operators.ranks import average_ranks, running_total
from tablewright.session import attach, beside, match, scalars

PAIRS_PER_PASS = 200


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def sample_skewness(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population value; null below 3 rows."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; null below 4 rows."""
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


_QUARTILES = (0.25, 0.5, 0.75)
_PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _moments(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """All moments and quantiles of all columns in one aggregation."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        v = present_double(df, c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.avg(v).alias(f"mean{i}"),
            F.stddev_samp(v).alias(f"std{i}"),
            F.var_samp(v).alias(f"var{i}"),
            F.min(v).alias(f"min{i}"),
            F.max(v).alias(f"max{i}"),
            F.skewness(v).alias(f"g1{i}"),
            F.kurtosis(v).alias(f"g2{i}"),
        ]
    return with_quantiles(df, columns, probabilities, aggs, by)


def descriptive(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, spread, range, quartiles and missing values, one row per column.

    A column without values reports zeros.
    """
    columns = numeric_columns(df, columns)
    row = _moments(df, columns, _QUARTILES, by)
    records = []
    for i, c in enumerate(columns):
        q = F.col(f"`q_{c}`")
        missing = F.col("rows") - F.col(f"n{i}")
        records.append(
            {
                "column": F.lit(c),
                "count": F.col(f"n{i}"),
                "mean": _zero(F.col(f"mean{i}")),
                "std": _zero(F.col(f"std{i}")),
                "min": _zero(F.col(f"min{i}")),
                "q25": _zero(q[0]),
                "q50": _zero(q[1]),
                "q75": _zero(q[2]),
                "max": _zero(F.col(f"max{i}")),
                "missing_count": missing,
                "missing_ratio": _zero(F.try_divide(missing, F.col("rows"))),
            }
        )
    return rows_of(row, records, by)


def distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness and kurtosis, variance, range and quartile range."""
    columns = numeric_columns(df, columns)
    row = _moments(df, columns, _QUARTILES)
    records = []
    for i, c in enumerate(columns):
        n, q = F.col(f"n{i}"), F.col(f"`q_{c}`")
        records.append(
            {
                "column": F.lit(c),
                "skewness": sample_skewness(F.col(f"g1{i}"), n),
                "kurtosis": sample_kurtosis(F.col(f"g2{i}"), n),
                "variance": F.col(f"var{i}"),
                "range": F.col(f"max{i}") - F.col(f"min{i}"),
                "iqr": q[2] - q[0],
            }
        )
    return rows_of(row, records)


def advanced_descriptive(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Descriptive statistics with mode, nine percentiles, shape and labels."""
    columns = numeric_columns(df, columns)
    row = _moments(df, columns, _PERCENTILES)
    records = []
    for i, c in enumerate(columns):
        n, q = F.col(f"n{i}"), F.col(f"`q_{c}`")
        skew, kurt = sample_skewness(F.col(f"g1{i}"), n), sample_kurtosis(F.col(f"g2{i}"), n)
        rec = {
            "column": F.lit(c),
            "count": n,
            "mean": F.col(f"mean{i}"),
            "median": q[4],
            "std": F.col(f"std{i}"),
            "variance": F.col(f"var{i}"),
            "min": F.col(f"min{i}"),
            "max": F.col(f"max{i}"),
            "range": F.col(f"max{i}") - F.col(f"min{i}"),
            "iqr": q[5] - q[3],
            "skewness": skew,
            "kurtosis": kurt,
            "skewness_label": labels.skew_label(skew),
            "kurtosis_label": labels.kurtosis_label(kurt),
        }
        rec |= {f"p{int(p * 100)}": q[j] for j, p in enumerate(_PERCENTILES)}
        records.append(rec)
    return rows_of(row, records).join(modes(df, columns).select("column", F.col("mode").cast("double").alias("mode")), "column", "left")


def distribution_analysis(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Shape, Jarque-Bera normality (two degrees of freedom: p = exp(-JB/2)) and class."""
    columns = numeric_columns(df, columns)
    row = _moments(df, columns, (0.5,))
    records = []
    for i, c in enumerate(columns):
        n, g1, g2 = F.col(f"n{i}"), F.col(f"g1{i}"), F.col(f"g2{i}")
        skew, kurt = sample_skewness(g1, n), sample_kurtosis(g2, n)
        jb = n / 6.0 * (g1 * g1 + g2 * g2 / 4.0)
        p = F.exp(-jb / 2.0)
        records.append(
            {
                "column": F.lit(c),
                "skewness": skew,
                "kurtosis": kurt,
                "jarque_bera": jb,
                "p_value": p,
                "is_normal": p > 0.05,
                "distribution": labels.distribution_class(skew, kurt),
            }
        )
    return rows_of(row, records)


# --- correlation ------------------------------------------------------------------


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column1, column2, r)`` for every pair, pairwise complete; one scan per 200 pairs."""
    columns = numeric_columns(df, columns)
    pairs = list(combinations(columns, 2))
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        some = pairs[start : start + PAIRS_PER_PASS]
        row = df.agg(*[F.corr(present_double(df, a), present_double(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(some)])
        parts.append(
            rows_of(row, [{"column1": F.lit(a), "column2": F.lit(b), "r": F.col(f"r{i}")} for i, (a, b) in enumerate(some)])
        )
    if not parts:
        raise ValueError("correlation needs two numeric columns")
    return reduce(DataFrame.unionByName, parts)


def _pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return (
        df.select(present_double(df, a).alias("x"), present_double(df, b).alias("y"))
        .filter("x IS NOT NULL AND y IS NOT NULL")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def spearman_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of one pair, from distinct pairs and their average ranks.

    Equal pairs collapse before anything is ranked; ranks join back on the value.
    """
    cells = _pair_counts(df, a, b)

    def ranked(axis: str) -> DataFrame:
        counts = cells.groupBy(axis).agg(F.sum("w").alias("n"))
        return average_ranks(counts, axis).select(axis, F.col("rank").alias(f"r{axis}"))

    n = F.sum("w")
    joined = cells.join(ranked("x"), "x").join(ranked("y"), "y")
    middle = scalars(cells.agg(((F.coalesce(F.sum("w"), F.lit(0)) + 1) / 2.0).alias("m"))).getField("m")
    dx, dy, w = F.col("dx"), F.col("dy"), F.col("w")
    return (
        joined.select("w", (F.col("rx") - middle).alias("dx"), (F.col("ry") - middle).alias("dy"))
        .agg(
            n.alias("n"),
            F.try_divide(F.sum(w * dx * dy), F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))).alias("r"),
        )
        .select(F.lit(a).alias("column1"), F.lit(b).alias("column2"), "n", "r")
    )


def kendall_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall's tau-b of one pair in n log n rows, without comparing row pairs.

    y values are numbered; for every binary digit of that number, cells agreeing
    on the higher digits form a group in which digit 0 lies below digit 1. A
    running total over x inside each group then counts, for every cell with
    digit 1, the weight of lower-y cells with smaller and with larger x. Each
    pair of different y values is separated by exactly one digit.
    """
    cells = _pair_counts(df, a, b)
    ys = running_total(cells.groupBy("y").agg(F.sum("w").alias("n")), ["y"], {"k": F.lit(1).cast("long")}).select("y", "k")
    numbered = cells.join(ys, "y")
    bits = scalars(numbered.agg(F.greatest(F.lit(1), F.length(F.bin(F.coalesce(F.max("k"), F.lit(1))))).alias("b"))).getField("b")
    split = (
        numbered.select("x", "w", "k", F.explode(F.sequence(F.lit(0), bits - 1)).alias("bit"))
        .withColumn("prefix", F.expr("shiftright(k, bit + 1)"))
        .withColumn("upper", F.expr("shiftright(k, bit) & 1"))
        .groupBy("bit", "prefix", "x")
        .agg(
            F.coalesce(F.sum(F.when(F.col("upper") == 0, F.col("w"))), F.lit(0)).alias("w0"),
            F.coalesce(F.sum(F.when(F.col("upper") == 1, F.col("w"))), F.lit(0)).alias("w1"),
        )
    )
    run = running_total(split, ["x"], {"upto": F.col("w0")}, ["bit", "prefix"])
    low = (F.col("upto") - F.col("w0")).cast("double")
    # concordant - discordant = sum w1 * (smaller x) - w1 * (larger x), where larger = total - upto.
    totals = split.groupBy("bit", "prefix").agg(F.sum("w0").alias("t0"), F.sum("w1").alias("t1"))
    conc = run.agg(
        _zero(F.sum(F.col("w1") * low)).alias("c"), _zero(F.sum(F.col("w1").cast("double") * F.col("upto"))).alias("u")
    )
    cross = totals.agg(_zero(F.sum(F.col("t0").cast("double") * F.col("t1"))).alias("t"))
    tie = lambda c: _zero(F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2.0))
    tx = scalars(cells.groupBy("x").agg(F.sum("w").alias("n")).agg(tie("n").alias("v"))).getField("v")
    ty = scalars(cells.groupBy("y").agg(F.sum("w").alias("n")).agg(tie("n").alias("v"))).getField("v")
    n = scalars(cells.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("v"))).getField("v")
    t = scalars(cross).getField("t")
    pairs = n.cast("double") * (n - 1) / 2.0
    return conc.select(
        F.lit(a).alias("column1"),
        F.lit(b).alias("column2"),
        n.alias("n"),
        F.try_divide(F.col("c") - (t - F.col("u")), F.sqrt(pairs - tx) * F.sqrt(pairs - ty)).alias("r"),
    )


def correlation(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """All pairs by one method, with the plain strength bands."""
    columns = numeric_columns(df, columns)
    if method == "pearson":
        found = pearson(df, columns)
    else:
        one = {"spearman": spearman_pair, "kendall": kendall_pair}[method]
        found = reduce(DataFrame.unionByName, [one(df, a, b).drop("n") for a, b in combinations(columns, 2)])
    return found.select(
        "column1", "column2", "r", F.abs("r").alias("abs_r"), labels.strength_band(F.col("r")).alias("strength")
    ).orderBy(F.desc("abs_r"), "column1", "column2")


def correlation_analysis(df: DataFrame, columns: Sequence[str] | None = None, methods: Sequence[str] = ("pearson", "spearman", "kendall")) -> DataFrame:
    """All pairs by several methods, five strength classes, and the high flag."""
    parts = [correlation(df, columns, m).select(F.lit(m).alias("method"), "column1", "column2", "r") for m in methods]
    return reduce(DataFrame.unionByName, parts).select(
        "*", labels.correlation_label(F.col("r")).alias("strength"), (F.abs("r") >= 0.7).alias("is_high")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Full matrix as rows ``(row, column, r)``, both triangles and the diagonal."""
    columns = numeric_columns(df, columns)
    half = correlation(df, columns, method)
    flip = lambda a, b: half.select(F.col(a).alias("row"), F.col(b).alias("column"), "r")
    spread = df.agg(*[F.stddev_pop(present_double(df, c)).alias(f"s{i}") for i, c in enumerate(columns)])
    diagonal = rows_of(
        spread,
        [{"row": F.lit(c), "column": F.lit(c), "r": F.when(F.col(f"s{i}") > 0, F.lit(1.0))} for i, c in enumerate(columns)],
    )
    return flip("column1", "column2").unionByName(flip("column2", "column1")).unionByName(diagonal)


# --- histograms ----------------------------------------------------------------------


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins, last one closed, empty ones present.

    Bounds are per column over the whole table, so groups share their bins. A
    constant column spans value - 0.5 .. value + 0.5.
    """
    columns = numeric_columns(df, columns)
    bounds = df.agg(
        *[F.min(present_double(df, c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(present_double(df, c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    )

    def edge(i: int, which: str) -> Column:
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        shift = F.when(lo == hi, 0.5).otherwise(0.0)
        return lo - shift if which == "lo" else hi + shift

    edges = bounds.select(
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in columns]),
            F.array(*[F.struct(edge(i, "lo").alias("lo"), edge(i, "hi").alias("hi")) for i in range(len(columns))]),
        ).alias("m")
    )
    cell = attach(tall(df, columns, by), edges).withColumn("e", F.col("_s.m")[F.col("column")])
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    bin_no = F.least(F.floor((F.col("value") - F.col("e.lo")) / width), F.lit(bins - 1)).cast("int")
    counts = cell.groupBy(*by, "column", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    seen = counts.select(*by, "column").distinct()
    grid = seen.select(*by, "column", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = match(grid, counts, [*by, "column", "bin"], "left")
    out = attach(filled, edges).withColumn("e", F.col("_s.m")[F.col("column")])
    return out.select(
        *by,
        "column",
        "bin",
        (F.col("e.lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("e.lo") + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


# --- regression ------------------------------------------------------------------------


def simple_regression(df: DataFrame, target: str, feature: str) -> DataFrame:
    """Least squares on one feature, entirely as aggregates."""
    y, x = present_double(df, target), present_double(df, feature)
    return df.agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def regression(df: DataFrame, target: str, features: Sequence[str], interactions: bool = False) -> DataFrame:
    """Least squares on several features, rows with missing values dropped.

    With ``interactions`` all squares and products join the features. Output is
    tidy: one row per term with its coefficient and importance, then metrics.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    terms = {f: present_double(df, f) for f in features}
    if interactions:
        for i, a in enumerate(features):
            for b in features[i:]:
                terms[f"{a} {b}" if a != b else f"{a}^2"] = present_double(df, a) * present_double(df, b)
    data = df.select(present_double(df, target).alias("y"), *[c.alias(f"t{i}") for i, c in enumerate(terms.values())]).dropna()
    packed = VectorAssembler(inputCols=[f"t{i}" for i in range(len(terms))], outputCol="x").transform(data).select("y", "x")
    model = LinearRegression(featuresCol="x", labelCol="y", solver="normal").fit(packed)
    k = len(terms)
    residual = F.col("y") - F.col("prediction")
    checks = model.transform(packed).agg(
        F.count(F.lit(1)).alias("n"),
        (1 - F.try_divide(F.sum(residual * residual), F.var_pop("y") * F.count("y"))).alias("r2"),
        F.avg(residual).alias("residual_mean"),
        F.stddev_samp(residual).alias("residual_std"),
        F.min(residual).alias("residual_min"),
        F.max(residual).alias("residual_max"),
    )
    adjusted = 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1), F.col("n") - k - 1)
    record = lambda kind, name, value: {"kind": F.lit(kind), "name": F.lit(name), "value": value}
    rows = [record("coefficient", t, F.lit(float(c))) for t, c in zip(terms, model.coefficients)]
    rows += [record("importance", t, F.lit(abs(float(c)))) for t, c in zip(terms, model.coefficients)]
    rows += [record("metric", "intercept", F.lit(float(model.intercept))), record("metric", "adjusted_r2", adjusted)]
    rows += [record("metric", m, F.col(m).cast("double")) for m in ("n", "r2", "residual_mean", "residual_std", "residual_min", "residual_max")]
    return rows_of(checks, rows)


# --- table summaries -----------------------------------------------------------------------


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing and complete counts and ratios, one row per column, one pass."""
    columns = list(columns or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(absent(df, c)).alias(f"m{i}") for i, c in enumerate(columns)])
    records = []
    for i, c in enumerate(columns):
        m, n = F.col(f"m{i}"), F.col("n")
        records.append(
            {
                "column": F.lit(c),
                "total_count": n,
                "missing_count": m,
                "missing_ratio": _zero(F.try_divide(m, n)),
                "complete_count": n - m,
                "complete_ratio": _zero(F.try_divide(n - m, n)),
            }
        )
    return rows_of(row, records)


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: rows, distinct rows and duplicates; copies collapse before the shuffle."""
    return (
        df.groupBy(*[quoted(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("_n"))
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.count(F.lit(1)).alias("unique_rows"),
        )
        .select("row_count", "unique_rows", (F.col("row_count") - F.col("unique_rows")).alias("duplicate_rows"))
    )


def table_summary(df: DataFrame) -> DataFrame:
    """One row: size, kinds of columns, missing cells, duplicate rows."""
    missing = df.agg(
        sum([F.count_if(absent(df, c)) for c in df.columns[1:]], F.count_if(absent(df, df.columns[0]))).alias("missing_cells")
    )
    return beside(duplicate_count(df), missing).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(string_columns(df))).alias("text_columns"),
        "missing_cells",
        "duplicate_rows",
    )


def column_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numbers get mean, std, min, max; other columns distinct count and top value."""
    columns = list(columns or df.columns)
    numbers = numeric_columns(df, columns)
    others = [c for c in columns if c not in numbers]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(absent(df, c)).alias(f"m{i}"))
        if c in numbers:
            v = present_double(df, c)
            aggs += [F.avg(v).alias(f"mean{i}"), F.stddev_samp(v).alias(f"std{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
    null = F.lit(None).cast("double")
    records = []
    for i, c in enumerate(columns):
        number = c in numbers
        records.append(
            {
                "column": F.lit(c),
                "kind": F.lit("numeric" if number else "categorical"),
                "missing_count": F.col(f"m{i}"),
                **{k: F.col(f"{k}{i}") if number else null for k in ("mean", "std", "min", "max")},
            }
        )
    base = rows_of(df.agg(*aggs), records)
    if not others:
        return base.withColumns({"distinct_count": F.lit(None).cast("long"), "most_common": F.lit(None).cast("string")})
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in others])
    ).alias("cell")
    # Counts per value first: distinct count and most common value both come from them.
    seen = (
        df.select(cells)
        .select("cell.*")
        .filter("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct_count"),
            F.min(F.struct((-F.col("n")).alias("neg"), "value")).getField("value").alias("most_common"),
        )
    )
    return base.join(seen, "column", "left")


def summary_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Overview, descriptive, distribution and correlation as ``(section, column, metric, value)``."""
    columns = numeric_columns(df, columns)

    def melt(part: DataFrame, section: str, label: Column, metrics: Sequence[str]) -> DataFrame:
        cells = F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        ).alias("cell")
        return part.select(F.lit(section).alias("section"), label.alias("column"), cells).select("section", "column", "cell.*")

    described = descriptive(df, columns)
    shaped = distribution(df, columns)
    overview = df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(len(numeric_columns(df))).alias("numeric_columns")
    )
    parts = [
        melt(overview, "overview", F.lit("*"), ["row_count", "column_count", "numeric_columns"]),
        melt(described, "descriptive", F.col("column"), [c for c in described.columns if c != "column"]),
        melt(shaped, "distribution", F.col("column"), [c for c in shaped.columns if c != "column"]),
    ]
    if len(columns) > 1:
        parts.append(melt(pearson(df, columns), "correlation", F.concat_ws("|", "column1", "column2"), ["r"]))
    return reduce(DataFrame.unionByName, parts)
