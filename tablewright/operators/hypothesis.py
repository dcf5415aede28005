"""Hypothesis tests: Spark reduces the rows, a scalar function ends with p.

Every test is one or two aggregations over the data and yields a single row.
Rank tests count equal values first, so the ranked table has one row per
distinct value. ``p_value`` comes from a vectorised function on that one row;
dropping the column drops the function from the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import labels, probability
from tablewright.operators.columns import present_double, quoted
from tablewright.operators.quantiles import with_quantiles
from tablewright.operators.ranks import average_ranks
from tablewright.operators.stats import spearman_pair
from tablewright.session import beside, scalars

ALPHA = 0.05


def _judged(row: DataFrame, p: Column, alpha: float = ALPHA) -> DataFrame:
    return row.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def _t_judged(row: DataFrame, alpha: float) -> DataFrame:
    return _judged(row, probability.t_p_value(F.col("statistic"), F.col("df")), alpha)


# --- t tests -----------------------------------------------------------------------


def one_sample_t(df: DataFrame, column: str, value: float = 0.0, alpha: float = ALPHA) -> DataFrame:
    v = present_double(df, column)
    row = df.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).select(
        "n",
        "mean",
        "std",
        F.try_divide(F.col("mean") - value, F.col("std") / F.sqrt("n")).alias("statistic"),
        (F.col("n") - 1).cast("double").alias("df"),
    )
    return _t_judged(row, alpha)


def two_groups(df: DataFrame, column: str, group: str, median: bool = False) -> DataFrame:
    """Statistics of exactly two groups in one row, ``a`` before ``b`` in group order."""
    v = present_double(df, column)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var")]
    present = df.filter(quoted(group).isNotNull())
    if median:
        per = with_quantiles(present, [column], [0.5], aggs, [group]).withColumn("median", F.col(f"`q_{column}`")[0])
    else:
        per = present.groupBy(group).agg(*aggs)
    fields = ["n", "mean", "std", "var", *(["median"] if median else [])]
    packed = F.struct(quoted(group).cast("string").alias("name"), *fields)
    both = per.agg(
        F.min_by(packed, quoted(group)).alias("a"), F.max_by(packed, quoted(group)).alias("b"), F.count(F.lit(1)).alias("groups")
    )
    checked = F.when(F.col("groups") == 2, F.col("a")).otherwise(
        F.raise_error(F.concat(F.lit("expected exactly 2 groups, found "), F.col("groups").cast("string"))).cast(
            both.schema["a"].dataType
        )
    )
    return both.select(checked.alias("a"), "b").select(
        F.col("a.name").alias("group_a"),
        F.col("b.name").alias("group_b"),
        *[F.col(f"{side}.{f}").alias(f"{f}_{side}") for f in fields for side in "ab"],
    )


def _pooled(row: DataFrame) -> DataFrame:
    n_a, n_b = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide((n_a - 1) * F.col("var_a") + (n_b - 1) * F.col("var_b"), n_a + n_b - 2))
    return row.withColumn("pooled_std", pooled).withColumns(
        {
            "statistic": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.col("pooled_std") * F.sqrt(1 / n_a + 1 / n_b)),
            "df": (n_a + n_b - 2).cast("double"),
        }
    )


def two_sample_t(df: DataFrame, column: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """Student's t with pooled variance between two groups."""
    return _t_judged(_pooled(two_groups(df, column, group)), alpha)


def two_column_t(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """Student's t between two columns taken as independent samples."""
    x, y = present_double(df, a), present_double(df, b)
    row = df.agg(
        *[
            f(c).alias(f"{n}_{s}")
            for s, c in (("a", x), ("b", y))
            for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("var", F.var_samp))
        ]
    )
    return _t_judged(_pooled(row), alpha)


def paired_t(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """Paired t on two columns of the same row; pairs with a gap are dropped."""
    return one_sample_t(df.select((present_double(df, a) - present_double(df, b)).alias("difference")), "difference", 0.0, alpha)


#: Sizes up to which rank tests are exact where there are no ties.
EXACT_GROUP, EXACT_CELLS, EXACT_PAIRS = 8, 100_000, 50

# --- rank tests ------------------------------------------------------------------------


def _ties(n: Column) -> Column:
    c = n.cast("double")
    return F.sum(c * c * c - c)


def mann_whitney(df: DataFrame, column: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """Two-sided U test.

    Without ties and with a group of at most ``EXACT_GROUP`` rows the p-value is
    exact (up to ``EXACT_CELLS`` pairs of rows, where the normal one is as good);
    else the normal approximation with tie and continuity correction.
    """
    counts = (
        df.select(quoted(group).alias("g"), present_double(df, column).alias("value"))
        .filter("g IS NOT NULL AND value IS NOT NULL")
        .groupBy("g", "value")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    sides = scalars(counts.agg(F.min("g").alias("a"), F.max("g").alias("b"), F.count_distinct("g").alias("k")))
    merged = (
        counts.withColumn("first", F.col("g") == sides.getField("a"))
        .groupBy("value")
        .agg(F.sum("w").alias("n"), F.coalesce(F.sum(F.when(F.col("first"), F.col("w"))), F.lit(0)).alias("na"))
    )
    ranked = average_ranks(merged)
    k = sides.getField("k")
    row = ranked.agg(
        F.sum("na").alias("n_a"), (F.sum("n") - F.sum("na")).alias("n_b"), F.sum(F.col("na") * F.col("rank")).alias("r"), _ties(F.col("n")).alias("t")
    ).select(
        F.when(k == 2, sides.getField("a").cast("string"))
        .otherwise(F.raise_error(F.lit("the U test needs exactly 2 groups")).cast("string"))
        .alias("group_a"),
        sides.getField("b").cast("string").alias("group_b"),
        "n_a",
        "n_b",
        (F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2.0).alias("statistic"),
        "t",
    )
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    spread = F.sqrt(n_a * n_b / 12.0 * ((n + 1) - F.try_divide(F.col("t"), n * (n - 1))))
    larger = F.greatest(F.col("statistic"), n_a * n_b - F.col("statistic"))
    small = (F.col("t") == 0) & (F.least(n_a, n_b) <= EXACT_GROUP) & (n_a * n_b <= EXACT_CELLS)
    exact = probability.u_p_value(F.when(small, F.col("statistic")), n_a, n_b)
    row = row.withColumn("z", F.try_divide(larger - n_a * n_b / 2.0 - 0.5, spread)).withColumn("_exact", exact).drop("t")
    near = F.least(F.lit(1.0), probability.normal_p_value(F.greatest(F.col("z"), F.lit(0.0))))
    return _judged(row, F.coalesce("_exact", near), alpha).drop("_exact")


def mann_whitney_columns(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """U test between two columns taken as independent samples."""
    both = df.select(
        F.inline(
            F.array(
                F.struct(F.lit("1").alias("side"), present_double(df, a).alias("value")),
                F.struct(F.lit("2").alias("side"), present_double(df, b).alias("value")),
            )
        )
    )
    return mann_whitney(both, "value", "side", alpha).drop("group_a", "group_b")


def wilcoxon(df: DataFrame, column: str, value: float = 0.0, alpha: float = ALPHA) -> DataFrame:
    """Signed-rank test against a value; zero differences are dropped.

    Exact for up to ``EXACT_PAIRS`` differences without ties, else the normal approximation.
    """
    d = df.select((present_double(df, column) - value).alias("d")).filter("d IS NOT NULL AND d <> 0")
    counts = d.groupBy(F.abs("d").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("up")
    )
    row = average_ranks(counts).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("up") * F.col("rank")), F.lit(0.0)).alias("w_plus"),
        _ties(F.col("n")).alias("t"),
    )
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2.0
    row = row.select(
        "n",
        "w_plus",
        (total - F.col("w_plus")).alias("w_minus"),
        F.least(F.col("w_plus"), total - F.col("w_plus")).alias("statistic"),
        "t",
    )
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("t") / 2.0) / 24.0)
    small = (F.col("t") == 0) & (n <= EXACT_PAIRS) & (n > 0)
    row = row.withColumn("z", F.try_divide(F.col("statistic") - n * (n + 1) / 4.0, spread))
    row = row.withColumn("_exact", probability.signed_rank_p_value(F.when(small, F.col("w_plus")), n)).drop("t")
    return _judged(row, F.coalesce("_exact", probability.normal_p_value(F.col("z"))), alpha).drop("_exact")


def kruskal_wallis(df: DataFrame, column: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """H with tie correction over any number of groups."""
    counts = (
        df.select(quoted(group).alias("g"), present_double(df, column).alias("value"))
        .filter("g IS NOT NULL AND value IS NOT NULL")
        .groupBy("g", "value")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    ranked = average_ranks(counts.groupBy("value").agg(F.sum("w").alias("n")))
    per = counts.join(ranked.select("value", "rank"), "value").groupBy("g").agg(
        F.sum("w").alias("m"), F.sum(F.col("w") * F.col("rank")).alias("r")
    )
    ties = scalars(counts.groupBy("value").agg(F.sum("w").alias("n")).agg(_ties(F.col("n")).alias("t"))).getField("t")
    n = F.col("n").cast("double")
    row = per.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("m").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s")
    ).select(
        "groups",
        "n",
        F.try_divide(F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.try_divide(ties, n * n * n - n)).alias("statistic"),
        (F.col("groups") - 1).cast("double").alias("df"),
    )
    return _judged(row, probability.chi2_p_value(F.col("statistic"), F.col("df")), alpha)


def group_medians(df: DataFrame, column: str, group: str) -> DataFrame:
    v = present_double(df, column)
    per = with_quantiles(df.filter(quoted(group).isNotNull()), [column], [0.5], [F.count(v).alias("n")], [group])
    return per.select(group, "n", F.col(f"`q_{column}`")[0].alias("median"))


# --- variance, counts, correlation ---------------------------------------------------------


def anova(df: DataFrame, column: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """One-way analysis of variance from group sizes, means and variances."""
    v = present_double(df, column)
    per = (
        df.filter(quoted(group).isNotNull())
        .groupBy(group)
        .agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("s2"))
        .filter("n > 0")
    )
    mean = scalars(per.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))).getField("m")
    row = per.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - mean, 2)).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("s2", F.lit(0.0))).alias("ss_within"),
    ).select(
        "groups",
        "n",
        "ss_between",
        "ss_within",
        (F.col("groups") - 1).cast("double").alias("df_between"),
        (F.col("n") - F.col("groups")).cast("double").alias("df_within"),
    )
    f = F.try_divide(F.try_divide("ss_between", "df_between"), F.try_divide("ss_within", "df_within"))
    row = row.withColumn("statistic", f)
    return _judged(row, probability.f_p_value(F.col("statistic"), F.col("df_between"), F.col("df_within")), alpha)


def group_statistics(df: DataFrame, column: str, group: str) -> DataFrame:
    v = present_double(df, column)
    return df.groupBy(group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected counts of every combination that occurs."""
    cells = df.filter(quoted(a).isNotNull() & quoted(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("observed"))
    rows = cells.groupBy(a).agg(F.sum("observed").alias("row_total"))
    cols = cells.groupBy(b).agg(F.sum("observed").alias("column_total"))
    n = scalars(cells.agg(F.sum("observed").alias("n"))).getField("n")
    return cells.join(rows, a).join(cols, b).select(
        a, b, "observed", "row_total", "column_total", (F.col("row_total").cast("double") * F.col("column_total") / n).alias("expected")
    )


def chi_square_independence(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """Test of independence, with Yates' correction on a 2 x 2 table.

    Needs only the combinations that occur: the empty cells of the full grid
    enter through the margins (sum of O^2/E, less n).
    """
    cells = crosstab(df, a, b)
    o, e = F.col("observed").cast("double"), F.col("expected")
    margin = lambda key, total: scalars(
        cells.groupBy(key).agg(F.first(total).alias("t")).agg(
            F.count(F.lit(1)).alias("k"), F.sum(1.0 / F.col("t")).alias("inverse")
        )
    )
    rows, cols = margin(a, "row_total"), margin(b, "column_total")
    base = cells.agg(F.sum(F.col("observed")).alias("n"), F.sum(o * o / e).alias("s"), F.max(F.abs(o - e)).alias("delta"))
    df_value = ((rows.getField("k") - 1) * (cols.getField("k") - 1)).cast("double")
    delta = F.col("delta") - F.least(F.lit(0.5), F.col("delta"))
    corrected = delta * delta * F.col("n") * rows.getField("inverse") * cols.getField("inverse")
    row = base.select(
        "n",
        F.when(df_value == 1, corrected).otherwise(F.greatest(F.col("s") - F.col("n"), F.lit(0.0))).alias("statistic"),
        df_value.alias("df"),
    )
    return _judged(row, probability.chi2_p_value(F.col("statistic"), F.col("df")), alpha)


def chi_square_fit(df: DataFrame, observed: str, expected: str, alpha: float = ALPHA) -> DataFrame:
    """Goodness of fit of one column's category counts to another's, by category."""
    count = lambda c, n: df.filter(quoted(c).isNotNull()).groupBy(quoted(c).alias("category")).agg(F.count(F.lit(1)).alias(n))
    both = count(observed, "o").join(count(expected, "e"), "category", "full").na.fill(0, ["o", "e"])
    scale = scalars(both.agg((F.sum("o") / F.sum("e")).alias("s"))).getField("s")
    e = F.col("e") * scale
    row = both.agg(
        F.sum("o").alias("n"), F.sum(F.try_divide(F.pow(F.col("o") - e, 2), e)).alias("statistic"), (F.count(F.lit(1)) - 1).cast("double").alias("df")
    )
    return _judged(row, probability.chi2_p_value(F.col("statistic"), F.col("df")), alpha)


def _r_judged(row: DataFrame, alpha: float) -> DataFrame:
    r, n = F.col("r"), F.col("n")
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    row = row.withColumns({"statistic": t, "df": (n - 2).cast("double"), "strength": labels.correlation_label(r)})
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(probability.t_p_value(F.col("statistic"), F.col("df")))
    return _judged(row, p, alpha)


def pearson_test(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    x, y = present_double(df, a), present_double(df, b)
    both = df.agg(F.count_if(x.isNotNull() & y.isNotNull()).alias("n"), F.corr(x, y).alias("r"))
    return _r_judged(both.select(F.lit(a).alias("column1"), F.lit(b).alias("column2"), "n", "r"), alpha)


def spearman_test(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    return _r_judged(spearman_pair(df, a, b), alpha)


# --- A/B analysis ---------------------------------------------------------------------------


def ab_statistics(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Both groups, pooled spread, Cohen's d = (b - a) / s, t and the mean difference."""
    row = _pooled(two_groups(df, metric, group, median=True))
    d = F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("pooled_std"))
    return row.withColumns({"mean_difference": F.col("mean_b") - F.col("mean_a"), "cohens_d": d}).withColumns(
        {"effect": labels.effect_label(F.col("cohens_d")), "practical": F.abs("cohens_d") >= 0.2}
    )


def recommendation(significant: Column, practical: Column) -> Column:
    return (
        F.when(significant & practical, "apply")
        .when(significant, "review")
        .when(practical, "collect_more_data")
        .otherwise("keep_current")
    )


def ab_test(df: DataFrame, group: str, metric: str, test: str = "t_test", level: float = 0.95) -> DataFrame:
    """A/B analysis with test, confidence interval of the difference and advice."""
    row = ab_statistics(df, group, metric)
    if test == "t_test":
        row = _t_judged(row, 1 - level)
    elif test == "mann_whitney":
        row = beside(row.drop("statistic"), mann_whitney(df, metric, group, 1 - level).select("statistic", "p_value", "significant"))
    else:
        raise ValueError(f"unknown test: {test}")
    margin = probability.t_quantile_of(F.lit(1 - (1 - level) / 2), F.col("df")) * F.col("pooled_std") * F.sqrt(
        1 / F.col("n_a") + 1 / F.col("n_b")
    )
    return row.withColumn("_margin", margin).select(
        "*",
        (F.col("mean_difference") - F.col("_margin")).alias("ci_lower"),
        (F.col("mean_difference") + F.col("_margin")).alias("ci_upper"),
        recommendation(F.col("significant"), F.col("practical")).alias("recommendation"),
    ).drop("_margin")


def power(row: DataFrame, alpha: float = ALPHA, wanted: float = 0.8) -> DataFrame:
    """Power of the two-sided t test and sample size needed per group, from A/B statistics rows.

    Both by the noncentral t distribution; without an effect no size is enough (null).
    """
    d = F.abs("cohens_d")
    reach = d * F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    return row.select(
        "group_a",
        "group_b",
        "cohens_d",
        probability.t_power_of(reach, (F.col("n_a") + F.col("n_b") - 2).cast("double"), F.lit(alpha)).alias("power"),
        F.nanvl(probability.t_needed_of(d, F.lit(alpha), F.lit(wanted)), F.lit(None)).cast("long").alias("needed_per_group"),
    )


TESTS = {
    "one_sample": one_sample_t,
    "two_sample": two_sample_t,
    "two_column": two_column_t,
    "paired": paired_t,
    "mann_whitney": mann_whitney,
    "mann_whitney_columns": mann_whitney_columns,
    "wilcoxon": wilcoxon,
    "kruskal_wallis": kruskal_wallis,
    "anova": anova,
    "chi_square": chi_square_independence,
    "chi_square_fit": chi_square_fit,
    "pearson": pearson_test,
    "spearman": spearman_test,
}


def run_test(name: str, df: DataFrame, *args, **kwargs) -> DataFrame:
    """Any test by name."""
    if name not in TESTS:
        raise ValueError(f"unknown test: {name}")
    return TESTS[name](df, *args, **kwargs)
