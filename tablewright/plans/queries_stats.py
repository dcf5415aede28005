"""Queries over descriptive statistics, correlation, histograms and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import stats
from tablewright.plans.registry import Tables, query

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Missing values made from the row itself, the same way on both sides.
GAPPY = "(select l_orderkey, l_linenumber, l_quantity, case when l_linenumber = 3 then null else l_discount end as l_discount, case when l_linenumber % 2 = 0 then null else l_returnflag end as l_returnflag from lineitem)"


def gappy(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_linenumber") % 2 != 0, F.col("l_returnflag")).alias("l_returnflag"),
    )


def rounded(df, digits: int = 6, skip=()):
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.round(c, digits) for c in df.columns if kinds[c] == "double" and c not in skip})


_DESCRIBE = """
    select '{c}' as "column", count({c}) as count, round(coalesce(avg({c}), 0), 4) as mean, round(coalesce(stddev_samp({c}), 0), 4) as std,
           round(coalesce(min({c}), 0), 4)::double as min, round(quantile_cont({c}, 0.25), 4)::double as q25, round(quantile_cont({c}, 0.5), 4)::double as q50, round(quantile_cont({c}, 0.75), 4)::double as q75,
           round(max({c}), 4)::double as max, count(*) - count({c}) as missing_count, round((count(*) - count({c})) / count(*), 4) as missing_ratio from {t}
"""


def describe_sql(columns, table):
    return " union all ".join(_DESCRIBE.format(c=c, t=table) for c in columns)


@query("descriptive_stats", describe_sql(LINE, "lineitem"))
def _(t: Tables):
    return rounded(stats.descriptive(t.lineitem, LINE), 4)


@query("descriptive_stats_missing", describe_sql(["l_quantity", "l_discount"], GAPPY))
def _(t: Tables):
    return rounded(stats.descriptive(gappy(t), ["l_quantity", "l_discount"]), 4)


@query(
    "descriptive_by_group",
    " union all ".join(
        f"""select l_returnflag, '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4) as min,
        round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50, round(quantile_cont({c}, 0.75), 4) as q75, round(max({c}), 4) as max,
        count(*) - count({c}) as missing_count, 0::double as missing_ratio from lineitem group by l_returnflag"""
        for c in ["l_quantity", "l_extendedprice"]
    ),
)
def _(t: Tables):
    return rounded(stats.descriptive(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_returnflag"]), 4)


_SHAPE = """
    select '{c}' as "column", round(skewness({c}), 6) as skewness, round(kurtosis({c}), 6) as kurtosis, round(var_samp({c}), 2) as variance,
           round(max({c}) - min({c}), 2) as range, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) as iqr from {t}
"""


@query("distribution_stats", " union all ".join(_SHAPE.format(c=c, t="lineitem") for c in LINE))
def _(t: Tables):
    out = rounded(stats.distribution(t.lineitem, LINE), 6)
    return out.withColumns({c: F.round(c, 2) for c in ("variance", "range")})


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]
_PEARSON = " union all ".join(f"select '{a}' as column1, '{b}' as column2, corr({a}, {b}) as r from lineitem" for a, b in _PAIRS)


@query(
    "correlation_pearson",
    f"select column1, column2, round(r, 6) as r, round(abs(r), 6) as abs_r, case when abs(r) > 0.7 then 'strong' when abs(r) > 0.3 then 'moderate' else 'weak' end as strength from ({_PEARSON})",
)
def _(t: Tables):
    return rounded(stats.correlation(t.lineitem, LINE))


def spearman_sql(a, b, table):
    return f"""
    select '{a}' as column1, '{b}' as column2, count(*) as n, corr(ra, rb) as r from (
      select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra,
             rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb
      from {table} where {a} is not null and {b} is not null)
    """


def kendall_sql(a, b, table):
    return f"""
    with c as (select {a} as x, {b} as y, count(*) as w from {table} where {a} is not null and {b} is not null group by 1, 2),
    s as (select sum(case when (p.x - q.x) * (p.y - q.y) > 0 then 1.0 when (p.x - q.x) * (p.y - q.y) < 0 then -1.0 else 0 end * p.w * q.w) / 2 as s from c p, c q),
    n as (select sum(w) as n from c), tx as (select sum(n * (n - 1) / 2) as v from (select sum(w) as n from c group by x)), ty as (select sum(n * (n - 1) / 2) as v from (select sum(w) as n from c group by y))
    select '{a}' as column1, '{b}' as column2, n.n::bigint as n, s.s / (sqrt(n.n * (n.n - 1) / 2 - tx.v) * sqrt(n.n * (n.n - 1) / 2 - ty.v)) as r from s, n, tx, ty
    """


@query("correlation_spearman", f"select column1, column2, n, round(r, 6) as r from ({spearman_sql('l_quantity', 'l_extendedprice', 'lineitem')})")
def _(t: Tables):
    return rounded(stats.spearman_pair(t.lineitem, "l_quantity", "l_extendedprice"))


@query("correlation_spearman_ties", f"select column1, column2, n, round(r, 6) as r from ({spearman_sql('l_discount', 'l_tax', GAPPY.replace('l_quantity,', 'l_quantity, l_tax,'))})")
def _(t: Tables):
    df = t.lineitem.select("l_tax", F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("l_discount"))
    return rounded(stats.spearman_pair(df, "l_discount", "l_tax"))


@query("correlation_kendall", f"select column1, column2, n, round(r, 6) as r from ({kendall_sql('l_quantity', 'l_discount', 'lineitem')})")
def _(t: Tables):
    return rounded(stats.kendall_pair(t.lineitem, "l_quantity", "l_discount"))


def _analysis_sql():
    parts = [f"select 'pearson' as method, 'p_size' as column1, 'p_retailprice' as column2, corr(p_size, p_retailprice) as r from part"]
    parts.append(f"select 'spearman', column1, column2, r from ({spearman_sql('p_size', 'p_retailprice', 'part')})")
    parts.append(f"select 'kendall', column1, column2, r from ({kendall_sql('p_size', 'p_retailprice', 'part')})")
    return f"""select method, column1, column2, round(r, 6) as r, case when abs(r) < 0.1 then 'negligible' when abs(r) < 0.3 then 'weak' when abs(r) < 0.5 then 'moderate' when abs(r) < 0.7 then 'strong' else 'very_strong' end as strength,
    abs(r) >= 0.7 as is_high from ({' union all '.join(parts)})"""


@query("correlation_analysis", _analysis_sql())
def _(t: Tables):
    return rounded(stats.correlation_analysis(t.part, ["p_size", "p_retailprice"]))


_ADVANCED = """
    select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean, round(quantile_cont({c}, 0.5), 4) as median, round(stddev_samp({c}), 4) as std, round(var_samp({c}), 2) as variance,
      round(min({c}), 4) as min, round(max({c}), 4) as max, round(max({c}) - min({c}), 4) as range, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) as iqr,
      round(skewness({c}), 4) as skewness, round(kurtosis({c}), 4) as kurtosis,
      case when abs(skewness({c})) < 0.5 then 'symmetric' when abs(skewness({c})) < 1 then 'moderately_skewed' else 'highly_skewed' end as skewness_label,
      case when kurtosis({c}) < -1 then 'flat' when kurtosis({c}) < 1 then 'normal_peak' else 'peaked' end as kurtosis_label,
      round(quantile_cont({c}, 0.01), 4) as p1, round(quantile_cont({c}, 0.05), 4) as p5, round(quantile_cont({c}, 0.1), 4) as p10, round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50,
      round(quantile_cont({c}, 0.75), 4) as p75, round(quantile_cont({c}, 0.9), 4) as p90, round(quantile_cont({c}, 0.95), 4) as p95, round(quantile_cont({c}, 0.99), 4) as p99,
      (select m from (select {c} as m, count(*) as k from lineitem group by 1 order by k desc, m limit 1)) as mode
    from lineitem
"""


@query("descriptive_advanced", " union all ".join(_ADVANCED.format(c=c) for c in ["l_quantity", "l_discount", "l_extendedprice"]))
def _(t: Tables):
    out = rounded(stats.advanced_descriptive(t.lineitem, ["l_quantity", "l_discount", "l_extendedprice"]), 4, ("mode",))
    return out.withColumn("variance", F.round("variance", 2))


_JB = """
    select '{c}' as "column", skewness({c}) as s, kurtosis({c}) as k, count({c}) as n,
      (select avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) from {t}, (select avg({c}) as m from {t})) as g1,
      (select avg(power({c} - m, 4)) / power(avg(power({c} - m, 2)), 2) - 3 from {t}, (select avg({c}) as m from {t})) as g2 from {t}
"""


@query(
    "distribution_analysis",
    f"""
    select "column", round(s, 6) as skewness, round(k, 6) as kurtosis, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 2) as jarque_bera,
      round(exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)), 6) as p_value, exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)) > 0.05 as is_normal,
      case when abs(s) < 0.5 and abs(k) < 1 then 'near_normal' when s > 1 then 'right_skewed' when s < -1 then 'left_skewed' when k > 3 then 'heavy_tailed' when k < -1 then 'light_tailed' else 'mixed' end as distribution
    from ({_JB.format(c='o_totalprice', t='orders')} union all {_JB.format(c='value', t='events')})
    """,
)
def _(t: Tables):
    out = stats.distribution_analysis(t.orders, ["o_totalprice"]).unionByName(stats.distribution_analysis(t.events, ["value"]))
    return rounded(out).withColumn("jarque_bera", F.round("jarque_bera", 2))


def histogram_sql(c, t, bins):
    return f"""
    with b as (select min({c}) as lo, max({c}) as hi from {t}), w as (select lo, (hi - lo) / {bins} as w from b),
    k as (select least(floor(({c} - lo) / w), {bins} - 1)::int as bin, count(*) as n from {t}, w where {c} is not null group by 1)
    select '{c}' as "column", i::int as bin, round(lo + w * i, 6) as bin_start, round(lo + w * (i + 1), 6) as bin_end, coalesce(n, 0) as count
    from w, range({bins}) r(i) left join k on k.bin = i
    """


@query("histogram", histogram_sql("value", "events", 30))
def _(t: Tables):
    return rounded(stats.histogram(t.events, ["value"], 30))


@query("histogram_many", f"select * from ({histogram_sql('l_quantity', 'lineitem', 30)}) union all select * from ({histogram_sql('l_extendedprice', 'lineitem', 30)})")
def _(t: Tables):
    return rounded(stats.histogram(t.lineitem, ["l_quantity", "l_extendedprice"], 30))


@query("regression_simple", "select regr_count(l_extendedprice, l_quantity)::bigint as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem")
def _(t: Tables):
    out = stats.simple_regression(t.lineitem, "l_extendedprice", "l_quantity")
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("regression_many")
def _(t: Tables):
    return stats.regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query(
    "regression_two",
    """with s as (select count(*) as n, avg(l_extendedprice) as my, avg(l_quantity) as m1, avg(l_discount) as m2, covar_pop(l_quantity, l_quantity) as s11, covar_pop(l_discount, l_discount) as s22, covar_pop(l_quantity, l_discount) as s12,
      covar_pop(l_quantity, l_extendedprice) as s1y, covar_pop(l_discount, l_extendedprice) as s2y, covar_pop(l_extendedprice, l_extendedprice) as syy from lineitem),
    b as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from s), r as (select *, (b1 * s1y + b2 * s2y) / syy as r2 from b)
    select 'coefficient' as kind, 'l_quantity' as name, round(b1, 4) as value from r union all select 'coefficient', 'l_discount', round(b2, 2) from r union all select 'metric', 'intercept', round(my - b1 * m1 - b2 * m2, 2) from r
    union all select 'metric', 'r2', round(r2, 6) from r union all select 'metric', 'adjusted_r2', round(1 - (1 - r2) * (n - 1) / (n - 3), 6) from r union all select 'metric', 'residual_std', round(sqrt(n * syy * (1 - r2) / (n - 1)), 2) from r""",
)
def _(t: Tables):
    out = stats.regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"])
    kept = out.filter("kind = 'coefficient' OR name IN ('intercept', 'r2', 'adjusted_r2', 'residual_std')")
    digits = F.when(F.col("name") == "l_quantity", F.round("value", 4)).when(F.col("name").contains("r2"), F.round("value", 6)).otherwise(F.round("value", 2))
    return kept.withColumn("value", digits)


@query("regression_interactions")
def _(t: Tables):
    return stats.regression(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount"], interactions=True)


@query(
    "table_summary",
    f"""select count(*) as row_count, 3 as column_count, 2 as numeric_columns, 1 as text_columns,
    (count(*) - count(l_discount)) + (count(*) - count(l_returnflag)) as missing_cells, count(*) - (select count(*) from (select distinct l_linenumber, l_discount, l_returnflag from {GAPPY})) as duplicate_rows from {GAPPY}""",
)
def _(t: Tables):
    return stats.table_summary(gappy(t).select("l_linenumber", "l_discount", "l_returnflag"))


def _column_sql(c, t, number):
    if number:
        return f"""select '{c}' as "column", 'numeric' as kind, count(*) - count({c}) as missing_count, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c}), 4)::double as min, round(max({c}), 4)::double as max,
        null::bigint as distinct_count, null::varchar as most_common from {t}"""
    return f"""select '{c}' as "column", 'categorical' as kind, count(*) - count({c}) as missing_count, null::double as mean, null::double as std, null::double as min, null::double as max, count(distinct {c}) as distinct_count,
        (select v from (select {c} as v, count(*) as n from {t} where {c} is not null group by 1 order by n desc, v limit 1)) as most_common from {t}"""


@query("column_report", " union all ".join([_column_sql("l_discount", GAPPY, True), _column_sql("l_quantity", GAPPY, True), _column_sql("l_returnflag", GAPPY, False)]))
def _(t: Tables):
    return rounded(stats.column_report(gappy(t), ["l_discount", "l_quantity", "l_returnflag"]), 4)


@query("describe_all", " union all ".join([_column_sql("o_totalprice", "orders", True), _column_sql("o_orderstatus", "orders", False), _column_sql("o_orderpriority", "orders", False)]))
def _(t: Tables):
    return rounded(stats.column_report(t.orders.select("o_totalprice", "o_orderstatus", "o_orderpriority")), 4)


@query(
    "missing_counts",
    " union all ".join(
        f"""select '{c}' as "column", count(*) as total_count, count(*) - count({c}) as missing_count, round((count(*) - count({c})) / count(*), 6) as missing_ratio, count({c}) as complete_count, round(count({c}) / count(*), 6) as complete_ratio from {GAPPY}"""
        for c in ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    ),
)
def _(t: Tables):
    return rounded(stats.missing_counts(gappy(t)))


def summary_sql(table, columns, n_columns, n_numeric):
    described = describe_sql(columns, table)
    shaped = " union all ".join(_SHAPE.format(c=c, t=table).replace(", 2)", ", 6)") for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    corr = " union all ".join(f"select 'correlation' as section, '{a}|{b}' as \"column\", 'r' as metric, corr({a}, {b}) as value from {table}" for a, b in pairs)
    metrics = ["count", "mean", "std", "min", "q25", "q50", "q75", "max", "missing_count", "missing_ratio"]
    shapes = ["skewness", "kurtosis", "variance", "range", "iqr"]
    parts = [f"select 'overview' as section, '*' as \"column\", 'row_count' as metric, count(*)::double as value from {table}",
             f"select 'overview', '*', 'column_count', {n_columns}::double", f"select 'overview', '*', 'numeric_columns', {n_numeric}::double"]
    parts += [f"select 'descriptive', \"column\", '{m}', {m}::double from d" for m in metrics]
    parts += [f"select 'distribution', \"column\", '{m}', {m} from s" for m in shapes]
    parts += [f"select * from ({corr})"]
    return f"with d as ({described}), s as ({shaped}) select section, \"column\", metric, round(value, 3) as value from ({' union all '.join(parts)})"


@query("summary_report", summary_sql("lineitem", ["l_quantity", "l_discount"], 11, 8))
def _(t: Tables):
    return rounded(stats.summary_report(t.lineitem, ["l_quantity", "l_discount"]), 3)
