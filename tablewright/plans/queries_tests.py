"""Queries over hypothesis tests and A/B analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import hypothesis as h
from tablewright.plans.queries_stats import rounded, spearman_sql
from tablewright.plans.registry import ORACLES, Tables, query

AB = "(select event_type as g, value as v from events where event_type in ('click', 'view'))"


#: Intervals of the integrals below.
_GRID = 20_000
_W = f"case when i in (0, {_GRID}) then 1 when i % 2 = 1 then 4 else 2 end"


def _integral(f: str, low: str, high: str) -> str:
    """Simpson's rule for f(x) from low to high, up to the factor that cancels in a ratio."""
    return f"sum({_W} * ({f.replace('@', f'({low} + ({high} - {low}) * i / {_GRID}.0)')})) * any_value({high} - {low})"


def tested(sql: str, kind: str, digits: int = 6, shown: int | None = None) -> str:
    """``sql`` (rows with an exact statistic) with their p-values from the integrated density."""
    half = "pi() / 2"
    if kind == "t":  # x = sqrt(df) tan(a)
        f, low, zero, high = "pow(greatest(cos(@), 0), df - 1)", "atan(abs(statistic) / sqrt(df))", "0.0", half
    elif kind == "f":  # d1 x / (d1 x + d2) = sin(a)^2
        f, low, zero, high = "pow(greatest(sin(@), 0), df_between - 1) * pow(greatest(cos(@), 0), df_within - 1)", "atan(sqrt(df_between * statistic / df_within))", "0.0", half
    elif kind == "chi":  # x = u^2
        f, low, zero, high = "pow(@, df - 1) * exp(-(@) * (@) / 2)", "sqrt(statistic)", "0.0", "(greatest(sqrt(statistic), sqrt(df)) + 14)"
    else:
        f, low, zero, high = "exp(-(@) * (@) / 2)", "abs(z)", "0.0", "(abs(z) + 14)"
    tail, whole = _integral(f, low, high), _integral(f, zero, high)
    p = "least(1.0, tail / whole)"
    name = "z" if kind == "z" else "statistic"
    return f"""
    with base as (select *, row_number() over () as _row from ({sql})), q as (select _row, {tail} as tail, {whole} as whole from base, range(0, {_GRID + 1}) g(i) group by _row), p as (select _row, {p} as p from q)
    select base.* exclude (_row) replace (round({name}, {shown or digits}) as {name}), round(p, {digits}) as p_value, p < 0.05 as significant from base join p using (_row)
    """


def ab(t: Tables):
    return t.events.filter(F.col("event_type").isin("click", "view")).select(F.col("event_type").alias("g"), F.col("value").alias("v"))


@query("t_one_sample", tested("select count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, ((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value)))) as statistic, (count(value) - 1)::double as df from events", "t"))
def _(t: Tables):
    return rounded(h.one_sample_t(t.events, "value", 50.0))


_TWO = f"""
    with a as (select count(v) as n, avg(v) as m, stddev_samp(v) as s, var_samp(v) as w, quantile_cont(v, 0.5) as q from {AB} where g = 'click'),
         b as (select count(v) as n, avg(v) as m, stddev_samp(v) as s, var_samp(v) as w, quantile_cont(v, 0.5) as q from {AB} where g = 'view'),
         j as (select a.n as n_a, b.n as n_b, a.m as mean_a, b.m as mean_b, a.s as std_a, b.s as std_b, a.w as var_a, b.w as var_b, a.q as median_a, b.q as median_b, sqrt(((a.n - 1) * a.w + (b.n - 1) * b.w) / (a.n + b.n - 2)) as pooled_std from a, b)
"""


@query(
    "t_two_sample",
    tested(
        _TWO + """select 'click' as group_a, 'view' as group_b, n_a, n_b, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(std_a, 6) as std_a, round(std_b, 6) as std_b, round(var_a, 4) as var_a, round(var_b, 4) as var_b,
    round(pooled_std, 6) as pooled_std, ((mean_a - mean_b) / (pooled_std * sqrt(1 / n_a + 1 / n_b))) as statistic, (n_a + n_b - 2)::double as df from j""",
        "t",
    ),
)
def _(t: Tables):
    out = rounded(h.two_sample_t(ab(t), "v", "g"), 6, ("var_a", "var_b"))
    return out.withColumns({"var_a": F.round("var_a", 4), "var_b": F.round("var_b", 4)})


@query(
    "t_two_columns",
    tested(
        """with j as (select count(l_discount) as n_a, avg(l_discount) as m_a, var_samp(l_discount) as v_a, count(l_tax) as n_b, avg(l_tax) as m_b, var_samp(l_tax) as v_b from lineitem)
    select ((m_a - m_b) / (sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)) * sqrt(1 / n_a + 1 / n_b))) as statistic, (n_a + n_b - 2)::double as df from j""",
        "t", 5,
    ),
)
def _(t: Tables):
    return rounded(h.two_column_t(t.lineitem, "l_discount", "l_tax").select("statistic", "df", "p_value", "significant"), 5)


@query(
    "t_paired",
    tested(
        """select count(d) as n, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as std, (avg(d) / (stddev_samp(d) / sqrt(count(d)))) as statistic, (count(d) - 1)::double as df
    from (select l_discount - l_tax as d from lineitem)""",
        "t", 6, 5,
    ),
)
def _(t: Tables):
    out = rounded(h.paired_t(t.lineitem, "l_discount", "l_tax"))
    return out.withColumn("statistic", F.round("statistic", 5))


_RANKS = f"""
    with r as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from {AB}),
    k as (select sum(n * n * n - n)::double as t from (select count(*)::double as n from {AB} group by v)),
    s as (select count(*) filter (where g = 'click') as n_a, count(*) filter (where g = 'view') as n_b, sum(r) filter (where g = 'click') as ra from r),
    u as (select n_a, n_b, ra - n_a * (n_a + 1) / 2.0 as u, t from s, k)
    select 'click' as group_a, 'view' as group_b, n_a, n_b, u::double as statistic,
      ((greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - t / ((n_a + n_b) * (n_a + n_b - 1.0))))) as z from u
    """


@query(
    "mann_whitney",
    tested(
        _RANKS,
        "z",
    ),
)
def _(t: Tables):
    return rounded(h.mann_whitney(ab(t), "v", "g"))


@query(
    "mann_whitney_columns",
    """
    with x as (select 1 as g, l_discount as v from lineitem union all select 2, l_tax from lineitem),
    r as (select g, rank() over (order by v) + (count(*) over (partition by v) - 1) / 2.0 as r from x)
    select count(*) filter (where g = 1) as n_a, count(*) filter (where g = 2) as n_b, round(sum(r) filter (where g = 1) - count(*) filter (where g = 1) * (count(*) filter (where g = 1) + 1) / 2.0, 1)::double as statistic from r
    """,
)
def _(t: Tables):
    return h.mann_whitney_columns(t.lineitem, "l_discount", "l_tax").select("n_a", "n_b", F.round("statistic", 1).alias("statistic"))


@query(
    "wilcoxon",
    tested(
        """
    with d as (select value - 100 as d from events where value <> 100),
    r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from d),
    k as (select sum(n * n * n - n)::double as t from (select count(*)::double as n from d group by abs(d))),
    s as (select count(*) as n, sum(r) filter (where d > 0)::double as wp, sum(r) filter (where d < 0)::double as wm from r)
    select n, wp as w_plus, wm as w_minus, least(wp, wm) as statistic, ((least(wp, wm) - n * (n + 1) / 4.0) / sqrt((n::double * (n + 1) * (2 * n + 1) - t / 2) / 24)) as z from s, k
    """,
        "z",
    ),
)
def _(t: Tables):
    return rounded(h.wilcoxon(t.events, "value", 100.0))


@query(
    "kruskal_wallis",
    tested(
        """
    with r as (select event_type as g, value as v, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as r from events),
    k as (select sum(n * n * n - n) as t from (select count(*)::double as n from events group by value)),
    s as (select g, count(*)::double as m, sum(r)::double as r from r group by g), n as (select count(*)::double as n from events)
    select count(*) as groups, sum(m)::bigint as n, ((12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(r * r / m) - 3 * (any_value(n.n) + 1)) / (1 - any_value(t) / (any_value(n.n) ** 3 - any_value(n.n)))) as statistic,
      (count(*) - 1)::double as df from s, n, k
    """,
        "chi", 5,
    ),
)
def _(t: Tables):
    return rounded(h.kruskal_wallis(t.events, "value", "event_type"), 5)


@query("group_medians", "select event_type, count(value) as n, round(quantile_cont(value, 0.5), 4) as median from events group by 1")
def _(t: Tables):
    return rounded(h.group_medians(t.events, "value", "event_type"), 4)


@query(
    "anova_one_way",
    tested(
        """
    with g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m, var_samp(o_totalprice) as v from orders group by 1), a as (select avg(o_totalprice) as m, count(*) as n from orders)
    select count(*) as groups, sum(g.n)::bigint as n, ((sum(g.n * (g.m - a.m) ** 2) / (count(*) - 1)) / (sum((g.n - 1) * g.v) / (sum(g.n) - count(*)))) as statistic,
      (count(*) - 1)::double as df_between, (sum(g.n) - count(*))::double as df_within,
      round(sum(g.n * (g.m - a.m) ** 2) / 1e6, 4) as ss_between, round(sum((g.n - 1) * g.v) / 1e6, 4) as ss_within from g, a
    """,
        "f",
    ),
)
def _(t: Tables):
    out = rounded(h.anova(t.orders, "o_totalprice", "o_orderpriority"), 6, ("ss_between", "ss_within"))
    return out.withColumns({c: F.round(F.col(c) / 1e6, 4) for c in ("ss_between", "ss_within")})


@query(
    "group_statistics",
    "select o_orderpriority, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std, round(sum(o_totalprice), 2) as total, min(o_totalprice) as min, max(o_totalprice) as max from orders group by 1",
)
def _(t: Tables):
    out = rounded(h.group_statistics(t.orders, "o_totalprice", "o_orderpriority"), 4)
    return out.withColumn("total", F.round("total", 2))


def _chi_sql(table, a, b):
    return f"""
    with c as (select {a} as a, {b} as b, count(*) as o from {table} group by 1, 2), ra as (select a, sum(o) as r from c group by a), cb as (select b, sum(o) as k from c group by b), n as (select sum(o) as n from c),
    g as (select coalesce(c.o, 0) as o, r * k / n as e from ra cross join cb cross join n left join c on c.a = ra.a and c.b = cb.b),
    d as (select ((select count(*) from ra) - 1) * ((select count(*) from cb) - 1) as d)
    select sum(o)::bigint as n, (sum(case when d.d = 1 then (abs(o - e) - least(0.5, abs(o - e))) ** 2 / e else (o - e) ** 2 / e end)) as statistic, any_value(d.d)::double as df from g, d
    """


@query("chi_square_independence", tested(_chi_sql("orders", "o_orderstatus", "o_orderpriority"), "chi"))
def _(t: Tables):
    return rounded(h.chi_square_independence(t.orders, "o_orderstatus", "o_orderpriority"))


@query("chi_square_two_by_two", tested(_chi_sql("labels", "quality", "toxic"), "chi"))
def _(t: Tables):
    return rounded(h.chi_square_independence(t.labels, "quality", "toxic"))


@query(
    "crosstab",
    """with c as (select o_orderstatus, o_orderpriority, count(*) as observed from orders group by 1, 2)
    select o_orderstatus, o_orderpriority, observed, (sum(observed) over (partition by o_orderstatus))::bigint as row_total, (sum(observed) over (partition by o_orderpriority))::bigint as column_total,
      round((sum(observed) over (partition by o_orderstatus)) * (sum(observed) over (partition by o_orderpriority)) / (sum(observed) over ()), 6) as expected from c""",
)
def _(t: Tables):
    return rounded(h.crosstab(t.orders, "o_orderstatus", "o_orderpriority"))


_FIT = "(select l_linenumber as a, case when l_quantity > 10 then l_linenumber else (l_linenumber % 7) + 1 end as b from lineitem)"


@query(
    "chi_square_fit",
    tested(
        f"""
    with o as (select a as c, count(*) as o from {_FIT} group by 1), e as (select b as c, count(*) as e from {_FIT} group by 1), j as (select coalesce(o.o, 0) as o, coalesce(e.e, 0) as e from o full join e on o.c = e.c)
    select sum(o)::bigint as n, (sum((o - e * s) ** 2 / (e * s))) as statistic, (count(*) - 1)::double as df from j, (select sum(o) / sum(e) as s from j)
    """,
        "chi",
    ),
)
def _(t: Tables):
    df = t.lineitem.select(
        F.col("l_linenumber").alias("a"),
        F.when(F.col("l_quantity") > 10, F.col("l_linenumber")).otherwise(F.col("l_linenumber") % 7 + 1).alias("b"),
    )
    return rounded(h.chi_square_fit(df, "a", "b"))


_R = "case when abs(r) < 0.1 then 'negligible' when abs(r) < 0.3 then 'weak' when abs(r) < 0.5 then 'moderate' when abs(r) < 0.7 then 'strong' else 'very_strong' end as strength"


@query(
    "pearson_test",
    tested(
        f"select 'l_quantity' as column1, 'l_extendedprice' as column2, n, round(r, 6) as r, (r * sqrt((n - 2) / (1 - r * r))) as statistic, (n - 2)::double as df, {_R} from (select count(*) as n, corr(l_quantity, l_extendedprice) as r from lineitem)",
        "t", 6, 4,
    ),
)
def _(t: Tables):
    out = h.pearson_test(t.lineitem, "l_quantity", "l_extendedprice")
    return out.withColumns({"r": F.round("r", 6), "statistic": F.round("statistic", 4), "p_value": F.round("p_value", 6)})


@query(
    "spearman_test",
    tested(
        f"select column1, column2, n, round(r, 6) as r, (r * sqrt((n - 2) / (1 - r * r))) as statistic, (n - 2)::double as df, {_R} from ({spearman_sql('p_size', 'p_retailprice', 'part')})",
        "t", 6, 4,
    ),
)
def _(t: Tables):
    out = h.spearman_test(t.part, "p_size", "p_retailprice")
    return out.withColumns({"r": F.round("r", 6), "statistic": F.round("statistic", 4), "p_value": F.round("p_value", 6)})


@query(
    "ab_statistics",
    _TWO + """select 'click' as group_a, 'view' as group_b, n_a, n_b, round(mean_a, 6) as mean_a, round(mean_b, 6) as mean_b, round(std_a, 6) as std_a, round(std_b, 6) as std_b, round(median_a, 4) as median_a, round(median_b, 4) as median_b,
    round((mean_b - mean_a) / pooled_std, 6) as cohens_d, round(mean_b - mean_a, 6) as mean_difference,
    case when abs((mean_b - mean_a) / pooled_std) < 0.2 then 'small' when abs((mean_b - mean_a) / pooled_std) < 0.5 then 'medium' when abs((mean_b - mean_a) / pooled_std) < 0.8 then 'large' else 'very_large' end as effect,
    abs((mean_b - mean_a) / pooled_std) >= 0.2 as practical from j""",
)
def _(t: Tables):
    keep = ["group_a", "group_b", "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", "median_a", "median_b", "cohens_d", "mean_difference", "effect", "practical"]
    out = rounded(h.ab_statistics(ab(t), "g", "v").select(*keep))
    return out.withColumns({"median_a": F.round("median_a", 4), "median_b": F.round("median_b", 4)})


# The 0.975 quantile of t by the Cornish-Fisher expansion of the normal one.
_Z = 1.959963984540054
_Q = " + ".join(
    [f"{_Z}", f"{(_Z**3 + _Z) / 4} / df", f"{(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / pow(df, 2)", f"{(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / pow(df, 3)"]
)
_AB = f"""
    with j as (select *, (n_a + n_b - 2)::double as df, (mean_b - mean_a) / pooled_std as cohens_d, mean_b - mean_a as mean_difference from ({_TWO} select * from j) j)
    select n_a, n_b, round(mean_difference, 6) as mean_difference, round(cohens_d, 6) as cohens_d, abs(cohens_d) >= 0.2 as practical, df, {{statistic}} as statistic,
      round(mean_difference - ({_Q}) * pooled_std * sqrt(1 / n_a + 1 / n_b), 5) as ci_lower, round(mean_difference + ({_Q}) * pooled_std * sqrt(1 / n_a + 1 / n_b), 5) as ci_upper{{more}} from j{{source}}
"""
_ADVICE = "case when significant and practical then 'apply' when significant then 'review' when practical then 'collect_more_data' else 'keep_current' end as recommendation"


def _ab_shown(out: DataFrame) -> DataFrame:
    keep = ["n_a", "n_b", "mean_difference", "cohens_d", "practical", "df", "statistic", "ci_lower", "ci_upper", "p_value", "significant", "recommendation"]
    return rounded(out.select(*keep), 6, ("ci_lower", "ci_upper")).withColumns({c: F.round(c, 5) for c in ("ci_lower", "ci_upper")})


@query("ab_test_t", f"select *, {_ADVICE} from ({tested(_AB.format(statistic='(mean_a - mean_b) / (pooled_std * sqrt(1 / n_a + 1 / n_b))', more='', source=''), 't')})")
def _(t: Tables):
    return _ab_shown(h.ab_test(ab(t), "g", "v"))


@query(
    "ab_test_ranks",
    f"select * exclude (z), {_ADVICE} from ({tested(_AB.format(statistic='u', more=', z', source=f', (select statistic as u, z from ({_RANKS}))'), 'z')})",
)
def _(t: Tables):
    return _ab_shown(h.ab_test(ab(t), "g", "v", "mann_whitney"))


# Power at (n_a, n_b): the chance that a normal variable around the noncentrality exceeds the limit times the pooled deviation, over that deviation's density.
_PHI = "(0.5 + ({x}) * sum(case when j in (0, 200) then 1 when j % 2 = 1 then 4 else 2 end * exp(-0.5 * pow(({x}) * j / 200.0, 2))) / 600 / sqrt(2 * pi()))"
_POWER = f"""
    with b as (select n_a, n_b, (mean_b - mean_a) / pooled_std as d from ({_TWO} select * from j)),
    sizes as (select 0 as given, n_a::double as m, n_b::double as n, d from b union all select 1, k, k, d from (select ceil(2 * (({_Z} + 0.8416212335729143) / d) ** 2) + step as k, d from b, range(-2, 5) r(step)) where k >= 2),
    p as (select *, m + n - 2 as df, abs(d) * sqrt(m * n / (m + n)) as shift from sizes), c as (select *, {_Q} as lim from p),
    s as (select *, case when i in (0, 200) then 1 when i % 2 = 1 then 4 else 2 end as w, 1 + (i - 100) * 0.09 / sqrt(2 * df) as s from c, range(0, 201) g(i)),
    h as (select given, m, n, d, w * exp((df - 1) * ln(s) - df * (s * s - 1) / 2) as f, {_PHI.format(x='shift - lim * s')} + {_PHI.format(x='-shift - lim * s')} as reject from s, range(0, 201) g(j) group by given, m, n, d, df, w, s, shift, lim),
    r as (select given, m, n, d, sum(f * reject) / sum(f) as power from h group by given, m, n, d)
"""


@query(
    "ab_power",
    _POWER + """select 'click' as group_a, 'view' as group_b, round(d, 6) as cohens_d, round(power, 6) as power, (select min(m) from r where given = 1 and power >= 0.8)::bigint as needed_per_group from r where given = 0""",
)
def _(t: Tables):
    return rounded(h.power(h.ab_statistics(ab(t), "g", "v")))


@query(
    "rank_tests_exact",
    """
    with v as (select n_nationkey, any_value(n_regionkey) = 0 as first, avg(c_acctbal) as v from customer join nation on c_nationkey = n_nationkey group by 1), x as (select *, row_number() over (order by v) as r from v),
    one as (select sum(r) filter (where first) - 15 as stat, count(*) filter (where first) * count(*) filter (where not first) as most, count(*) as n from x), i as (select unnest(range(1, n + 1)) as r from one),
    all_u as (select a.r + b.r + c.r + d.r + e.r - 15 as stat from i a join i b on b.r > a.r join i c on c.r > b.r join i d on d.r > c.r join i e on e.r > d.r),
    m as (select event_type, avg(value) - 245 as d from events group by 1), d as (select d, row_number() over (order by abs(d)) as r from m), two as (select coalesce(sum(r) filter (where d > 0), 0) as stat, count(*) as n from d),
    all_w as (select coalesce(list_sum(list_filter(range(1, n + 1), lambda k: ((s >> (k - 1)::int) & 1) = 1)), 0) as stat from two, range(0, 1024) b(s) where s < 1 << n::int)
    select 'mann_whitney' as test, round(least(1, 2 * avg((all_u.stat <= least(one.stat, most - one.stat))::int)), 9) as p_value from all_u, one
    union all select 'wilcoxon', round(least(1, 2 * avg((all_w.stat <= least(two.stat, n * (n + 1) / 2 - two.stat))::int)), 9) from all_w, two
    """,
)
def _(t: Tables):
    """Means of whole tables are few values without ties: the nations of one region against the others, and event types against a value."""
    nations = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_regionkey").agg(F.avg("c_acctbal").alias("v"))
    types = t.events.groupBy("event_type").agg(F.avg("value").alias("v"))
    both = {"mann_whitney": h.mann_whitney(nations.withColumn("g", F.col("n_regionkey") == 0), "v", "g"), "wilcoxon": h.wilcoxon(types, "v", 245.0)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("test"), F.round("p_value", 9).alias("p_value")) for n, df in both.items()])


_RUNS = {
    "one_sample": "t_one_sample", "two_sample": "t_two_sample", "mann_whitney": "mann_whitney", "wilcoxon": "wilcoxon",
    "kruskal_wallis": "kruskal_wallis", "anova": "anova_one_way", "chi_square": "chi_square_independence", "pearson": "pearson_test",
}


@query(
    "hypothesis_p_values",
    " union all ".join(f"select '{n}' as test, round(statistic, 3) as statistic, round(p_value, 4) as p_value, significant from ({ORACLES[q]})" for n, q in _RUNS.items()),
)
def _(t: Tables):
    runs = {
        "one_sample": h.run_test("one_sample", t.events, "value", 50.0),
        "two_sample": h.run_test("two_sample", ab(t), "v", "g"),
        "mann_whitney": h.run_test("mann_whitney", ab(t), "v", "g"),
        "wilcoxon": h.run_test("wilcoxon", t.events, "value", 100.0),
        "kruskal_wallis": h.run_test("kruskal_wallis", t.events, "value", "event_type"),
        "anova": h.run_test("anova", t.orders, "o_totalprice", "o_orderpriority"),
        "chi_square": h.run_test("chi_square", t.orders, "o_orderstatus", "o_orderpriority"),
        "pearson": h.run_test("pearson", t.lineitem, "l_quantity", "l_extendedprice"),
    }
    parts = [df.select(F.lit(n).alias("test"), F.round("statistic", 3).alias("statistic"), F.round("p_value", 4).alias("p_value"), "significant") for n, df in runs.items()]
    return reduce(DataFrame.unionByName, parts)
