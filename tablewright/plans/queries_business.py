"""Queries over the business templates: orders, sales and the click/view comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import templates as tp
from tablewright.plans.queries_stats import describe_sql, rounded
from tablewright.plans.queries_tests import AB, ab
from tablewright.plans.queries_tests import tested
from tablewright.plans.registry import Tables, query


def purchases(t: Tables):
    return t.orders.select(
        F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("purchase_amount"), F.col("o_orderdate").alias("purchase_date")
    )


def sales(t: Tables):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").alias("sales_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sales_amount"),
        F.col("p_brand").alias("product_category"),
    )


SALES = "s as (select l_shipdate as d, l_extendedprice * (1 - l_discount) as a, p_brand as c from lineitem join part on l_partkey = p_partkey)"
_FACTS = "f as (select o_custkey as customer_id, date_diff('day', max(o_orderdate), (select max(o_orderdate) from orders))::bigint as recency, count(*) as frequency, sum(o_totalprice) as monetary, avg(o_totalprice) as ap, min(o_orderdate) as fp, max(o_orderdate) as lp from orders group by 1)"


def _score(c, reverse):
    order = (5, 4, 3, 2, 1) if reverse else (1, 2, 3, 4, 5)
    edges = ", ".join(f"quantile_cont({c}, {p}) as {c[0]}{i}" for i, p in enumerate((0.0, 0.2, 0.4, 0.6, 0.8, 1.0)))
    same = " or ".join(f"{c[0]}{i} = {c[0]}{i + 1}" for i in range(5))
    case = f"case when {same} then 3 " + " ".join(f"when {c} <= {c[0]}{i + 1} then {order[i]}" for i in range(4)) + f" else {order[4]} end"
    return edges, case


_E = [_score("recency", True), _score("frequency", False), _score("monetary", False)]
_RFM = f"with {_FACTS}, e as (select {', '.join(e for e, _ in _E)} from f), r as (select customer_id, recency, frequency, monetary, {_E[0][1]} as r_score, {_E[1][1]} as f_score, {_E[2][1]} as m_score from f, e)"
_SEG = f"with {_FACTS}, e as (select quantile_cont(monetary, 0.8) as m8, quantile_cont(monetary, 0.5) as m5, quantile_cont(frequency, 0.8) as f8 from f), g as (select *, case when monetary > m8 and frequency > f8 then 'vip' when monetary > m8 then 'high_value' when monetary > m5 then 'medium_value' else 'low_value' end as segment from f, e)"


@query("rfm", _RFM + " select customer_id, recency, frequency, round(monetary, 2) as monetary, r_score, f_score, m_score, r_score + f_score + m_score as rfm_score from r")
def _(t: Tables):
    return rounded(tp.rfm(purchases(t)), 2)


@query("rfm_distribution", _RFM + " select r_score + f_score + m_score as rfm_score, count(*) as customers from r group by 1")
def _(t: Tables):
    return tp.rfm_distribution(tp.rfm(purchases(t)))


@query("customer_segments", _SEG + " select customer_id, round(monetary, 2) as total_spent, round(ap, 6) as avg_purchase, frequency as purchase_count, fp as first_purchase, lp as last_purchase, segment from g")
def _(t: Tables):
    out = tp.segments(purchases(t))
    return out.withColumns({"total_spent": F.round("total_spent", 2), "avg_purchase": F.round("avg_purchase", 6)})


@query("segment_stats", _SEG + " select segment, count(*) as customers, round(avg(monetary), 4) as total_spent_mean, round(stddev_samp(monetary), 4) as total_spent_std, round(avg(frequency), 4) as purchase_count_mean, round(stddev_samp(frequency), 4) as purchase_count_std from g group by 1")
def _(t: Tables):
    return rounded(tp.segment_stats(tp.segments(purchases(t))), 4)


for _by, _expr in (("month", "month(o_orderdate)::int"), ("weekday", "(isodow(o_orderdate) - 1)::int"), ("customer", "o_custkey")):
    query(
        f"purchases_by_{_by}",
        f"select {_expr} as {_by}, round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 6) as mean, count(o_totalprice) as n, round(stddev_samp(o_totalprice), 6) as std from orders group by 1",
    )(lambda t, by=_by: rounded(tp.purchase_patterns(purchases(t), by), 6).withColumn("total", F.round("total", 2)))


@query(
    "customer_advice",
    _RFM + ", x as (select count(*) filter (where r_score + f_score + m_score >= 12) / count(*) < 0.2 as few from r), y as (" + _SEG + " select count(*) filter (where segment = 'low_value') > count(*) filter (where segment = 'vip') as many from g) select 'strengthen_retention' as advice from x where few union all select 'raise_customer_value' from y where many",
)
def _(t: Tables):
    p = purchases(t)
    return tp.customer_advice(tp.rfm(p), tp.segments(p))


_MONTHS = f"with {SALES}, m as (select date_trunc('month', d)::date as month, sum(a) as total from s group by 1), i as (select *, row_number() over (order by month) - 1 as i from m)"


@query("sales_monthly", _MONTHS + " select month, round(total, 2) as total from m")
def _(t: Tables):
    return rounded(tp.monthly_sales(sales(t)), 2)


@query("sales_trend", _MONTHS + " select count(*) as months, round(regr_slope(total, i), 4) as slope, round(regr_r2(total, i), 6) as r2, case when regr_slope(total, i) > 0 then 'up' when regr_slope(total, i) < 0 then 'down' else 'stable' end as direction from i")
def _(t: Tables):
    out = tp.sales_trend(sales(t))
    return out.withColumns({"slope": F.round("slope", 4), "r2": F.round("r2", 6)})


_SEASON = f"with {SALES}, k as (select 'month' as kind, month(d)::int as period, avg(a) as mean from s group by 2 union all select 'quarter', quarter(d)::int, avg(a) from s group by 2), z as (select *, mean / (select avg(a) from s) as ix from k)"


@query("sales_seasonality", _SEASON + " select kind, period, round(mean, 4) as mean, round(ix, 6) as seasonal_index from z")
def _(t: Tables):
    out = tp.sales_seasonality(sales(t))
    return out.withColumns({"mean": F.round("mean", 4), "seasonal_index": F.round("seasonal_index", 6)})


@query("sales_by_category", f"with {SALES} select c as product_category, round(sum(a), 2) as total, round(avg(a), 4) as mean, count(a) as n, round(stddev_samp(a), 4) as std from s group by 1")
def _(t: Tables):
    return rounded(tp.sales_by_category(sales(t)), 4).withColumn("total", F.round("total", 2))


@query(
    "sales_advice",
    _SEASON + f", m as (select date_trunc('month', d)::date as month, sum(a) as total from s group by 1), i as (select regr_slope(total, i) as sl from (select *, row_number() over (order by month) - 1 as i from m)) "
    "select case when sl < 0 then 'review_marketing' else 'keep_strategy' end as advice, null::int as month from i where sl <> 0 union all select 'stock_up', arg_max(period, ix) from z where kind = 'month' union all select 'promote', arg_min(period, ix) from z where kind = 'month'",
)
def _(t: Tables):
    return tp.sales_advice(sales(t))


@query("ab_basic", f'select g as "group", count(v) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, min(v) as min, max(v) as max from {AB} group by 1')
def _(t: Tables):
    return rounded(tp.ab_basic(ab(t).toDF("group", "metric")))


_EFFECT = f"""with a as (select count(v) as n, avg(v) as m, var_samp(v) as w from {AB} where g = 'click'), b as (select count(v) as n, avg(v) as m, var_samp(v) as w from {AB} where g = 'view'),
    j as (select a.n as na, b.n as nb, a.m as ma, b.m as mb, sqrt(((a.n - 1) * a.w + (b.n - 1) * b.w) / (a.n + b.n - 2)) as s from a, b)"""


@query(
    "ab_effect",
    _EFFECT + " select 'click' as group_a, 'view' as group_b, round(ma, 6) as mean_a, round(mb, 6) as mean_b, round(ma - mb, 6) as difference, round((ma - mb) / s, 6) as cohens_d, case when abs((ma - mb) / s) < 0.2 then 'small' when abs((ma - mb) / s) < 0.5 then 'medium' else 'large' end as effect, round((ma - mb) / (s * sqrt(1 / na + 1 / nb)), 6) as statistic, (na + nb - 2)::double as df from j",
)
def _(t: Tables):
    return rounded(tp.ab_effect(ab(t).toDF("group", "metric")))


_JUDGED = tested(_EFFECT + " select abs((ma - mb) / s) as d, (ma - mb) / (s * sqrt(1 / na + 1 / nb)) as statistic, (na + nb - 2)::double as df from j", "t")


@query(
    "ab_advice",
    f"with r as ({_JUDGED}) select case when significant then 'choose_winner' else 'collect_more_data' end as advice from r union all select case when d < 0.2 then 'weigh_impact' when d < 0.5 then 'apply_after_review' else 'apply_now' end from r",
)
def _(t: Tables):
    return tp.ab_advice(ab(t).toDF("group", "metric"))


@query("template_customer_stats", _RFM + ", z as (" + describe_sql(["recency", "frequency", "monetary"], "r") + ") select * from z")
def _(t: Tables):
    return rounded(tp.execute("customer_analysis", purchases(t))["rfm_stats"], 4)
