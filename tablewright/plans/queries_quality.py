"""Queries over data quality, outliers and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import cleaning, outliers, quality, stats, trends
from tablewright.plans.queries_stats import GAPPY, gappy, rounded
from tablewright.plans.registry import Tables, query

# --- quality report --------------------------------------------------------------------

_IQR = """select '{c}' as "column", count({c}) as total_values, count(*) filter (where {c} < lo or {c} > hi) as outlier_count, round(count(*) filter (where {c} < lo or {c} > hi) / count({c}), 6) as outlier_ratio,
    round(any_value(lo), 4) as lower_bound, round(any_value(hi), 4) as upper_bound
    from {t}, (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t}))"""
_ZED = """select '{c}' as "column", count({c}) as total_values, count(*) filter (where abs(({c} - m) / s) > {k}) as outlier_count, round(count(*) filter (where abs(({c} - m) / s) > {k}) / count({c}), 6) as outlier_ratio,
    null::double as lower_bound, null::double as upper_bound from {t}, (select avg({c}) as m, stddev_samp({c}) as s from {t})"""


@query("outlier_stats_iqr", " union all ".join(_IQR.format(c=c, t=t) for c, t in [("value", "events")]))
def _(t: Tables):
    return rounded(rounded(outliers.outlier_stats(t.events, ["value"])), 4, ("outlier_ratio",))


@query("outlier_stats_zscore", " union all ".join(_ZED.format(c=c, t="lineitem", k="1.5::double") for c in ["l_quantity", "l_extendedprice"]))
def _(t: Tables):
    return rounded(outliers.outlier_stats(t.lineitem, ["l_quantity", "l_extendedprice"], "zscore", 1.5))


@query(
    "outlier_flags",
    """select event_id, value, value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) as value_outlier from events, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)""",
)
def _(t: Tables):
    return outliers.flag(t.events.select("event_id", "value"), ["value"])


@query(
    "outlier_first_rows",
    """select * from (select 'value' as "column", event_id, value, row_number() over (order by event_id) as row_number from events, (select avg(value) as m, stddev_samp(value) as s from events) where abs((value - m) / s) > 3) where row_number <= 10""",
)
def _(t: Tables):
    return outliers.outlier_rows(t.events, "event_id", ["value"], "zscore", 3.0, 10)


_ROWZ = """
    with s as (select avg(l_quantity) as m1, stddev_samp(l_quantity) as s1, avg(d) as m2, stddev_samp(d) as s2, avg(l_extendedprice) as m3, stddev_samp(l_extendedprice) as s3
               from (select *, coalesce(case when l_linenumber <> 3 then l_discount end, 0) as d from lineitem)),
    z as (select l_orderkey * 10 + l_linenumber as id, greatest(abs((l_quantity - m1) / s1), abs((d - m2) / s2), abs((l_extendedprice - m3) / s3)) as score
          from (select *, coalesce(case when l_linenumber <> 3 then l_discount end, 0) as d from lineitem), s)
"""


def _wide(t: Tables):
    return t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity",
        F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("d"), "l_extendedprice",
    )


@query("outlier_row_zscore", _ROWZ + "select id, round(score, 6) as score, case when score > 1.7 then -1 else 1 end as label from z")
def _(t: Tables):
    return rounded(outliers.row_zscore(_wide(t), "id", threshold=1.7))


@query(
    "anomaly_stats",
    _ROWZ + """select count(*) as total, count(*) filter (where score > 1.7) as anomalies, count(*) filter (where score <= 1.7) as normal, round(count(*) filter (where score > 1.7) / count(*), 6) as anomaly_ratio,
    round(avg(score), 6) as mean_score, round(max(score), 6) as max_score, round(min(score), 6) as min_score from z""",
)
def _(t: Tables):
    return rounded(outliers.anomaly_stats(outliers.row_zscore(_wide(t), "id", threshold=1.7)))


_VOTES = """
    with q as (select avg(value) as m, stddev_samp(value) as s, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
    v as (select event_id, value, (case when abs((value - m) / s) > 3 then 1 else 0 end + case when value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) then 1 else 0 end + case when value > 150 then 1 else 0 end) as votes from events, q)
"""


def _labels(t: Tables):
    df = t.events.select("event_id", "value")
    label = lambda c: F.when(c, -1).otherwise(1)
    return {
        "zscore": outliers.flag(df, ["value"], "zscore").select("event_id", label(F.col("value_outlier")).alias("label")),
        "iqr": outliers.flag(df, ["value"]).select("event_id", label(F.col("value_outlier")).alias("label")),
        "rule": df.select("event_id", label(F.col("value") > 150).alias("label")),
    }


@query("outlier_votes", _VOTES + "select event_id, votes::bigint as votes, case when votes >= 1.5 then -1 else 1 end as label from v")
def _(t: Tables):
    return outliers.vote(_labels(t), "event_id", 0.5)


@query(
    "outlier_vote_summary",
    _VOTES + "select count(*) as total, count(*) filter (where votes >= 1.5) as outliers, round(count(*) filter (where votes >= 1.5) / count(*), 6) as outlier_ratio, round(avg(votes) filter (where votes >= 1.5) / 3, 6) as confidence from v",
)
def _(t: Tables):
    return rounded(outliers.vote_summary(outliers.vote(_labels(t), "event_id", 0.5), 3))


@query(
    "outlier_compare",
    _VOTES + """select * from (select 'zscore' as method, count(*) as total, count(*) filter (where abs((value - m) / s) > 3) as outliers, round(count(*) filter (where abs((value - m) / s) > 3) / count(*), 6) as outlier_ratio from events, q
    union all select 'iqr', count(*), count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)), round(count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) / count(*), 6) from events, q
    union all select 'rule', count(*), count(*) filter (where value > 150), round(count(*) filter (where value > 150) / count(*), 6) from events)""",
)
def _(t: Tables):
    return rounded(outliers.compare_methods(_labels(t)))


@query(
    "outlier_summary",
    """with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events), f as (select value from events, q where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1))
    select 'value' as "column", count(*) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max from f""",
)
def _(t: Tables):
    marked = outliers.flag(t.events.select("event_id", "value"), ["value"])
    return rounded(outliers.flagged_summary(marked, F.col("value_outlier"), ["value"]))


_PLAIN = "(select l_linenumber, l_discount, l_returnflag from " + GAPPY + ")"


@query(
    "consistency",
    f"""select (select count(*) from {_PLAIN}) as row_count, (select count(*) from {_PLAIN}) - count(*) as duplicate_rows, round(((select count(*) from {_PLAIN}) - count(*)) / (select count(*) from {_PLAIN}), 6) as duplicate_ratio,
    count(*) as unique_rows, round(count(*) / (select count(*) from {_PLAIN}), 6) as unique_ratio, 0::bigint as mixed_columns from (select distinct * from {_PLAIN})""",
)
def _(t: Tables):
    return rounded(quality.consistency(gappy(t).select("l_linenumber", "l_discount", "l_returnflag")))


_SCORES = f"""
    with p as (select * from {_PLAIN}), n as (select count(*) as n, count(l_discount) as d, count(l_returnflag) as r, (select count(*) from (select distinct * from p)) as u from p),
    b as (select quantile_cont(l_linenumber, 0.25) as a1, quantile_cont(l_linenumber, 0.75) as a3, quantile_cont(l_discount, 0.25) as b1, quantile_cont(l_discount, 0.75) as b3 from p),
    o as (select count(*) filter (where l_linenumber < a1 - 1.5 * (a3 - a1) or l_linenumber > a3 + 1.5 * (a3 - a1)) / count(l_linenumber) as x, count(*) filter (where l_discount < b1 - 1.5 * (b3 - b1) or l_discount > b3 + 1.5 * (b3 - b1)) / count(l_discount) as y from p, b),
    s as (select (1 + d / n + r / n) / 3 * 100 as missing_score, 100 - (x + y) / 2 * 100 as outlier_score, 100 - (n - u) / n * 20 as consistency_score, (n - u) / n as duplicate_ratio from n, o)
"""


@query(
    "quality_scores",
    _SCORES + """select round(missing_score, 6) as missing_score, round(outlier_score, 6) as outlier_score, round(consistency_score, 6) as consistency_score, round(duplicate_ratio, 6) as duplicate_ratio, 0::bigint as mixed_columns,
    round(missing_score * 0.4 + outlier_score * 0.3 + consistency_score * 0.3, 6) as overall_score from s""",
)
def _(t: Tables):
    return rounded(quality.component_scores(gappy(t).select("l_linenumber", "l_discount", "l_returnflag")))


@query(
    "quality_findings",
    _SCORES + """, m as (select 'l_linenumber' as c, 0 as r from n union all select 'l_discount', 1 - d / n from n union all select 'l_returnflag', 1 - r / n from n)
    select 'recommendation' as severity, 'missing_values' as code, c as "column" from m where r > 0.1 union all select 'critical', 'missing_values', c from m where r > 0.5
    union all select 'recommendation', 'duplicate_rows', '*' from s where duplicate_ratio > 0.1 union all select 'critical', 'duplicate_rows', '*' from s where duplicate_ratio > 0.5
    union all select 'recommendation', 'outliers', 'l_linenumber' from o where x > 0.05 union all select 'recommendation', 'outliers', 'l_discount' from o where y > 0.05""",
)
def _(t: Tables):
    return quality.report_findings(gappy(t).select("l_linenumber", "l_discount", "l_returnflag"))


@query(
    "completeness",
    f"select (count(*) * 5 - count(l_orderkey) - count(l_linenumber) - count(l_quantity) - count(l_discount) - count(l_returnflag))::bigint as missing_cells, count(*) * 5 as total_cells, round(1 - (count(l_orderkey) + count(l_linenumber) + count(l_quantity) + count(l_discount) + count(l_returnflag)) / (count(*) * 5), 6) as missing_ratio, round((count(l_orderkey) + count(l_linenumber) + count(l_quantity) + count(l_discount) + count(l_returnflag)) / (count(*) * 5), 6) as completeness from {GAPPY}",
)
def _(t: Tables):
    return rounded(quality.completeness(gappy(t)))


@query(
    "value_consistency",
    """with g as (select l_partkey as id, min(l_suppkey) <> max(l_suppkey) as a, min(l_returnflag) <> max(l_returnflag) as b from lineitem group by 1)
    select 'part_id' as id_column, 'l_suppkey' as "column", round(1 - avg(a::int), 6) as score from g union all select 'part_id', 'l_returnflag', round(1 - avg(b::int), 6) from g""",
)
def _(t: Tables):
    return rounded(quality.value_consistency(t.lineitem.select(F.col("l_partkey").alias("part_id"), "l_suppkey", "l_returnflag")))


@query(
    "range_violations",
    """with b as (select quantile_cont(value, 0.01) as a, quantile_cont(value, 0.99) as z, quantile_cont(k, 0.01) as ka, quantile_cont(k, 0.99) as kz from (select value, cast(json_extract_string(props, '$.k') as bigint) - 3 as k from events)),
    v as (select count(*) filter (where value > z + 3 * (z - a) or value < a - 3 * (z - a)) + count(*) filter (where k > kz + 3 * (kz - ka) or k < ka - 3 * (kz - ka)) + count(*) filter (where k < 0) as v, 3 * count(*) as n from (select value, cast(json_extract_string(props, '$.k') as bigint) - 3 as k from events), b)
    select v as violations, n as checks, round(v / n, 6) as violation_ratio from v""",
)
def _(t: Tables):
    df = t.events.select("value", (F.get_json_object("props", "$.k").cast("bigint") - 3).alias("k_count"))
    return rounded(quality.range_violations(df))


_QUALITY = """
    with d as (select c_custkey as id, 'c' || c_custkey || case when c_custkey % 10 = 0 then '' else '@mail.example' end as email, case when c_custkey % 4 = 0 then null else c_acctbal end as balance, cast(c_nationkey as varchar) as code from customer),
    c as (select count(*) as n, count(balance) as b, avg(regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')::int) as f, avg(regexp_matches(email, '^-?\\d+\\.?\\d*$')::int) as te, avg(regexp_matches(code, '^-?\\d+\\.?\\d*$')::int) as tc,
      count(*) filter (where balance < 0) + count(*) filter (where balance > 9000) as cv, count(*) filter (where not regexp_matches(code, '^(?:[0-9])$')) as fv from d),
    q as (select quantile_cont(id, 0.01) as i1, quantile_cont(id, 0.99) as i9, quantile_cont(balance, 0.01) as b1, quantile_cont(balance, 0.99) as b9 from d),
    r as (select (count(*) filter (where id > i9 + 3 * (i9 - i1) or id < i1 - 3 * (i9 - i1)) + count(*) filter (where balance > b9 + 3 * (b9 - b1) or balance < b1 - 3 * (b9 - b1))) / (2 * count(*)) as rv from d, q),
    m as (select n, 1 - b / n as bm, (1 + (1 - te) + 1 + (1 - tc)) / 4 as ty, (1 + f + 1 + 1) / 4 as fo, cv, fv, rv from c, r),
    s as (select n, bm / 4 as missing_ratio, 1 - bm / 4 as completeness, greatest(0, least(1, 1 - (1 - ty) - rv)) as accuracy, (ty + 1 + fo) / 3 as consistency, ty, fo, cv, fv, rv, greatest(0, least(1, 1 - (cv + fv + floor(rv * n)) / (4 * n))) as validity from m)
"""


def _people(t: Tables):
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("id"),
        F.concat(F.lit("c"), key, F.when(key % 10 == 0, "").otherwise("@mail.example")).alias("email"),
        F.when(key % 4 != 0, F.col("c_acctbal")).alias("balance"),
        F.col("c_nationkey").cast("string").alias("code"),
    )


_RULES = {"balance": {"min": 0, "max": 9000}, "code": {"pattern": "[0-9]$"}}


@query(
    "quality_metrics",
    _QUALITY + """select n as row_count, round(missing_ratio, 6) as missing_ratio, round(completeness, 6) as completeness, round(accuracy, 6) as accuracy, round(consistency, 6) as consistency, round(validity, 6) as validity,
    round(ty, 6) as type_consistency, round(fo, 6) as format_consistency, cv as constraint_violations, fv as format_violations,
    round(completeness * 0.3 + accuracy * 0.3 + consistency * 0.2 + validity * 0.2, 6) as overall_score from s""",
)
def _(t: Tables):
    keep = ["row_count", "missing_ratio", "completeness", "accuracy", "consistency", "validity", "type_consistency", "format_consistency", "constraint_violations", "format_violations", "overall_score"]
    return rounded(quality.quality_metrics(_people(t), _RULES).select(*keep))


@query(
    "quality_advice",
    _QUALITY + """, a as (select 'improve_completeness' as advice from s where completeness < 0.8 union all select 'improve_accuracy' from s where accuracy < 0.8 union all select 'improve_consistency' from s where consistency < 0.8
    union all select 'improve_validity' from s where validity < 0.8 union all select 'high_missing_ratio' from s where missing_ratio > 0.2)
    select advice from a union all select 'good' where not exists (select 1 from a)""",
)
def _(t: Tables):
    return quality.quality_advice(quality.quality_metrics(_people(t), _RULES))


# --- quality over time: one snapshot per day of the event log --------------------------------

_SNAPS = """
    with d as (select cast(ts as date) as checked_at, count(*) as n, count(*) filter (where value >= 20) / count(*) as completeness, count(distinct user_id) / count(*) as accuracy,
        count(*) filter (where event_type <> 'error') / count(*) as consistency, count(*) filter (where value < 80) / count(*) as validity, 1 - count(*) filter (where value >= 20) / count(*) as missing_ratio from events group by 1),
    s as (select 'events' as dataset, checked_at, completeness, accuracy, consistency, validity, completeness * 0.3 + accuracy * 0.3 + consistency * 0.2 + validity * 0.2 as overall_score, missing_ratio, (row_number() over (order by checked_at) - 1)::double as i from d)
"""


def snapshots(t: Tables):
    n = F.count(F.lit(1))
    daily = t.events.groupBy(F.to_date("ts").alias("checked_at")).agg(
        (F.count_if(F.col("value") >= 20) / n).alias("completeness"),
        (F.count_distinct("user_id") / n).alias("accuracy"),
        (F.count_if(F.col("event_type") != "error") / n).alias("consistency"),
        (F.count_if(F.col("value") < 80) / n).alias("validity"),
        (1 - F.count_if(F.col("value") >= 20) / n).alias("missing_ratio"),
    )
    score = sum((F.col(k) * w for k, w in quality.OVERALL_WEIGHTS.items()), F.lit(0.0))
    return daily.select(F.lit("events").alias("dataset"), "*", score.alias("overall_score"))


@query(
    "quality_snapshot_trend",
    _SNAPS + """, w as (select *, count(*) over b as k, regr_slope(overall_score, i) over b as sl from s window b as (order by checked_at rows between 3 preceding and 1 preceding)), x as (select *, case when k >= 2 then coalesce(sl, 0) else 0 end as slope from w)
    select dataset, checked_at, round(overall_score, 6) as overall_score, case when slope > 0.01 then 'improving' when slope < -0.01 then 'declining' else 'stable' end as direction,
    round(case when abs(slope) > 0.01 then greatest(-1, least(1, slope * 10)) else 0 end, 6) as trend_score from x""",
)
def _(t: Tables):
    return rounded(trends.snapshot_trend(snapshots(t)))


_SLOPE = "(regr_slope(completeness, i) + regr_slope(accuracy, i) + regr_slope(consistency, i) + regr_slope(validity, i) + regr_slope(overall_score, i)) / 5"


@query(
    "quality_overall_trend",
    _SNAPS + f""", r as (select dataset, checked_at, completeness, accuracy, consistency, validity, overall_score, (row_number() over (order by checked_at) - 1)::double as i from s where checked_at >= date '2024-01-10'), g as (select dataset, count(*) as snapshots, {_SLOPE} as sl from r group by 1)
    select dataset, snapshots, case when sl > 0.01 then 'improving' when sl < -0.01 then 'declining' else 'stable' end as direction, round(case when abs(sl) > 0.01 then greatest(-1, least(1, sl * 10)) else 0 end, 6) as trend_strength from g""",
)
def _(t: Tables):
    return rounded(trends.overall_trend(snapshots(t), F.lit("2024-01-10").cast("date")))


def quad_sql(rows: str, keys: str = "") -> str:
    """Quadratic least squares over (keys, i, y) by centred normal equations."""
    lead = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    using = f"using ({keys})" if keys else "on true"
    return f"""
      (select {lead}n, a2, a1 - 2 * a2 * mid as c1, a0 - a1 * mid + a2 * mid * mid as c0, (a1 * suv + a2 * (suuv - su2 / n * sv)) / svv as r2 from (
        select {lead}n, mid, sv, suv, suuv, su2, su4, svv, (suuv - su2 * sv / n) / (su4 - su2 * su2 / n) as a2, suv / su2 as a1, (sv - (suuv - su2 * sv / n) / (su4 - su2 * su2 / n) * su2) / n as a0 from (
          select {lead}count(*) as n, any_value(mid) as mid, sum(y) as sv, sum((i - mid) * y) as suv, sum((i - mid) ** 2 * y) as suuv, sum((i - mid) ** 2) as su2, sum((i - mid) ** 4) as su4, regr_syy(y, i) as svv
          from {rows} r join (select {lead}(count(*) - 1) / 2.0::double as mid from {rows} {group}) m {using} {group})))
    """


@query(
    "quality_forecast",
    _SNAPS + ", u as (" + " union all ".join(f"select '{m}' as metric, i, {m} as y from s" for m in trends.METRICS) + "), f as (select * from " + quad_sql("u", "metric") + """)
    select 'events' as dataset, metric, step::int as step, round(greatest(0, least(1, c0 + c1 * (n - 1 + step) + a2 * (n - 1 + step) ** 2)), 6) as predicted from f, range(1, 8) t(step)""",
)
def _(t: Tables):
    return rounded(trends.forecast(snapshots(t)))


@query(
    "quality_trend_alerts",
    _SNAPS + """, l as (select *, row_number() over (order by checked_at desc) as r from s), f as (select *, overall_score - lag(overall_score) over (order by checked_at) as ch from l where r <= 5),
    g as (select count(*) as n, max(ch) filter (where r = 1) as lc, max(ch) as mc, count(*) filter (where overall_score < 0.8) as low from f)
    select 'events' as dataset, 'sharp_drop' as alert from g where lc < -0.1 union all select 'events', 'steady_decline' from g where n >= 3 and mc < 0 union all select 'events', 'lasting_low' from g where low >= 3""",
)
def _(t: Tables):
    return trends.trend_alerts(snapshots(t))


@query("quality_dashboard", _SNAPS + "select dataset, count(*) as snapshots, round(arg_max(overall_score, checked_at), 6) as latest, max(checked_at) as latest_at, round(avg(overall_score), 6) as mean, round(max(overall_score), 6) as best, round(min(overall_score), 6) as worst from s group by 1")
def _(t: Tables):
    return rounded(trends.dashboard(snapshots(t)))


@query(
    "quality_trend_advice",
    _SNAPS + ", z as (select * from s order by checked_at desc limit 1), m as (" + " union all ".join(f"select '{m}' as metric, {m} as value from z" for m in trends.METRICS) + ") select 'events' as dataset, metric, round(value, 6) as value from m where value < 0.8",
)
def _(t: Tables):
    return rounded(trends.trend_advice(snapshots(t)))


_ALERTS = _SNAPS + ", m as (" + " union all ".join(f"select checked_at, '{m}' as metric, {m} as value from s" for m in [*trends.METRICS, "missing_ratio"]) + ")"


@query(
    "quality_threshold_alerts",
    _ALERTS + """select dataset, checked_at, metric, round(value, 6) as value, op, round("limit", 6) as "limit" from (select 'events' as dataset, checked_at, metric, value, case when metric = 'missing_ratio' then 'gt' else 'lt' end as op, case when metric = 'missing_ratio' then 0.5 else 0.8 end::double as "limit" from m)
    where (op = 'lt' and value < "limit") or (op = 'gt' and value > "limit")""",
)
def _(t: Tables):
    rows = quality.metric_rows(snapshots(t), ["dataset", "checked_at"], [*trends.METRICS, "missing_ratio"])
    return rounded(quality.threshold_alerts(rows))


_LIMITS = """, l as (select event_type as metric, case when event_type in ('click', 'view') then 'gte' else 'lt' end as op, avg(value) as "limit" from events group by 1), v as (select cast(ts as date) as checked_at, event_type as metric, avg(value) as value from events group by 1, 2)"""


@query(
    "quality_table_thresholds",
    "with x as (select 1)" + _LIMITS + """select metric, checked_at, round(value, 6) as value, op, round("limit", 6) as "limit" from v join l using (metric) where (op = 'gte' and value >= "limit") or (op = 'lt' and value < "limit")""",
)
def _(t: Tables):
    limits = t.events.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("limit")).select(
        "metric", F.when(F.col("metric").isin("click", "view"), "gte").otherwise("lt").alias("op"), "limit"
    )
    rows = t.events.groupBy(F.to_date("ts").alias("checked_at"), F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return rounded(quality.threshold_alerts(rows, limits))


_ALERT_LOG = "(select event_id as alert_id, ts as checked_at, case when value > 150 then 'high' else 'low' end as severity, event_id % 5 = 0 as acknowledged from events where event_type = 'error')"


def _alert_log(t: Tables):
    return t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("alert_id"), F.col("ts").alias("checked_at"),
        F.when(F.col("value") > 150, "high").otherwise("low").alias("severity"), (F.col("event_id") % 5 == 0).alias("acknowledged"),
    )


@query("find_alerts", f"select * from {_ALERT_LOG} where severity = 'high' and not acknowledged and checked_at >= timestamp '2024-01-29 12:00:00' - interval 48 hours order by checked_at desc, alert_id")
def _(t: Tables):
    now = F.lit("2024-01-29 12:00:00").cast("timestamp_ntz")
    return quality.find_alerts(_alert_log(t), now, "high", False, 48)


@query("acknowledge_alerts", f"select alert_id, checked_at, severity, acknowledged or alert_id % 3 = 0 as acknowledged from {_ALERT_LOG}")
def _(t: Tables):
    log = _alert_log(t)
    return quality.acknowledge(log, log.filter("alert_id % 3 = 0"))


# --- cleaning ---------------------------------------------------------------------------------


@query("clean_missing_rows", f"select l_orderkey, l_linenumber, l_discount, l_returnflag from {GAPPY} where ((l_discount is null)::int + (l_returnflag is null)::int) / 4 <= 0.25")
def _(t: Tables):
    return cleaning.remove_missing_rows(gappy(t).drop("l_quantity"), 0.25)


@query("clean_missing_columns", f"select l_orderkey, l_linenumber, l_quantity, l_discount from {GAPPY}")
def _(t: Tables):
    return cleaning.remove_missing_columns(gappy(t), 0.3)


def _impute_sql(fill):
    return f"select l_orderkey, l_linenumber, round(coalesce(l_discount, (select {fill} from {GAPPY})), 6) as l_discount from {GAPPY}"


@query("impute_mean", _impute_sql("avg(l_discount)"))
def _(t: Tables):
    return rounded(cleaning.impute(gappy(t).select("l_orderkey", "l_linenumber", "l_discount"), "mean", ["l_discount"]))


@query("impute_median", _impute_sql("quantile_cont(l_discount, 0.5)"))
def _(t: Tables):
    return rounded(cleaning.impute(gappy(t).select("l_orderkey", "l_linenumber", "l_discount"), "median", ["l_discount"]))


@query(
    "impute_mode",
    f"select l_orderkey, l_linenumber, coalesce(l_returnflag, (select v from (select l_returnflag as v, count(*) as n from {GAPPY} where l_returnflag is not null group by 1 order by n desc, v limit 1))) as l_returnflag from {GAPPY}",
)
def _(t: Tables):
    return cleaning.impute(gappy(t).select("l_orderkey", "l_linenumber", "l_returnflag"), "mode", ["l_returnflag"])


@query(
    "remove_outliers_iqr",
    """with a as (select event_id, value, cast(json_extract_string(props, '$.k') as bigint) as k from events), b as (select a.* from a, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from a) where value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))
    select b.* from b, (select quantile_cont(k, 0.25) as q1, quantile_cont(k, 0.75) as q3 from b) where k between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)""",
)
def _(t: Tables):
    df = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return cleaning.remove_outliers(df, "iqr", ["value", "k"])


@query(
    "remove_outliers_zscore",
    "select event_id, value from events, (select avg(value) as m, stddev_samp(value) as s from events) where abs((value - m) / s) < 3",
)
def _(t: Tables):
    return cleaning.remove_outliers(t.events.select("event_id", "value"), "zscore", ["value"])


@query("standardise", "select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice from orders, (select avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from orders)")
def _(t: Tables):
    return rounded(cleaning.standardise(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("min_max_scale", "select o_orderkey, round((o_totalprice - m) / (s - m), 6) as o_totalprice from orders, (select min(o_totalprice) as m, max(o_totalprice) as s from orders)")
def _(t: Tables):
    return rounded(cleaning.standardise(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], "minmax"))


@query(
    "encode_labels",
    f"select l_orderkey, l_linenumber, dense_rank() over (order by coalesce(l_returnflag, 'None')) - 1 as l_returnflag from {GAPPY}",
)
def _(t: Tables):
    return cleaning.encode_labels(gappy(t).select("l_orderkey", "l_linenumber", "l_returnflag"))


@query(
    "encode_onehot",
    "select o_orderkey, (o_orderstatus = 'F')::int as o_orderstatus_F, (o_orderstatus = 'O')::int as o_orderstatus_O, (o_orderstatus = 'P')::int as o_orderstatus_P from orders",
)
def _(t: Tables):
    return cleaning.encode_onehot(t.orders.select("o_orderkey", "o_orderstatus"))


@query(
    "cleaning_report",
    f"""with a as (select l_linenumber, l_discount, l_returnflag from {GAPPY}), b as (select distinct * from a), c as (select * from b where ((l_discount is null)::int + (l_returnflag is null)::int) / 3 <= 0.5),
    r as (select 0 as step_no, 'input' as step, count(*) as row_count, 1 - ((count(*) - count(l_discount)) + (count(*) - count(l_returnflag))) / (3 * count(*)) - (count(*) - (select count(*) from b)) / count(*) as q from a
    union all select 1, 'remove_duplicates', count(*), 1 - ((count(*) - count(l_discount)) + (count(*) - count(l_returnflag))) / (3 * count(*)) from b
    union all select 2, 'remove_missing_rows', count(*), 1 - ((count(*) - count(l_discount)) + (count(*) - count(l_returnflag))) / (3 * count(*)) from c)
    select step_no, step, row_count, 3 as column_count, round(greatest(0, least(1, q)), 6) as quality from r""",
)
def _(t: Tables):
    cleaner = cleaning.Cleaner.configured([{"name": "remove_duplicates"}, {"name": "remove_missing_rows", "parameters": {"threshold": 0.5}}])
    return rounded(cleaner.report(gappy(t).select("l_linenumber", "l_discount", "l_returnflag")))


@query(
    "encode_onehot_long",
    "select p_partkey, 'p_name_' || p_name as feature, 1 as value from part where p_name is not null union all select p_partkey, 'p_brand_' || p_brand, 1 from part where p_brand is not null",
)
def _(t: Tables):
    return cleaning.encode_onehot_long(t.part, "p_partkey", ["p_name", "p_brand"])


@query("cleaning_default")
def _(t: Tables):
    return cleaning.Cleaner.default().clean(gappy(t).drop("l_orderkey"))
