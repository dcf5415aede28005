"""Queries over time series: daily event totals and per-type daily means."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import breaks
from tablewright.operators import timeseries as ts
from tablewright.plans.queries_quality import quad_sql
from tablewright.plans.queries_stats import rounded
from tablewright.plans.queries_tests import tested
from tablewright.plans.registry import Tables, query

DAILY = "with d as (select date_trunc('day', ts)::timestamp as t, sum(value) as y from events group by 1), s as (select t, y, row_number() over (order by t) - 1 as idx from d)"
TYPED = "with d as (select event_type, date_trunc('day', ts)::timestamp as t, avg(value) as y from events group by 1, 2), s as (select event_type, t, y, row_number() over (partition by event_type order by t) - 1 as idx from d)"


def daily(t: Tables):
    return ts.series(t.events.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("value").alias("v")), "day", "v")


def typed(t: Tables):
    rows = t.events.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.avg("value").alias("v"))
    return ts.series(rows, "day", "v", ["event_type"])


def _decompose_sql(head, by, period, model):
    part = f"partition by {by} " if by else ""
    half = period // 2
    if period % 2:
        trend = f"case when count(*) over w = {period} then avg(y) over w end"
        window = f"window w as ({part}order by idx rows between {half} preceding and {half} following)"
    else:
        trend = f"(sum(y) over w + (lag(y, {half}) over v + lead(y, {half}) over v) / 2) / {period}"
        window = f"window w as ({part}order by idx rows between {half - 1} preceding and {half - 1} following), v as ({part}order by idx)"
    gap = "y - trend" if model == "additive" else "y / trend"
    lead = f"{by}, " if by else ""
    join = f"using ({by}, phase) join (select {by}, avg(m) as c from m group by {by}) c using ({by})" if by else "using (phase), (select avg(m) as c from m) c"
    seasonal = "m - c" if model == "additive" else "m / c"
    rest = "y - seasonal - trend" if model == "additive" else "y / (seasonal * trend)"
    return head + f""", r as (select *, idx % {period} as phase, {trend} as trend from s {window}), m as (select {lead}phase, avg({gap}) as m from r group by {lead}phase),
    x as (select {lead}t, y, idx, phase, trend, {seasonal} as seasonal from r join m {join}), dec as (select *, {rest} as residual from x)"""


_COLS = "t, round(y, 4) as y, idx, phase, round(trend, 4) as trend, round(seasonal, 4) as seasonal, round(residual, 4) as residual"


@query("decompose_additive", _decompose_sql(DAILY, "", 7, "additive") + f"select {_COLS} from dec")
def _(t: Tables):
    return rounded(ts.decompose(daily(t), 7), 4)


@query("decompose_multiplicative", _decompose_sql(DAILY, "", 6, "multiplicative") + f"select {_COLS} from dec")
def _(t: Tables):
    return rounded(ts.decompose(daily(t), 6, "multiplicative"), 4)


@query("decompose_many", _decompose_sql(TYPED, "event_type", 7, "additive") + f"select event_type, {_COLS} from dec")
def _(t: Tables):
    return rounded(ts.decompose(typed(t), 7, by=["event_type"]), 4)


@query(
    "decomposition_strength",
    _decompose_sql(TYPED, "event_type", 7, "additive") + "select event_type, count(*) as n, round(greatest(0, 1 - var_samp(y - trend) / var_samp(y)), 6) as trend_strength, round(greatest(0, 1 - var_samp(y - seasonal) / var_samp(y)), 6) as seasonal_strength, round(least(1, var_samp(residual) / var_samp(y)), 6) as residual_strength from dec group by 1",
)
def _(t: Tables):
    return rounded(ts.decomposition_strength(ts.decompose(typed(t), 7, by=["event_type"]), ["event_type"]))


@query(
    "trend_linear",
    TYPED + "select event_type, count(*) as n, round(regr_slope(y, idx), 6) as slope, round(regr_intercept(y, idx), 6) as intercept, round(regr_r2(y, idx), 6) as r2, round(sqrt((1 - regr_r2(y, idx)) * regr_syy(y, idx) / regr_sxx(y, idx) / (count(*) - 2)), 6) as std_err, case when regr_slope(y, idx) > 0 then 'up' when regr_slope(y, idx) < 0 then 'down' else 'flat' end as direction from s group by 1",
)
def _(t: Tables):
    return rounded(ts.linear_trend(typed(t), ["event_type"]).drop("sxx", "syy", "mean_x"))


@query("trend_line", DAILY + "select t, idx, round(sl * idx + ic, 4) as trend from s, (select regr_slope(y, idx) as sl, regr_intercept(y, idx) as ic from s)")
def _(t: Tables):
    s = daily(t)
    return rounded(ts.trend_line(s, ts.linear_trend(s)), 4)


_SLOPES = TYPED + ", f as (select event_type, count(*) as n, regr_slope(y, idx) as slope, regr_r2(y, idx) as r2, (count(*) - 2)::double as df from s group by 1) select event_type, n, round(slope, 6) as slope, sign(slope) * sqrt(r2 * df / (1 - r2)) as statistic, df from f"


@query(
    "trend_significance",
    f"select event_type, n, slope, p_value, case when p_value < 0.05 then case when slope > 0 then 'up' else 'down' end else 'flat' end as trend from ({tested(_SLOPES, 't')})",
)
def _(t: Tables):
    return rounded(ts.trend_significance(ts.linear_trend(typed(t), ["event_type"])).select("event_type", "n", "slope", "p_value", "trend"))


@query("trend_polynomial", TYPED + ", z as (select event_type, idx::double as i, y from s) select event_type, n, round(c0, 6) as c0, round(c1, 6) as c1, round(a2, 6) as c2, round(r2, 6) as r2 from " + quad_sql("z", "event_type"))
def _(t: Tables):
    return rounded(ts.quadratic_fit(typed(t), "idx", "y", ["event_type"]))


@query(
    "trend_moving_average",
    DAILY + """, n as (select count(*) as n, greatest(2, least(7, count(*) // 4))::int as w from s), a as (select idx, n, w, case when count(*) over f = 7 then avg(y) over f end as a from s, n window f as (order by idx rows between 3 preceding and 3 following))
    select any_value(n) as n, any_value(w) as window, round(avg(a) filter (where idx < n // 2), 4) as first_half, round(avg(a) filter (where idx >= n // 2), 4) as second_half,
    case when avg(a) filter (where idx >= n // 2) > avg(a) filter (where idx < n // 2) then 'up' else 'down' end as direction from a""",
)
def _(t: Tables):
    return rounded(ts.moving_average_trend(daily(t)), 4)


@query("moving_average", DAILY + "select t, round(y, 4) as y, idx, round(case when count(*) over f = 4 then avg(y) over f end, 4) as average from s window f as (order by idx rows between 2 preceding and 1 following)")
def _(t: Tables):
    return rounded(ts.moving_average(daily(t), 4), 4)


_ACF = ", c as (select {by} y - avg(y) over (partition by {part}) as y, idx, count(*) over (partition by {part}) as n from s), k as (select unnest(range(13))::int as lag), a as (select {out} k.lag, sum(c.y * l.y) / any_value(v.v) as acf, any_value(c.n) as n from k, c join c l on {on} l.idx = c.idx - k.lag join (select {by} sum(y * y) as v from c group by {grp}) v on {von} group by {out} k.lag)"
_ACF_ONE = _ACF.format(by="", part="1", out="", on="", grp="()", von="true")
_ACF_MANY = _ACF.format(by="event_type,", part="event_type", out="c.event_type,", on="l.event_type = c.event_type and", grp="event_type", von="v.event_type = c.event_type")


@query("autocorrelation", DAILY + _ACF_ONE + "select lag, round(acf, 6) as acf from a where lag <= n // 2")
def _(t: Tables):
    return rounded(ts.autocorrelation(daily(t)))


@query(
    "seasonal_period",
    TYPED + _ACF_MANY + """, p as (select *, lag(acf) over w as l, lead(acf) over w as r from a where lag <= n // 2 window w as (partition by event_type order by lag))
    select event_type, coalesce(arg_max(lag, acf) filter (where acf > l and acf > r), 1)::int as period from p group by 1""",
)
def _(t: Tables):
    return ts.seasonal_period(typed(t), by=["event_type"])


@query(
    "seasonal_strength",
    TYPED + ", m as (select event_type, idx % 7 as phase, avg(y) as m from s group by 1, 2), g as (select event_type, stddev_pop(m) as sd, avg(abs(m)) as sz from m group by 1) select event_type, 7 as period, round(sd, 6) as std, round(sd / sz, 6) as strength, case when sd > sz * 0.2 then 'strong' when sd > sz * 0.1 then 'moderate' else 'weak' end as pattern from g",
)
def _(t: Tables):
    return rounded(ts.seasonal_strength(typed(t), 7, ["event_type"]))


@query(
    "dominant_period",
    DAILY + """, n as (select count(*) as n from s), f as (select k, sqrt(sum(y * cos(2 * pi() * k * idx / n)) ** 2 + sum(y * sin(2 * pi() * k * idx / n)) ** 2) as a from s, n, range((select n // 2 from n)::bigint) r(k) group by k),
    b as (select k, a from f where k > 0 order by a desc, k limit 1) select n.n, round(b.k / n.n, 6) as frequency, round(n.n / b.k, 6) as period, round(b.a / (select avg(a) from f), 4) as strength, b.a > (select avg(a) from f) as is_seasonal from b, n""",
)
def _(t: Tables):
    out = rounded(ts.dominant_period(daily(t)))
    return out.withColumn("strength", F.round("strength", 4))


@query(
    "forecast_linear",
    TYPED + """, f as (select event_type, count(*) as n, regr_slope(y, idx) as sl, regr_intercept(y, idx) as ic, regr_sxx(y, idx) as sxx, avg(idx) as mx, sqrt((1 - regr_r2(y, idx)) * regr_syy(y, idx) / regr_sxx(y, idx) / (count(*) - 2)) as se from s group by 1),
    p as (select event_type, step::int as step, sl * (n - 1 + step) + ic as v, se * sqrt(1 + 1 / n + (n - 1 + step - mx) ** 2 / sxx) as e from f, range(1, 8) r(step))
    select event_type, step, round(v, 6) as forecast, round(v - 1.96 * e, 6) as lower, round(v + 1.96 * e, 6) as upper from p""",
)
def _(t: Tables):
    return rounded(ts.linear_forecast(typed(t), 7, ["event_type"]))


@query(
    "forecast_exponential",
    TYPED + ", f as (select event_type, count(*) as n, regr_slope(ln(y + 1), idx) as sl, regr_intercept(ln(y + 1), idx) as ic, regr_r2(ln(y + 1), idx) as r2 from s group by 1) select event_type, step::int as step, round(exp(sl * (n - 1 + step) + ic) - 1, 6) as forecast, round(r2, 6) as r2 from f, range(1, 8) r(step)",
)
def _(t: Tables):
    return rounded(ts.exponential_forecast(typed(t), 7, ["event_type"]))


@query("forecast_arima")
def _(t: Tables):
    return ts.arima(typed(t), 1, 1, 1, 7, ["event_type"])


@query(
    "forecast_autoregressive",
    TYPED + """, z as (select event_type, idx, y - lag(y) over w as z, y from s window w as (partition by event_type order by idx)), l as (select *, lag(z) over (partition by event_type order by idx) as l from z),
    f as (select event_type, count(*) as n, regr_slope(z, l) as phi, regr_intercept(z, l) as c, sqrt((regr_syy(z, l) - regr_sxy(z, l) ** 2 / regr_sxx(z, l)) / count(*)) as rmse, arg_max(z, idx) as z, arg_max(y, idx) as y from l where l is not null group by 1),
    a as (select event_type, n, c, phi, rmse, [y + c + phi * z, c + phi * z] as v from f)
    select event_type, n, round(c, 6) as intercept, round(phi, 6) as coefficient, round(n * (ln(2 * pi() * rmse ** 2) + 1) + 6, 6) as aic, round(rmse, 6) as rmse, round(v[1], 6) as forecast from a""",
)
def _(t: Tables):
    """Without a moving-average part the conditional likelihood is a regression."""
    out = ts.arima(typed(t), 1, 1, 0, 1, ["event_type"])
    return rounded(out.select("event_type", "n", "intercept", F.col("coefficients")[0].alias("coefficient"), "aic", "rmse", "forecast"))


@query("stationarity")
def _(t: Tables):
    return ts.stationarity(typed(t), by=["event_type"])


@query("forecast_seasonal")
def _(t: Tables):
    return ts.seasonal_regression(typed(t), 14, ["event_type"])


@query("forecast_breaks")
def _(t: Tables):
    return breaks.forecast(t.orders.select("o_orderstatus", F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("y")), 14, ["o_orderstatus"])


@query("forecast_breaks_optimum", "select o_orderstatus, count(*) as n, 0::bigint as violated from orders group by 1")
def _(t: Tables):
    """The fit of every series meets the conditions of the optimum, counted over all its rows."""
    return breaks.optimality(t.orders.select("o_orderstatus", F.col("o_orderdate").alias("t"), F.col("o_totalprice").alias("y")), ["o_orderstatus"])


@query("series_anomalies_zscore", "select event_id, value from events, (select avg(value) as m, stddev_pop(value) as s from events) where abs((value - m) / s) > 3")
def _(t: Tables):
    s = t.events.select("event_id", F.col("value").alias("y"))
    return ts.anomalies(s, "zscore", 3.0).select("event_id", F.col("y").alias("value"))


@query("series_anomalies_forest")
def _(t: Tables):
    s = t.events.select("event_id", F.col("value").alias("y"))
    return ts.anomalies(s, "isolation_forest", 0.05).select("event_id", F.col("y").alias("value"))


@query("series_anomalies_iqr", "select event_id, value from events, (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)")
def _(t: Tables):
    s = t.events.select("event_id", F.col("value").alias("y"))
    return ts.anomalies(s, "iqr").select("event_id", F.col("y").alias("value"))
