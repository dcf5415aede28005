"""Queries for the data behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import charts
from tablewright.plans.queries_stats import LINE, _SHAPE, describe_sql, histogram_sql, rounded
from tablewright.plans.registry import Tables, query


@query("chart_bar_counts", "select o_orderpriority, count(*)::double as value from orders group by 1")
def _(t: Tables):
    return charts.bar(t.orders, "o_orderpriority")


@query("chart_bar_sums", "select o_orderpriority, round(sum(o_totalprice), 2) as value from orders group by 1")
def _(t: Tables):
    return rounded(charts.bar(t.orders, "o_orderpriority", "o_totalprice"), 2)


@query("chart_line", "select event_type, ts, value from events order by 1, 2")
def _(t: Tables):
    return charts.line(t.events, "ts", ["value"], "event_type")


@query("chart_scatter", "select l_quantity, l_extendedprice, l_returnflag from lineitem")
def _(t: Tables):
    return charts.scatter(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


def _grid(x, y, table, bins, extra=""):
    b = lambda c: f"least(floor(({c} - min({c}) over ()) / ((max({c}) over () - min({c}) over ()) / {bins})), {bins - 1})::int"
    return f"select {b(x)} as x_bin, {b(y)} as y_bin{extra} from {table}"


@query("chart_density_grid", f"select x_bin, y_bin, count(*) as n from ({_grid('l_quantity', 'l_extendedprice', 'lineitem', 20)}) group by 1, 2")
def _(t: Tables):
    return charts.density_grid(t.lineitem, "l_quantity", "l_extendedprice", 20)


_MATRIX = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query(
    "chart_scatter_matrix",
    " union all ".join(f"select '{a}' as x, '{b}' as y, x_bin, y_bin, count(*) as n from ({_grid(a, b, 'lineitem', 10)}) group by 3, 4" for a, b in _MATRIX),
)
def _(t: Tables):
    return charts.scatter_matrix(t.lineitem, LINE, 10)


@query("chart_histogram", histogram_sql("o_totalprice", "orders", 20))
def _(t: Tables):
    return rounded(charts.histogram(t.orders, "o_totalprice", 20))


@query(
    "chart_histogram_hue",
    """with b as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 10 as w from orders), k as (select o_orderstatus, least(floor((o_totalprice - lo) / w), 9)::int as bin, count(*) as n from orders, b group by 1, 2)
    select g.o_orderstatus, 'o_totalprice' as "column", i::int as bin, round(lo + w * i, 6) as bin_start, round(lo + w * (i + 1), 6) as bin_end, coalesce(n, 0) as count
    from b, (select distinct o_orderstatus from orders) g cross join range(10) r(i) left join k on k.bin = i and k.o_orderstatus = g.o_orderstatus""",
)
def _(t: Tables):
    return rounded(charts.histogram(t.orders, "o_totalprice", 10, "o_orderstatus"))


def _box_sql(keys, value, table):
    lead = f"t.{keys}, " if keys else ""
    group = f"group by t.{keys}" if keys else ""
    join = f"join q on t.{keys} is not distinct from q.{keys}" if keys else ", q"
    return f"""with q as (select {lead}quantile_cont({value}, 0.25) as q1, quantile_cont({value}, 0.5) as md, quantile_cont({value}, 0.75) as q3 from {table} t {group})
    select {lead}count(*) as n, round(any_value(q1), 4) as q1, round(any_value(md), 4) as median, round(any_value(q3), 4) as q3,
      min({value}) filter (where {value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_low, max({value}) filter (where {value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_high,
      count(*) filter (where not ({value} between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as fliers from {table} t {join} {group}"""


@query("chart_box", _box_sql("", "value", "events"))
def _(t: Tables):
    return charts.box(t.events, "value").withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("chart_box_groups", _box_sql("event_type", "value", "events"))
def _(t: Tables):
    return charts.box(t.events, "value", ["event_type"]).withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    "chart_box_fliers",
    """
    with q as (select event_type, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events group by 1)
    select e.event_type, e.value from events e join q on e.event_type is not distinct from q.event_type where e.value < q1 - 1.5 * (q3 - q1) or e.value > q3 + 1.5 * (q3 - q1)
    """,
)
def _(t: Tables):
    return charts.box_fliers(t.events, "value", ["event_type"])


# Half of the labels' hue is null: documents without a label.
_NULL_HUE = "(select d.n_chars::double as n_chars, l.quality as hue from documents d left join labels l on d.doc_id = l.doc_id)"


@query("chart_box_null_group", _box_sql("hue", "n_chars", _NULL_HUE))
def _(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left").select("n_chars", F.col("quality").alias("hue"))
    return charts.box(d, "n_chars", ["hue"]).withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    "chart_heatmap",
    " union all ".join(f"select '{a}' as row, '{b}' as \"column\", round(corr({a}, {b}), 6) as r from lineitem" if a != b else f"select '{a}' as row, '{a}' as \"column\", 1.0::double as r" for a in LINE for b in LINE),
)
def _(t: Tables):
    return rounded(charts.heatmap(t.lineitem, LINE))


@query("chart_pivot_heatmap", "select l_linestatus, l_returnflag, round(avg(l_extendedprice), 4) as mean from lineitem group by 1, 2")
def _(t: Tables):
    return rounded(charts.pivot_heatmap(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice"), 4)


@query(
    "chart_pivot_table",
    "select l_linestatus, " + ", ".join(f"round(avg(l_extendedprice) filter (where l_returnflag = '{f}'), 4) as {f}" for f in "ANR") + " from lineitem group by 1",
)
def _(t: Tables):
    return rounded(charts.pivot_table(t.lineitem, "l_returnflag", "l_linestatus", "l_extendedprice", ["A", "N", "R"]), 4)


@query("chart_pie", "select c_mktsegment, round(sum(c_acctbal), 2) as value, round(sum(c_acctbal) * 100 / (select sum(c_acctbal) from customer), 4) as percent from customer group by 1")
def _(t: Tables):
    out = charts.pie(t.customer, "c_mktsegment", "c_acctbal")
    return out.withColumns({"value": F.round("value", 2), "percent": F.round("percent", 4)})


@query("chart_grouped_bar", "select o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) as mean from orders group by 1, 2")
def _(t: Tables):
    return rounded(charts.grouped_bar(t.orders, "o_orderpriority", "o_totalprice", "o_orderstatus"), 4)


@query(
    "chart_density",
    """with b as (select count(value) as n, stddev_samp(value) as s, min(value) as lo, max(value) as hi from events),
    g as (select i, lo + (hi - lo) * i / 49 as x, s * n ** -0.2::double as bw, n from b, range(50) r(i))
    select i::int as i, round(any_value(x), 6) as x, round(sum(exp(-0.5::double * power((x - value) / bw, 2))) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 8) as density from g, events where value is not null group by i""",
)
def _(t: Tables):
    out = charts.density(t.events, "value", 50)
    return out.select("i", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("chart_qq")
def _(t: Tables):
    return charts.qq(t.orders, "o_totalprice", 100)


@query(
    "chart_qq_sample",
    "select i::int as i, round((i + 0.5) / 100.0, 6)::double as probability, round(quantile_cont(o_totalprice, [" + ", ".join(str((i + 0.5) / 100) for i in range(100)) + "])[i + 1], 6) as sample from orders, range(100) r(i) group by i",
)
def _(t: Tables):
    out = charts.qq(t.orders, "o_totalprice", 100).drop("theoretical")
    return out.select("i", F.round("probability", 6).alias("probability"), F.round("sample", 6).alias("sample"))


@query("chart_ecdf", "select value, n, round((sum(n) over (order by value)) / (sum(n) over ()), 9) as ecdf from (select value, count(*) as n from events group by 1)")
def _(t: Tables):
    return rounded(charts.ecdf(t.events, "value"), 9)


@query("chart_time_series", "select ts, 'value' as series, value from events union all select ts, 'k', cast(json_extract_string(props, '$.k') as double) from events")
def _(t: Tables):
    df = t.events.select("ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return charts.multi_series(df, "ts", ["value", "k"])


@query(
    "chart_statistics",
    f"""with d as ({describe_sql(['l_quantity', 'l_discount'], 'lineitem')}), s as ({' union all '.join(_SHAPE.format(c=c, t='lineitem') for c in ['l_quantity', 'l_discount'])})
    select "column", mean, std, q25, q50, q75, round(skewness, 4) as skewness, round(kurtosis, 4) as kurtosis from d join s using ("column")""",
)
def _(t: Tables):
    return rounded(charts.plot_statistics(t.lineitem, ["l_quantity", "l_discount"]), 4)


@query("chart_board", "select 'statuses' as chart, count(*) as rows from (select distinct o_orderstatus from orders) union all select 'priorities', count(*) from (select distinct o_orderpriority from orders)")
def _(t: Tables):
    board = charts.chart_board(
        t.orders, [{"kind": "bar", "x": "o_orderstatus", "title": "statuses"}, {"kind": "pie", "category": "o_orderpriority", "title": "priorities"}]
    )
    return board.groupBy("chart").agg(F.count(F.lit(1)).alias("rows"))


@query("chart_dashboard", _box_sql("", "o_totalprice", "orders"))
def _(t: Tables):
    box = charts.dashboard(t.orders.select("o_totalprice", "o_orderstatus"))["box"]
    return box.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})
