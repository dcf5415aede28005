"""Queries over windows, cooldowns, batch functions and the one-call analysis."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tablewright.operators import stats
from tablewright.plans import analyze
from tablewright.plans.queries_stats import _column_sql, rounded, summary_sql
from tablewright.plans.registry import Tables, query
from tablewright.session import fresh_folder
from tablewright.sources import sinks
from tablewright.streaming import chunks, events, expiring

# --- batch functions ---------------------------------------------------------------------


def _net(batch: pa.RecordBatch) -> pa.RecordBatch:
    net = pc.multiply(batch.column("l_extendedprice"), pc.subtract(1.0, batch.column("l_discount")))
    return pa.RecordBatch.from_arrays([batch.column("l_orderkey"), net], ["l_orderkey", "net"])


@query("map_batches", "select l_orderkey, l_extendedprice * (1 - l_discount) as net from lineitem")
def _(t: Tables):
    return chunks.map_batches(t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount"), _net, "l_orderkey long, net double")


def _tagged(frame, name):
    frame.columns = ["id", "balance"]
    frame["source"] = name
    return frame[["source", "id", "balance"]]


@query("map_sources", "select 'customer' as source, c_custkey as id, c_acctbal as balance from customer union all select 'supplier', s_suppkey, s_acctbal from supplier")
def _(t: Tables):
    sources = {"customer": t.customer.select("c_custkey", "c_acctbal"), "supplier": t.supplier.select("s_suppkey", "s_acctbal")}
    return chunks.map_sources(sources, _tagged, "source string, id long, balance double")


def _partial(frame):
    return frame.groupby("l_returnflag", as_index=False).agg(n=("l_quantity", "size"), total=("l_quantity", "sum"), top=("l_quantity", "max"))


@query("merge_batches", "select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as total, max(l_quantity) as top from lineitem group by 1")
def _(t: Tables):
    out = chunks.merge_batches(
        t.lineitem.select("l_returnflag", "l_quantity"), _partial, "l_returnflag string, n long, total double, top double",
        ["l_returnflag"], {"n": F.sum, "total": F.sum, "top": F.max},
    )
    return rounded(out, 2)


# --- windows ----------------------------------------------------------------------------------


def stamped(t: Tables):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


_TUMBLING = (
    "select time_bucket(interval '6 hours', ts, timestamp '2024-01-01 00:00:00') as window_start, time_bucket(interval '6 hours', ts, timestamp '2024-01-01 00:00:00') + interval 6 hours as window_end, event_type, count(*) as n, round(sum(value), 2) as total, min(value) as low, max(value) as high from events group by 1, 2, 3"
)


@query("window_tumbling", _TUMBLING)
def _(t: Tables):
    return _plain(rounded(events.window_counts(stamped(t), "ts", "value", "6 hours", keys=["event_type"]), 2))


def arriving(t: Tables):
    """The event file as a stream."""
    return events.read_stream(t.spark, t.sf_dir, t.events.schema, pattern="events.parquet")


@query("stream_windows", _TUMBLING)
def _(t: Tables):
    # Files may arrive in any order, so the delay spans the whole log and nothing is dropped.
    late = events.late_tolerant(arriving(t), "ts", "40 days")
    counts = events.window_counts(late, "ts", "value", "6 hours", keys=["event_type"])
    done = events.drain(counts, "update", ["window_start", "window_end", "event_type"])
    return _plain(rounded(done, 2))


@query(
    "window_sliding",
    "select w - o * interval 1 hour as window_start, w - o * interval 1 hour + interval 3 hours as window_end, count(*) as n, round(sum(value), 2) as total, min(value) as low, max(value) as high from (select date_trunc('hour', ts)::timestamp as w, value from events), range(3) r(o) group by 1, 2",
)
def _(t: Tables):
    return _plain(rounded(events.window_counts(stamped(t), "ts", "value", "3 hours", "1 hour"), 2))


@query(
    "window_sessions",
    """with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minutes then 1 else 0 end as b from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(b) over (partition by user_id order by ts) as s from g) select min(ts) as session_start, max(ts) + interval 30 minutes as session_end, user_id, count(*) as n from s group by user_id, s""",
)
def _(t: Tables):
    return _plain(events.sessions(stamped(t), "ts", "30 minutes", ["user_id"]))


@query(
    "quality_windows",
    """with d as (select date_trunc('day', ts)::timestamp as window_start, avg((value >= 20)::int) as filled, avg((event_type <> 'error')::int) as success from events group by 1)
    select window_start, 'filled' as metric, round(filled, 6) as value from d union all select window_start, 'success', round(success, 6) from d""",
)
def _(t: Tables):
    checks = {"filled": F.col("value") >= 20, "success": F.col("event_type") != "error"}
    return _plain(rounded(events.quality_windows(stamped(t), "ts", "1 day", checks)))


_COOLDOWN = (
    """with recursive h as (select event_type as rule_id, event_id as alert_id, ts from events where value > 100), o as (select *, row_number() over (partition by rule_id order by ts, alert_id) as i from h),
    n as (select a.rule_id, a.i, a.ts, a.alert_id, (select min(b.i) from o b where b.rule_id = a.rule_id and b.ts >= a.ts + interval 60 minutes) as nx from o a),
    w as (select rule_id, i, ts, alert_id, nx from n where i = 1 union all select n.rule_id, n.i, n.ts, n.alert_id, n.nx from w join n on n.rule_id = w.rule_id and n.i = w.nx)
    select rule_id, ts, alert_id from w"""
)


def _raised(rows):
    return rows.filter("value > 100").select(F.col("event_type").alias("rule_id"), "ts", F.col("event_id").alias("alert_id"))


@query("alert_cooldown", _COOLDOWN)
def _(t: Tables):
    return _plain(events.cooldown_batch(_raised(stamped(t)), 60))


@query("stream_cooldown", _COOLDOWN)
def _(t: Tables):
    return _plain(events.drain(events.cooldown_stream(_raised(arriving(t)), 60)))


def replayed(t: Tables):
    """The event table as a stream of six stretches of its time, three hours late at most."""
    table = t.events
    folder = expiring.replay(table, "ts", 6)
    return events.read_stream(t.spark, folder, table.schema, files_per_trigger=1)


_CLOSED = "(select max(ts) - interval 3 hours as mark from events)"


@query("stream_windows_closed", f"select w.* from ({_TUMBLING}) w, {_CLOSED} where window_end <= mark")
def _(t: Tables):
    late = events.late_tolerant(replayed(t), "ts", "3 hours")
    return _plain(rounded(events.drain(events.window_counts(late, "ts", "value", "6 hours", keys=["event_type"])), 2))


@query(
    "stream_sessions_closed",
    f"""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 30 minutes then 1 else 0 end as b from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(b) over (partition by user_id order by ts) as s from g), e as (select min(ts) as session_start, max(ts) + interval 30 minutes as session_end, user_id, count(*) as n from s group by user_id, s)
    select e.* from e, {_CLOSED} where session_end <= mark""",
)
def _(t: Tables):
    return _plain(events.drain(events.sessions(events.late_tolerant(replayed(t), "ts", "3 hours"), "ts", "30 minutes", ["user_id"])))


@query(
    "stream_cooldown_expiring",
    f"""with recursive mark as (select max(ts) - interval 3 hours as mark from events where value > 100),
    h as (select event_type as rule_id, event_id as alert_id, ts from events, mark where value > 100 and time_bucket(interval 10 minutes, ts, timestamp '2024-01-01 00:00:00') + interval 10 minutes <= mark),
    o as (select *, row_number() over (partition by rule_id order by ts, alert_id) as i from h),
    n as (select a.rule_id, a.i, a.ts, a.alert_id, (select min(b.i) from o b where b.rule_id = a.rule_id and b.ts >= a.ts + interval 60 minutes) as nx from o a),
    w as (select rule_id, i, ts, alert_id, nx from n where i = 1 union all select n.rule_id, n.i, n.ts, n.alert_id, n.nx from w join n on n.rule_id = w.rule_id and n.i = w.nx)
    select rule_id, ts, alert_id from w""",
)
def _(t: Tables):
    return _plain(events.drain(expiring.cooldown_expiring(_raised(replayed(t)), 60, "3 hours")))


@query(
    "stream_quality",
    """with m as (select count(*) as n, 1 - count(*) filter (where value > 150) / (count(*) * 3) as validity from events)
    select 'validity' as metric, round(validity, 6) as value, 'lt' as op, 0.999::double as "limit" from m where validity < 0.999""",
)
def _(t: Tables):
    folder = fresh_folder(t.spark, "alerts")
    rows = arriving(t).select("event_type", "value", "props")
    run = events.monitor(
        rows,
        lambda alerts, epoch: sinks.append_alerts(alerts, folder),
        fresh_folder(t.spark, "progress"),
        [("validity", "lt", 0.999), ("completeness", "lt", 0.9)],
        {"value": {"max": 150}},
    )
    run.awaitTermination()
    found = sinks.load_document(t.spark, folder, "epoch int, metric string, value double, op string, `limit` double")
    return rounded(found.drop("epoch"))


# --- one-call analysis ------------------------------------------------------------------------------


@query("analyze_orders")
def _(t: Tables):
    return analyze.flat_report(t.orders)


@query(
    "analyze_quick",
    " union all ".join(_column_sql(c, "customer", c in ("c_custkey", "c_nationkey", "c_acctbal")) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")),
)
def _(t: Tables):
    return rounded(analyze.analyze(t.customer, "quick")["columns"], 4)


@query("analyze_sources", "select count(*) as row_count from (select c_custkey from customer union all select s_suppkey from supplier)")
def _(t: Tables):
    both = {"customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")), "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))}
    return analyze.analyze(both, "quick")["summary"].select("row_count")


def _profile_sql():
    base = summary_sql("lineitem", ["l_quantity", "l_discount"], 2, 2)
    box = lambda c: f"(select count(*) filter (where {c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a)) / count(*) from lineitem, (select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from lineitem))"
    scores = f"""(select 100.0::double as missing_score, 100 - ({box('l_quantity')} + {box('l_discount')}) / 2 * 100 as outlier_score, (select 1 - (select count(*) from (select distinct l_quantity, l_discount from lineitem)) / count(*) from lineitem) as duplicate_ratio)"""
    parts = " union all ".join(
        f"select 'quality', '*', '{m}', round({e}, 3) from {scores}"
        for m, e in [
            ("missing_score", "missing_score"), ("outlier_score", "outlier_score"), ("consistency_score", "100 - duplicate_ratio * 20"), ("duplicate_ratio", "duplicate_ratio"),
            ("mixed_columns", "0::double"), ("overall_score", "missing_score * 0.4 + outlier_score * 0.3 + (100 - duplicate_ratio * 20) * 0.3"),
        ]
    )
    return f"select * from ({base}) union all {parts}"


@query("profile", _profile_sql())
def _(t: Tables):
    return rounded(analyze.profile(t.lineitem.select("l_quantity", "l_discount")), 3)
