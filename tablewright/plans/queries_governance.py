"""Queries over contracts, catalog, audit, access, lineage and alert rules.

The event log stands in for the audit log; the star schema's keys are the
lineage edges, so both grow with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import governance as g
from tablewright.operators import lineage
from tablewright.plans.registry import Tables, query

CONTRACT = g.Contract(
    "c1",
    "orders",
    "1.0.0",
    [
        g.ContractColumn("o_orderkey", "integer", False),
        g.ContractColumn("o_custkey", "integer", False),
        g.ContractColumn("o_clerk", "string", True),
        g.ContractColumn("o_orderpriority", "integer", True),
        g.ContractColumn("o_totalprice", "float", False),
    ],
    [
        g.Rule("o_custkey", "unique", severity="warning"),
        g.Rule("o_totalprice", "range", {"min": 1000, "max": 200000}),
        g.Rule("o_orderstatus", "pattern", {"pattern": "[FO]$"}),
        g.Rule("o_orderkey", "custom", {"expression": "o_orderkey % 10 <> 3 OR o_totalprice > 50000"}, "warning"),
        g.Rule("o_orderpriority", "not_null"),
    ],
)
_CHECK = """
    with o as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, case when o_orderkey % 11 = 0 then null when o_orderkey % 2 = 0 then left(o_orderpriority, 1) else o_orderpriority end as o_orderpriority from orders),
    x as (select *, o_orderpriority is not null and try_cast(o_orderpriority as bigint) is null as e_type, o_totalprice < 1000 or o_totalprice > 200000 as e_range, not regexp_matches(o_orderstatus, '^(?:[FO]$)') as e_pattern, o_orderpriority is null as e_null,
      count(*) over (partition by o_custkey) > 1 as w_unique, not (o_orderkey % 10 <> 3 or o_totalprice > 50000) as w_custom from o)
"""


def _checked(t: Tables):
    k = F.col("o_orderkey")
    priority = F.when(k % 11 == 0, None).when(k % 2 == 0, F.left("o_orderpriority", F.lit(1))).otherwise(F.col("o_orderpriority"))
    return g.check_contract(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", priority.alias("o_orderpriority")), CONTRACT)


@query(
    "contract_rows",
    _CHECK + """select o_orderkey, concat_ws(',', case when e_type then 'o_orderpriority:type' end, case when e_range then 'o_totalprice:range' end, case when e_pattern then 'o_orderstatus:pattern' end, case when e_null then 'o_orderpriority:not_null' end) as errors,
    concat_ws(',', case when w_unique then 'o_custkey:unique' end, case when w_custom then 'o_orderkey:custom' end) as warnings from x""",
)
def _(t: Tables):
    return _checked(t).select("o_orderkey", F.concat_ws(",", "_errors").alias("errors"), F.concat_ws(",", "_warnings").alias("warnings"))


@query(
    "contract_summary",
    _CHECK + "select * from (" + " union all ".join(
        f"select '{s}' as severity, '{c}' as code, count(*) as rows from x where {f}"
        for s, c, f in [
            ("error", "o_orderpriority:type", "e_type"), ("error", "o_totalprice:range", "e_range"), ("error", "o_orderstatus:pattern", "e_pattern"),
            ("error", "o_orderpriority:not_null", "e_null"), ("warning", "o_custkey:unique", "w_unique"), ("warning", "o_orderkey:custom", "w_custom"),
        ]
    ) + ") where rows > 0",
)
def _(t: Tables):
    return g.violation_summary(_checked(t))


@query("contract_valid_rows", _CHECK + "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from x where not (e_type or e_range or e_pattern or e_null)")
def _(t: Tables):
    return g.split_valid(_checked(t))[0]


@query(
    "contract_transforms",
    """select o_orderkey, case o_orderstatus when 'F' then 'finished' when 'O' then 'open' else 'other' end as status, strftime(o_orderdate, '%Y/%m') as period, format('{:,.1f}', o_totalprice) as price_text, o_totalprice * 1.1 as gross from orders""",
)
def _(t: Tables):
    steps = [
        g.Transform("status", "map", "o_orderstatus", {"values": {"F": "finished", "O": "open"}, "default": "other"}),
        g.Transform("period", "format", "o_orderdate", {"pattern": "yyyy/MM"}),
        g.Transform("price_text", "format", "o_totalprice", {"decimals": 1}),
        g.Transform("gross", "calculate", parameters={"expression": "o_totalprice * 1.1D"}),
    ]
    return g.apply_transforms(t.orders, steps).select("o_orderkey", "status", "period", "price_text", "gross")


@query("catalog_dangling", "select c.* from conversations c where not exists (select 1 from labels l where l.doc_id = c.conv_id)")
def _(t: Tables):
    return g.dangling(t.conversations, "conv_id", t.labels, "doc_id")


@query("catalog_search", "select p_partkey, p_name, p_type from part where contains(lower(p_name), 'ring') or contains(lower(p_type), 'ring')")
def _(t: Tables):
    return g.search(t.part.select("p_partkey", "p_name", "p_type"), "RING", ["p_name", "p_type"])


@query(
    "catalog_samples",
    " union all ".join(f"select '{c}' as \"column\", string_agg(v, ',' order by v) as samples from (select distinct {c} as v from customer order by v limit 5)" for c in ["c_mktsegment", "c_name"]),
)
def _(t: Tables):
    return g.sample_values(t.customer, ["c_mktsegment", "c_name"]).select("column", F.concat_ws(",", "samples").alias("samples"))


# --- audit: view reads, click writes, purchase deletes, signup assigns, error fails ---------

_AUDIT = """
    with w as (select event_id, ts, user_id, case event_type when 'view' then 'read' when 'click' then 'Update' when 'purchase' then 'remove' else event_type end as act, event_type, value from events),
    a as (select event_id, ts, user_id, case when event_type = 'signup' then case when event_id % 2 = 0 then 'role_assign' else 'permission_grant' end when event_type = 'error' then 'login'
       when lower(act) in ('write', 'update', 'create') then 'data_write' when lower(act) in ('delete', 'remove') then 'data_delete' else 'data_read' end as event_type,
       case when value > 200 then 'critical' when value > 150 then 'high' when value > 50 then 'medium' else 'low' end as severity, event_type <> 'error' as success from w)
"""


def audit(t: Tables):
    kind, v = F.col("event_type"), F.col("value")
    act = F.when(kind == "view", "read").when(kind == "click", "Update").when(kind == "purchase", "remove").otherwise(kind)
    change = F.when(F.col("event_id") % 2 == 0, "assign_role").otherwise("grant")
    event_type = F.when(kind == "signup", g.permission_event_type(change)).when(kind == "error", "login").otherwise(g.data_event_type(act))
    return t.events.select(
        "event_id", "ts", "user_id", event_type.alias("event_type"),
        F.when(v > 200, "critical").when(v > 150, "high").when(v > 50, "medium").otherwise("low").alias("severity"),
        (kind != "error").alias("success"),
    )


@query("audit_classified", _AUDIT + "select * from a")
def _(t: Tables):
    return audit(t)


@query("audit_events", _AUDIT + "select * from a where event_type = 'data_write' and ts >= timestamp '2024-01-20 00:00:00'")
def _(t: Tables):
    return g.find_events(audit(t), event_type="data_write", start=F.lit("2024-01-20").cast("timestamp_ntz"))


@query("audit_user_activity", _AUDIT + "select * from a where user_id = 7")
def _(t: Tables):
    return g.find_events(audit(t), user=7)


@query("audit_failed", _AUDIT + "select * from a where not success")
def _(t: Tables):
    return g.find_events(audit(t), success=False)


@query("audit_high_severity", _AUDIT + "select * from a where severity in ('high', 'critical')")
def _(t: Tables):
    return g.find_events(audit(t), severity=g.HIGH_SEVERITIES)


@query(
    "audit_summary",
    _AUDIT + """, r as (select * from a where ts >= timestamp '2024-01-15 00:00:00')
    select case when event_type is not null then 'event_type' when severity is not null then 'severity' when user_id is not null then 'user' else 'total' end as kind, coalesce(event_type, severity, user_id, '*') as value, count(*) as events,
    count(*) filter (where success) as successful, count(*) filter (where not success) as failed, count(*) filter (where s2 in ('high', 'critical')) as high_severity from (select event_type, severity, severity as s2, cast(user_id as varchar) as user_id, success from r) group by grouping sets ((event_type), (severity), (user_id), ())""",
)
def _(t: Tables):
    return g.audit_summary(audit(t), F.lit("2024-01-15").cast("timestamp_ntz"))


@query(
    "compliance_report",
    _AUDIT + """, c as (select count(*) as total_events, count(*) filter (where event_type in ('data_read', 'data_write', 'data_delete')) as data_access_events, count(*) filter (where event_type = 'login') as authentication_events,
    count(*) filter (where event_type in ('role_assign', 'permission_grant')) as permission_events, count(*) filter (where not success) as failed_events, count(*) filter (where severity in ('high', 'critical')) as high_severity_events from a)
    select *, round(greatest(0, 100 - failed_events / total_events * 30 - high_severity_events / total_events * 20), 6) as compliance_score,
    concat_ws(',', case when failed_events > total_events * 0.1 then 'check_system' end, case when high_severity_events > 0 then 'act_on_high_severity' end, case when data_access_events = 0 then 'check_logging' end) as advice from c""",
)
def _(t: Tables):
    return g.compliance(audit(t)).withColumn("compliance_score", F.round("compliance_score", 6))


@query(
    "collection_status",
    """with s as (select distinct o_custkey as job, o_orderpriority as source from orders), c as (select o_custkey as job, o_orderpriority as source, count(*) filter (where o_orderstatus = 'P') as e from orders where o_totalprice > 60000 group by 1, 2)
    select s.job, count(*) filter (where c.e is null) as missing, count(*) filter (where c.e > 0) as with_errors, count(*) as sources,
    case when count(*) filter (where c.e is null) > 0 and count(*) filter (where c.e > 0) > 0 then 'failed' when count(*) filter (where c.e is null) > 0 or count(*) filter (where c.e > 0) > 0 then 'partial' else 'completed' end as status
    from s left join c using (job, source) group by 1""",
)
def _(t: Tables):
    key = F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority")
    wanted = t.orders.select(F.col("o_custkey").alias("job"), key.alias("source")).distinct()
    got = t.orders.filter("o_totalprice > 60000").select(key.alias("source"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"))
    return g.collection_status(wanted, got)


# --- access ------------------------------------------------------------------------------------

_ACCESS = """
    with req as (select event_id as request_id, user_id, event_type as resource_type, 'r' || (event_id % 4) as resource_id, case when event_id % 3 = 0 then 'write' else 'read' end as action from events),
    usr as (select distinct user_id, user_id % 9 <> 0 as is_active from events), rol as (select user_id, user_id % 5 as role_id from usr),
    per as (select distinct user_id % 5 as role_id, event_type as resource_type, case when user_id % 2 = 0 then null else 'r' || (user_id % 4) end as resource_id, case when user_id % 7 = 0 then 'admin' else 'read' end as action from events)
"""


@query(
    "authorise_requests",
    _ACCESS + """select r.*, exists (select 1 from usr u join rol l on u.user_id = l.user_id join per p on l.role_id = p.role_id where u.user_id = r.user_id and u.is_active and p.resource_type = r.resource_type
      and (p.resource_id is null or p.resource_id = r.resource_id) and (p.action = r.action or p.action = 'admin')) as allowed from req r""",
)
def _(t: Tables):
    e = t.events
    requests = e.select(
        F.col("event_id").alias("request_id"), "user_id", F.col("event_type").alias("resource_type"),
        F.concat(F.lit("r"), F.col("event_id") % 4).alias("resource_id"), F.when(F.col("event_id") % 3 == 0, "write").otherwise("read").alias("action"),
    )
    users = e.select("user_id", (F.col("user_id") % 9 != 0).alias("is_active")).distinct()
    roles = users.select("user_id", (F.col("user_id") % 5).alias("role_id"))
    permissions = e.select(
        (F.col("user_id") % 5).alias("role_id"), F.col("event_type").alias("resource_type"),
        F.when(F.col("user_id") % 2 != 0, F.concat(F.lit("r"), F.col("user_id") % 4)).alias("resource_id"),
        F.when(F.col("user_id") % 7 == 0, "admin").otherwise("read").alias("action"),
    ).distinct()
    return g.authorise(requests, users, roles, permissions)


@query(
    "policy_decisions",
    "select event_id, event_type, case when event_type = 'error' then 'deny' when event_type in ('view', 'click') and user_id = 5 then 'deny' when event_type in ('view', 'click', 'signup') then 'allow' else 'deny' end as decision from events",
)
def _(t: Tables):
    rules = [
        g.PolicyRule("deny", {"event_type": "error"}),
        g.PolicyRule("deny", {"event_type": ["view", "click"], "user_id": 5}),
        g.PolicyRule("allow", {"event_type": ["view", "click", "signup"]}),
    ]
    return g.evaluate_policy(t.events, rules).select("event_id", "event_type", "decision")


# --- lineage -------------------------------------------------------------------------------------


def edges(t: Tables) -> DataFrame:
    """Key references of the star schema as lineage edges between records."""

    def part(df, source, a, target, b, kind):
        return df.select(
            F.concat(F.lit(f"{source}:"), F.col(a)).alias("source"), F.concat(F.lit(f"{target}:"), F.col(b)).alias("target"), F.lit(kind).alias("transformation")
        )

    return reduce(
        DataFrame.unionByName,
        [
            part(t.nation, "region", "n_regionkey", "nation", "n_nationkey", "split"),
            part(t.customer, "nation", "c_nationkey", "customer", "c_custkey", "assign"),
            part(t.orders, "customer", "o_custkey", "order", "o_orderkey", "buy"),
            part(t.region, "region", "r_regionkey", "region", "r_regionkey", "self"),
        ],
    )


_EDGES = """
    with e as (select 'region:' || n_regionkey as source, 'nation:' || n_nationkey as target, 'split' as transformation from nation union all select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'assign' from customer
      union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'buy' from orders union all select 'region:' || r_regionkey, 'region:' || r_regionkey, 'self' from region)
"""


@query(
    "lineage_downstream",
    _EDGES + """select 'nation:' || n_nationkey as node, 1 as depth, 'split' as transformation from nation where n_regionkey = 2 union all select 'customer:' || c_custkey, 2, 'assign' from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2
    union all select 'order:' || o_orderkey, 3, 'buy' from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 2""",
)
def _(t: Tables):
    start = t.region.filter("r_regionkey = 2").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))
    return lineage.trace(edges(t), start)


@query(
    "lineage_upstream",
    """with o as (select o_custkey, c_nationkey, n_regionkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_totalprice > 190000)
    select distinct 'customer:' || o_custkey as node, 1 as depth, 'buy' as transformation from o union all select distinct 'nation:' || c_nationkey, 2, 'assign' from o union all select distinct 'region:' || n_regionkey, 3, 'split' from o""",
)
def _(t: Tables):
    start = t.orders.filter("o_totalprice > 190000").select(F.concat(F.lit("order:"), "o_orderkey").alias("node"))
    return lineage.trace(edges(t), start, "upstream")


@query("lineage_direct", _EDGES + "select case when target = 'nation:3' then 'upstream' else 'downstream' end as direction, source, target, transformation from e where source = 'nation:3' or target = 'nation:3'")
def _(t: Tables):
    return lineage.direct_edges(edges(t), "nation:3")


@query(
    "lineage_paths",
    """select 'region:1' as node, 'region:1>region:1' as path, 1 as depth, true as circular union all select 'nation:' || n_nationkey, 'region:1>nation:' || n_nationkey, 1, false from nation where n_regionkey = 1
    union all select 'customer:' || c_custkey, 'region:1>nation:' || n_nationkey || '>customer:' || c_custkey, 2, false from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1
    union all select 'order:' || o_orderkey, 'region:1>nation:' || n_nationkey || '>customer:' || c_custkey || '>order:' || o_orderkey, 3, false from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where n_regionkey = 1""",
)
def _(t: Tables):
    return lineage.lineage_paths(edges(t), "region:1")


# --- alert rules ---------------------------------------------------------------------------------

RULES = [
    g.AlertRule("r1", "big {event_type}", "purchase", {"value": {"operator": "gt", "value": 100}}, "user {user_id} spent {value}", "high", 60),
    g.AlertRule("r2", "click", "click", {"user_id": 3}, "click by {user_id}", "low"),
    g.AlertRule("r3", "small", "purchase", {"value": {"operator": "lte", "value": 5}, "no_such_field": 1}, "never", "low"),
    g.AlertRule("r4", "purchase", "purchase", {"value": {"operator": "gte", "value": 150}}, "very big: {missing}", "critical"),
]
_HITS = """
    with h as (select event_id, ts, user_id, 'r1' as rule_id, 'high' as priority, 'big purchase' as title, 'user ' || user_id || ' spent ' || value as message, 60 as cooldown_minutes, value from events where event_type = 'purchase' and value > 100
    union all select event_id, ts, user_id, 'r2', 'low', 'click', 'click by ' || user_id, 0, value from events where event_type = 'click' and user_id = 3
    union all select event_id, ts, user_id, 'r4', 'critical', 'purchase', 'very big: {missing}', 0, value from events where event_type = 'purchase' and value >= 150)
"""


@query("alert_matches", _HITS + "select event_id, rule_id, priority, title, message, cooldown_minutes from h")
def _(t: Tables):
    return g.match_alerts(t.events, RULES).select("event_id", "rule_id", "priority", "title", "message", "cooldown_minutes")


@query(
    "alert_stats",
    _HITS + ", m as (select rule_id, priority, case when event_id % 4 = 0 then 'failed' else 'sent' end as status from h) select case when rule_id is not null then 'rule' when priority is not null then 'priority' when status is not null then 'status' else 'total' end as kind, coalesce(rule_id, priority, status, '*') as value, count(*) as messages from m group by grouping sets ((rule_id), (priority), (status), ())",
)
def _(t: Tables):
    sent = g.match_alerts(t.events, RULES).withColumn("status", F.when(F.col("event_id") % 4 == 0, "failed").otherwise("sent"))
    return g.alert_stats(sent)
