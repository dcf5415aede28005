"""Queries over sources, schemas, conversion, joins, unions and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.masking import mask_value
from tablewright.operators import convert, relational, schema, unify
from tablewright.plans.registry import Tables, query
from tablewright.sources import registry as source_registry
from tablewright.sources import search_index, sinks

# --- sources -----------------------------------------------------------------


@query(
    "search_hits_page",
    """
    select cast(event_id as varchar) as _id, event_type as _index, coalesce(value, 0) as _score,
           cast(json_extract_string(props, '$.k') as bigint) as k
    from events order by value desc, event_id limit 100 offset 50
    """,
)
def _(t: Tables):
    kind = schema.T.StructType([schema.T.StructField("k", schema.T.LongType())])
    page = search_index.page(t.events, [F.desc("value"), F.asc("event_id")], 50, 100)
    return search_index.flatten_hits(page, F.col("props"), kind, F.col("event_id"), F.col("event_type"), F.col("value"))


@query(
    "search_hits_flatten",
    """
    select event_type as _index, count(*) as hits, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as k_sum
    from events group by event_type
    """,
)
def _(t: Tables):
    kind = schema.T.StructType([schema.T.StructField("k", schema.T.LongType())])
    hits = search_index.flatten_hits(t.events, F.col("props"), kind, F.col("event_id"), F.col("event_type"), F.col("value"))
    return hits.groupBy("_index").agg(F.count("_id").alias("hits"), F.sum("k").alias("k_sum"))


@query(
    "schema_discovery",
    """
    select 'customer' as table_name, * from (
      select 0 as position, 'c_custkey' as column_name, 'bigint' as data_type, count(*) as row_count, count(*)-count(c_custkey) as missing_count from customer
      union all select 1, 'c_name', 'string', count(*), count(*)-count(c_name) from customer
      union all select 2, 'c_nationkey', 'int', count(*), count(*)-count(c_nationkey) from customer
      union all select 3, 'c_acctbal', 'double', count(*), count(*)-count(c_acctbal) from customer
      union all select 4, 'c_mktsegment', 'string', count(*), count(*)-count(c_mktsegment) from customer)
    union all
    select 'labels', * from (
      select 0, 'doc_id', 'bigint', count(*), count(*)-count(doc_id) from labels
      union all select 1, 'quality', 'int', count(*), count(*)-count(quality) from labels
      union all select 2, 'toxic', 'int', count(*), count(*)-count(toxic) from labels)
    """,
)
def _(t: Tables):
    return source_registry.column_catalog({"customer": t.customer, "labels": t.labels})


@query(
    "source_provenance",
    "select _source, 'all rows' as _query, count(*) as n from (select 'customer' as _source from customer union all select 'supplier' from supplier) group by 1",
)
def _(t: Tables):
    sources = source_registry.SourceRegistry()
    sources.register("customer", lambda s: t.customer.select(F.col("c_name").alias("name")))
    sources.register("supplier", lambda s: t.supplier.select(F.col("s_name").alias("name")))
    both = sources.run(t.spark, "customer", "all rows").unionByName(sources.run(t.spark, "supplier", "all rows"))
    return both.groupBy("_source", "_query").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sql_query_params",
    "select o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_totalprice >= 100000 and o_orderstatus = 'F' group by 1",
)
def _(t: Tables):
    space = source_registry.TableSpace(t.spark)
    space.register("tw_orders", t.orders)
    return space.sql(
        "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM tw_orders "
        "WHERE o_totalprice >= :low AND o_orderstatus = :status GROUP BY o_orderpriority",
        {"low": 100000, "status": "F"},
    )


@query(
    "json_serialise",
    """
    select '{"o_orderkey":' || o_orderkey || ',"amount":' || cast(floor(o_totalprice) as bigint) || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') ||
           '","at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '","status":"' || o_orderstatus || '"}' as json
    from orders
    """,
)
def _(t: Tables):
    return sinks.json_rows(
        t.orders.select(
            "o_orderkey",
            F.floor("o_totalprice").cast("decimal(20,0)").alias("amount"),
            F.to_date("o_orderdate").alias("day"),
            F.col("o_orderdate").alias("at"),
            F.col("o_orderstatus").alias("status"),
        )
    )


@query(
    "audit_rows",
    """
    select strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as timestamp, cast(user_id as varchar) as actor, event_type as action,
           props as metadata, cast(ts as date) as event_date from events
    """,
)
def _(t: Tables):
    return sinks.audit_rows(t.events, F.col("ts"), F.col("user_id"), F.col("event_type"), F.col("props"))


# --- projections and filters ---------------------------------------------------


@query("select_columns", "select o_orderkey, o_totalprice from orders")
def _(t: Tables):
    return relational.select_columns(t.orders, ["o_orderkey", "o_totalprice"])


@query("filter_rows", "select * from lineitem where l_quantity >= 45 and l_discount between 0.02 and 0.05")
def _(t: Tables):
    return relational.filter_rows(t.lineitem, "l_quantity >= 45 AND l_discount BETWEEN 0.02 AND 0.05")


@query("rename_columns", "select c_custkey as customer_id, c_name as name, c_nationkey, c_acctbal as balance, c_mktsegment from customer")
def _(t: Tables):
    return relational.rename(t.customer, {"c_custkey": "customer_id", "c_name": "name", "c_acctbal": "balance"})


@query("keep_columns", "select s_suppkey, s_acctbal from supplier")
def _(t: Tables):
    return relational.keep_columns(t.supplier, ["s_suppkey", "no_such_column", "s_acctbal"])


@query("filter_compare", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_totalprice > 150000 and o_orderstatus = 'F'")
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return relational.filter_compare(relational.filter_compare(df, "o_totalprice > 150000"), "o_orderstatus == F")


@query(
    "transform_chain",
    "select l_orderkey as id, cast(l_quantity as bigint) as qty, cast(l_linenumber as varchar) as line from lineitem where l_quantity >= 40",
)
def _(t: Tables):
    return relational.transform_chain(
        t.lineitem,
        [
            {"type": "column_rename", "mapping": {"l_orderkey": "id", "l_quantity": "qty", "l_linenumber": "line"}},
            {"type": "column_filter", "columns": ["id", "qty", "line"]},
            {"type": "row_filter", "condition": "qty >= 40"},
            {"type": "column_type_conversion", "types": {"qty": "bigint", "line": "string"}},
        ],
    )


@query("mask_columns", "select c_custkey, '***' as c_name, c_nationkey, '***' as c_acctbal, c_mktsegment from customer")
def _(t: Tables):
    return relational.mask_columns(t.customer, ["c_name", "c_acctbal"])


@query("head_sample", "select * from orders order by o_orderkey limit 5")
def _(t: Tables):
    return relational.head(t.orders, 5, ["o_orderkey"])


@query(
    "apply_mapping",
    "select c_custkey as id, upper(c_name) as name, cast(c_acctbal as bigint) as balance, 'KR' as country, c_nationkey as nation from customer where c_acctbal = trunc(c_acctbal) or true",
)
def _(t: Tables):
    m = schema.SchemaMap(
        "customer",
        [
            schema.ColumnMap("c_custkey", "id", "bigint"),
            schema.ColumnMap("c_name", "name", "string", transform="uppercase"),
            schema.ColumnMap("balance_whole", "balance", "bigint"),
            schema.ColumnMap("country", "country", "string", required=False, default="KR"),
            schema.ColumnMap("c_nationkey", "nation", "int"),
        ],
    )
    return schema.apply_mapping(t.customer.withColumn("balance_whole", F.rint("c_acctbal")), m)


@query(
    "value_transforms",
    """
    select p_partkey, upper(p_name) as upper_name, lower(p_brand) as lower_brand, trim('  ' || p_type || ' ') as trimmed,
           abs(p_retailprice - 1000) as distance, round_even(p_size + 0.5, 0)::double as rounded from part
    """,
)
def _(t: Tables):
    v = schema.VALUE_TRANSFORMS
    return t.part.select(
        "p_partkey",
        v["uppercase"](F.col("p_name")).alias("upper_name"),
        v["lowercase"](F.col("p_brand")).alias("lower_brand"),
        v["trim"](F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("trimmed"),
        v["abs"](F.col("p_retailprice") - 1000).alias("distance"),
        v["round"](F.col("p_size") + F.lit(0.5)).alias("rounded"),
    )


@query(
    "normalised_names",
    "select c_custkey as customer_id, c_name as customer_name, c_acctbal as customer_name_1 from customer",
)
def _(t: Tables):
    df = t.customer.select(
        F.col("c_custkey").alias("Customer ID"), F.col("c_name").alias("--Customer  Name"), F.col("c_acctbal").alias("customer.name")
    )
    return schema.normalise_names(df)


@query(
    "auto_mapping",
    "select c_custkey as custkey, c_name as name, c_acctbal as acctbal from customer",
)
def _(t: Tables):
    target = schema.T.StructType.fromDDL("custkey bigint, name string, acctbal double")
    return schema.apply_mapping(t.customer, schema.make_mapping("customer", t.customer.schema, target))


@query("table_info", "select count(*) as row_count, 11 as column_count from lineitem")
def _(t: Tables):
    return schema.table_info(t.lineitem).select("row_count", "column_count")


@query(
    "compare_schemas",
    """
    with a as (select column_name, column_type as data_type from (describe customer)), b as (select 'c_' || substr(column_name, 3) as column_name, column_type as data_type from (describe supplier))
    select coalesce(a.column_name, b.column_name) as column_name,
           case a.data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' end as type_left,
           case b.data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' end as type_right,
           case when a.column_name is null then 'only_right' when b.column_name is null then 'only_left' when a.data_type <> b.data_type then 'type_differs' else 'same' end as verdict
    from a full join b on a.column_name = b.column_name
    """,
)
def _(t: Tables):
    renamed = t.supplier.toDF(*["c_" + c[2:] for c in t.supplier.columns])
    return schema.compare_schemas(schema.schema_rows(t.spark, t.customer.schema), schema.schema_rows(t.spark, renamed.schema))


# --- conversion ------------------------------------------------------------------


@query(
    "convert_text",
    """
    select o_orderkey, try_cast(case when o_orderkey % 7 = 0 then 'bad' else cast(o_custkey as varchar) end as bigint) as whole,
           try_cast(cast(o_totalprice as varchar) as double) as amount,
           try_strptime(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S')::timestamp as at,
           cast(try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') as date) as day
    from orders
    """,
)
def _(t: Tables):
    text = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("whole"),
        F.col("o_totalprice").cast("string").alias("amount"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
    )
    return convert.convert_columns(
        text,
        {"whole": "bigint", "amount": "double", "at": "timestamp_ntz", "day": "date"},
        params={"day": {"format": "%d/%m/%Y"}},
    )


@query(
    "convert_bool",
    """
    select event_id, case when lower(w) in ('true','1','yes','on') then true when lower(w) in ('false','0','no','off') then false end as flag,
           k <> 0 as nonzero, value <> 0 as has_value
    from (select event_id, value, cast(json_extract_string(props, '$.k') as bigint) % 3 as k,
                 case event_type when 'click' then 'YES' when 'view' then 'off' when 'error' then 'maybe' when 'signup' then '1' else 'False' end as w from events)
    """,
)
def _(t: Tables):
    words = F.when(F.col("event_type") == "click", "YES").when(F.col("event_type") == "view", "off").when(
        F.col("event_type") == "error", "maybe").when(F.col("event_type") == "signup", "1").otherwise("False")
    df = t.events.select(
        "event_id",
        words.alias("flag"),
        (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("nonzero"),
        F.col("value").alias("has_value"),
    )
    return convert.convert_columns(df, {"flag": "boolean", "nonzero": "boolean", "has_value": "boolean"})


@query(
    "convert_numbers",
    "select l_orderkey, l_linenumber, cast(l_linenumber as double) as line_d, cast(l_orderkey as varchar) as key_s, cast(l_shipdate as date) as ship_day from lineitem",
)
def _(t: Tables):
    df = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_linenumber").alias("line_d"), F.col("l_orderkey").alias("key_s"), F.col("l_shipdate").alias("ship_day")
    )
    return convert.convert_columns(df, {"line_d": "double", "key_s": "string", "ship_day": "date"})


@query(
    "conversion_failures",
    "select count(*) filter (where lang is not null and try_cast(lang as bigint) is null) as lang, count(*) filter (where try_cast(right(text, 1) as double) is null) as last_char from documents",
)
def _(t: Tables):
    df = t.documents.select("lang", F.right("text", F.lit(1)).alias("last_char"))
    return convert.failures(df, {"lang": "bigint", "last_char": "double"})


@query(
    "convert_skip_policy",
    "select o_orderkey, o_orderpriority, cast(o_custkey as varchar)::bigint as cust from orders",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_custkey").cast("string").alias("cust"))
    return convert.convert_columns(df, {"o_orderpriority": "bigint", "cust": "bigint"}, on_error="skip")


@query(
    "convert_raise_policy",
    "select o_orderkey, o_custkey as cust from orders",
)
def _(t: Tables):
    df = t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("cust"))
    return convert.convert_columns(df, {"cust": "bigint"}, on_error="raise")


@query(
    "conform_schema",
    "select s_suppkey as id, s_name as name, cast(s_nationkey as bigint) as nation, cast(null as double) as score from supplier",
)
def _(t: Tables):
    target = schema.T.StructType.fromDDL("id bigint, name string, nation bigint, score double")
    return convert.conform(t.supplier, target, {"id": "s_suppkey", "name": "s_name", "nation": "s_nationkey"})


_DETECT = """
    select '{c}' as "column", count({c}) as non_null,
      case when count({c}) = 0 then 'string'
           when count(*) filter (where lower(cast({c} as varchar)) in ('true','false')) = count({c}) then 'bool'
           when count(*) filter (where regexp_matches(cast({c} as varchar), '^[+-]?[0-9]+$')) = count({c}) then
             case when min(try_cast({c} as bigint)) >= 0 then
               case when max(try_cast({c} as bigint)) < 256 then 'uint8' when max(try_cast({c} as bigint)) < 65536 then 'uint16' when max(try_cast({c} as bigint)) < 4294967296 then 'uint32' else 'uint64' end
             else 'int64' end
           when count(try_cast({c} as double)) = count({c}) then 'float64' else 'string' end as detected_type
    from {t}
"""


@query(
    "detect_types",
    " union all ".join(_DETECT.format(c=c, t="lineitem") for c in ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag"]),
)
def _(t: Tables):
    return schema.detect_types(t.lineitem, ["l_orderkey", "l_linenumber", "l_discount", "l_returnflag"])


@query("narrow_numbers", "select p_partkey::int as p_partkey, p_size::int as p_size, p_retailprice from part")
def _(t: Tables):
    return schema.narrow_numbers(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_partkey", "p_size"])


# --- joins -------------------------------------------------------------------------

_JOIN = """
    select l.doc_id, l.quality, l.toxic, p.page_id, p.url
    from labels l {kind} join (select page_id, url from pages) p on l.doc_id = p.page_id
"""


def _doc_join(t: Tables, kind: str):
    return relational.join_tables(("l", t.labels), ("p", t.pages.select("page_id", "url")), "l.doc_id = p.page_id", kind)


for _kind in relational.JOIN_TYPES:
    query(f"join_{_kind}", _JOIN.format(kind=_kind))(lambda t, k=_kind: _doc_join(t, k))


@query(
    "join_theta",
    """
    with q as (select distinct date_trunc('quarter', o_orderdate) as opens from orders)
    select o.o_orderkey, q.opens from orders o join q on o.o_orderdate >= q.opens and o.o_orderdate < q.opens + interval 3 month
    """,
)
def _(t: Tables):
    # Intervals that do not overlap: every order meets one of them.
    quarters = t.orders.select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("opens")).distinct()
    joined = relational.join_tables(
        ("o", t.orders), ("q", quarters), "o.o_orderdate >= q.opens AND o.o_orderdate < q.opens + INTERVAL 3 MONTH"
    )
    return joined.select("o_orderkey", "opens")


@query(
    "multi_join",
    """
    select r.r_name, n.n_name, count(*) as orders, round(sum(o.o_totalprice), 2) as total
    from region r join nation n on r.r_regionkey = n.n_regionkey join customer c on n.n_nationkey = c.c_nationkey
    left join orders o on c.c_custkey = o.o_custkey group by 1, 2
    """,
)
def _(t: Tables):
    joined = relational.multi_join(
        {"r": t.region, "n": t.nation, "c": t.customer, "o": t.orders},
        ["r.r_regionkey = n.n_regionkey", "n.n_nationkey = c.c_nationkey", "c.c_custkey = o.o_custkey"],
        ["inner", "inner", "left"],
    )
    return joined.groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def _sql_query(name: str, text: str):
    @query(name, text)
    def run(t: Tables):
        space = source_registry.TableSpace(t.spark)
        for table in ("customer", "orders", "lineitem", "events", "part", "labels", "documents"):
            if table in text:
                space.register(table, getattr(t, table))
        return space.sql(text)


_sql_query("sql_group_by", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by l_returnflag, l_linestatus")
_sql_query("sql_window", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running from orders")
_sql_query("sql_exists", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
_sql_query("sql_not_exists", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
_sql_query("sql_rollup", "select l_returnflag, l_linestatus, count(*) as n, round(avg(l_discount), 4) as mean_discount from lineitem group by rollup (l_returnflag, l_linestatus)")
_sql_query("sql_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
_sql_query("sql_intersect", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'")
_sql_query("sql_except", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
_sql_query("sql_subquery", "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.8 from orders)")


@query(
    "join_then_stats",
    """
    with per as (select c.c_custkey, sum(o.o_totalprice) as total from customer c join orders o on c.c_custkey = o.o_custkey group by 1),
    parts as (select p.p_partkey, avg(l.l_extendedprice) as mean_price from lineitem l join part p on l.l_partkey = p.p_partkey group by 1)
    select 'customer_total' as measure, count(*) as n, round(avg(total), 4) as mean, round(stddev_samp(total), 4) as std, round(quantile_cont(total, 0.5), 4) as q50 from per
    union all
    select 'part_mean_price', count(*), round(avg(mean_price), 4), round(stddev_samp(mean_price), 4), round(quantile_cont(mean_price, 0.5), 4) from parts
    """,
)
def _(t: Tables):
    from tablewright.operators.quantiles import with_quantiles

    per = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.sum("o_totalprice").alias("x"))
    parts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.avg("l_extendedprice").alias("x"))

    def describe(df, name):
        return with_quantiles(
            df, ["x"], [0.5], [F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_samp("x"), 4).alias("std")]
        ).select(F.lit(name).alias("measure"), "n", "mean", "std", F.round(F.col("q_x")[0], 4).alias("q50"))

    return describe(per, "customer_total").unionByName(describe(parts, "part_mean_price"))


@query(
    "customer_order_summary",
    "select c.c_custkey, c.c_name, count(o.o_orderkey) as total_orders, round(coalesce(sum(o.o_totalprice), 0), 2) as total_spent, max(o.o_orderdate) as last_order_date from customer c left join orders o on c.c_custkey = o.o_custkey group by 1, 2",
)
def _(t: Tables):
    spent = t.orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("s"), F.max("o_orderdate").alias("last_order_date")
    )
    return t.customer.join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("total_orders"),
        F.round(F.coalesce("s", F.lit(0.0)), 2).alias("total_spent"), "last_order_date",
    )


# --- set operations -----------------------------------------------------------------

_PEOPLE = {
    "customer": {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation", "c_acctbal": "balance", "c_mktsegment": "segment"},
    "supplier": {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation", "s_acctbal": "balance"},
}


@query(
    "unify_union",
    """
    select c_custkey as id, c_name as name, cast(c_nationkey as bigint) as nation, c_acctbal as balance, c_mktsegment as segment from customer
    union all select s_suppkey, s_name, s_nationkey, s_acctbal, null from supplier
    """,
)
def _(t: Tables):
    return unify.unify({"customer": t.customer, "supplier": t.supplier}, _PEOPLE)


@query(
    "unify_intersection",
    """
    select c_custkey as id, c_name as name, cast(c_nationkey as bigint) as nation, c_acctbal as balance from customer
    union all select s_suppkey, s_name, s_nationkey, s_acctbal from supplier
    """,
)
def _(t: Tables):
    return unify.unify({"customer": t.customer, "supplier": t.supplier}, _PEOPLE, "intersection")


@query(
    "unify_custom",
    "select s_suppkey as id, coalesce(c_name, s_name) as name from supplier left join customer on s_suppkey = c_custkey",
)
def _(t: Tables):
    def merge(sources):
        c, s = sources["customer"], sources["supplier"]
        return s.join(c.select("id", F.col("name").alias("other")), "id", "left").select("id", F.coalesce("other", "name").alias("name"))

    return unify.unify({"customer": t.customer, "supplier": t.supplier}, _PEOPLE, "custom", merge)


@query(
    "integrate_sources",
    "select 'customer' as _source, c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select 'supplier', s_suppkey, s_name, s_acctbal, null from supplier",
)
def _(t: Tables):
    return unify.integrate(
        {
            "customer": t.customer.select(F.col("c_custkey").alias("ID"), F.col("c_name").alias("Name "), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment")),
            "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("NAME"), F.col("s_acctbal").alias("s bal")),
        },
        {"supplier": {"s bal": "balance"}},
    )


@query(
    "validate_unified",
    """
    with u as (select c_custkey as id, c_mktsegment as segment from customer union all select s_suppkey, null from supplier),
    m as (select count(*) as n, count(*) - count(id) as a, count(*) - count(segment) as b from u)
    select 'id' as "column", a as missing_count, round(a / n, 6) as missing_ratio, round(1 - (a / n + b / n) / 2, 6) as quality_score from m
    union all select 'segment', b, round(b / n, 6), round(1 - (a / n + b / n) / 2, 6) from m
    """,
)
def _(t: Tables):
    u = unify.unify(
        {"customer": t.customer.select("c_custkey", "c_mktsegment"), "supplier": t.supplier.select("s_suppkey")}, _PEOPLE
    )
    return unify.validate_unified(u).withColumns(
        {"missing_ratio": F.round("missing_ratio", 6), "quality_score": F.round("quality_score", 6)}
    )


@query(
    "source_summary",
    "select 'customer' as source, count(*) as row_count, 5 as filled_columns from customer union all select 'supplier', count(*), 4 from supplier",
)
def _(t: Tables):
    return unify.source_summary(unify.unify({"customer": t.customer, "supplier": t.supplier}, _PEOPLE, source_column="_source"))


@query("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def _(t: Tables):
    return relational.keep_one(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query(
    "distinct_keep_first",
    "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn = 1",
)
def _(t: Tables):
    return relational.keep_one(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query(
    "distinct_keep_last",
    "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderkey desc) as rn from orders) where rn = 1",
)
def _(t: Tables):
    return relational.keep_one(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "last")


@query(
    "distinct_keep_none",
    "select doc_id, text from (select doc_id, text, count(*) over (partition by text) as n from documents) where n = 1",
)
def _(t: Tables):
    return relational.keep_one(t.documents.select("doc_id", "text"), ["text"], ["doc_id"], False)


# --- ordering and top lists -----------------------------------------------------------


@query("sort_rows", "select event_id, ts, value from events order by ts, event_id")
def _(t: Tables):
    return t.events.select("event_id", "ts", "value").orderBy("ts", "event_id")


@query("newest_first", "select event_id, ts, event_type from events order by ts desc, event_id desc limit 100")
def _(t: Tables):
    return t.events.select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query(
    "latest_per_key",
    "select user_id, max(ts) as ts, arg_max(event_id, (ts, event_id)) as event_id from events group by user_id",
)
def _(t: Tables):
    return relational.latest_per_key(t.events.select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])


@query(
    "top_groups",
    "select user_id, count(*) as n, round(sum(value), 2) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high from events group by 1 order by sum(value) desc, user_id limit 10",
)
def _(t: Tables):
    top = relational.top_groups(t.events, "user_id", "value")
    return top.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("offset_page", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 20 offset 40")
def _(t: Tables):
    return search_index.page(t.orders.select("o_orderkey", "o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 40, 20)


@query(
    "first_per_group",
    "select * from (select o_orderpriority, o_orderkey, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as row_number from orders) where row_number <= 10",
)
def _(t: Tables):
    df = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return relational.first_per_group(df, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query(
    "log_aggregates",
    """
    select count(*) as n, min(ts) as first_ts, max(ts) as last_ts, count(distinct user_id) as users, count(distinct event_type) as types,
           count(distinct props) as props, round(sum(value), 2) as total, round(avg(value), 6) as mean from events
    """,
)
def _(t: Tables):
    return t.events.agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.countDistinct("props").alias("props"),
        F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
    )


# --- masking and similarity --------------------------------------------------------------


@query(
    "mask_typed",
    """
    with s as (select c_custkey, lower(replace(c_name, '#', '.')) || '@mail' || c_nationkey || '.example' as email,
                      printf('+1 (%03d) %03d-%04d', 200 + c_nationkey, c_custkey % 1000, c_custkey % 10000) as phone,
                      printf('%03d-%02d-%04d', c_custkey % 900, c_nationkey, c_custkey % 10000) as ssn,
                      printf('4000 1234 %04d %04d', c_nationkey, c_custkey % 10000) as card, c_mktsegment as seg from customer),
    d as (select *, split_part(email, '@', 1) as loc, regexp_replace(phone, '[^0-9]', '', 'g') as pd from s)
    select c_custkey, left(loc, 1) || repeat('*', length(loc) - 2) || right(loc, 1) || '@' || split_part(email, '@', 2) as email,
           left(pd, 3) || '-***-' || right(pd, 4) as phone, '***-**-' || right(ssn, 4) as ssn,
           '****-****-****-' || right(card, 4) as card, left(seg, 1) || repeat('*', length(seg) - 2) || right(seg, 1) as seg
    from d
    """,
)
def _(t: Tables):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    df = t.customer.select(
        c,
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail"), n, F.lit(".example")).alias("email"),
        F.format_string("+1 (%03d) %03d-%04d", n + 200, c % 1000, c % 10000).alias("phone"),
        F.format_string("%03d-%02d-%04d", c % 900, n, c % 10000).alias("ssn"),
        F.format_string("4000 1234 %04d %04d", n, c % 10000).alias("card"),
        F.col("c_mktsegment").alias("seg"),
    )
    return df.withColumns({k: mask_value(F.col(k), k) for k in ["email", "phone", "ssn", "card", "seg"]})


_PROFILE = """
    with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
    u as (select vec_id, label, unnest(v) as x, unnest(range(len(v))) as i from e),
    p as (select i, avg(x) as m from u where label = 3 group by i),
    s as (select vec_id, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) as similarity from u join p using (i) group by vec_id)
"""


@query("similar_entities", _PROFILE + "select vec_id, round(similarity, 6) as similarity from s order by s.similarity desc, vec_id limit 10")
def _(t: Tables):
    profile = relational.mean_vector(t.embeddings.filter("label = 3"), "embedding")
    return relational.similar_entities(t.embeddings, "vec_id", "embedding", profile, 10).withColumn("similarity", F.round("similarity", 6))


@query("similar_segment", _PROFILE + "select vec_id, round(similarity, 6) as similarity from s where s.similarity >= 0.25")
def _(t: Tables):
    profile = relational.mean_vector(t.embeddings.filter("label = 3"), "embedding")
    found = relational.similar_entities(t.embeddings, "vec_id", "embedding", profile, None, 0.25)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("segment_rule", "select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal > 5000")
def _(t: Tables):
    return relational.filter_entities(t.customer, "c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select("c_custkey", "c_acctbal")
