"""The operators as registered queries over the given tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import (
    divergence,
    embedding_tiles,
    exact_dedup,
    filter_audit,
    mixing,
    packing,
    pii,
    quality_crf,
    quality_rules,
    secret_scan,
    simhash,
    substring_windows,
    suffix_dedup,
)
from tablewright.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op1_weighted_fair_mix",
    r"""
    with k as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || coalesce(doc_id::varchar, 'null')) as key from documents),
    src as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as i from k group by source),
    w as (select *, ([3.0, 1.0, 2.0])[(i % 3) + 1]::double as weight, 2.0::double * source_size as cap from src),
    lv as (select *, row_number() over o as rk,
        (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, i rows between current row and unbounded following) as level
      from w window o as (order by cap / weight, i)),
    tg as (select source, source_size, least(cap, coalesce((select arg_min(level, rk) from lv where level * weight <= cap) * weight, cap)) as target from lv),
    q as (select k.*, source_size, target, substr(key, 1, 3) as bucket, (sum(size) over (partition by k.source order by key, doc_id, size rows unbounded preceding) - size)::bigint as before,
        row_number() over (partition by k.source, substr(key, 1, 3) order by key, doc_id, size) as n from k join tg on k.source is not distinct from tg.source),
    c as (select q.*, r, (before + r * source_size)::bigint as a, (before + r * source_size + size)::bigint as b from q, (values (0), (1)) v(r) where size > 0 and target > 0),
    e as (select *, unnest(range(greatest(least(floor(a * 4096.0::double / target), 8192)::bigint - 1, 0), least(least(floor(b * 4096.0::double / target), 8192)::bigint + 1, 8192) + 1)) as k from c),
    z as (select *, greatest(a, floor(k * target / 4096.0::double)::bigint) as f, case when k = 8192 then b else least(b, floor((k + 1) * target / 4096.0::double)::bigint) end as t from e),
    p as (select source, bucket, n, t - f as w, (sum(t - f) over (order by k, t / target, source nulls last, bucket, n, r rows unbounded preceding) - (t - f))::bigint as pos from z where t > f),
    m as (select sum(floor(target))::bigint as budget from tg),
    g as (select source, bucket, n, sum(least(w, budget - pos))::bigint as taken, min(pos) as "position" from p, m where pos < budget group by all)
    select q.doc_id, q.source, q.size, q.source_size, q.target, coalesce(g.taken, 0)::bigint as taken, g."position"
    from q left join g on q.source is not distinct from g.source and q.bucket = g.bucket and q.n = g.n
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op2_suffix_array")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


@query("op3_disclosure_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(documents(spark, sf_dir))


@query("op4_line_crf")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.quality_scores(docs, model)


@query("op5_adaptive_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir))


@query("op6_token_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(documents(spark, sf_dir))


@query("op7_compact_windows")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_windows.near_passages(documents(spark, sf_dir))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op9_simhash_pivots")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query(
    "op10_chunk_recipes",
    r"""
    with t as (
      select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents
    )
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = max(doc_id) over w as kept, sha256(x) as text_sha256
    from t window w as (partition by x)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


@query(
    "op11_filter_audit",
    r"""
    with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    f as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x),
            regexp_matches(x, '[#$%&*|]'), coalesce(min(doc_id) over (partition by x) < doc_id, false)] as fails from t),
    l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
    m as (select part, fails, count(*) as n, count_if(l.good) as good, count_if(l.toxic) as toxic from f left join l using (doc_id) group by part, fails),
    c(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
    o as (select a.x || b.x || c.x || d.x || e.x as filter_order from c a, c b, c c, c d, c e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    r as (select m.*, filter_order, coalesce(list_min([case when fails[i] then strpos(filter_order, 'ABCDE'[i]) end for i in range(1, 6)]), 6) as gone from m, o),
    s as (select part, filter_order, step::int as step, filter_order[step] as filter,
            sum(n) filter (where gone > step) as kept, sum(n) filter (where gone = step) as removed,
            sum(n) filter (where fails[strpos('ABCDE', filter_order[step])] and gone < step) as redundant,
            sum(n) filter (where fails[strpos('ABCDE', filter_order[step])] and len(list_filter(fails, lambda y: y)) = 1) as unique_fails,
            sum(good) filter (where gone = step) as good_lost, sum(toxic) filter (where gone = step) as toxic_lost
          from r, range(1, 6) k(step) group by part, filter_order, step)
    select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
           coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
           coalesce(sum(removed) over (partition by part, filter), 0)::bigint as shapley, filter
    from s
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(
    "op12_embedding_tiles",
    r"""
    with recursive u as (select vec_id, embedding::double[] as x from embeddings
      where len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0 and len(list_filter(embedding, lambda y: y <> 0)) > 0),
    link as (select a.vec_id as a, b.vec_id as b from u a, u b where a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.95),
    reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
    n as (select a, count(*) as n from link group by a),
    c as (select a, min(b) as c from reach group by a)
    select vec_id, coalesce(n.n, 0)::bigint as n_links, least(vec_id, coalesce(c.c, vec_id)) as component_id, vec_id = least(vec_id, coalesce(c.c, vec_id)) as kept
    from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return embedding_tiles.near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(
    "op13_source_divergence",
    r"""
    with t as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w, row_number() over () as r from documents),
    o as (select lang, source, r, unnest(w) as term from t),
    kept as (select lang, term, count(*) as n from o group by lang, term having count(distinct r) >= 10),
    c as (select lang, source, term, count(*) as n from o join kept k using (lang, term) group by all),
    g as (select distinct lang, source from t),
    v as (select lang, count(*) as kinds, sum(n) as total from kept group by lang),
    gn as (select lang, source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by all),
    p as (select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (gn.total + 2 * v.kinds) as p
          from gn join v using (lang) join kept k using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
    q as (select lang, term, 1 + (1000000000::hugeint * (n + 2)) // (v.total + 2 * v.kinds) as q from kept join v using (lang)),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source
      left join (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term group by all) s
        on s.lang = a.lang and s.source = a.source and s.item = b.source),
    terms as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::bigint as value
      from p join q on p.lang = q.lang and p.term = q.term where p.n > 0 and p.p > q.q),
    u as (select * from pairs union all select * from terms)
    select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from u
    qualify part = 'pair' or row_number() over (partition by lang, source, part order by value desc, item) <= 10
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))
