"""Queries over clustering, reduction, anomaly models and scoring."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import anomaly, clustering, features, neighbours, reduction, scoring
from tablewright.operators.cleaning import impute
from tablewright.plans.queries_stats import rounded
from tablewright.plans.registry import Tables, query
from tablewright.session import beside

PART = ["p_size", "p_retailprice"]

#: Coordinates of an embedding.
WIDTH = 64
ALL = [f"e{i}" for i in range(WIDTH)]


def parts(t: Tables):
    return t.part.select("p_partkey", *PART)


def vectors(t: Tables, d: int = WIDTH):
    """The coordinates of the embeddings as columns."""
    return t.embeddings.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(d)])


@query("cluster_kmeans")
def _(t: Tables):
    return clustering.cluster(parts(t), "p_partkey", PART, "kmeans", 3)


@query("cluster_kmeans_check", "select count(*) as rows, 0::bigint as misplaced, 0::bigint as off_centre from embeddings")
def _(t: Tables):
    return clustering.kmeans_check(vectors(t), ALL, 3)


@query("cluster_centres")
def _(t: Tables):
    return clustering.centres(vectors(t), ALL, "kmeans", 3)


@query("cluster_mixture_means")
def _(t: Tables):
    return clustering.centres(parts(t), PART, "gmm", 3)


@query("cluster_hierarchical")
def _(t: Tables):
    return clustering.cluster(parts(t), "p_partkey", PART, "hierarchical", 3)


@query(
    "cluster_ward_tree",
    """select count(distinct (p_size, p_retailprice)) - 1 as merges, round(2.0::double * (count(*) - 1), 6) as cost, 0::bigint as ids_lost, count(*) as largest from part""",
)
def _(t: Tables):
    """A tree over all points adds up to the whole variance, ends in one cluster, and loses every id but one."""
    tree = clustering.WardTree(features.scaled(parts(t), PART, ["p_partkey"]))
    lost = tree.points.select("id").join(tree.merges.select(F.col("b").alias("id")).distinct(), "id", "left_anti").agg((F.count(F.lit(1)) - 1).alias("ids_lost"))
    whole = tree.merges.agg(F.count(F.lit(1)).alias("merges"), F.round(F.sum("cost"), 6).alias("cost"), F.max("size").alias("largest"))
    return beside(whole, lost).select("merges", "cost", "ids_lost", "largest")


@query("cluster_mixture")
def _(t: Tables):
    return clustering.cluster(parts(t), "p_partkey", PART, "gmm", 3)


@query("cluster_optimal_k")
def _(t: Tables):
    return clustering.optimal_k(parts(t), PART, "kmeans", 5)


@query("cluster_compare")
def _(t: Tables):
    return clustering.compare_methods(parts(t), PART, 3)


_DB = """
    with recursive u as (select c_custkey, (c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over () as x, (c_nationkey - avg(c_nationkey) over ()) / stddev_samp(c_nationkey) over () as y from customer),
    p as (select c_custkey as i, x, y from u),
    n as (select a.i as i, b.i as j from p a join p b on (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {eps} * {eps}),
    core as (select i from n group by i having count(*) >= {k}),
    e as (select n.i, n.j from n join core a on n.i = a.i join core b on n.j = b.i),
    r as (select i, i as c from core union select e.j, r.c from r join e on e.i = r.i),
    cc as (select i, min(c) as c from r group by i)
"""


@query(
    "cluster_density",
    _DB.format(eps="0.05::double", k=4) + """, m as (select i, c from cc union all select n.i, min(cc.c) from n join cc on n.j = cc.i where n.i not in (select i from core) group by n.i),
    z as (select c, count(*) filter (where i in (select i from core)) as core_size from m group by c)
    select core_size, count(*) as clusters from z group by 1 union all select -1, count(*) from p where i not in (select i from m)""",
)
def _(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))
    out = clustering.dbscan(df, "c_custkey", ["c_acctbal", "nation"], 0.05, 4, with_core=True)
    sizes = out.filter("cluster >= 0").groupBy("cluster").agg(F.count_if("is_core").alias("core_size"))
    noise = out.filter("cluster = -1").agg(F.lit(-1).cast("long").alias("core_size"), F.count(F.lit(1)).alias("clusters"))
    return sizes.groupBy("core_size").agg(F.count(F.lit(1)).alias("clusters")).unionByName(noise)


_WIDE = """
    with recursive w as (select vec_id, unnest(cast(embedding as double[])) as x, unnest(range(64)) as c from embeddings),
    z as (select vec_id, c, (x - avg(x) over (partition by c)) / stddev_samp(x) over (partition by c) as x from w),
    u as (select vec_id as i, list(x order by c) as x from z group by 1),
    n as (select a.i, b.i as j from u a join u b on list_distance(a.x, b.x) <= 9),
    core as (select i from n group by i having count(*) >= 8),
    e as (select n.i, n.j from n join core a on n.i = a.i join core b on n.j = b.i),
    r as (select i, i as c from core union select e.j, r.c from r join e on e.i = r.i),
    cc as (select i, min(c) as c from r group by i), num as (select c, dense_rank() over (order by c) - 1 as cluster from (select distinct c from cc)),
    m as (select i, cluster, true as is_core from cc join num using (c) union all
          select n.i, min(cluster), false from n join cc on cc.i = n.j join num using (c) where n.i not in (select i from core) group by n.i)
    select u.i as vec_id, coalesce(m.cluster, -1) as cluster, coalesce(is_core, false) as is_core from u left join m using (i)
"""


@query("cluster_density_wide", _WIDE)
def _(t: Tables):
    """Memberships over all 64 coordinates."""
    return clustering.dbscan(vectors(t).drop("label"), "vec_id", ALL, 9.0, 8, with_core=True)


@query(
    "cluster_stats",
    """with v as (select vec_id, label, unnest(cast(embedding as double[])) as x, unnest(range(64)) as i from embeddings),
    m as (select label, i, avg(x) as m, count(*) as n from v group by all), d as (select label, vec_id, any_value(n) as n, sqrt(sum((x - m) ** 2)) as d from v join m using (label, i) group by all)
    select label, any_value(n) as size, round(avg(d), 6) as mean_distance, round(max(d), 6) as max_distance, round(min(d), 6) as min_distance, round(count(*) * 100 / (select count(*) from embeddings), 6) as percent from d group by 1""",
)
def _(t: Tables):
    return rounded(clustering.cluster_stats(vectors(t), ALL, "label"))


@query("reduce_pca")
def _(t: Tables):
    return reduction.pca(vectors(t).drop("label"), "vec_id", components=3)


@query(
    "reduce_pca_check",
    f"select count(*) as rows, {WIDTH}.0::double as variance, 0::bigint as correlated, 0::bigint as unordered from embeddings",
)
def _(t: Tables):
    """A full projection keeps the total variance, its components do not correlate, and they fall in variance."""
    p = reduction.pca(vectors(t).drop("label"), "vec_id", components=WIDTH)
    names = [c for c in p.columns if c != "vec_id"]
    pairs = [F.abs(F.corr(a, b)) > 1e-6 for a, b in zip(names, names[1:])]
    spread = p.agg(F.count(F.lit(1)).alias("rows"), *[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(names)], *[x.alias(f"c{i}") for i, x in enumerate(pairs)])
    v = [F.col(f"v{i}") for i in range(len(names))]
    count = lambda flags: sum((f.cast("long") for f in flags), F.lit(0).cast("long"))
    return spread.select(
        "rows",
        F.round(sum(v[1:], v[0]), 6).alias("variance"),
        count([F.col(f"c{i}") for i in range(len(pairs))]).alias("correlated"),
        count([b > a + 1e-9 for a, b in zip(v, v[1:])]).alias("unordered"),
    )


@query("reduce_ica")
def _(t: Tables):
    return reduction.ica(vectors(t).drop("label"), "vec_id", components=2)


@query("reduce_lda")
def _(t: Tables):
    return reduction.lda(vectors(t), "vec_id", "label", components=2)


@query("component_info")
def _(t: Tables):
    return reduction.component_info(vectors(t).drop("vec_id", "label"))


@query(
    "pca_variance",
    """with v as (select cast(embedding[1] as double) as a, cast(embedding[2] as double) as b from embeddings), c as (select corr(a, b) as r from v)
    select 1 as component, round(1 + abs(r), 6) as variance, round((1 + abs(r)) / 2, 6) as ratio from c union all select 2, round(1 - abs(r), 6), round((1 - abs(r)) / 2, 6) from c""",
)
def _(t: Tables):
    return rounded(reduction.component_info(vectors(t, 2).select("e0", "e1")).select("component", "variance", "ratio"))


@query("reduce_compare")
def _(t: Tables):
    return reduction.compare(vectors(t).drop("label"), "vec_id")


@query("anomaly_isolation_forest")
def _(t: Tables):
    return anomaly.isolation_forest(parts(t), "p_partkey", PART)


_LOF = """
    with w as (select vec_id, unnest(cast(embedding as double[])) as x, unnest(range(64)) as c from embeddings),
    z as (select vec_id, c, (x - avg(x) over (partition by c)) / stddev_samp(x) over (partition by c) as x from w),
    u as (select vec_id as i, list(x order by c) as x from z group by 1),
    d as (select a.i, b.i as j, list_distance(a.x, b.x) as d from u a join u b on a.i <> b.i),
    n as (select * from (select i, j, d, row_number() over (partition by i order by d, j) as r from d) where r <= 20), k as (select i, max(d) as kd from n group by i),
    l as (select n.i, count(*) / sum(greatest(n.d, k.kd) + 1e-10) as lrd from n join k on n.j = k.i group by n.i)
    select n.i as vec_id, round(avg(b.lrd) / any_value(a.lrd), 6) as score from n join l a on n.i = a.i join l b on n.j = b.i group by n.i
"""


@query("anomaly_local_factor", _LOF)
def _(t: Tables):
    return rounded(neighbours.local_outlier_factor(vectors(t).drop("label"), "vec_id", k=20))


@query("anomaly_local_labels")
def _(t: Tables):
    return anomaly.local_outliers(vectors(t).drop("label"), "vec_id")


@query("anomaly_one_class")
def _(t: Tables):
    return anomaly.one_class_svm(vectors(t).drop("label"), "vec_id")


@query("anomaly_one_class_boundary")
def _(t: Tables):
    return anomaly.one_class_boundary(vectors(t).drop("label"), "vec_id")


@query("anomaly_elliptic")
def _(t: Tables):
    return anomaly.elliptic_envelope(parts(t), "p_partkey", PART)


@query(
    "anomaly_mahalanobis",
    """with s as (select avg(p_size) as ma, avg(p_retailprice) as mb, stddev_samp(p_size) as sa, stddev_samp(p_retailprice) as sb, corr(p_size, p_retailprice) as r, count(*) as n from part),
    z as (select p_partkey, (p_size - ma) / sa as a, (p_retailprice - mb) / sb as b, r, n from part, s) select p_partkey, round((a * a - 2 * r * a * b + b * b) / (1 - r * r) * n / (n - 1), 6) as score from z""",
)
def _(t: Tables):
    return rounded(anomaly.elliptic_envelope(parts(t), "p_partkey", PART, steps=0).select("p_partkey", "score"))


@query("anomaly_ensemble")
def _(t: Tables):
    return anomaly.ensemble(vectors(t).drop("label"), "vec_id")


@query("anomaly_auto")
def _(t: Tables):
    return anomaly.labels(vectors(t).drop("label"), "vec_id")


@query("anomaly_compare")
def _(t: Tables):
    return anomaly.compare(parts(t), "p_partkey", PART)


@query("anomaly_summary")
def _(t: Tables):
    return anomaly.detect(parts(t), "p_partkey", "isolation_forest", PART)[1]


_KNN = """
    with v as (select vec_id as i, list_concat(cast(embedding[1:2] as double[]), cast(embedding[4:] as double[])) as x, case when vec_id % 7 <> 0 then cast(embedding[3] as double) end as z from embeddings),
    d as (select a.i, b.z, row_number() over (partition by a.i order by list_distance(a.x, b.x), b.i) as r from v a join v b on a.z is null and b.z is not null)
    select i as vec_id, round(coalesce(z, (select avg(d.z) from d where d.i = v.i and r <= 5)), 6) as e2 from v
"""


@query("impute_neighbours", _KNN)
def _(t: Tables):
    df = vectors(t).drop("label").withColumn("e2", F.when(F.col("vec_id") % 7 != 0, F.col("e2")))
    return rounded(impute(df, "knn", ALL).select("vec_id", "e2"))


_GAPPY = """
    with l as (select vec_id as i, unnest(range(64)) as c, unnest(cast(embedding as double[])) as v from embeddings),
    g as (select i, c, case when c >= 5 or (i + 3 * c) % 4 <> 0 then v end as v from l),
    d as (select a.i, b.i as j, 64 * sum((a.v - b.v) ** 2) / count(*) as d from g a join g b using (c) where a.i <> b.i and a.v is not null and b.v is not null group by all),
    n as (select q.i, q.c, b.v, row_number() over (partition by q.i, q.c order by d.d, d.j) as r from g q join d on d.i = q.i join g b on b.i = d.j and b.c = q.c where q.v is null and b.v is not null),
    f as (select i, c, avg(v) as v from n where r <= 5 group by all), z as (select g.i, g.c, coalesce(g.v, f.v) as v from g left join f on f.i = g.i and f.c = g.c where g.c < 5)
    select i as vec_id, round(max(v) filter (where c = 0), 6) as e0, round(max(v) filter (where c = 1), 6) as e1, round(max(v) filter (where c = 2), 6) as e2,
           round(max(v) filter (where c = 3), 6) as e3, round(max(v) filter (where c = 4), 6) as e4 from z group by i
"""


@query("impute_gappy_donors", _GAPPY)
def _(t: Tables):
    """Gaps in five columns at once: three in four rows are donors with gaps of their own."""
    gaps = {f"e{i}": F.when((F.col("vec_id") + 3 * i) % 4 != 0, F.col(f"e{i}")) for i in range(5)}
    df = vectors(t).drop("label").withColumns(gaps)
    return rounded(impute(df, "knn", ALL).select("vec_id", *gaps))


@query("score_batch")
def _(t: Tables):
    labelled = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    model = Pipeline(
        stages=[VectorAssembler(inputCols=["n_chars", "toxic"], outputCol="features"), LogisticRegression(maxIter=20)]
    ).fit(labelled.select(F.col("n_chars").cast("double"), F.col("toxic").cast("double"), "label"))
    return scoring.score(labelled, model, ["n_chars", "toxic"], ["doc_id"])


class MeanThreshold:
    """A stand-in for a model trained elsewhere."""

    def predict(self, x):
        return (x[:, 0] > 25).astype(float)


@query("score_foreign", "select l_orderkey, l_linenumber, (l_quantity > 25)::int::double as prediction, null::double as confidence from lineitem")
def _(t: Tables):
    return scoring.score_foreign(t.lineitem, MeanThreshold(), ["l_quantity"], ["l_orderkey", "l_linenumber"])


@query("score_summary", "select prediction, count(*) as rows from (select (l_quantity > 25)::int::double as prediction from lineitem) group by 1")
def _(t: Tables):
    scored = scoring.score_foreign(t.lineitem, MeanThreshold(), ["l_quantity"], ["l_orderkey"])
    return scoring.score_summary(scored).select("prediction", "rows")
