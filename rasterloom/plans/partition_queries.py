"""Queries over partition algebra, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import partition as P
from rasterloom.plans.registry import query
from rasterloom.session import read_table


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("partition_stats", """
WITH s AS (SELECT l_partkey AS label, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k, max(n) AS top, sum(n*ln(n)) AS logs, coalesce(sum(n) FILTER (n < 20), 0) AS small FROM s)
SELECT k, round(top/total,6) AS largest_fraction, round(CASE WHEN k<=1 THEN 0 ELSE (ln(total)-logs/total)/ln(k) END,6) AS normalized_entropy, round(small/total,6) AS microcluster_mass FROM t""")
def partition_stats(spark, d):
    return P.partition_stats(read_table(spark, d, "lineitem"), "l_partkey").select("k", *_r("largest_fraction", "normalized_entropy", "microcluster_mass"))


@query("partition_diagnostics", """
WITH s AS (SELECT source AS label, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM s), u AS (SELECT n, n < 0.005*total AS tiny FROM s, t),
v AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k, max(n) AS top, sum(n*ln(n)) AS logs, coalesce(sum(n) FILTER (tiny),0) AS small, count(*) FILTER (tiny) AS tiny_clusters FROM u)
SELECT k, round(top/total,6) AS largest_fraction, round(CASE WHEN k<=1 THEN 0 ELSE (ln(total)-logs/total)/ln(k) END,6) AS normalized_entropy, round(small/total,6) AS microcluster_mass, tiny_clusters FROM v""")
def partition_diagnostics(spark, d):
    return P.partition_diagnostics(read_table(spark, d, "documents"), "source").select("k", *_r("largest_fraction", "normalized_entropy", "microcluster_mass"), "tiny_clusters")


@query("contingency", "SELECT l_returnflag AS t, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency(spark, d):
    return P.contingency(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


_SUMS = """
WITH c AS ({cells}), a AS (SELECT sum(n) AS m FROM c GROUP BY t), b AS (SELECT sum(n) AS m FROM c GROUP BY p),
s AS (SELECT (SELECT sum(n)::DOUBLE FROM c) AS n, (SELECT sum(n*(n-1)/2.0) FROM c) AS nij, (SELECT sum(m*(m-1)/2.0) FROM a) AS ai, (SELECT sum(m*(m-1)/2.0) FROM b) AS bj,
 (SELECT sum(n*ln(n)) FROM c) AS l, (SELECT sum(m*ln(m)) FROM a) AS la, (SELECT sum(m*ln(m)) FROM b) AS lb),
h AS (SELECT *, ln(n)-la/n AS ht, ln(n)-lb/n AS hp, greatest(0, ln(n)+(l-la-lb)/n) AS mi FROM s)
"""
_LINES = "SELECT l_returnflag AS t, l_linestatus AS p, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1,2"
_ORDERS = "SELECT o_orderstatus AS t, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders GROUP BY 1,2"
_DOCS = "SELECT lang AS t, source AS p, count(*)::DOUBLE AS n FROM documents GROUP BY 1,2"


@query("partition_ari", _SUMS.format(cells=_LINES) + "SELECT round((nij-ai*bj/(n*(n-1)/2))/((ai+bj)/2-ai*bj/(n*(n-1)/2)),6) AS ari FROM h")
def partition_ari(spark, d):
    return P.ari(P.contingency(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")).select(*_r("ari"))


@query("partition_nmi", _SUMS.format(cells=_ORDERS) + "SELECT round(2*mi/(ht+hp),6) AS nmi FROM h")
def partition_nmi(spark, d):
    return P.information(P.contingency(read_table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")).select(*_r("nmi"))


@query("homogeneity_completeness_v", _SUMS.format(cells=_DOCS) + "SELECT round(mi/ht,6) AS homogeneity, round(mi/hp,6) AS completeness, round(2*(mi/ht)*(mi/hp)/(mi/ht+mi/hp),6) AS v_measure FROM h")
def homogeneity(spark, d):
    return P.information(P.contingency(read_table(spark, d, "documents"), "lang", "source")).select(*_r("homogeneity", "completeness", "v_measure"))


_EMI = """, ex AS (SELECT sum(k/n*ln(n*k/(x.m*y.m))*exp(lgamma(x.m+1)+lgamma(y.m+1)+lgamma(n-x.m+1)+lgamma(n-y.m+1)-lgamma(n+1)-lgamma(k+1)-lgamma(x.m-k+1)-lgamma(y.m-k+1)-lgamma(n-x.m-y.m+k+1))) AS e
 FROM (SELECT n::DOUBLE AS n FROM s), (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY t) x, (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY p) y, LATERAL (SELECT unnest(range(greatest(1, x.m+y.m-n)::BIGINT, least(x.m, y.m)::BIGINT+1))::DOUBLE AS k) r)"""


@query("ami", _SUMS.format(cells=_DOCS) + _EMI + " SELECT round((mi-e)/((ht+hp)/2-e),6) AS ami FROM h, ex")
def ami(spark, d):
    return spark.createDataFrame([(round(P.ami(P.contingency(read_table(spark, d, "documents"), "lang", "source")), 6),)], "ami double")


@query("fragmentation", f"""
WITH c AS ({_DOCS}), w AS (SELECT *, sum(n) OVER (PARTITION BY t) AS cn, sum(n) OVER (PARTITION BY t ORDER BY n DESC, p ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY t ORDER BY n DESC, p) AS rk FROM c)
SELECT t, max(cn)::BIGINT AS class_n, min(rk) FILTER (run >= 0.9*cn-1e-9) AS fragments, round(max(n/cn),6) AS dominant_fraction, round(CASE WHEN count(*)<=1 THEN 0 ELSE -sum(n/cn*ln(n/cn))/ln(count(*)) END,6) AS normalized_entropy FROM w GROUP BY t""")
def fragmentation(spark, d):
    return P.fragmentation(P.contingency(read_table(spark, d, "documents"), "lang", "source")).select("t", "class_n", F.col("fragments").cast("long"), *_r("dominant_fraction", "normalized_entropy"))


@query("oversegmentation_counts", """
WITH r AS (SELECT label AS t, vec_id % 17 AS p FROM embeddings WHERE label <> 0), n AS (SELECT count(*) AS n FROM r), b AS (SELECT p, count(*) AS m FROM r GROUP BY p)
SELECT (SELECT count(DISTINCT t) FROM r) AS k_true, count(*) AS k_pred, count(*) - (SELECT count(DISTINCT t) FROM r) AS k_difference, max(n.n) AS n_labelled, avg(CASE WHEN m < 0.005*n.n THEN 1.0 ELSE 0.0 END) AS tiny_fraction FROM b, n""")
def oversegmentation(spark, d):
    e = read_table(spark, d, "embeddings").select("label", (F.col("vec_id") % 17).alias("p"))
    return P.oversegmentation_counts(P.contingency(e, "label", "p", 0))


@query("oversegmentation_ratios", """
WITH r AS (SELECT label AS t, vec_id % 17 AS p FROM embeddings WHERE label <> 0), c AS (SELECT t, p, count(*) AS n FROM r GROUP BY 1,2), b AS (SELECT p, max(n) AS m, sum(n) AS n FROM c GROUP BY p), k AS (SELECT count(DISTINCT t)::DOUBLE AS kt, count(DISTINCT p) AS kp FROM c)
SELECT round(17/kt,6) AS full_ratio, round(kp/kt,6) AS labelled_ratio, round(100/17.0,6) AS fine_to_final, round((SELECT sum(m)/sum(n) FROM b),6) AS purity FROM k""")
def oversegmentation_ratios(spark, d):
    e = read_table(spark, d, "embeddings").select("label", (F.col("vec_id") % 17).alias("p"))
    return P.oversegmentation_ratios(P.contingency(e, "label", "p", 0), 100, 17).select(*_r("full_ratio", "labelled_ratio", "fine_to_final", "purity"))


@query("noise_accounting", """
WITH d AS (SELECT lang, CASE WHEN n_chars < 500 THEN -1 ELSE n_chars % 7 END AS l FROM documents)
SELECT round(avg((l=-1)::INT),6) AS noise_fraction, round(avg((l=-1)::INT) FILTER (lang <> 'en'),6) AS noise_fraction_labelled, count(DISTINCT l) FILTER (l <> -1) AS n_clusters FROM d""")
def noise_accounting(spark, d):
    rows = read_table(spark, d, "documents").select("lang", F.when(F.col("n_chars") < 500, -1).otherwise(F.col("n_chars") % 7).alias("l"))
    return P.noise_accounting(rows, "l", F.col("lang") != "en").select(*_r("noise_fraction", "noise_fraction_labelled"), "n_clusters")


@query("hungarian_eval_small", f"""
WITH c AS ({_LINES}), p AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT p FROM c)), t AS (SELECT t, sum(n) AS size FROM c GROUP BY 1), w AS (SELECT sum(n) AS n FROM c),
h AS (SELECT t.t, p.k, coalesce(n,0) AS n FROM t CROSS JOIN p LEFT JOIN c ON c.t=t.t AND c.p=p.p), z AS (SELECT k, sum(n) AS m FROM h GROUP BY 1),
m AS (SELECT a.t AS t1, b.t AS t2, a.n AS n1, b.n AS n2 FROM h a JOIN h b ON a.k=1 AND b.k=2 AND a.t<>b.t ORDER BY a.n+b.n DESC LIMIT 1),
e AS (SELECT (n1+n2)/w.n AS oa, (n1/(SELECT size FROM t WHERE t=t1)+n2/(SELECT size FROM t WHERE t=t2))/(SELECT count(*) FROM t) AS ba, ((SELECT size FROM t WHERE t=t1)*(SELECT m FROM z WHERE k=1)+(SELECT size FROM t WHERE t=t2)*(SELECT m FROM z WHERE k=2))/(w.n*w.n) AS pe FROM m, w)
SELECT round(oa,6) AS overall_accuracy, round(ba,6) AS balanced_accuracy, round((oa-pe)/(1-pe),6) AS kappa FROM e""")
def hungarian_small(spark, d):
    e = P.evaluate(read_table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", None)
    return spark.createDataFrame([tuple(round(e[k], 6) for k in ("overall_accuracy", "balanced_accuracy", "kappa"))], "overall_accuracy double, balanced_accuracy double, kappa double")


def _matched(clusters):
    """The largest overlap of a one-to-one matching, cluster by cluster over all sets of classes used."""
    sql = f"WITH c AS (SELECT label AS t, vec_id % {clusters} AS p, count(*) AS n FROM embeddings WHERE label <> 0 GROUP BY 1, 2), k AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS bit FROM (SELECT DISTINCT t FROM c)), d0 AS (SELECT 0::BIGINT AS used, 0::HUGEINT AS hit)"
    for p in range(clusters):
        sql += f", d{p + 1} AS MATERIALIZED (SELECT used, max(hit) AS hit FROM (SELECT used, hit FROM d{p} UNION ALL SELECT used | (1 << bit), hit + n FROM d{p}, c JOIN k USING (t) WHERE p = {p} AND (used >> bit) & 1 = 0) GROUP BY 1)"
    return sql + f" SELECT round((SELECT max(hit) FROM d{clusters})/sum(n),6) AS overall_accuracy FROM c"


@query("hungarian_eval", _matched(17))
def hungarian_eval(spark, d):
    e = P.evaluate(read_table(spark, d, "embeddings").select("label", (F.col("vec_id") % 17).cast("int").alias("p")), "label", "p", 0)
    return spark.createDataFrame([(round(e["overall_accuracy"], 6),)], "overall_accuracy double")


@query("mean_pairwise_ari", """
WITH l AS (SELECT r.r AS run, vec_id AS i, (vec_id * (r.r + 2) + label) % 5 AS l FROM embeddings, (SELECT unnest([0,1,2]) AS r) r),
c AS (SELECT a.run AS a, b.run AS b, a.l AS t, b.l AS p, count(*)::DOUBLE AS n FROM l a JOIN l b ON a.i=b.i AND a.run<b.run GROUP BY 1,2,3,4),
s AS (SELECT a, b, sum(n) AS n, sum(n*(n-1)/2) AS nij FROM c GROUP BY 1,2), x AS (SELECT a,b,sum(m*(m-1)/2) AS ai FROM (SELECT a,b,t,sum(n) AS m FROM c GROUP BY 1,2,3) GROUP BY 1,2), y AS (SELECT a,b,sum(m*(m-1)/2) AS bj FROM (SELECT a,b,p,sum(n) AS m FROM c GROUP BY 1,2,3) GROUP BY 1,2)
SELECT round(avg((nij-ai*bj/(n*(n-1)/2))/((ai+bj)/2-ai*bj/(n*(n-1)/2))),6) AS mean_ari FROM s JOIN x USING(a,b) JOIN y USING(a,b)""")
def mean_pairwise(spark, d):
    e = read_table(spark, d, "embeddings").withColumn("run", F.explode(F.array(*map(F.lit, range(3)))))
    rows = e.select("run", F.col("vec_id").alias("i"), ((F.col("vec_id") * (F.col("run") + 2) + F.col("label")) % 5).alias("l"))
    return P.mean_pairwise_ari(rows, "run", "i", "l").select(*_r("mean_ari"))
