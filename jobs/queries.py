"""The jobs as queries: each runs twice into one new folder of the shared storage and gives what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import growing_agreement, text_regions
from rasterloom.session import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def job1_text_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "text_regions")
    for _ in range(2):
        rows = text_regions.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    return rows.withColumn("value", F.round("value", 6) + 0.0)


def job2_growing_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "growing_agreement")
    for _ in range(2):
        rows = growing_agreement.run(spark, f"{sf_dir}/documents.parquet", f"{out}/output", f"{out}/checkpoint")
    return rows.withColumn("value", F.round("value", 6) + 0.0)


#: Agreement of the contingency tables c (g, t, p, n), as (g, item, value).
_AGREEMENT = """x AS (SELECT g, sum(n)::DOUBLE AS n, sum(n*(n-1)/2.0) AS pairs, sum(n*ln(n)) AS logs FROM c GROUP BY 1),
xt AS (SELECT g, count(*) AS k, sum(m*(m-1)/2.0) AS pairs, sum(m*ln(m)) AS logs FROM (SELECT g, t, sum(n)::DOUBLE AS m FROM c GROUP BY 1, 2) GROUP BY 1),
xp AS (SELECT g, count(*) AS k, sum(m*(m-1)/2.0) AS pairs, sum(m*ln(m)) AS logs FROM (SELECT g, p, sum(n)::DOUBLE AS m FROM c GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT x.g, x.n, xt.k AS kt, xp.k AS kp, greatest(0, ln(x.n)-xt.logs/x.n) AS ht, greatest(0, ln(x.n)-xp.logs/x.n) AS hp, greatest(0, ln(x.n)+(x.logs-xt.logs-xp.logs)/x.n) AS mi,
 x.pairs AS a, xt.pairs*xp.pairs/nullif(x.n*(x.n-1)/2, 0) AS e, (xt.pairs+xp.pairs)/2 AS m FROM x JOIN xt USING (g) JOIN xp USING (g)),
z AS (SELECT g, n, kt AS k_true, kp AS k_pred, ht AS entropy_true, hp AS entropy_pred, CASE WHEN n<2 OR m=e THEN 1 ELSE (a-e)/nullif(m-e, 0) END AS ari, CASE WHEN kt=1 AND kp=1 THEN 1 WHEN kt=1 OR kp=1 THEN 0 ELSE 2*mi/(ht+hp) END AS nmi,
 CASE WHEN kt=1 THEN 1 ELSE mi/nullif(ht, 0) END AS homogeneity, CASE WHEN kp=1 THEN 1 ELSE mi/nullif(hp, 0) END AS completeness FROM y),
q AS (SELECT *, CASE WHEN homogeneity+completeness=0 THEN 0 ELSE 2*homogeneity*completeness/(homogeneity+completeness) END AS v_measure FROM z),
u AS (SELECT g, unnest(['n','k_true','k_pred','entropy_true','entropy_pred','ari','nmi','homogeneity','completeness','v_measure']) AS item, unnest([n,k_true,k_pred,entropy_true,entropy_pred,ari,nmi,homogeneity,completeness,v_measure]::DOUBLE[]) AS value FROM q)"""


def _regions_sql() -> str:
    config = text_regions.read_config()
    bands = range(len(config["letters"]))
    join = lambda form, by=", ": by.join(form.format(k=k, c=c) for k, c in enumerate(config["letters"]))
    total = join("c{k}", "+")
    own = [r for r in config["references"] if r == "lang"]
    told = " UNION ALL ".join(f"SELECT '{r}' AS g, {r}::VARCHAR AS t, region AS p FROM documents JOIN a USING (doc_id) WHERE {r} IS NOT NULL" if r in own else f"SELECT '{r}', {r}::VARCHAR, region FROM labels JOIN a USING (doc_id) WHERE {r} IS NOT NULL" for r in config["references"])
    far = "+".join(f"(z.z{k}-p.p{k})*(z.z{k}-p.p{k})" for k in bands)
    return f"""
WITH b AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS x FROM documents), h AS (SELECT id, doc_id, source, {join("length(x)-length(replace(x,'{c}','')) AS c{k}")} FROM b),
s AS (SELECT id, doc_id, source, {join(f"c{{k}}/greatest(1,{total})::DOUBLE AS v{{k}}")} FROM h), st AS (SELECT {join("avg(v{k}) AS m{k}, stddev_pop(v{k}) AS s{k}")} FROM s),
zs AS MATERIALIZED (SELECT id, doc_id, source, {join("(v{k}-m{k})/CASE WHEN s{k}<1e-8 THEN 1 ELSE s{k} END AS z{k}")} FROM s, st),
top AS (SELECT source FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, source LIMIT {config["regions"]}),
p AS (SELECT source AS region, {join("avg(z{k}) AS p{k}")} FROM zs JOIN top USING (source) GROUP BY 1),
a AS MATERIALIZED (SELECT id, z.doc_id, region, round(sqrt({far}), 6) AS distance FROM zs z, p QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, region) = 1),
r AS ({told}), c AS (SELECT g, t, p, count(*)::DOUBLE AS n FROM r GROUP BY 1, 2, 3), {_AGREEMENT},
w AS (SELECT *, sum(n) OVER (PARTITION BY g, t) AS cn, sum(n) OVER (PARTITION BY g, t ORDER BY n DESC, p ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY g, t ORDER BY n DESC, p) AS rk FROM c),
f AS (SELECT g, t, max(cn) AS class_n, min(rk) FILTER (run >= 0.9*cn-1e-9) AS fragments, max(n/cn) AS dominant_fraction, CASE WHEN count(*)<=1 THEN 0 ELSE -sum(n/cn*ln(n/cn))/ln(count(*)) END AS normalized_entropy FROM w GROUP BY 1, 2)
SELECT 'region' AS part, region AS name, doc_id::VARCHAR AS item, distance AS value FROM a
UNION ALL SELECT 'agreement', g, item, round(value, 6) FROM u
UNION ALL SELECT 'class', g, t || '/' || unnest(['class_n','fragments','dominant_fraction','normalized_entropy']), round(unnest([class_n,fragments,dominant_fraction,normalized_entropy]::DOUBLE[]), 6) FROM f"""


_GROWN = f"""
WITH l AS (SELECT lang, source, floor(log2(n_chars+1))::BIGINT::VARCHAR AS length FROM documents),
r AS (SELECT 'lang/source' AS g, lang AS t, source AS p FROM l UNION ALL SELECT 'lang/length', lang, length FROM l UNION ALL SELECT 'source/length', source, length FROM l),
c AS (SELECT g, t, p, count(*)::DOUBLE AS n FROM r WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2, 3), {_AGREEMENT}
SELECT g AS pair, 0::BIGINT AS batch, t, p, 'rows' AS item, n AS value FROM c UNION ALL SELECT g, 0, NULL, NULL, item, round(value, 6) FROM u"""

QUERIES = {"job1_text_regions": job1_text_regions, "job2_growing_agreement": job2_growing_agreement}
ORACLE = {"job1_text_regions": _regions_sql(), "job2_growing_agreement": _GROWN}
