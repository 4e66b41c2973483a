"""Queries over whole runs, baselines and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import baselines as B
from rasterloom.operators import graph as G
from rasterloom.operators import modes as M
from rasterloom.operators import partition as P
from rasterloom.operators import scene as S
from rasterloom.operators import study as R
from rasterloom.plans import graph_queries
from rasterloom.plans.registry import query
from rasterloom.session import materialise, read_table
from rasterloom.sources import files as X
from rasterloom.streaming.contingency import contingency_of_files

#: The scene made of `embeddings` has no spatial structure, so its modes need a wide radius.
CONFIG = R.Configuration(pca_components=20, k=12, window_radius=5, checkpoint=25, fine_radius=1.6, filter_radius=1)


SCENE, D2 = graph_queries._SCENE, graph_queries._D2
consolidation_sql = graph_queries.consolidation_sql


def _pixels(spark, d):
    return S.scene_from_vectors(read_table(spark, d, "embeddings"), label=None)


@query("region_discovery_t25")
def region_discovery(spark, d):
    return R.discover(_pixels(spark, d), CONFIG)


@query("region_evaluation")
def region_evaluation(spark, d):
    """Labels are read only after the partition is locked."""
    labels = R.discover(_pixels(spark, d), CONFIG).select("i", "label")
    R.check_lock(R.lock(CONFIG, labels), CONFIG, labels)
    truth = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("gt"))
    e = P.evaluate(labels.join(truth, "i"), "gt", "label", 0)
    keys = ["overall_accuracy", "balanced_accuracy", "kappa", "nmi", "ari", "ami", "homogeneity", "completeness", "v_measure"]
    return spark.createDataFrame([tuple(float(e[k]) for k in keys)], ", ".join(f"{k} double" for k in keys))


TAUS, BETAS = (0.0, 0.2, 0.3, 0.4, 0.5, 1.0), (0.0, 0.5)
_SURFACE = consolidation_sql([(b, t) for b in BETAS for t in TAUS], 39) + """, z AS (SELECT beta, tau, rank() OVER (PARTITION BY beta ORDER BY tau) - 1 AS tau_index, mode, grp, n FROM gr JOIN g USING (q)), y AS (SELECT beta, tau, dense_rank() OVER (PARTITION BY beta ORDER BY tau) - 1 AS tau_index, mode, grp, n FROM gr JOIN g USING (q)),
 zs AS (SELECT beta, tau, tau_index, grp, sum(n) AS n FROM y GROUP BY ALL), st AS (SELECT beta, tau, tau_index, count(*) AS k, max(n)/sum(n) AS largest, CASE WHEN count(*)<=1 THEN 0 ELSE (ln(sum(n))-sum(n*ln(n))/sum(n))/ln(count(*)) END AS entropy, sum(n*(n-1)/2) AS pairs, sum(n) AS total FROM zs GROUP BY ALL),
 ce AS (SELECT b.beta, b.tau_index, a.grp AS t, b.grp AS p, sum(b.n) AS n FROM y a JOIN y b ON b.beta=a.beta AND b.mode=a.mode AND b.tau_index=a.tau_index+1 GROUP BY ALL), nj AS (SELECT beta, tau_index, sum(n*(n-1)/2) AS s FROM ce GROUP BY ALL),
 ar AS (SELECT x.beta, x.tau, x.tau_index, x.k, x.largest, x.entropy, 1-x.k/40.0 AS compression, CASE WHEN (x.pairs+w.pairs)/2 = x.pairs*w.pairs/(x.total*(x.total-1)/2) THEN 1 ELSE (s-x.pairs*w.pairs/(x.total*(x.total-1)/2))/((x.pairs+w.pairs)/2-x.pairs*w.pairs/(x.total*(x.total-1)/2)) END AS ari_prev FROM st x LEFT JOIN st w ON w.beta=x.beta AND w.tau_index=x.tau_index-1 LEFT JOIN nj ON nj.beta=x.beta AND nj.tau_index=x.tau_index)
 SELECT beta, tau, tau_index, k, round(largest,6) AS largest, round(entropy,6) AS entropy, round(compression,6) AS compression, round(ari_prev,6) AS ari_prev, round(greatest(ari_prev, lead(ari_prev) OVER (PARTITION BY beta ORDER BY tau)),6) AS stability FROM ar"""


@query("tau_surface", _SURFACE)
def tau_surface(spark, d):
    s = _pixels(spark, d)
    rows = R.tau_surface(s.select("i", "v"), s.select("i", (F.col("i") % 40).alias("label")), TAUS, BETAS)
    return rows.select("beta", "tau", F.col("tau_index").cast("long"), "k", *[F.round(c, 6).alias(c) for c in ("largest", "entropy", "compression", "ari_prev", "stability")])


def _merged_sql(left):
    sql = consolidation_sql([(0.0, 0.0)], 0).partition(", r0 AS")[0] + ", h0 AS MATERIALIZED (SELECT mode, mode AS grp FROM n0)"
    for k in range(40 - left):
        raw = f"sqrt({D2.format(a='a.mu', b='b.mu')})"
        sql += f""", p{k} AS MATERIALIZED (SELECT a.mode AS a, b.mode AS b FROM n{k} a JOIN n{k} b ON a.mode<b.mode ORDER BY {raw}/greatest(sqrt((a.disp*a.disp+b.disp*b.disp)/2),1e-8), a.mode, b.mode LIMIT 1),
 t{k} AS MATERIALIZED (SELECT coalesce(p.a, m.mode) AS into_, m.* FROM n{k} m LEFT JOIN p{k} p ON p.b=m.mode), l{k} AS (SELECT into_, list(u ORDER BY k) AS mu FROM (SELECT into_, i AS k, sum(n*mu[i])/sum(n) AS u FROM t{k}, range(1,65) r(i) GROUP BY 1,2) GROUP BY 1),
 o{k} AS (SELECT into_, sum(n) AS n, sum(n*(disp*disp+list_sum(list_transform(mu, lambda z: z*z))))/sum(n) AS e, count(*) AS parts, any_value(disp) AS disp FROM t{k} GROUP BY 1),
 n{k + 1} AS MATERIALIZED (SELECT o.into_ AS mode, l.mu, CASE WHEN parts=1 THEN o.disp ELSE sqrt(greatest(e-list_sum(list_transform(l.mu, lambda z: z*z)),0)) END AS disp, o.n FROM o{k} o JOIN l{k} l USING (into_)),
 h{k + 1} AS MATERIALIZED (SELECT h.mode, coalesce(p.a, h.grp) AS grp FROM h{k} h LEFT JOIN p{k} p ON p.b=h.grp)"""
    return sql + f" SELECT sc.i, dense_rank() OVER (ORDER BY grp) - 1 AS label FROM sc JOIN h{40 - left} h ON h.mode=sc.i%40"


@query("merge_to_k", _merged_sql(9))
def merge_to_k(spark, d):
    s = _pixels(spark, d)
    return R.merge_to(s.select("i", "v"), s.select("i", (F.col("i") % 40).alias("label")), 9)


_HEX = "('0x' || substr(md5({text}), {at}, 8))::BIGINT"
_NOISE = SCENE + f""", st AS (SELECT k, stddev_pop(v[k]) AS s FROM sc, range(1,65) r(k) GROUP BY k), u AS (SELECT i, k, v[k] AS v, s, ({_HEX.format(text="concat('1:', i, ':', k-1)", at=1)}+0.5)/4294967296.0 AS u1, ({_HEX.format(text="concat('1:', i, ':', k-1)", at=9)}+0.5)/4294967296.0 AS u2 FROM sc JOIN st ON true),
 w AS (SELECT i, v+0.01*s*sqrt(-2*ln(u1))*cos(2*pi()*u2) AS v FROM u) SELECT i, round(sum(v),6) AS total, round(sum(v*v),6) AS norm2 FROM w GROUP BY 1"""


def _digest(df):
    return df.select("i", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"))


@query("perturb_noise", _NOISE)
def perturb_noise(spark, d):
    return _digest(R.add_noise(_pixels(spark, d)))


@query("perturb_replace", SCENE + f""", w AS (SELECT *, row_number() OVER (ORDER BY i)-1 AS at, count(*) OVER () AS n FROM sc), x AS (SELECT a.i, CASE WHEN {_HEX.format(text="concat('1:', a.i)", at=1)} < CAST(floor(0.05*4294967296) AS BIGINT) THEN b.v ELSE a.v END AS v FROM w a JOIN w b ON b.at=(a.at+1+7919%(a.n-1))%a.n)
 SELECT i, round(list_sum(v),6) AS total, round(list_sum(list_transform(v, lambda z: z*z)),6) AS norm2 FROM x""")
def perturb_replace(spark, d):
    return _digest(R.replace_pixels(_pixels(spark, d)))


# Variants of the base run, each with the entries that differ, as the protocol has them.
_VARIANTS = [
    ("ablation", "full", ""), ("ablation", "graph_no_mutual_gate", "mutual=false min_degree=0"), ("ablation", "graph_no_spatial_affinity", "use_spatial_affinity=false"),
    ("ablation", "diffusion_T0", "checkpoint=0"), ("ablation", "mode_no_spatial_cleanup", "filter_radius=0"), ("ablation", "mode_no_fine_grouping", "disable_fine_grouping=true filter_radius=0"),
    ("ablation", "consolidation_disabled", "disable_consolidation=true"), ("ablation", "consolidation_no_size_weighting", "size_exponent=0.0"),
    *[("sensitivity", f"window_radius={w}", f"window_radius={w}") for w in (3, 5, 7, 9)], *[("sensitivity", f"pca_components={c}", f"pca_components={c}") for c in (10, 20, 30, 40)],
    *[("sensitivity", f"checkpoint={t}", f"checkpoint={t}") for t in (6, 12, 25, 50)], *[("sensitivity", f"fine_radius={r}", f"fine_radius={r}") for r in (0.8, 1.2, 1.6, 2, 2.4)],
]
_BASE = {"alpha": "0.5", "checkpoint": "25", "disable_consolidation": "false", "disable_fine_grouping": "false", "filter_radius": "1", "fine_radius": "1.6", "k": "12", "max_neighbors": "50", "merge_components": "10", "min_degree": "4", "mutual": "true", "pca_components": "20", "prototype_neighbors": "30", "prototype_threshold": "0.75", "size_exponent": "0.5", "use_spatial_affinity": "true", "window_radius": "5"}


def _variants_sql():
    rows = []
    for study, variant, changes in _VARIANTS:
        entries = _BASE | dict(c.split("=") for c in changes.split())
        entries["fine_radius"] = str(float(entries["fine_radius"]))
        rows.append(f"('{study}', '{variant}', '" + "{" + ",".join(f'"{k}":{v}' for k, v in entries.items()) + "}')")
    return f"SELECT n_name AS scene, study, variant, sha256(config) AS protocol_sha256 FROM nation, (VALUES {', '.join(rows)}) t(study, variant, config)"


@query("configuration_grid", _variants_sql())
def configuration_grid(spark, d):
    """Every variant of every scene (a nation each), with the fingerprint that its results are cached under."""
    runs = [("ablation", n, R.canonical_sha(R.asdict(c))) for n, c in R.ablations(CONFIG).items()] + [("sensitivity", n, R.canonical_sha(R.asdict(c))) for n, c in R.sensitivity(CONFIG).items()]
    grid = spark.createDataFrame(runs, "study string, variant string, protocol_sha256 string")
    return read_table(spark, d, "nation").select(F.col("n_name").alias("scene")).crossJoin(F.broadcast(grid))  # 25 variants


@query("repeatability", """WITH r AS (SELECT vec_id AS i, label AS gt, greatest(vec_id % 12, 3) AS t, greatest(vec_id % 12, 4) AS p FROM embeddings),
 c AS (SELECT t, p, count(*) AS n, count(*) FILTER (gt<>0) AS m FROM r GROUP BY 1,2), a AS (SELECT t, sum(n) AS n, sum(m) AS m FROM c GROUP BY 1), b AS (SELECT p, sum(n) AS n, sum(m) AS m FROM c GROUP BY 1),
 s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(m) FROM c) AS m, (SELECT sum(n*(n-1)/2.0) FROM c) AS x, (SELECT sum(n*(n-1)/2.0) FROM a) AS y, (SELECT sum(n*(n-1)/2.0) FROM b) AS z, (SELECT sum(m*(m-1)/2.0) FROM c) AS xm, (SELECT sum(m*(m-1)/2.0) FROM a) AS ym, (SELECT sum(m*(m-1)/2.0) FROM b) AS zm, (SELECT count(*) FROM a) AS k_a, (SELECT count(*) FROM b) AS k_b)
 SELECT n::BIGINT AS n, k_a, k_b, k_b-k_a AS k_difference, m::BIGINT AS n_labelled, round((x-y*z/(n*(n-1)/2))/((y+z)/2-y*z/(n*(n-1)/2)),6) AS ari, round((xm-ym*zm/(m*(m-1)/2))/((ym+zm)/2-ym*zm/(m*(m-1)/2)),6) AS ari_labelled FROM s""")
def repeatability(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("gt"))
    run = lambda least: e.select("i", F.greatest(F.col("i") % 12, F.lit(least)).alias("label"))
    r = R.repeatability(run(3), run(4), e)
    return r.select("n", "k_a", "k_b", "k_difference", "n_labelled", F.round("ari", 6).alias("ari"), F.round("ari_labelled", 6).alias("ari_labelled"))


@query("resume_antijoin", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def resume_antijoin(spark, d):
    done = read_table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("k"))
    return R.remaining(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), done, ["k"])


def _features(spark, d):
    return B.features(_pixels(spark, d))


@query("baseline_features", SCENE + ", st AS (SELECT k, avg(v[k]) AS m, stddev_pop(v[k]) AS s FROM sc, range(1,65) r(k) GROUP BY k) SELECT i, round(sum(((v[k]-m)/s)*((v[k]-m)/s)),5) AS norm2 FROM sc JOIN st ON true GROUP BY i")
def baseline_features(spark, d):
    """P5 at full rank, where scores keep the scaled vector's length; truncation is tested against numpy."""
    return B.features(_pixels(spark, d), 64).select("i", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2"))


@query("kmeans_baseline")
def kmeans_baseline(spark, d):
    return B.kmeans(_features(spark, d), 9)


@query("minibatch_kmeans_baseline")
def minibatch_baseline(spark, d):
    return B.minibatch_kmeans(_features(spark, d), 9)


@query("fcm_baseline")
def fcm_baseline(spark, d):
    return B.fuzzy_cmeans(_features(spark, d), 9)


@query("slic_kmeans_baseline")
def slic_baseline(spark, d):
    return B.slic_kmeans(_features(spark, d), 4, size=25)


@query("hdbscan_baseline")
def hdbscan_baseline(spark, d):
    return B.hdbscan(_features(spark, d).select("i", "v"), k=10)


def _graph(spark, d):
    s = S.zscore(_pixels(spark, d))
    e = materialise(G.spectral_edges(G.build_graph(s, pca_components=None, k=8, window_radius=3), s))
    return materialise(G.affinities(e).select("i", "j", "w"))


@query("leiden_baseline")
def leiden_baseline(spark, d):
    return B.communities(_graph(spark, d))


@query("leiden_protocol")
def leiden_protocol(spark, d):
    """Communities of every evaluation seed at the resolution that the protocol's grid and selection seeds point to."""
    chosen, _, labels = B.leiden_selected(materialise(_graph(spark, d)))
    return labels.select(F.lit(float(chosen)).alias("resolution"), "seed", "i", "label")


@query("count_matched_baseline")
def count_matched_baseline(spark, d):
    """As many clusters as another partition has over the labelled pixels."""
    e = read_table(spark, d, "embeddings")
    other = e.select(F.col("vec_id").alias("i"), (F.col("vec_id") % 7).alias("label"))
    return B.count_matched(_features(spark, d), None, "minibatch", partition=other, support=e.where("label <> 0").select(F.col("vec_id").alias("i")))


@query("undirected_dedupe", "SELECT DISTINCT least(l_partkey, l_suppkey) AS i, greatest(l_partkey, l_suppkey) AS j FROM lineitem WHERE l_partkey <> l_suppkey")
def undirected_dedupe(spark, d):
    e = read_table(spark, d, "lineitem").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"))
    return G.undirected_edges(e)


@query("dense_numbers", "SELECT o_custkey AS c, dense_rank() OVER (ORDER BY o_custkey) - 1 AS label FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_numbers(spark, d):
    return M.dense_numbers(read_table(spark, d, "orders").select(F.col("o_custkey").alias("c")).distinct(), "c")


@query("table_export", "SELECT o_orderpriority AS dataset, o_orderstatus AS method, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2")
def table_export(spark, d):
    rows = read_table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method")).agg(F.count("*").alias("n"))
    return X.export_table(rows, ["F", "O"], order=["1-URGENT", "2-HIGH"])


@query("key_differences", "(SELECT DISTINCT c_custkey AS k, 'first' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) UNION ALL (SELECT k, 'both' AS side FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders))")
def key_differences(spark, d):
    c, o = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k")), read_table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return R.key_differences(c, o)


@query("union_of_columns", "SELECT r_name AS name, r_regionkey AS region, -1 AS nation FROM region UNION ALL SELECT n_name, -1, n_nationkey FROM nation")
def union_of_columns(spark, d):
    a = read_table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    b = read_table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"))
    return X.union_of_rows([a, b]).fillna(-1)


@query("tolerance_compare", "SELECT l_orderkey, l_linenumber, abs(round(l_extendedprice,1)-l_extendedprice) <= 1e-12 AS same FROM lineitem")
def tolerance_compare(spark, d):
    p = F.col("l_extendedprice")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.agrees(F.round(p, 1), p).alias("same"))


@query("file_classes", """WITH f AS (SELECT url AS path, page_id*9973 AS size, regexp_extract(lower(url), '[^/]([.][^./]+)$', 1) AS suffix, string_split(lower(url), '/') AS parts FROM pages)
 SELECT path, CASE WHEN string_split(path, '/')[1]='release' THEN 'included_release' WHEN size >= 26214400 THEN 'large_excluded' WHEN suffix IN ('.mat','.bsq','.hdr','.tif','.tiff') OR list_contains(parts,'data') THEN 'third_party_or_raw_data'
 WHEN list_has_any(parts, ['__pycache__','node_modules','.cache','tmp']) OR suffix IN ('.pyc','.log','.aux','.out') THEN 'temporary_or_build' WHEN suffix='.zip' THEN 'historical_archive' WHEN suffix='.ipynb' THEN 'historical_notebook' WHEN suffix IN ('.py','.json','.yaml','.yml','.csv','.md','.txt','.npy','.png') THEN 'supplied_code_or_output' ELSE 'other_excluded' END AS category FROM f""")
def file_classes(spark, d):
    """P13 over the paths of the pages, with sizes of their numbers."""
    p = read_table(spark, d, "pages").select(F.col("url").alias("path"), (F.col("page_id") * 9973).alias("size"))
    return p.select("path", X.file_class(F.col("path"), F.col("size")).alias("category"))


@query("file_manifest")
def file_manifest(spark, d):
    return X.manifest(spark, d)


_METHODS = ("PCA-KMeans", "MiniBatch-KMeans", "FCM", "SLIC-KMeans", "DLSS", "S2DL")


@query("fairness_table", f"WITH m AS (SELECT unnest({list(_METHODS)!r}) AS method, unnest(range(1, 7)) AS k UNION ALL SELECT 'region discovery', -1), r AS (SELECT user_id % 7 AS k, count(*) AS n_runs, count(DISTINCT event_id % 5) AS n_seeds FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT method, CASE WHEN k < 0 THEN 'no' ELSE 'yes' END AS \"receives_true_K\", coalesce(n_runs, 0) AS n_runs, coalesce(n_seeds, 0) AS n_seeds FROM m LEFT JOIN r USING (k)")
def fairness_table(spark, d):
    """R10 with the runs that the events stand for: a user's number names the method, an event's the seed; errors are no runs."""
    e = read_table(spark, d, "events").where("event_type <> 'error'")
    runs = e.select(F.element_at(F.array(*map(F.lit, ("none", *_METHODS))), (F.col("user_id") % 7 + 1).cast("int")).alias("method"), (F.col("event_id") % 5).alias("seed"))
    return X.fairness(spark, runs).select("method", "receives_true_K", "n_runs", "n_seeds")


@query("incremental_contingency", "SELECT event_type AS t, CAST(user_id % 10 AS BIGINT) AS p, count(*) AS n FROM events GROUP BY 1, 2")
def incremental_contingency(spark, d):
    return contingency_of_files(spark, f"{d}/events.parquet", F.col("event_type"), (F.col("user_id") % 10).cast("long"))
