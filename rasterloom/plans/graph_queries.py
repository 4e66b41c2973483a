"""Queries over the scene made of `embeddings`, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions.vector import rounded
from rasterloom.operators import diffusion as D
from rasterloom.operators import graph as G
from rasterloom.operators import linkage as L
from rasterloom.operators import modes as M
from rasterloom.operators import prototypes as T
from rasterloom.operators import scene as S
from rasterloom.operators.automatic import states
from rasterloom.operators.spatial import majority_filter
from rasterloom.plans.registry import query
from rasterloom.session import materialise, read_table
from rasterloom.sources import scenes

RADIUS, K, LEAST = 3, 10, 4

_SCENE = """
WITH RECURSIVE sc AS (SELECT vec_id AS i, CAST(vec_id // w AS BIGINT) AS y, vec_id % w AS x, list_transform(embedding, lambda z: z::DOUBLE) AS v, label AS gt
 FROM embeddings, (SELECT CAST(round(sqrt(1.25*count(*))) AS BIGINT) AS w FROM embeddings))"""
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]-z[2])*(z[1]-z[2])))"
_CAND = _SCENE + f""", cand AS (SELECT a.i, b.i AS j, {_D2.format(a="a.v", b="b.v")} AS d2 FROM sc a JOIN sc b ON abs(a.y-b.y)<={RADIUS} AND abs(a.x-b.x)<={RADIUS} AND a.i<>b.i)"""
_TOP = _CAND + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM cand) WHERE rank <= {K})"""
_MUT = _TOP + """, mut AS (SELECT i, j FROM top a WHERE EXISTS (SELECT 1 FROM top b WHERE b.i=a.j AND b.j=a.i))"""
_REP = _MUT + f""", deg AS (SELECT t.i, count(m.j) AS deg FROM (SELECT DISTINCT i FROM top) t LEFT JOIN mut m ON m.i=t.i GROUP BY 1),
 miss AS (SELECT t.i, t.j, deg, row_number() OVER (PARTITION BY t.i ORDER BY rank) AS n FROM top t JOIN deg ON deg.i=t.i AND deg < {LEAST} WHERE NOT EXISTS (SELECT 1 FROM mut m WHERE m.i=t.i AND m.j=t.j)),
 add_ AS (SELECT i, j FROM miss WHERE n <= {LEAST}-deg), rep AS (SELECT i, j FROM mut UNION SELECT i, j FROM add_ UNION SELECT j, i FROM add_)"""
_AFF = _REP + f""", ed AS (SELECT r.i, r.j, sqrt({_D2.format(a="a.v", b="b.v")}) AS d, sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS sp FROM rep r JOIN sc a ON a.i=r.i JOIN sc b ON b.i=r.j),
 bw AS (SELECT greatest(median(d),1e-6) AS ss, greatest(median(sp),1e-6) AS st FROM ed), aff AS (SELECT i, j, exp(-d*d/(2*ss*ss))*exp(-sp*sp/(2*st*st)) AS w FROM ed, bw)"""


def _scene(spark, d):
    return S.scene_from_vectors(read_table(spark, d, "embeddings"))


def _top(scene):
    return G.local_topk(G.window_candidates(scene, RADIUS), K, RADIUS)


def _repaired(spark, d):
    scene = _scene(spark, d)
    top = materialise(G.tiled_topk(scene, RADIUS, K))
    return scene, G.repaired_edges(top, G.mutual_edges(top), LEAST, K)


def _weighted(spark, d):
    scene, edges = _repaired(spark, d)
    full = materialise(G.spectral_edges(G.grid_edges(edges, scene), scene))
    return scene, G.affinities(full)


@query("band_stats", _SCENE + " SELECT k-1 AS band, round(avg(v[k]),6) AS mean, round(stddev_pop(v[k]),6) AS std FROM sc, range(1,65) r(k) GROUP BY k")
def band_stats(spark, d):
    return S.band_stats(_scene(spark, d)).select(F.col("band").cast("long"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("band_zscore", _SCENE + ", st AS (SELECT k, avg(v[k]) AS m, stddev_pop(v[k]) AS s FROM sc, range(1,65) r(k) GROUP BY k) SELECT i, round(sum(((v[k]-m)/CASE WHEN s<1e-8 THEN 1 ELSE s END)*((v[k]-m)/CASE WHEN s<1e-8 THEN 1 ELSE s END)),5) AS norm2, round(max((v[k]-m)/CASE WHEN s<1e-8 THEN 1 ELSE s END),5) AS top FROM sc JOIN st ON true GROUP BY i")
def band_zscore(spark, d):
    z = S.zscore(_scene(spark, d))
    return z.select("i", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 5).alias("norm2"), F.round(F.array_max("v"), 5).alias("top"))


@query("minmax_rescale", _SCENE + ", st AS (SELECT k, min(v[k]) AS lo, max(v[k]) AS hi FROM sc, range(1,6) r(k) GROUP BY k) SELECT i, round(sum((v[k]-lo)/greatest(hi-lo,1e-8)),6) AS total FROM sc JOIN st ON true GROUP BY i")
def minmax_rescale(spark, d):
    return S.minmax(_scene(spark, d)).select("i", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("scene_crop", _SCENE + " SELECT i, y, x, gt FROM sc WHERE y < 8 AND x < 8")
def scene_crop(spark, d):
    return S.crop(_scene(spark, d), 8).select("i", "y", "x", "gt")


@query("scene_facts", _SCENE + """ SELECT 'vectors' AS scene, max(y)+1 AS height, max(x)+1 AS width, 64::BIGINT AS bands, count(*) AS pixels, array_to_string(range(0, 64), ',') AS wavelengths, array_to_string(range(0, max(gt)+1), ',') AS class_names FROM sc""")
def scene_facts(spark, d):
    facts = scenes.scene_facts(_scene(spark, d), "vectors")
    return facts.withColumns({"wavelengths": F.array_join(F.transform("wavelengths", lambda w: w.cast("int").cast("string")), ","), "class_names": F.array_join("class_names", ",")})


@query("pca_scores", _SCENE + ", b AS (SELECT k, avg(v[k]) AS m FROM sc, range(1,65) r(k) GROUP BY k) SELECT i, round(sum((v[k]-m)*(v[k]-m)),5) AS norm2 FROM sc JOIN b ON true GROUP BY i")
def pca_scores(spark, d):
    """At full rank, scores keep each pixel's squared distance from the mean."""
    p = S.pca(_scene(spark, d), 64)
    return p.select("i", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x * x), 5).alias("norm2"))


@query("window_candidates", _CAND + " SELECT i, j, round(d2,6) AS d2 FROM cand")
def window_candidates(spark, d):
    return G.window_candidates(_scene(spark, d), RADIUS).select("i", "j", F.round("d2", 6).alias("d2"))


@query("local_topk", _TOP + " SELECT i, j, rank, round(d2,6) AS d2 FROM top")
def local_topk(spark, d):
    return _top(_scene(spark, d)).select("i", "j", F.col("rank").cast("long"), F.round("d2", 6).alias("d2"))


@query("tiled_topk", _TOP + " SELECT i, j, rank, round(d2,6) AS d2 FROM top")
def tiled_topk(spark, d):
    return G.tiled_topk(_scene(spark, d), RADIUS, K, tile=8).select("i", "j", F.col("rank").cast("long"), F.round("d2", 6).alias("d2"))


@query("mutual_edges", _MUT + " SELECT i, j FROM mut")
def mutual_edges(spark, d):
    return G.mutual_edges(materialise(G.tiled_topk(_scene(spark, d), RADIUS, K)))


@query("union_edges", _TOP + " SELECT i, j FROM top UNION SELECT j, i FROM top")
def union_edges(spark, d):
    return G.union_edges(materialise(G.tiled_topk(_scene(spark, d), RADIUS, K)))


@query("repaired_edges", _REP + " SELECT i, j FROM rep")
def repaired_edges(spark, d):
    return _repaired(spark, d)[1]


@query("bandwidths", _AFF + " SELECT round(ss,6) AS sigma_spectral, round(st,6) AS sigma_spatial FROM bw")
def bandwidths(spark, d):
    scene, edges = _repaired(spark, d)
    return G.bandwidths(materialise(G.spectral_edges(G.grid_edges(edges, scene), scene).select("d", "sp"))).select(F.round("sigma_spectral", 6).alias("sigma_spectral"), F.round("sigma_spatial", 6).alias("sigma_spatial"))


@query("affinity_edges", _AFF + " SELECT i, j, round(w,6) AS w FROM aff")
def affinity_edges(spark, d):
    return _weighted(spark, d)[1].select("i", "j", F.round("w", 6).alias("w"))


@query("transition_rows", _AFF + " SELECT i, j, round(w/sum(w) OVER (PARTITION BY i),6) AS p FROM aff")
def transition_rows(spark, d):
    return G.transition_rows(_weighted(spark, d)[1]).select("i", "j", F.round("p", 6).alias("p"))


@query("degree_stats", _REP + ", dg AS (SELECT sc.i, count(rep.j) AS deg FROM sc LEFT JOIN rep ON rep.i=sc.i GROUP BY 1) SELECT min(deg) AS degree_min, median(deg) AS degree_median, quantile_cont(deg,0.9) AS degree_p90, max(deg) AS degree_max, count(*) FILTER (deg=0) AS isolated_nodes FROM dg")
def degree_stats(spark, d):
    scene, edges = _repaired(spark, d)
    return G.degree_stats(edges, scene)


def _unrolled(t):
    sql = _AFF + ", tr AS (SELECT i, j, w/sum(w) OVER (PARTITION BY i) AS p FROM aff), y0 AS (SELECT i, k, v[k] AS u FROM sc, range(1,65) r(k))"
    for n in range(1, t + 1):
        sql += f", y{n} AS (SELECT a.i, a.k, 0.5*any_value(a.u)+0.5*sum(tr.p*b.u) AS u FROM y{n - 1} a JOIN tr ON tr.i=a.i JOIN y{n - 1} b ON b.i=tr.j AND b.k=a.k GROUP BY 1,2)"
    return sql


def _state(scene):
    return scene.select("i", F.col("v").alias("y"), F.col("v").alias("x0"))


def _digest(state):
    return state.select("i", F.round(F.aggregate("y", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


@query("diffusion_step", _unrolled(1) + " SELECT i, round(sum(u),6) AS total, round(sum(u*u),6) AS norm2 FROM y1 GROUP BY i")
def diffusion_step(spark, d):
    scene, edges = _weighted(spark, d)
    return _digest(D.diffusion_step(_state(scene), edges))


@query("diffusion_t3", _unrolled(3) + " SELECT i, round(sum(u),6) AS total, round(sum(u*u),6) AS norm2 FROM y3 GROUP BY i")
def diffusion_t3(spark, d):
    scene, edges = _weighted(spark, d)
    return _digest(D.diffuse(scene, edges, max_iter=3, tol=0.0)[0])


@query("movement", _unrolled(1) + " SELECT round(max(m),6) AS movement FROM (SELECT sqrt(sum((a.u-b.u)*(a.u-b.u))) AS m FROM y0 a JOIN y1 b ON a.i=b.i AND a.k=b.k GROUP BY a.i)")
def movement(spark, d):
    scene, edges = _weighted(spark, d)
    edges = materialise(edges)
    return D.movement(_state(scene), D.diffusion_step(_state(scene), edges)).select(F.round("movement", 6).alias("movement"))


def _powers():
    """The damped step as a matrix, squared again and again; 25, 50 and 100 rounds are products of its powers."""
    sql = _AFF + """, al AS MATERIALIZED (SELECT i, j, 0.5*w/sum(w) OVER (PARTITION BY i) AS a FROM aff), p1 AS MATERIALIZED (SELECT i, j, sum(a) AS a FROM (SELECT * FROM al UNION ALL SELECT i, i, CASE WHEN i IN (SELECT i FROM al) THEN 0.5 ELSE 1.0 END FROM sc) GROUP BY 1, 2)"""
    for n in (2, 4, 8, 16, 32, 64):
        sql += f", p{n} AS MATERIALIZED (SELECT x.i, y.j, sum(x.a*y.a) AS a FROM p{n // 2} x JOIN p{n // 2} y ON y.i=x.j GROUP BY 1, 2)"
    sql += ", s0 AS MATERIALIZED (SELECT i, k, v[k] AS u FROM sc, range(1,65) r(k))"
    for t, parts in ((25, (16, 8, 1)), (50, (32, 16, 2)), (100, (64, 32, 4))):
        before = "s0"
        for n in parts:
            sql += f", s{t}_{n} AS MATERIALIZED (SELECT p.i, s.k, sum(p.a*s.u) AS u FROM p{n} p JOIN {before} s ON s.i=p.j GROUP BY 1, 2)"
            before = f"s{t}_{n}"
    return sql + " SELECT t, i, round(sum(u),5) AS total, round(sum(u*u),5) AS norm2 FROM (SELECT 25 AS t, * FROM s25_1 UNION ALL SELECT 50, * FROM s50_2 UNION ALL SELECT 100, * FROM s100_4) GROUP BY 1, 2"


@query("diffusion_t100", _powers())
def diffusion_t100(spark, d):
    """States after 25, 50 and 100 rounds, by tiles."""
    scene, edges = _weighted(spark, d)
    at = (25, 50, 100)
    rows = [s.select(F.lit(t).alias("t"), "i", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm2")) for t, s in zip(at, states(scene, edges, at), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _shifted(rounds):
    sql = _REP + ", ed AS MATERIALIZED (SELECT r.i, r.j, sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS sp FROM rep r JOIN sc a ON a.i=r.i JOIN sc b ON b.i=r.j), z0 AS MATERIALIZED (SELECT i, v FROM sc)"
    for n in range(rounds):
        d2 = _D2.format(a="a.v", b="b.v")
        sql += f""", w{n} AS MATERIALIZED (SELECT e.i, e.j, exp(-({d2})/2.0)*exp(-e.sp*e.sp/8.0) AS w FROM ed e JOIN z{n} a ON a.i=e.i JOIN z{n} b ON b.i=e.j), m{n} AS (SELECT w.i, k, sum(w.w*b.v[k])/sum(w.w) AS u FROM w{n} w JOIN z{n} b ON b.i=w.j, range(1,65) r(k) GROUP BY 1, 2 HAVING sum(w.w) > 1e-12),
 z{n + 1} AS MATERIALIZED (SELECT a.i, list(0.5*a.v[a.k]+0.5*coalesce(u, a.v[a.k]) ORDER BY a.k) AS v FROM (SELECT i, k, v FROM z{n}, range(1,65) r(k)) a LEFT JOIN m{n} m ON m.i=a.i AND m.k=a.k GROUP BY 1)"""
    return sql + f" SELECT i, round(list_sum(v),6) AS total, round(list_sum(list_transform(v, lambda z: z*z)),6) AS norm2 FROM z{rounds}"


@query("dynamic_mean_shift", _shifted(4))
def dynamic_mean_shift(spark, d):
    scene, edges = _repaired(spark, d)
    return _digest(D.diffuse_dynamic(scene, G.grid_edges(edges, scene), sigma_spectral=1.0, sigma_spatial=2.0, max_iter=4, tol=0.0)[0])


_KNN = _SCENE + f""", kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM (SELECT a.i, b.i AS j, sqrt({_D2.format(a="a.v", b="b.v")}) AS d FROM sc a JOIN sc b ON a.i<>b.i)) WHERE rank <= 12)"""


@query("knn_global", _KNN + " SELECT i, j, rank, round(d,6) AS d FROM kn")
def knn_global(spark, d):
    return M.knn(_scene(spark, d), 12, block=200).select("i", "j", F.col("rank").cast("long"), F.round("d", 6).alias("d"))


@query("local_scale", _KNN + " SELECT round(median(d),6) AS scale FROM kn WHERE rank=10 AND d>0")
def local_scale(spark, d):
    return spark.createDataFrame([(round(M.local_scale(M.knn(_scene(spark, d), 12)), 6),)], "scale double")


@query("fine_modes", _KNN + """, e AS (SELECT i, j FROM kn WHERE d <= 1.05 UNION SELECT j, i FROM kn WHERE d <= 1.05), reach AS (SELECT i, i AS c FROM sc UNION SELECT e.j AS i, reach.c FROM reach JOIN e ON e.i=reach.i),
 m AS (SELECT i, min(c) AS c FROM reach GROUP BY i) SELECT i, dense_rank() OVER (ORDER BY c)-1 AS label FROM m""")
def fine_modes(spark, d):
    scene = _scene(spark, d)
    return M.merge_from_neighbors(M.knn(scene, 12), 1.05, scene)


@query("majority_filter", _SCENE + """, sz AS (SELECT max(y) AS h, max(x) AS w FROM sc), v AS (SELECT a.i, a.gt AS own, b.gt AS l FROM sc a, sz, range(-2,3) r(dy), range(-2,3) s(dx), sc b WHERE b.y=least(greatest(a.y+dy,0),h) AND b.x=least(greatest(a.x+dx,0),w)),
 c AS (SELECT i, l, own, count(*) AS n FROM v GROUP BY 1,2,3) SELECT i, l AS label FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY n DESC, (l=own)::INT DESC, l) AS k FROM c) WHERE k=1""")
def majority(spark, d):
    return majority_filter(_scene(spark, d), 2, "gt").select("i", "label")


_PROTO = _SCENE + """, mv AS (SELECT gt AS mode, k, avg(v[k]) AS mu, greatest(avg(v[k]*v[k])-avg(v[k])*avg(v[k]),0) AS var, count(*) AS n FROM sc, range(1,65) r(k) GROUP BY 1,2),
 mr AS (SELECT mode, list(mu ORDER BY k) AS mu, sqrt(sum(var)) AS disp, max(n) AS n FROM mv GROUP BY 1), fl AS (SELECT coalesce(quantile_cont(disp,0.25) FILTER (disp>1e-6 AND n>=5),1e-3) AS floor FROM mr),
 mo AS (SELECT mode, mu, greatest(disp,floor) AS disp, n FROM mr, fl)"""
_SEP = _PROTO + f""", ds AS (SELECT a.mode AS a, b.mode AS b, sqrt({_D2.format(a="a.mu", b="b.mu")}) AS raw, a.disp AS s, b.disp AS t FROM mo a JOIN mo b ON a.mode<>b.mode),
 se AS (SELECT a, b, raw, raw/greatest(sqrt((s*s+t*t)/2),1e-8) AS sep, row_number() OVER (PARTITION BY a ORDER BY raw, b) AS rank FROM ds), pe AS (SELECT * FROM se WHERE rank<=5),
 be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sep, raw, b) AS k FROM pe) WHERE k=1 AND sep<=3), pr AS (SELECT x.a, x.b FROM be x JOIN be y ON x.a=y.b AND x.b=y.a WHERE x.a<x.b)"""


def _modes(spark, d):
    return T.mode_prototypes(_scene(spark, d), label="gt")


@query("mode_prototypes", _PROTO + " SELECT mode, n, round(disp,6) AS disp, round(list_sum(mu),6) AS total FROM mo")
def mode_prototypes(spark, d):
    return _modes(spark, d).select("mode", "n", F.round("disp", 6).alias("disp"), F.round(F.aggregate("mu", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("dispersion_floor", _PROTO + " SELECT round(floor,6) AS floor FROM fl")
def dispersion_floor(spark, d):
    return T.dispersion_floor(T.mode_prototypes(_scene(spark, d), label="gt", floored=False)).select(F.round("floor", 6).alias("floor"))


@query("prototype_edges", _SEP + " SELECT a, b, rank, round(raw,6) AS raw, round(sep,6) AS sep FROM pe")
def prototype_edges(spark, d):
    return T.prototype_edges(materialise(_modes(spark, d)), 5).select("a", "b", F.col("rank").cast("long"), F.round("raw", 6).alias("raw"), F.round("sep", 6).alias("sep"))


@query("mutual_best_pairs", _SEP + " SELECT a, b FROM pr")
def mutual_best_pairs(spark, d):
    return T.mutual_best_pairs(T.prototype_edges(materialise(_modes(spark, d)), 5), 3.0)


@query("pooled_merge", _SEP + """, mp AS (SELECT coalesce(pr.a, mo.mode) AS to_, mo.* FROM mo LEFT JOIN pr ON pr.b=mo.mode), pk AS (SELECT to_, k, sum(n*mu[k])/sum(n) AS m FROM mp, range(1,65) r(k) GROUP BY 1,2),
 pv AS (SELECT to_, sum(m*m) AS q, sum(m) AS total FROM pk GROUP BY 1), ps AS (SELECT to_, sum(n) AS n, sum(n*(disp*disp+list_sum(list_transform(mu, lambda z: z*z))))/sum(n) AS e FROM mp GROUP BY 1)
 SELECT to_ AS mode, n::BIGINT AS n, round(sqrt(greatest(e-q,0)),6) AS disp, round(total,6) AS total FROM ps JOIN pv USING (to_)""")
def pooled_merge(spark, d):
    modes = materialise(_modes(spark, d))
    merged = T.pooled_merge(modes, T.mutual_best_pairs(T.prototype_edges(modes, 5), 3.0))
    return merged.select("mode", "n", F.round("disp", 6).alias("disp"), F.round(F.aggregate("mu", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


_FORTY = _PROTO.replace("gt AS mode", "CAST(i%40 AS BIGINT) AS mode")


def consolidation_sql(grid, rounds):
    """CTEs g (q, beta, tau) and gr (q, mode, grp, n): the reciprocal rounds written out; grid: (beta, tau) entries."""
    values = ", ".join(f"({q}, {b}, {t})" for q, (b, t) in enumerate(grid))
    sql = _FORTY + f""", g AS (SELECT q, beta::DOUBLE AS beta, tau::DOUBLE AS tau FROM (VALUES {values}) t(q, beta, tau)), n0 AS MATERIALIZED (SELECT q, beta, tau, mode, mu, disp, n::DOUBLE AS n FROM mo, g), r0 AS MATERIALIZED (SELECT q, mode, mode AS grp, n FROM n0)"""
    for k in range(rounds):
        raw = f"sqrt({_D2.format(a='a.mu', b='b.mu')})"
        sql += f""", a{k} AS MATERIALIZED (SELECT *, CASE WHEN beta=0 THEN disp ELSE disp/pow(greatest(n/greatest(median(n) OVER (PARTITION BY q),1),1e-8),beta) END AS s FROM n{k}),
 d{k} AS (SELECT a.q, a.tau, a.mode AS a, b.mode AS b, {raw} AS raw, a.s, b.s AS t FROM a{k} a JOIN a{k} b ON b.q=a.q AND b.mode<>a.mode), e{k} AS (SELECT * FROM (SELECT *, raw/greatest(sqrt((s*s+t*t)/2),1e-8) AS sep, row_number() OVER (PARTITION BY q, a ORDER BY raw, b) AS rank FROM d{k}) WHERE rank<=30),
 b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, a ORDER BY sep, raw, b) AS z FROM e{k}) WHERE z=1 AND sep<=tau AND tau>0), p{k} AS MATERIALIZED (SELECT x.q, x.a, x.b FROM b{k} x JOIN b{k} y ON y.q=x.q AND y.a=x.b AND y.b=x.a WHERE x.a<x.b),
 t{k} AS MATERIALIZED (SELECT coalesce(p.a, m.mode) AS into_, m.* FROM n{k} m LEFT JOIN p{k} p ON p.q=m.q AND p.b=m.mode), c{k} AS (SELECT q, into_, i AS k, sum(n*mu[i])/sum(n) AS u FROM t{k}, range(1,65) r(i) GROUP BY 1,2,3), l{k} AS (SELECT q, into_, list(u ORDER BY k) AS mu FROM c{k} GROUP BY 1,2),
 o{k} AS (SELECT q, into_, any_value(beta) AS beta, any_value(tau) AS tau, sum(n) AS n, sum(n*(disp*disp+list_sum(list_transform(mu, lambda z: z*z))))/sum(n) AS e, count(*) AS parts, any_value(disp) AS disp FROM t{k} GROUP BY 1,2),
 n{k + 1} AS MATERIALIZED (SELECT o.q, o.beta, o.tau, o.into_ AS mode, l.mu, CASE WHEN parts=1 THEN o.disp ELSE sqrt(greatest(e-list_sum(list_transform(l.mu, lambda z: z*z)),0)) END AS disp, o.n FROM o{k} o JOIN l{k} l ON l.q=o.q AND l.into_=o.into_),
 r{k + 1} AS MATERIALIZED (SELECT r.q, r.mode, coalesce(p.a, r.grp) AS grp, r.n FROM r{k} r LEFT JOIN p{k} p ON p.q=r.q AND p.b=r.grp)"""
    return sql + f", gr AS (SELECT * FROM r{rounds})"


_GROUPS = consolidation_sql([(0.5, 0.4)], 39) + " SELECT sc.i, dense_rank() OVER (ORDER BY grp) - 1 AS label FROM sc JOIN gr ON gr.mode=sc.i%40"


def _forty(spark, d):
    scene = _scene(spark, d).withColumn("label", F.col("i") % 40)
    return scene.select("i", "label"), materialise(T.mode_prototypes(scene))


@query("reciprocal_consolidate", _GROUPS)
def reciprocal(spark, d):
    labels, modes = _forty(spark, d)
    return T.apply_groups(labels, T.consolidate_modes(modes, 0.4, size_exponent=0.5))


def _linked(threshold, how, merges=39):
    """One merge of the two closest groups after another, written out; how: the aggregate over the pairs between two groups."""
    sql = _FORTY + f", x AS MATERIALIZED (SELECT a.mode AS a, b.mode AS b, sqrt({_D2.format(a='a.mu', b='b.mu')})/greatest(sqrt((a.disp*a.disp+b.disp*b.disp)/2),1e-8) AS sep FROM mo a JOIN mo b ON a.mode<>b.mode), h0 AS MATERIALIZED (SELECT mode, mode AS grp FROM mo)"
    for n in range(merges):
        sql += f""", f{n} AS MATERIALIZED (SELECT a, b FROM (SELECT u.grp AS a, v.grp AS b, {how} AS sep FROM x JOIN h{n} u ON u.mode=x.a JOIN h{n} v ON v.mode=x.b WHERE u.grp < v.grp GROUP BY 1, 2) WHERE sep <= {threshold} ORDER BY sep, a, b LIMIT 1), h{n + 1} AS MATERIALIZED (SELECT h.mode, coalesce(f.a, h.grp) AS grp FROM h{n} h LEFT JOIN f{n} f ON f.b=h.grp)"""
    return sql + f" SELECT sc.i, dense_rank() OVER (ORDER BY grp) - 1 AS label FROM sc JOIN h{merges} h ON h.mode=sc.i%40"


def _linkage(spark, d, threshold, how):
    labels, modes = _forty(spark, d)
    return T.apply_groups(labels, L.linkage_groups(modes, threshold, how))


@query("linkage_consolidate", _linked(0.4, "max(sep)"))
def linkage(spark, d):
    return _linkage(spark, d, 0.4, "complete")


@query("linkage_average", _linked(0.37, "round(avg(sep), 12)"))
def linkage_average(spark, d):
    return _linkage(spark, d, 0.37, "average")


@query("linkage_single", _linked(0.34, "min(sep)"))
def linkage_single(spark, d):
    return _linkage(spark, d, 0.34, "single")


@query("cluster_once")
def cluster_once(spark, d):
    """Diffusion and merging in one call."""
    scene, edges = _weighted(spark, d)
    return D.cluster(scene, edges, max_iter=3, tol=0.0, merge_tol=1.6)
