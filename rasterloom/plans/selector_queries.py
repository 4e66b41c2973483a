"""Queries over selectors and statistics, with their DuckDB SQL."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.operators import automatic as M
from rasterloom.operators import partition, study
from rasterloom.operators import selectors as E
from rasterloom.operators import stats as A
from rasterloom.plans.registry import query
from rasterloom.session import read_table

# Curves of a real table: each line number's rows, labelled by the remainder of their supplier, of which the lowest ones
# fall into one cluster as tau grows; the previous tau's partition is the finer one, which gives their agreement.
STEPS, CLASSES = 12, 64
_CURVE = f"""WITH lb AS (SELECT l_linenumber AS curve, t.t, greatest(l_suppkey % {CLASSES}, 5*t.t) AS lab FROM lineitem, range(0,{STEPS}) t(t)),
sz AS (SELECT curve, t, lab, count(*) AS n FROM lb GROUP BY 1,2,3), st AS (SELECT curve, t, count(*) AS k, sum(n)::DOUBLE AS total, max(n) AS top, sum(n*ln(n)) AS logs, sum(n*(n-1)/2.0) AS pairs FROM sz GROUP BY 1,2),
c AS (SELECT a.curve, a.t/4.0 AS tau, a.k, round(a.top/a.total,9) AS largest, round(CASE WHEN a.k<=1 THEN 0 ELSE (ln(a.total)-a.logs/a.total)/ln(a.k) END,9) AS entropy,
 round(CASE WHEN a.total < 2 OR (a.pairs+b.pairs)/2 = b.pairs*a.pairs/(a.total*(a.total-1)/2) THEN b.pairs*0+1 ELSE (b.pairs-b.pairs*a.pairs/(a.total*(a.total-1)/2))/((a.pairs+b.pairs)/2-b.pairs*a.pairs/(a.total*(a.total-1)/2)) END,9) AS ari_prev, a.total::BIGINT AS n FROM st a LEFT JOIN st b ON b.curve=a.curve AND b.t=a.t-1)"""
_ISLANDS = "w AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY tau) AS pos FROM c WHERE tau > 0), g AS (SELECT *, pos - row_number() OVER (PARTITION BY curve ORDER BY tau) AS island FROM w WHERE {ok}), r AS (SELECT *, min(tau) OVER (PARTITION BY curve, island) AS run, count(*) OVER (PARTITION BY curve, island) AS run_length FROM g)"
_OK = "largest <= 0.4 AND entropy >= 0.35"


def table_curves(spark, d):
    """(curve, tau, k, largest, entropy, ari_prev, n)."""
    rows = read_table(spark, d, "lineitem").select(F.col("l_linenumber").alias("curve"), (F.col("l_suppkey") % CLASSES).alias("s"))
    fine = rows.groupBy("curve", "s").agg(F.count("*").alias("n"))
    sizes = fine.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).groupBy("curve", "t", F.greatest("s", 5 * F.col("t")).alias("lab")).agg(F.sum("n").alias("n"))
    total, n = F.sum("n").cast("double"), F.col("n").cast("double")
    entropy = F.when(F.count("*") <= 1, 0.0).otherwise((F.log(total) - F.sum(n * F.log(n)) / total) / F.log(F.count("*").cast("double")))
    stats = sizes.groupBy("curve", "t").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.round(F.max("n") / total, 9).alias("largest"), F.round(entropy, 9).alias("entropy"), F.sum(n * (n - 1) / 2).alias("pairs"))
    before = F.lag("pairs").over(Window.partitionBy("curve").orderBy("t"))  # cells of both partitions are those of the finer one
    rows = stats.withColumn("pairs_t", before).withColumn("_p", F.col("pairs")).withColumn("pairs_p", F.col("_p")).withColumn("pairs", F.col("pairs_t"))
    return rows.select("curve", (F.col("t") / 4).alias("tau"), "k", "largest", "entropy", F.round(F.when(F.col("pairs").isNotNull(), partition._ari()), 9).alias("ari_prev"), "n")


@query("endpoint_runs", f"{_CURVE}, {_ISLANDS.format(ok=_OK)} SELECT curve, tau, run, run_length FROM r")
def endpoint_runs(spark, d):
    return E.eligible_runs(table_curves(spark, d).where("tau > 0"), E.gates()).select("curve", "tau", "run", "run_length")


@query("adjacent_stability", f"{_CURVE} SELECT curve, tau, greatest(ari_prev, lead(ari_prev) OVER (PARTITION BY curve ORDER BY tau)) AS stability FROM c")
def adjacent_stability(spark, d):
    return E.adjacent_stability(table_curves(spark, d)).select("curve", "tau", "stability")


_ADJACENT = "x AS (SELECT *, lead(ari_prev) OVER (PARTITION BY curve ORDER BY tau) AS nx, row_number() OVER (PARTITION BY curve ORDER BY tau) AS k2, count(*) OVER (PARTITION BY curve) AS m FROM c), a AS (SELECT *, coalesce((ari_prev+nx)/2, ari_prev, nx) AS adjacent_ari, k2 > 1 AND k2 < m AS interior FROM x)"


@query("adjacent_resolution", f"{_CURVE}, {_ADJACENT} SELECT curve, tau, round(adjacent_ari,8) AS adjacent_ari, interior FROM a")
def adjacent_resolution(spark, d):
    return E.mean_adjacent(table_curves(spark, d), "curve", "tau", "ari_prev").select("curve", "tau", F.round("adjacent_ari", 8).alias("adjacent_ari"), "interior")


@query("endpoint_select_v1", f"""{_CURVE}, {_ISLANDS.format(ok=_OK + " AND ari_prev >= 0.95")}, f AS (SELECT curve, max(tau) AS tau FROM r WHERE run = (SELECT min(run) FROM r q WHERE q.curve = r.curve) GROUP BY 1),
b AS (SELECT curve, k > greatest(20, ceil(0.5*sqrt(n))) AS pass FROM c WHERE tau = 0)
SELECT c.curve, c.tau, c.k FROM c JOIN b USING (curve) LEFT JOIN f USING (curve) WHERE c.tau = CASE WHEN pass AND f.tau IS NOT NULL THEN f.tau ELSE 0 END""")
def endpoint_select_v1(spark, d):
    return E.select_consolidation(table_curves(spark, d), F.col("n"))


@query("endpoint_select_segment", f"{_CURVE}, {_ISLANDS.format(ok=_OK)}, e AS (SELECT curve, run, max(tau) AS tau, count(*) AS length FROM r GROUP BY 1,2), k AS (SELECT e.curve, e.tau, c.k, e.length, row_number() OVER (PARTITION BY e.curve ORDER BY c.k, e.tau DESC) AS z FROM e JOIN c ON c.curve=e.curve AND c.tau=e.tau) SELECT curve, tau, k, length FROM k WHERE z = 1")
def endpoint_select_segment(spark, d):
    return E.select_segment(table_curves(spark, d))


_STABLE = "sb AS (SELECT *, greatest(ari_prev, lead(ari_prev) OVER (PARTITION BY curve ORDER BY tau)) AS stability FROM c)"
_RULE_SQL = """rule_{name} AS (SELECT curve, '{name}' AS rule, tau FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY {order}) AS z FROM (
 SELECT *, min(k) OVER (PARTITION BY curve) AS few FROM (SELECT *, count(*) OVER (PARTITION BY curve, island) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY curve ORDER BY tau) AS island FROM (
 SELECT *, row_number() OVER (PARTITION BY curve ORDER BY tau) AS pos FROM sb WHERE tau > 0) WHERE {ok})) WHERE len >= {least}) WHERE {band}) WHERE z = 1)"""


def _rule_sql(name):
    alone = name == "stability_only"
    ok = " AND ".join(["true", *["largest <= 0.4"] * (not alone and name != "minus_largest"), *["entropy >= 0.35"] * (not alone and name != "minus_entropy")])
    order = "stability DESC, k, tau DESC" if alone else "k, tau DESC"
    return _RULE_SQL.format(name=name, order=order, ok=ok, least=1 if alone or name == "minus_persistence" else 2, band="true" if alone or name == "minus_band" else "k <= 1.25*few")


@query("selector_rules", f"{_CURVE}, {_STABLE}, " + ", ".join(map(_rule_sql, E.SELECTOR_RULES)) + ", p AS (" + " UNION ALL ".join(f"SELECT * FROM rule_{r}" for r in E.SELECTOR_RULES) + """), o AS (SELECT curve, tau, entropy, max(entropy) OVER (PARTITION BY curve) AS oracle, rank() OVER (PARTITION BY curve ORDER BY entropy DESC) AS rank FROM c)
 SELECT p.curve, p.rule, o.entropy AS selected, o.oracle, round(o.oracle-o.entropy,8) AS gap, o.rank FROM p JOIN o ON o.curve=p.curve AND o.tau=p.tau""")
def selector_rules(spark, d):
    """What each rule chooses, and its rank by a metric against the best candidate."""
    rows = E.adjacent_stability(table_curves(spark, d))
    gaps = [E.oracle_gaps(rows, E.rule_choice(rows, rule), "entropy").withColumn("gap", F.round("gap", 8)).withColumn("rule", F.lit(rule)) for rule in E.SELECTOR_RULES]
    return reduce(lambda a, b: a.unionByName(b), gaps).withColumn("rank", F.col("rank").cast("long"))


# Candidates of a real table: 4 checkpoints x 4 radii x 2 size weights, each a partition of the vectors' numbers.
_LABELS = "WITH RECURSIVE cd AS (SELECT b*16+t*4+g AS candidate, t, g, b*0.5 AS beta, t+g+b AS s FROM range(0,4) r(t), range(0,4) s(g), range(0,2) q(b)), lb AS (SELECT candidate, vec_id AS i, greatest(vec_id % 16, s) AS l FROM embeddings, cd)"
_PEERS = _LABELS + """, sz AS (SELECT candidate, l, count(*) AS n FROM lb GROUP BY 1,2), st AS (SELECT candidate, count(*) AS k, sum(n)::DOUBLE AS total, max(n) AS top, sum(n*ln(n)) AS logs, sum(n*(n-1)/2.0) AS pairs FROM sz GROUP BY 1),
e AS (SELECT cd.*, k, 1-k/16.0 AS compression, round(top/total,9) <= 0.4 AND round((ln(total)-logs/total)/ln(k),9) >= 0.35 AS eligible, pairs, total FROM cd JOIN st USING (candidate)),
pe AS (SELECT x.candidate AS a, y.candidate AS b, CASE WHEN x.beta<>y.beta THEN 'beta' WHEN x.t<>y.t THEN 't' ELSE 'g' END AS axis FROM cd x JOIN cd y ON x.candidate<y.candidate AND ((x.beta=y.beta AND abs(x.t-y.t)+abs(x.g-y.g)=1) OR (x.beta<>y.beta AND x.t=y.t AND x.g=y.g))),
ce AS (SELECT pe.a, pe.b, x.l AS p, y.l AS q, count(*) AS n FROM pe JOIN lb x ON x.candidate=pe.a JOIN lb y ON y.candidate=pe.b AND y.i=x.i GROUP BY 1,2,3,4), nij AS (SELECT a, b, sum(n*(n-1)/2.0) AS s FROM ce GROUP BY 1,2),
ar AS (SELECT pe.*, CASE WHEN x.total < 2 OR (x.pairs+y.pairs)/2 = x.pairs*y.pairs/(x.total*(x.total-1)/2) THEN 1 ELSE (nij.s-x.pairs*y.pairs/(x.total*(x.total-1)/2))/((x.pairs+y.pairs)/2-x.pairs*y.pairs/(x.total*(x.total-1)/2)) END AS ari FROM pe JOIN nij USING (a,b) JOIN e x ON x.candidate=pe.a JOIN e y ON y.candidate=pe.b),
ends AS (SELECT a AS c, axis, ari FROM ar UNION ALL SELECT b, axis, ari FROM ar)"""


def _grid(spark):
    i = F.col("id")
    t, g, b = F.floor(i / 4) % 4, i % 4, F.floor(i / 16)
    return spark.range(32).select(i.alias("candidate"), t.alias("t_index"), g.alias("g_index"), (b * 0.5).alias("beta"), (t + g + b).alias("s"))


def _candidates(spark, d):
    """(entries, agreements of neighbours) of the table's candidates."""
    grid = _grid(spark)
    labels = read_table(spark, d, "embeddings").crossJoin(F.broadcast(grid)).select("candidate", F.col("vec_id").alias("i"), F.greatest(F.col("vec_id") % 16, F.col("s")).alias("l"))  # 32 candidates
    stats = labels.groupBy("candidate", "l").agg(F.count("*").alias("n")).groupBy("candidate").agg(F.count("*").alias("k"), (F.max("n") / F.sum("n")).alias("largest"), ((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")) / F.log(F.count("*").cast("double"))).alias("entropy"))
    rows = grid.join(stats, "candidate").withColumn("ok", (F.round("largest", 9) <= E.LARGEST) & (F.round("entropy", 9) >= E.ENTROPY)).orderBy("candidate").collect()
    entries = [E.Candidate(r["t_index"], r["g_index"], r["beta"], 0.0, r["k"], 1 - r["k"] / 16, r["ok"]) for r in rows]
    pairs = spark.createDataFrame([(a, b) for a, b, _ in E._peers(entries)], "a long, b long")
    cells = labels.withColumnsRenamed({"candidate": "a", "l": "t"}).join(F.broadcast(pairs), "a").join(labels.withColumnsRenamed({"candidate": "b", "l": "p"}), ["b", "i"]).groupBy("a", "b", "t", "p").agg(F.count("*").alias("n"))
    return entries, {(r["a"], r["b"]): r["ari"] for r in partition.ari_of_cells(cells).collect()}


@query("select_v2", _PEERS + """, ru AS (SELECT s.s AS stability_min, c.c AS compression_max, b.b AS beta_agreement_min FROM (SELECT unnest([0.8,0.825,0.85,0.875,0.9]::DOUBLE[]) AS s) s, (SELECT unnest([0.85,0.9,0.95]::DOUBLE[]) AS c) c, (SELECT unnest([0.5,0.6,0.7,0.8,0.9]::DOUBLE[]) AS b) b),
sm AS (SELECT c, coalesce(max(ari) FILTER (axis<>'beta'),0) AS stab, coalesce(max(ari) FILTER (axis='beta'),0) AS agree FROM ends GROUP BY 1),
go AS (SELECT ru.*, e.*, stab FROM ru, e JOIN sm ON sm.c=e.candidate WHERE eligible AND compression <= compression_max AND stab >= stability_min AND (beta = 0 OR agree >= beta_agreement_min)),
ed AS (SELECT x.stability_min, x.compression_max, x.beta_agreement_min, ar.a, ar.b FROM ar JOIN go x ON x.candidate=ar.a JOIN go y ON y.candidate=ar.b AND y.stability_min=x.stability_min AND y.compression_max=x.compression_max AND y.beta_agreement_min=x.beta_agreement_min WHERE axis<>'beta' AND ari >= x.stability_min),
un AS (SELECT * FROM ed UNION ALL SELECT stability_min, compression_max, beta_agreement_min, b, a FROM ed),
rc AS (SELECT stability_min, compression_max, beta_agreement_min, candidate AS id, candidate AS c FROM go UNION SELECT rc.stability_min, rc.compression_max, rc.beta_agreement_min, un.b, rc.c FROM rc JOIN un ON un.stability_min=rc.stability_min AND un.compression_max=rc.compression_max AND un.beta_agreement_min=rc.beta_agreement_min AND un.a=rc.id),
cc AS (SELECT stability_min, compression_max, beta_agreement_min, id, min(c) AS comp FROM rc GROUP BY 1,2,3,4),
gm AS (SELECT go.*, comp FROM go JOIN cc ON cc.id=go.candidate AND cc.stability_min=go.stability_min AND cc.compression_max=go.compression_max AND cc.beta_agreement_min=go.beta_agreement_min),
gs AS (SELECT stability_min, compression_max, beta_agreement_min, beta, comp, count(*) AS n, avg(stab) AS mean, median(t) AS mt, median(g) AS mg FROM gm GROUP BY 1,2,3,4,5 HAVING count(*) > 1),
gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stability_min, compression_max, beta_agreement_min, beta ORDER BY n DESC, mean DESC, comp) AS z FROM gs) WHERE z=1),
gp AS (SELECT x.* FROM gb x LEFT JOIN gb o ON o.stability_min=x.stability_min AND o.compression_max=x.compression_max AND o.beta_agreement_min=x.beta_agreement_min AND o.beta<>x.beta
 WHERE o.beta IS NULL OR (x.beta=0.5 AND (x.n>o.n OR (x.n=o.n AND x.mean>=o.mean+0.01))) OR (x.beta=0 AND NOT (o.n>x.n OR (o.n=x.n AND o.mean>=x.mean+0.01)))),
ch AS (SELECT gm.stability_min, gm.compression_max, gm.beta_agreement_min, candidate, t, g, gm.beta, row_number() OVER (PARTITION BY gm.stability_min, gm.compression_max, gm.beta_agreement_min ORDER BY round(stab,9) DESC, abs(t-mt)+abs(g-mg), compression, candidate) AS z FROM gm JOIN gp ON gp.stability_min=gm.stability_min AND gp.compression_max=gm.compression_max AND gp.beta_agreement_min=gm.beta_agreement_min AND gp.comp=gm.comp)
SELECT ru.stability_min, ru.compression_max, ru.beta_agreement_min, candidate::INT AS pick, t::INT AS t, g::INT AS g, beta::DOUBLE AS beta
FROM ru LEFT JOIN (SELECT * FROM ch WHERE z=1) ch ON ch.stability_min=ru.stability_min AND ch.compression_max=ru.compression_max AND ch.beta_agreement_min=ru.beta_agreement_min""")
def select_v2(spark, d):
    cands, ari = _candidates(spark, d)
    ari = {k: round(v, 9) for k, v in ari.items()}
    rows = []
    for rule in E.all_rules():
        pick = E.select_v2(cands, ari, rule)
        c = None if pick is None else cands[pick]
        rows.append((rule.stability_min, rule.compression_max, rule.beta_agreement_min, pick, *((c.t, c.g, c.beta) if c else (None,) * 3)))
    return spark.createDataFrame(rows, "stability_min double, compression_max double, beta_agreement_min double, pick int, t int, g int, beta double")


@query("choose_across_scales", _PEERS + """, be AS (SELECT c, max(ari) AS best FROM ends WHERE axis<>'beta' GROUP BY 1) SELECT candidate::INT AS pick, t::INT AS t, g::INT AS g, beta::DOUBLE AS beta FROM e JOIN be ON be.c=e.candidate WHERE eligible AND best >= 0.9 ORDER BY t, beta<>0.5, k, round(best,9) DESC, g LIMIT 1""")
def choose_across_scales(spark, d):
    cands, ari = _candidates(spark, d)
    pick = E.choose_across_scales(cands, {k: round(v, 9) for k, v in ari.items()})
    return spark.createDataFrame([(pick, cands[pick].t, cands[pick].g, cands[pick].beta)] if pick is not None else [], "pick int, t int, g int, beta double")


# Candidates for the joins of peers: what the users' numbers say.
_USERS = "WITH c AS (SELECT DISTINCT user_id AS candidate, user_id % 4 AS t, (user_id // 4) % 4 AS g, (user_id // 16) % 2 AS b FROM events)"


def _users(spark, d):
    u = F.col("user_id")
    return read_table(spark, d, "events").select(u.alias("candidate"), (u % 4).alias("t_index"), (F.floor(u / 4) % 4).alias("g_index"), (F.floor(u / 16) % 2).alias("beta")).distinct()


@query("grid_peers", _USERS + " SELECT x.candidate AS a, y.candidate AS b, CASE WHEN abs(x.t-y.t)=1 THEN 't' ELSE 'gamma' END AS axis FROM c x JOIN c y ON x.b=y.b AND x.candidate<y.candidate AND abs(x.t-y.t)+abs(x.g-y.g)=1")
def grid_peers(spark, d):
    return E.grid_pairs(_users(spark, d))


@query("beta_peers", _USERS + " SELECT x.candidate AS a, y.candidate AS b FROM c x JOIN c y ON x.t=y.t AND x.g=y.g AND x.candidate<y.candidate WHERE x.b<>y.b")
def beta_peers(spark, d):
    return E.beta_pairs(_users(spark, d))


_RULES = "WITH e AS (SELECT user_id % 5 AS s, (user_id // 5) % 3 AS c, (user_id // 15) % 5 AS b, user_id % 8 AS scene, round(avg(value)/100,6) AS v, round(max(value)/1000,6) AS w FROM events GROUP BY 1,2,3,4), m AS (SELECT s, c, b, count(*) AS coverage, avg(v) AS mean_nmi, avg(w) AS mean_ari, avg((v+w)/2) AS score FROM e GROUP BY 1,2,3)"


@query("calibrate_rules", _RULES + " SELECT s, c, b, coverage, round(score,6) AS score, row_number() OVER (ORDER BY coverage DESC, round(score,9) DESC, s DESC, c, b DESC) AS position FROM m")
def calibrate_rules(spark, d):
    u = F.col("user_id")
    e = read_table(spark, d, "events").groupBy((u % 5).alias("stability_min"), (F.floor(u / 5) % 3).alias("compression_max"), (F.floor(u / 15) % 5).alias("beta_agreement_min"), (u % 8).alias("scene")).agg(F.round(F.avg("value") / 100, 6).alias("nmi"), F.round(F.max("value") / 1000, 6).alias("ari"))
    ranked = E.rank_rules(e.withColumn("oa", F.col("nmi")).withColumn("ba", F.col("ari")))
    return ranked.select(F.col("stability_min").alias("s"), F.col("compression_max").alias("c"), F.col("beta_agreement_min").alias("b"), "coverage", F.round("structural_score", 6).alias("score"), F.col("position").cast("long"))


_RESOLUTION = f"""{_CURVE}, {_ADJACENT}, u AS (SELECT tau AS resolution, k, largest, entropy, interior, adjacent_ari, round(1-tau/10,6) AS seed_ari, curve FROM a),
v AS (SELECT *, interior AND k >= 2 AND largest <= 0.4 AND entropy >= 0.35 AS ok, round(least(seed_ari, adjacent_ari),9) AS low, greatest(largest-0.4,0)+greatest(0.35-entropy,0) AS off FROM u WHERE k >= 2)
SELECT curve, resolution, k, NOT ok AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY ok DESC, CASE WHEN ok THEN 0 ELSE off END, low DESC, CASE WHEN ok THEN round(adjacent_ari,9) END DESC, CASE WHEN ok THEN seed_ari END DESC, CASE WHEN ok THEN entropy END DESC, resolution) AS z FROM v) WHERE z = 1"""


@query("select_resolution", _RESOLUTION)
def select_resolution(spark, d):
    rows = E.mean_adjacent(table_curves(spark, d), "curve", "tau", "ari_prev")
    rows = rows.withColumn("adjacent_ari", F.round("adjacent_ari", 9)).withColumn("seed_ari", F.round(1 - F.col("tau") / 10, 6)).withColumnRenamed("tau", "resolution")
    return E.select_resolution(rows, "curve").select("curve", "resolution", "k", "fallback")


_SCORES = "WITH s AS (SELECT user_id % 9 AS dataset, event_type AS method, round(avg(value),6) AS score FROM events GROUP BY 1,2)"
_RANKS = _SCORES + ", r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score)-1)/2.0 AS rk FROM s), m AS (SELECT method, count(*) AS datasets, avg(rk) AS average_rank, coalesce(stddev_samp(rk),0) AS rank_std FROM r GROUP BY 1)"


def _scores(spark, d):
    e = read_table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 9).alias("dataset"), F.col("event_type").alias("method")).agg(F.round(F.avg("value"), 6).alias("score"))


@query("repeat_aggregate", "SELECT user_id % 9 AS dataset, event_type AS method, round(avg(value),6) AS mean, round(coalesce(stddev_samp(value),0),6) AS std, count(value) AS n_repeats FROM events GROUP BY 1,2")
def repeat_aggregate(spark, d):
    e = read_table(spark, d, "events").select((F.col("user_id") % 9).alias("dataset"), F.col("event_type").alias("method"), "value")
    return A.repeat_aggregate(e, ["dataset", "method"], "value").select("dataset", "method", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n_repeats")


@query("average_ranks", _RANKS + " SELECT method, datasets, round(average_rank,6) AS average_rank, round(rank_std,6) AS rank_std FROM m")
def average_ranks(spark, d):
    return A.method_ranks(_scores(spark, d)).select("method", "datasets", F.round("average_rank", 6).alias("average_rank"), F.round("rank_std", 6).alias("rank_std"))


@query("friedman", _RANKS + ", q AS (SELECT max(datasets) AS n, count(*) AS k, sum(average_rank*average_rank) AS q FROM m) SELECT n AS datasets, k AS methods, round(12.0*n/(k*(k+1))*(q-k*(k+1)*(k+1)/4.0),6) AS statistic FROM q")
def friedman(spark, d):
    return A.friedman(_scores(spark, d)).select("datasets", "methods", F.round("statistic", 6).alias("statistic"))


@query("ablation_deltas", "WITH m AS (SELECT user_id % 9 AS dataset, event_type AS variant, avg(value) AS mean FROM events GROUP BY 1,2) SELECT m.dataset, m.variant, round(m.mean,6) AS mean, round(m.mean-f.mean,6) AS delta FROM m JOIN m f ON f.dataset=m.dataset AND f.variant=(SELECT min(event_type) FROM events)")
def ablation_deltas(spark, d):
    e = read_table(spark, d, "events").select((F.col("user_id") % 9).alias("dataset"), F.col("event_type").alias("variant"), "value")
    base = e.agg(F.min("variant")).first()[0]
    return A.mean_deltas(e, "dataset", "variant", base, "value").select("dataset", "variant", F.round("mean", 6).alias("mean"), F.round("delta", 6).alias("delta"))


@query("best_baseline", _SCORES + ", o AS (SELECT min(method) AS m FROM s), b AS (SELECT dataset, method, score, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, method) AS k FROM s, o WHERE method <> o.m) SELECT s.dataset, round(s.score,6) AS own_value, b.method AS best_method, round(b.score,6) AS best_value, round(s.score-b.score,6) AS delta FROM s JOIN o ON s.method=o.m JOIN b ON b.dataset=s.dataset AND b.k=1")
def best_baseline(spark, d):
    s = _scores(spark, d)
    own = s.agg(F.min("method")).first()[0]
    return A.best_other(s, "dataset", "method", own, "score").select("dataset", F.round("own_value", 6).alias("own_value"), "best_method", F.round("best_value", 6).alias("best_value"), F.round("delta", 6).alias("delta"))


@query("win_counts", _SCORES + ", o AS (SELECT min(method) AS m FROM s) SELECT s.method, count(*) FILTER (q.score>s.score) AS wins, count(*) FILTER (q.score=s.score) AS ties, count(*) FILTER (q.score<s.score) AS losses FROM s JOIN o ON s.method<>o.m JOIN s q ON q.dataset=s.dataset AND q.method=o.m GROUP BY 1")
def win_counts(spark, d):
    s = _scores(spark, d)
    return A.win_counts(s, "dataset", "method", s.agg(F.min("method")).first()[0], "score")


_STAGES = {"graph": "l_tax", "diffusion": "l_discount"}


@query("empirical_scaling", """SELECT l_returnflag AS scene, round(avg(l_quantity),6) AS seconds, round(stddev_samp(l_quantity),6) AS seconds_std, round(max(l_partkey)/avg(l_quantity),4) AS pixels_per_second,
 round(1e6*avg(l_quantity)/max(l_suppkey),4) AS us_per_edge, round(avg(l_tax),6) AS graph_mean, round(avg(l_tax)/avg(l_quantity),6) AS graph_share, round(avg(l_discount),6) AS diffusion_mean,
 round(avg(l_discount)/avg(l_quantity),6) AS diffusion_share FROM lineitem GROUP BY 1""")
def empirical_scaling(spark, d):
    stages = [F.col(c).alias(name) for name, c in _STAGES.items()]
    r = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene"), F.col("l_partkey").alias("n_pixels"), F.col("l_suppkey").alias("n_edges"), F.col("l_quantity").alias("seconds"), *stages)
    found = A.empirical_scaling(r, tuple(_STAGES))
    digits = {"pixels_per_second": 4, "us_per_edge": 4}
    return found.select("scene", *(F.round(c, digits.get(c, 6)).alias(c) for c in found.columns[1:]))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return A.status_counts(read_table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "status")


@query("holm", "WITH t AS (SELECT event_type AS test, round((count(*) % 97)/4000.0,6) AS p FROM events GROUP BY 1), s AS (SELECT *, least(1.0,(count(*) OVER ()-row_number() OVER (ORDER BY p, test)+1)*p) AS st FROM t) SELECT test, p, round(max(st) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING),6) AS pvalue_holm FROM s")
def holm(spark, d):
    t = read_table(spark, d, "events").groupBy(F.col("event_type").alias("test")).agg(F.round((F.count("*") % 97) / 4000.0, 6).alias("p"))
    return A.holm(t, "p", "test").select("test", "p", F.round("pvalue_holm", 6).alias("pvalue_holm"))


_WILCOXON = _SCORES + """, o AS (SELECT min(method) AS m FROM s), df AS (SELECT s.method, s.dataset, q.score-s.score AS df FROM s JOIN o ON s.method<>o.m JOIN s q ON q.dataset=s.dataset AND q.method=o.m WHERE q.score<>s.score),
rk AS (SELECT *, 2*rank() OVER (PARTITION BY method ORDER BY abs(df)) + count(*) OVER (PARTITION BY method, abs(df)) - 1 AS r, row_number() OVER (PARTITION BY method ORDER BY dataset) - 1 AS bit FROM df),
ob AS (SELECT method, least(coalesce(sum(r) FILTER (df>0),0), coalesce(sum(r) FILTER (df<0),0)) AS low, count(*) AS n FROM rk GROUP BY 1),
ways AS (SELECT rk.method, m.m, sum(CASE WHEN (m.m >> rk.bit) & 1 = 1 THEN r ELSE 0 END) AS w FROM rk, range(0,512) m(m) JOIN ob ON true WHERE ob.method=rk.method AND m.m < (1 << ob.n) GROUP BY 1,2)
SELECT method, low/2.0 AS statistic, least(1.0, 2.0*count(*) FILTER (w<=low)/(1 << any_value(n))) AS pvalue FROM ways JOIN ob USING (method) GROUP BY method, low"""


@query("wilcoxon_exact", _WILCOXON)
def wilcoxon_exact(spark, d):
    s = _scores(spark, d)
    methods = sorted(r["method"] for r in s.select("method").distinct().collect())
    value = {(r["dataset"], r["method"]): r["score"] for r in s.collect()}  # methods x datasets
    rows = [(m, *A.wilcoxon_exact([value[k, methods[0]] - value[k, m] for k in range(9) if (k, m) in value and (k, methods[0]) in value])) for m in methods[1:]]
    return spark.createDataFrame(rows, "method string, statistic double, pvalue double")


_POISSON = ", ".join(f"{sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r}" for k in range(12))


@query("block_bootstrap_ci", f"""WITH w AS (SELECT CAST(round(sqrt(1.25*count(*))) AS BIGINT) AS w FROM embeddings), s AS (SELECT CAST(vec_id // w AS BIGINT) // 8 AS a, (vec_id % w) // 8 AS b, (label = vec_id % 10)::INT AS hit FROM embeddings, w WHERE label <> 0),
 o AS (SELECT a, b, sum(hit) AS hit, count(*) AS n FROM s GROUP BY 1,2), x AS (SELECT r, hit, n, len(list_filter([{_POISSON}], lambda z: z <= ('0x' || substr(md5(concat('0:', r, ':', a, ':', b)), 1, 8))::BIGINT/4294967296.0)) AS w FROM o, range(1,301) q(r)),
 v AS (SELECT r, sum(w*hit)/sum(w*n) AS v FROM x GROUP BY 1) SELECT round(avg(v),8) AS mean, round(stddev_samp(v),8) AS std, round(quantile_cont(v,0.025),8) AS ci95_lower, round(quantile_cont(v,0.975),8) AS ci95_upper FROM v""")
def block_bootstrap_ci(spark, d):
    from rasterloom.operators.scene import scene_from_vectors

    s = scene_from_vectors(read_table(spark, d, "embeddings")).where("gt <> 0").withColumn("right", F.col("gt") == F.col("i") % 10)
    return A.block_bootstrap(s, "right", 8).select(*[F.round(c, 8).alias(c) for c in ("mean", "std", "ci95_lower", "ci95_upper")])


@query("spearman_signals", "WITH r AS (SELECT l_returnflag AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity)-1)/2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice)-1)/2.0 AS ry FROM lineitem) SELECT g, round(corr(rx,ry),6) AS rho, count(*) AS n FROM r GROUP BY 1")
def spearman_signals(spark, d):
    r = read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    return A.spearman(r, ["g"], "l_quantity", "l_extendedprice").select("g", F.round("rho", 6).alias("rho"), "n")


@query("evidence_join", f"{_CURVE}, w AS (SELECT l_linenumber AS curve, round(avg(l_discount)*30,6) AS w FROM lineitem GROUP BY 1), k AS (SELECT c.curve, tau, k, row_number() OVER (PARTITION BY c.curve ORDER BY round(abs(tau-w),12), tau) AS z FROM c JOIN w USING (curve)) SELECT curve, tau, k FROM k WHERE z = 1")
def evidence_join(spark, d):
    wanted = read_table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("curve")).agg(F.round(F.avg("l_discount") * 30, 6).alias("wanted_tau"))
    return E.nearest_entry(table_curves(spark, d), wanted).select("curve", "tau", "k")


@query("automatic_selection")
def automatic_selection(spark, d):
    """E2 end to end over a small grid: every entry of the surface, and whether it is a local endpoint and the one chosen."""
    found = _automatic(spark, d)
    pick = M.select_automatic(found)
    ends = spark.createDataFrame([(c.t, c.g, float(c.beta), float(c.tau), True, k == pick) for k, c in enumerate(found.entries)], "t_index int, g_index int, beta double, tau double, endpoint boolean, chosen boolean")
    return found.surface.join(ends, ["t_index", "g_index", "beta", "tau"], "left").fillna(False, ["endpoint", "chosen"])


def _automatic(spark, d, part: int | None = None):
    from rasterloom.operators.scene import scene_from_vectors

    s = scene_from_vectors(read_table(spark, d, "embeddings"), label=None)
    return M.candidates(s, study.Configuration(k=12, window_radius=5, filter_radius=1), M.Grid(checkpoints=(10, 25), gammas=(1.0, 1.25), taus=(0.0, 0.1, 0.2, 0.3, 0.4, 0.6)))


@query("automatic_calibration")
def automatic_calibration(spark, d):
    """E4 and E5 end to end: the 75 rules over a scene's candidates, scored by the reference labels and ranked."""
    truth = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").alias("gt"))
    return M.calibrate({"vectors": (_automatic(spark, d), truth)})
