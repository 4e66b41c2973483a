"""Endpoint selection from label-free statistics only.

A curve is a DataFrame (curve, tau, k, largest, entropy, ari_prev[, compression, stability]) of a parameter grid; a
surface adds the grid's coordinates. Selectors return None, or no row, where nothing is admissible: they abstain.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGEST, ENTROPY, COMPRESSION, STABILITY = 0.40, 0.35, 0.20, 0.95


def adjacent_stability(curve: DataFrame, by: str = "curve", order: str = "tau", ari: str = "ari_prev") -> DataFrame:
    """Curve with stability, the larger of the agreements with the grid's previous and next entry."""
    w = Window.partitionBy(by).orderBy(order)
    return curve.withColumn("stability", F.greatest(F.col(ari), F.lead(ari).over(w)))


def mean_adjacent(curve: DataFrame, by: str, order: str, ari: str) -> DataFrame:
    """Adjacent agreement as the mean of those that exist; interior: neither first nor last."""
    w = Window.partitionBy(by).orderBy(order)
    nxt = F.lead(ari).over(w)
    both = F.coalesce((F.col(ari) + nxt) / 2, F.col(ari), nxt)
    n = F.count("*").over(Window.partitionBy(by))
    k = F.row_number().over(w)
    return curve.withColumn("adjacent_ari", both).withColumn("interior", (k > 1) & (k < n))


def gates(largest: float = LARGEST, entropy: float = ENTROPY, compression: float | None = None, stability: float | None = None) -> Column:
    """Whether a row may be an endpoint."""
    ok = (F.col("largest") <= largest) & (F.col("entropy") >= entropy)
    if compression is not None:
        ok = ok & (F.col("compression") >= compression)
    if stability is not None:
        ok = ok & (F.col("stability") >= stability)
    return F.coalesce(ok, F.lit(False))


def eligible_runs(curve: DataFrame, ok: Column, by: str = "curve", order: str = "tau", least: int = 1) -> DataFrame:
    """Eligible rows in maximal runs of the grid of at least `least` entries, with run (its first entry's value) and run_length."""
    w = Window.partitionBy(by).orderBy(order)
    marked = curve.withColumn("_ok", ok).withColumn("_at", F.row_number().over(w))
    own = marked.where("_ok").withColumn("_island", F.col("_at") - F.row_number().over(w))
    island = Window.partitionBy(by, "_island")
    return own.withColumn("run", F.min(order).over(island)).withColumn("run_length", F.count("*").over(island)).where(F.col("run_length") >= least).drop("_ok", "_at", "_island")


def cluster_gate(n_pixels: int) -> int:
    return max(20, math.ceil(0.5 * math.sqrt(n_pixels)))


def select_consolidation(curve: DataFrame, n_pixels: Column, by: str = "curve") -> DataFrame:
    """A row for each curve: the last entry of the first plateau over tau > 0 (agreement with the previous entry, largest, entropy), else the baseline tau = 0; the baseline too if there are too few fine modes."""
    positive = curve.where("tau > 0")
    ok = gates() & F.coalesce(F.col("ari_prev") >= STABILITY, F.lit(False))
    runs = eligible_runs(positive, ok, by)
    first = runs.withColumn("_f", F.min("run").over(Window.partitionBy(by))).where(F.col("run") == F.col("_f"))
    last = first.groupBy(by).agg(F.max_by(F.struct("tau", "k"), "tau").alias("p"))
    base = curve.where("tau = 0").select(by, F.struct("tau", "k").alias("b"), F.greatest(F.lit(20), F.ceil(0.5 * F.sqrt(n_pixels))).alias("gate"))
    pick = F.when((F.col("b.k") > F.col("gate")) & F.col("p").isNotNull(), F.col("p")).otherwise(F.col("b"))
    return base.join(last, by, "left").select(by, pick.alias("s")).select(by, "s.tau", "s.k")


def select_segment(curve: DataFrame, by: str = "curve") -> DataFrame:
    """The last entry of the run over tau > 0 with admissible largest and entropy; of several runs that with the fewest clusters. Curves without one are left out."""
    runs = eligible_runs(curve.where("tau > 0"), gates(), by)
    ends = runs.groupBy(by, "run").agg(F.max_by(F.struct("tau", "k"), "tau").alias("s"), F.count("*").alias("length"))
    return ends.groupBy(by).agg(F.min_by(F.struct("s.tau", "s.k", "length"), F.struct("s.k", F.negative("s.tau"))).alias("s")).select(by, "s.tau", "s.k", "s.length")


def select_local(surface: DataFrame, least_run: int = 2) -> DataFrame:
    """E2, first part: of each (t_index, g_index, beta) the eligible entry in a run with the fewest clusters, then the higher stability, then the smaller tau."""
    keyed = surface.withColumn("curve", F.concat_ws("/", "t_index", "g_index", "beta"))
    runs = eligible_runs(keyed, gates(compression=COMPRESSION, stability=STABILITY), least=least_run)
    return runs.groupBy("t_index", "g_index", "beta").agg(F.min_by(F.struct("tau", "k", "stability"), F.struct("k", F.negative("stability"), "tau")).alias("s")).select("t_index", "g_index", "beta", "s.*")


def _grid_cells(candidates: DataFrame) -> DataFrame:
    """A row for each cell of the grid: its lowest candidate and how many it has (one, in a grid of the protocol)."""
    return candidates.groupBy("beta", "t_index", "g_index").agg(F.min("candidate").alias("first"), F.count("*").alias("members"))


def grid_peers(candidates: DataFrame) -> DataFrame:
    """(a, a_members, b, b_members, axis) of cells of one beta next to each other along t or gamma, a being the lower one. Each cell looks up its two upper neighbours, so rows are linear in cells."""
    cells = _grid_cells(candidates)
    up = F.explode(F.array(F.struct((F.col("t_index") + 1).alias("t_index"), F.col("g_index").alias("g_index"), F.lit("t").alias("axis")), F.struct("t_index", (F.col("g_index") + 1).alias("g_index"), F.lit("gamma").alias("axis"))))
    asks = cells.select("beta", F.col("first").alias("a"), F.col("members").alias("a_members"), up.alias("_up")).select("beta", "a", "a_members", "_up.*")
    return asks.join(cells, ["beta", "t_index", "g_index"]).select("a", "a_members", F.col("first").alias("b"), F.col("members").alias("b_members"), "axis")


def beta_peers(candidates: DataFrame) -> DataFrame:
    """(a, a_members, a_beta, b, b_members, b_beta) of cells at one (t, gamma) with betas a_beta < b_beta."""
    cells = _grid_cells(candidates)
    a = cells.select("t_index", "g_index", F.col("first").alias("a"), F.col("members").alias("a_members"), F.col("beta").alias("a_beta"))
    b = cells.select("t_index", "g_index", F.col("first").alias("b"), F.col("members").alias("b_members"), F.col("beta").alias("b_beta"))
    return a.join(b, ["t_index", "g_index"]).where("a_beta < b_beta").drop("t_index", "g_index")


#: Candidates of a cell that meet those of another one in a task.
TOGETHER = 4096


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The equi-join of left and right. Rows of one key are dealt into chunks that meet one by one, so that a large cell is no task of its own."""
    most = left.groupBy(*keys).count().unionByName(right.groupBy(*keys).count()).agg(F.max("count").alias("m")).first()["m"] or 0
    chunks = max(1, -(-most // TOGETHER))
    own = F.pmod(F.xxhash64("candidate"), F.lit(chunks))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    a = left.withColumnRenamed("candidate", "x").withColumn("_p", F.pmod(F.xxhash64("x"), F.lit(chunks)).cast("int")).withColumn("_q", every)
    b = right.withColumn("_q", own.cast("int")).withColumnRenamed("candidate", "y").withColumn("_p", every)
    return a.join(b, [*keys, "_p", "_q"])


def grid_pairs(candidates: DataFrame) -> DataFrame:
    """(a, b, axis) of candidates a < b of one beta in cells next to each other along t or gamma: every pair, so rows grow with the square of a cell's candidates."""
    rows = candidates.select("candidate", "beta", "t_index", "g_index")
    up = F.explode(F.array(F.struct((F.col("t_index") + 1).alias("t_index"), F.col("g_index").alias("g_index"), F.lit("t").alias("axis")), F.struct("t_index", (F.col("g_index") + 1).alias("g_index"), F.lit("gamma").alias("axis"))))
    asks = rows.select("candidate", "beta", up.alias("_up")).select("candidate", "beta", "_up.*")
    return _met(asks, rows, ["beta", "t_index", "g_index"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "axis")


def beta_pairs(candidates: DataFrame) -> DataFrame:
    """(a, b) of candidates a < b at one (t, gamma) with different beta: every pair."""
    rows = candidates.select("candidate", "t_index", "g_index", F.col("beta").alias("_b"))
    met = _met(rows.withColumnRenamed("_b", "_a"), rows, ["t_index", "g_index"])
    return met.where("_a < _b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


@dataclass(frozen=True)
class Candidate:
    """An endpoint of the (t, gamma, beta) grid."""

    t: int
    g: int
    beta: float
    tau: float
    k: int
    compression: float = 0.0
    eligible: bool = True


def _peers(cands: list[Candidate]) -> list[tuple[int, int, str]]:
    out = []
    for a, b in combinations(range(len(cands)), 2):
        x, y = cands[a], cands[b]
        if x.beta == y.beta and abs(x.t - y.t) + abs(x.g - y.g) == 1:
            out.append((a, b, "t" if x.t != y.t else "g"))
        elif (x.t, x.g) == (y.t, y.g) and x.beta != y.beta:
            out.append((a, b, "beta"))
    return out


def choose_across_scales(cands: list[Candidate], ari: dict[tuple[int, int], float], least: float = 0.90) -> int | None:
    """Among candidates whose best agreement with a grid neighbour reaches `least`: the earliest t, then beta 0.5, then fewest clusters, higher agreement, smaller gamma and tau."""
    best = [0.0] * len(cands)
    for a, b, axis in _peers(cands):
        if axis != "beta":
            for x in (a, b):
                best[x] = max(best[x], ari.get((a, b), 0.0))
    admitted = [i for i, c in enumerate(cands) if c.eligible and best[i] >= least]
    return min(admitted, key=lambda i: (cands[i].t, cands[i].beta != 0.5, cands[i].k, -best[i], cands[i].g, cands[i].tau), default=None)


@dataclass(frozen=True)
class Rule:
    stability_min: float = 0.80
    compression_max: float = 0.85
    beta_agreement_min: float = 0.90
    beta_gain: float = 0.01


def stable_groups(good: list[int], cands: list[Candidate], ari: dict[tuple[int, int], float], least: float) -> list[list[int]]:
    """Connected groups of two or more good candidates of one beta through grid neighbours that agree."""
    near: dict[int, list[int]] = {i: [] for i in good}
    for a, b, axis in _peers(cands):
        if axis != "beta" and a in near and b in near and ari.get((a, b), 0.0) >= least:
            near[a].append(b)
            near[b].append(a)
    seen: set[int] = set()
    groups = []
    for i in good:
        stack, own = [i], []
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                own.append(x)
                stack += near[x]
        if len(own) > 1:
            groups.append(sorted(own))
    return groups


def select_v2(cands: list[Candidate], ari: dict[tuple[int, int], float], rule: Rule = Rule()) -> int | None:
    """A representative of the largest stable group; beta 0.5 must earn its place over beta 0."""
    stab, agree = [0.0] * len(cands), [0.0] * len(cands)
    for a, b, axis in _peers(cands):
        for x in (a, b):
            held = agree if axis == "beta" else stab
            held[x] = max(held[x], ari.get((a, b), 0.0))
    good = [i for i, c in enumerate(cands) if c.eligible and c.compression <= rule.compression_max and stab[i] >= rule.stability_min and (c.beta == 0 or agree[i] >= rule.beta_agreement_min)]
    groups = stable_groups(good, cands, ari, rule.stability_min)
    mean = lambda g: sum(stab[i] for i in g) / len(g)
    top: dict[float, list[int]] = {}
    for g in groups:
        beta = cands[g[0]].beta
        if beta not in top or (len(g), mean(g)) > (len(top[beta]), mean(top[beta])):
            top[beta] = g
    if not top:
        return None
    zero, half = top.get(0.0), top.get(0.5)
    if zero is None or half is None:
        group = zero or half or next(iter(top.values()))
    else:
        group = half if len(half) > len(zero) or (len(half) == len(zero) and mean(half) >= mean(zero) + rule.beta_gain) else zero
    mid_t, mid_g = np.median([cands[i].t for i in group]), np.median([cands[i].g for i in group])
    return max(group, key=lambda i: (stab[i], -(abs(cands[i].t - mid_t) + abs(cands[i].g - mid_g)), -cands[i].compression))


# The calibration grid of the protocol.
RULE_GRID = {"stability_min": (0.80, 0.825, 0.85, 0.875, 0.90), "compression_max": (0.85, 0.90, 0.95), "beta_agreement_min": (0.50, 0.60, 0.70, 0.80, 0.90)}


def rank_rules(results: DataFrame) -> DataFrame:
    """E5, O3: results (rule columns, scene, oa, ba, nmi, ari; nulls where a rule abstains) averaged, with their position, best first.

    Order: scenes covered, mean of nmi and ari, the stricter stability, the lower compression, the stricter agreement.
    """
    means = [F.avg(c).alias(f"mean_{c}") for c in ("oa", "ba", "nmi", "ari")]
    mean = results.groupBy(*RULE_GRID).agg(F.count("nmi").alias("coverage"), *means, F.avg((F.col("nmi") + F.col("ari")) / 2).alias("structural_score"))
    best = Window.orderBy(F.desc("coverage"), F.desc_nulls_last("structural_score"), F.desc("stability_min"), "compression_max", F.desc("beta_agreement_min"))
    return mean.withColumn("position", F.row_number().over(best))  # a row a rule: 75


def all_rules(values: dict[str, Iterable[float]] = RULE_GRID) -> list[Rule]:
    return [Rule(s, c, b) for s in values["stability_min"] for c in values["compression_max"] for b in values["beta_agreement_min"]]


def select_resolution(rows: DataFrame, *by: str) -> DataFrame:
    """One row (for each group): of interior resolutions with 2 clusters or more and admissible largest and entropy the one with the largest least agreement; else the least violation of the gates.

    rows: resolution, k, largest, entropy, seed_ari, adjacent_ari, interior. Raises if all have one cluster; of groups, those are left out.
    """
    least = F.least("seed_ari", "adjacent_ari")
    ok = F.coalesce(F.col("interior") & gates(), F.lit(False))
    off = F.greatest(F.col("largest") - LARGEST, F.lit(0.0)) + F.greatest(ENTROPY - F.col("entropy"), F.lit(0.0))
    high = lambda c: F.coalesce(-c, F.lit(float("inf")))  # noqa: E731  (nulls come last)
    among = lambda c: F.when(ok, high(F.col(c))).otherwise(0.0)
    order = F.struct(~ok, F.when(ok, 0.0).otherwise(off), high(least), among("adjacent_ari"), among("seed_ari"), among("entropy"), "resolution")
    picked = rows.where("k >= 2").withColumn("fallback", ~ok).groupBy(*by).agg(F.min_by(F.struct(*rows.columns, "fallback"), order).alias("_s")).where("_s is not null").select("_s.*")
    if not by and picked.isEmpty():
        raise ValueError("every resolution gives one cluster")
    return picked


SELECTOR_RULES = ("full", "minus_persistence", "minus_largest", "minus_entropy", "minus_band", "stability_only")


def rule_choice(curve: DataFrame, rule: str, by: str = "curve") -> DataFrame:
    """(curve, tau, k) chosen when one part of the segment rule is left out. The band: clusters within 1.25 of the fewest."""
    ok = F.lit(True)
    if rule not in ("minus_largest", "stability_only"):
        ok = ok & (F.col("largest") <= LARGEST)
    if rule not in ("minus_entropy", "stability_only"):
        ok = ok & (F.col("entropy") >= ENTROPY)
    least = 1 if rule in ("minus_persistence", "stability_only") else 2
    rows = eligible_runs(curve.where("tau > 0"), F.coalesce(ok, F.lit(False)), by, least=least)
    fewest = F.min("k").over(Window.partitionBy(by))
    if rule not in ("minus_band", "stability_only"):
        rows = rows.withColumn("_few", fewest).where(F.col("k") <= 1.25 * F.col("_few"))
    key = F.struct(F.negative("stability"), "k", F.negative("tau")) if rule == "stability_only" else F.struct("k", F.negative("tau"))
    return rows.groupBy(by).agg(F.min_by(F.struct("tau", "k"), key).alias("s")).select(by, F.lit(rule).alias("rule"), "s.tau", "s.k")


def oracle_gaps(candidates: DataFrame, chosen: DataFrame, metric: str, by: str = "curve") -> DataFrame:
    """Of each curve the chosen entry's metric, the best one, the gap and the chosen one's rank (1: best)."""
    best = F.max(metric).over(Window.partitionBy(by))
    rank = F.rank().over(Window.partitionBy(by).orderBy(F.desc(metric)))
    rows = candidates.withColumn("oracle", best).withColumn("rank", rank)
    return rows.join(chosen.select(by, "tau"), [by, "tau"], "left_semi").select(by, F.col(metric).alias("selected"), "oracle", (F.col("oracle") - F.col(metric)).alias("gap"), "rank")


def nearest_entry(curve: DataFrame, wanted: DataFrame, by: str = "curve") -> DataFrame:
    """Of each curve the entry whose tau is nearest to the wanted one (ties: the smaller tau). wanted: (curve, wanted_tau), a row a curve."""
    row = F.struct(*[c for c in curve.columns if c != by])
    gap = F.struct(F.round(F.abs(F.col("tau") - F.col("wanted_tau")), 12), "tau")
    return curve.join(wanted, by).groupBy(by).agg(F.min_by(row, gap).alias("s")).select(by, "s.*")
