"""Selection from scene to partition over checkpoints, fine radii, consolidation and size weights (E2, E4), and its calibration (E5)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import diffusion, modes, partition, prototypes, scene, selectors, spatial, study
from rasterloom.session import fresh


@dataclass(frozen=True)
class Grid:
    # The protocol's candidate grid.
    checkpoints: tuple[int, ...] = (25, 50, 100, 200)
    gammas: tuple[float, ...] = (0.75, 1.0, 1.25, 1.5)
    taus: tuple[float, ...] = (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 1.0, 1.5, 2.0, 3.0)
    betas: tuple[float, ...] = (0.0, 0.5)
    rank: int = 10


@dataclass(frozen=True)
class Candidates:
    """The local endpoints of a scene's grid, their agreements, and what gives their labels."""

    entries: list[selectors.Candidate]
    ari: dict[tuple[int, int], float]
    surface: DataFrame  # t_index, g_index, beta, tau, ...: every entry of the grid
    fine: DataFrame  # t_index, g_index, i, mode
    groups: DataFrame  # candidate, t_index, g_index, mode, g

    def labels(self, candidate: int) -> DataFrame:
        """(i, label) of one candidate."""
        own = self.groups.where(F.col("candidate") == candidate)
        return self.fine.join(own, ["t_index", "g_index", "mode"]).select("i", F.col("g").alias("label"))


def states(full: DataFrame, weighted: DataFrame, checkpoints: tuple[int, ...], *, alpha: float = 0.5, radius: int | None = None) -> list[DataFrame]:
    """The diffused states (i, v) at each checkpoint."""
    every = diffusion.diffuse_tiled(full, weighted, checkpoints, alpha=alpha, radius=radius)
    return [every.where(F.col("t") == t).select("i", F.col("y").alias("v")) for t in checkpoints]


def candidates(pixels: DataFrame, config: study.Configuration = study.Configuration(), grid: Grid = Grid()) -> Candidates:
    """E2, first part, from features and geometry alone: of each checkpoint, fine radius (gamma times the local scale) and size weight the local endpoint among the thresholds."""
    full, weighted = study.weighted_graph(pixels, config)
    surfaces, sweeps, fines = [], [], []
    for t, state in enumerate(states(full, weighted, grid.checkpoints, alpha=config.alpha, radius=config.window_radius)):
        space = fresh(scene.pca(state, config.merge_components, standardise=True).select("i", F.col("p").alias("v")))
        near = fresh(modes.knn(space, max(config.max_neighbors - 1, grid.rank)))
        scale = modes.local_scale(near, grid.rank)
        for g, gamma in enumerate(grid.gammas):
            at = [F.lit(t).alias("t_index"), F.lit(g).alias("g_index")]
            fine = modes.merge_from_neighbors(near.where(F.col("rank") < config.max_neighbors), gamma * scale, full)
            clean = fresh(spatial.majority_filter(full.select("i", "y", "x").join(fine, "i"), config.filter_radius))
            swept = study.sweep(prototypes.mode_prototypes(clean.join(space, "i")), grid.taus, grid.betas, config.prototype_neighbors)
            fines.append(clean.select(*at, "i", F.col("label").alias("mode")))
            sweeps.append(swept.select(*at, "*"))
            surfaces.append(study.surface(swept).select(*at, "*"))
    union = lambda parts: fresh(reduce(DataFrame.unionByName, parts))
    surface, swept, fine = union(surfaces), union(sweeps), union(fines)
    local = selectors.select_local(surface).join(surface.select("t_index", "g_index", "beta", "tau", "compression"), ["t_index", "g_index", "beta", "tau"])
    rows = sorted(local.select("beta", "t_index", "g_index", "tau", "k", "compression").collect())  # one of each t, gamma and beta at most
    entries = [selectors.Candidate(r["t_index"], r["g_index"], r["beta"], r["tau"], r["k"], r["compression"]) for r in rows]
    named = surface.sparkSession.createDataFrame([(k, c.t, c.g, float(c.beta), float(c.tau)) for k, c in enumerate(entries)], "candidate int, t_index int, g_index int, beta double, tau double")
    groups = fresh(swept.join(named, ["t_index", "g_index", "beta", "tau"]).select("candidate", "t_index", "g_index", "mode", "g"))
    return Candidates(entries, _agreements(entries, fine, groups), surface, fine, groups)


def _agreements(entries: list[selectors.Candidate], fine: DataFrame, groups: DataFrame) -> dict[tuple[int, int], float]:
    """ARI of every two candidates that are neighbours in the grid: pixels are counted by their two fine modes once for each two cells of the grid, the candidates then only regroup modes."""
    pairs = [(a, b) for a, b, _ in selectors._peers(entries)]
    if not pairs:
        return {}
    spark = fine.sparkSession
    cells = sorted({(entries[a].t, entries[a].g, entries[b].t, entries[b].g) for a, b in pairs})
    wanted = spark.createDataFrame(cells, "t int, g int, u int, h int")  # neighbours in the grid
    left = fine.select(F.col("t_index").alias("t"), F.col("g_index").alias("g"), "i", F.col("mode").alias("m"))
    right = fine.select(F.col("t_index").alias("u"), F.col("g_index").alias("h"), "i", F.col("mode").alias("o"))
    met = fresh(left.join(F.broadcast(wanted), ["t", "g"]).join(right, ["i", "u", "h"]).groupBy("t", "g", "u", "h", "m", "o").agg(F.count("*").alias("n")))
    two = spark.createDataFrame([(a, b, entries[a].t, entries[a].g, entries[b].t, entries[b].g) for a, b in pairs], "a int, b int, t int, g int, u int, h int")
    first = groups.select(F.col("candidate").alias("a"), F.col("mode").alias("m"), F.col("g").alias("p1"))
    second = groups.select(F.col("candidate").alias("b"), F.col("mode").alias("o"), F.col("g").alias("p2"))
    table = met.join(F.broadcast(two), ["t", "g", "u", "h"]).join(first, ["a", "m"]).join(second, ["b", "o"]).groupBy("a", "b", F.col("p1").alias("t"), F.col("p2").alias("p")).agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["ari"] for r in partition.ari_of_cells(fresh(table)).collect()}


def select_automatic(found: Candidates, version: int = 1, rule: selectors.Rule = selectors.Rule()) -> int | None:
    """E2 (version 1) or E4 (version 2): the chosen candidate, or None where the rule abstains."""
    return selectors.choose_across_scales(found.entries, found.ari) if version == 1 else selectors.select_v2(found.entries, found.ari, rule)


def calibrate(scenes: dict[str, tuple[Candidates, DataFrame]], ignore: object = 0) -> DataFrame:
    """E5: every rule of the grid applied to every scene (its candidates and its reference labels (i, gt)), scored where it doesn't abstain, and ranked.

    The reference labels of the development scenes are used here only; a chosen partition is scored once.
    """
    scored: dict[tuple[str, int], dict] = {}
    rows = []
    for rule in selectors.all_rules():
        for name, (found, truth) in scenes.items():
            pick = selectors.select_v2(found.entries, found.ari, rule)
            if pick is not None and (name, pick) not in scored:
                scored[name, pick] = partition.evaluate(found.labels(pick).join(truth, "i"), "gt", "label", ignore)
            m = scored.get((name, pick), {}) if pick is not None else {}
            rows.append((rule.stability_min, rule.compression_max, rule.beta_agreement_min, name, *(None if not m else float(m[c]) for c in ("overall_accuracy", "balanced_accuracy", "nmi", "ari"))))
    spark = next(iter(scenes.values()))[1].sparkSession
    return selectors.rank_rules(spark.createDataFrame(rows, "stability_min double, compression_max double, beta_agreement_min double, scene string, oa double, ba double, nmi double, ari double"))
