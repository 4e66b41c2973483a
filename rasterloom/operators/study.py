"""Runs: configuration, the whole chain, ablation and sensitivity grids, locks, perturbation, repeatability."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, replace
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import diffusion, graph, modes, partition, prototypes, scene, spatial
from rasterloom.operators.selectors import adjacent_stability
from rasterloom.session import fresh


@dataclass(frozen=True)
class Configuration:
    """One run. Defaults are the frozen protocol's where it has one."""

    pca_components: int | None = 20
    k: int = 20
    window_radius: int = 7
    mutual: bool = True
    min_degree: int = 4
    use_spatial_affinity: bool = True
    alpha: float = 0.5
    checkpoint: int = 25
    fine_radius: float = 0.15
    filter_radius: int = 3
    prototype_threshold: float = 0.75
    prototype_neighbors: int = 30
    size_exponent: float = 0.5
    disable_fine_grouping: bool = False
    disable_consolidation: bool = False
    max_neighbors: int = 50
    merge_components: int = 10


def weighted_graph(pixels: DataFrame, config: Configuration, lap: Callable[[str], None] = lambda stage: None) -> tuple[DataFrame, DataFrame]:
    """The standardised scene (i, y, x, v) and its affinities (i, j, w)."""
    if "gt" in pixels.columns:
        raise ValueError("selection must not see the reference labels")
    full = fresh(scene.zscore(pixels.select("i", "y", "x", "v")))
    edges = fresh(graph.build_graph(full, pca_components=config.pca_components, k=config.k, window_radius=config.window_radius, mutual=config.mutual, min_degree=config.min_degree))
    lap("load_graph")
    weighted = fresh(graph.affinities(fresh(graph.spectral_edges(edges, full)), use_spatial=config.use_spatial_affinity).select("i", "j", "w"))
    lap("affinity")
    return full, weighted


def discover(pixels: DataFrame, config: Configuration = Configuration(), *, timer: Callable[[str, float], None] | None = None) -> DataFrame:
    """(i, y, x, fine, label) of a scene (i, y, x, v), from features and geometry alone.

    The reference labels, if any, must not be among the columns.
    """
    clock = time.perf_counter()

    def lap(stage: str) -> None:
        nonlocal clock
        now = time.perf_counter()
        if timer:
            timer(stage, now - clock)
        clock = now

    full, weighted = weighted_graph(pixels, config, lap)
    n = full.count()
    if config.checkpoint == 0:
        state = full.select("i", F.col("v").alias("y"))
    else:
        state = diffusion.diffuse_tiled(full, weighted, [config.checkpoint], radius=config.window_radius, alpha=config.alpha).select("i", "y")
    state = fresh(state)
    lap("diffusion")
    space = fresh(scene.pca(state.select("i", F.col("y").alias("v")), config.merge_components, standardise=True).select("i", F.col("p").alias("v")))
    if config.disable_fine_grouping:
        fine = full.select("i", F.col("i").alias("label"))
    else:
        fine = modes.merge_from_neighbors(modes.knn(space, config.max_neighbors - 1, n=n), config.fine_radius, full)
    fine = fresh(full.select("i", "y", "x").join(fine, "i"))
    clean = fresh(spatial.majority_filter(fine, config.filter_radius))
    if config.disable_consolidation:
        final = clean
    else:
        table = prototypes.mode_prototypes(clean.join(space, "i"))
        final = prototypes.apply_groups(clean, prototypes.consolidate_modes(table, config.prototype_threshold, k=config.prototype_neighbors, size_exponent=config.size_exponent))
    out = fresh(clean.select("i", "y", "x", F.col("label").alias("fine")).join(final.select("i", "label"), "i"))
    lap("modes_merge")
    return out


def tau_surface(features: DataFrame, labels: DataFrame, taus: Iterable[float], betas: Iterable[float] = (0.0, 0.5), k: int = 30) -> DataFrame:
    """(beta, tau, tau_index, k, largest, entropy, compression, ari_prev, stability) of each consolidation.

    features: (i, v); labels: (i, label), the fine modes. Consolidation works on modes; agreement between neighbours of
    the grid is computed from their mode-level contingency weighted by mode sizes, which equals the pixel-level one.
    """
    table = prototypes.mode_prototypes(labels.join(features, "i"))
    return surface(sweep(table, sorted(taus), betas, k))


def sweep(table: DataFrame, taus: Iterable[float], betas: Iterable[float] = (0.0, 0.5), k: int = 30, most: int = prototypes.MOST_MODES) -> DataFrame:
    """(beta, tau, tau_index, mode, g, n): the group of each mode of `table` at each entry of the grid. Up to `most` modes, entries are tasks of their own; more modes are merged entry by entry over the cluster."""
    table = fresh(table)
    grid = [(float(b), float(t), x) for b in betas for x, t in enumerate(taus)]
    names = "beta double, tau double, tau_index int"
    spark = table.sparkSession
    if table.count() > most:
        parts = [prototypes.consolidate_rounds(table, t, k=k, size_exponent=b).join(table.select("mode", "n"), "mode").select(F.lit(b).alias("beta"), F.lit(t).alias("tau"), F.lit(x).alias("tau_index"), "mode", F.col("group").alias("g"), "n") for b, t, x in grid]
        return fresh(reduce(DataFrame.unionByName, parts))
    ids, mu, disp, size = prototypes.modes_to_arrays(table, most)
    kind = table.schema["mode"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for b, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group, _ = prototypes.reciprocal_consolidate(mu, disp, size, t, k=k, size_exponent=b)
                m = len(ids)
                yield pa.RecordBatch.from_pydict({"beta": [b] * m, "tau": [t] * m, "tau_index": pa.array([x] * m, pa.int32()), "mode": ids, "g": group.astype("int64"), "n": size.astype("int64")})

    entries = spark.createDataFrame(grid, names).repartition(min(len(grid), 64))
    return fresh(entries.mapInArrow(run, f"{names}, mode {kind}, g long, n long"))


def surface(df: DataFrame) -> DataFrame:
    """Of each entry of a sweep its statistics, its agreement with the previous tau and its stability."""
    modes_of = df.groupBy("beta", "tau_index").agg(F.count("*").alias("fine"))
    sizes = df.groupBy("beta", "tau", "tau_index", "g").agg(F.sum("n").alias("n"))
    total = F.sum("n").cast("double")
    stats = sizes.groupBy("beta", "tau", "tau_index").agg(F.count("*").alias("k"), (F.max("n") / total).alias("largest"), F.when(F.count("*") <= 1, 0.0).otherwise((F.log(total) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total) / F.log(F.count("*").cast("double"))).alias("entropy"))
    a = df.select("beta", (F.col("tau_index") + 1).alias("tau_index"), "mode", F.col("g").alias("t"))
    cells = df.join(a, ["beta", "tau_index", "mode"]).groupBy("beta", "tau_index", "t", F.col("g").alias("p")).agg(F.sum("n").alias("n"))
    c2 = lambda x: F.sum(F.col(x) * (F.col(x) - 1) / 2.0)
    base = cells.groupBy("beta", "tau_index").agg(F.sum("n").alias("n"), c2("n").alias("pairs"))
    side = lambda c: cells.groupBy("beta", "tau_index", c).agg(F.sum("n").alias("m")).groupBy("beta", "tau_index").agg(c2("m").alias(f"pairs_{c}"))
    ari = base.join(side("t"), ["beta", "tau_index"]).join(side("p"), ["beta", "tau_index"]).select("beta", "tau_index", partition._ari().alias("ari_prev"))
    rows = stats.join(ari, ["beta", "tau_index"], "left").join(modes_of, ["beta", "tau_index"]).withColumn("compression", 1 - F.col("k") / F.col("fine")).drop("fine")
    return adjacent_stability(rows, "beta", "tau")


def ablations(base: Configuration) -> dict[str, Configuration]:
    """R1."""
    return {
        "full": base,
        "graph_no_mutual_gate": replace(base, mutual=False, min_degree=0),
        "graph_no_spatial_affinity": replace(base, use_spatial_affinity=False),
        "diffusion_T0": replace(base, checkpoint=0),
        "mode_no_spatial_cleanup": replace(base, filter_radius=0),
        "mode_no_fine_grouping": replace(base, disable_fine_grouping=True, filter_radius=0),
        "consolidation_disabled": replace(base, disable_consolidation=True),
        "consolidation_no_size_weighting": replace(base, size_exponent=0.0),
    }


def sensitivity(base: Configuration, fast: bool = False) -> dict[str, Configuration]:
    """R2: one factor at a time: window, search components, checkpoint (shares of the base's) and fine radius (shares of the base's)."""
    # The study's grids.
    windows, components = ((3, 7, 9), (10, 20, 40)) if fast else ((3, 5, 7, 9), (10, 20, 30, 40))
    checkpoints, radii = ((0.5, 1, 2), (0.75, 1.0, 1.25)) if fast else ((0.25, 0.5, 1, 2), (0.5, 0.75, 1.0, 1.25, 1.5))
    rounds = sorted({max(1, int(base.checkpoint * c)) for c in checkpoints})
    grids = {"window_radius": windows, "pca_components": components, "checkpoint": rounds, "fine_radius": [round(base.fine_radius * r, 8) for r in radii]}
    return {f"{name}={value:g}": replace(base, **{name: value}) for name, values in grids.items() for value in values}


class PeakMemory:
    """The largest resident set of this process and its children (in local mode: the JVM with its Python workers) while the block runs, in MB, from /proc; None where there is none."""

    def __init__(self, interval: float = 0.05) -> None:
        self.interval, self.mb = interval, None
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)

    @staticmethod
    def _resident() -> float:
        parents, sizes = {}, {}
        for p in Path("/proc").glob("[0-9]*"):
            try:
                parents[int(p.name)] = int((p / "stat").read_text().rpartition(")")[2].split()[1])
                sizes[int(p.name)] = int((p / "statm").read_text().split()[1])
            except (OSError, IndexError, ValueError):
                continue
        family, grown = {os.getpid()}, True
        while grown:
            more = {p for p, up in parents.items() if up in family} - family
            family |= more
            grown = bool(more)
        return sum(sizes.get(p, 0) for p in family) * os.sysconf("SC_PAGE_SIZE") / 1e6

    def _watch(self) -> None:
        while not self._over.wait(self.interval):
            self.mb = max(self.mb or 0.0, self._resident())

    def __enter__(self) -> PeakMemory:
        if Path("/proc/self/statm").exists():
            self.mb = self._resident()
            self._thread.start()
        return self

    def __exit__(self, *error: object) -> None:
        self._over.set()
        if self._thread.is_alive():
            self._thread.join(timeout=1)


def profile(pixels: DataFrame, config: Configuration, repeats: int = 3) -> list[dict]:
    """Of each repeat the seconds by stage, pixels, clusters, and the peak of resident memory."""
    out = []
    for repeat in range(repeats):
        row: dict = {"repeat": repeat}
        began = time.perf_counter()
        with PeakMemory() as memory:
            labels = discover(pixels, config, timer=lambda s, t, row=row: row.update({s: t}))
            counts = labels.agg(F.count("*").alias("n_pixels"), F.countDistinct("fine").alias("fine_modes"), F.countDistinct("label").alias("clusters")).first().asDict()
        out.append(row | {"total": time.perf_counter() - began, "peak_memory_mb": memory.mb} | counts)
    return out


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned runs not done yet."""
    return plan.join(done.select(keys), keys, "left_anti")


def key_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of a, with side: "first" (not in b) or "both"."""
    return a.subtract(b).withColumn("side", F.lit("first")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


def agrees(a: Column, b: Column, tolerance: float = 1e-12) -> Column:
    """K9: numbers within the tolerance; two nulls agree, one alone doesn't."""
    return F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())


def canonical_sha(value: object) -> str:
    """K7: SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def source_sha(root: Path = Path(__file__).resolve().parents[1]) -> str:
    """SHA-256 over the names and contents of the package's own sources (those of the core, by name)."""
    files = sorted(p for part in ("operators", "functions") for p in (root / part).glob("*.py"))
    return canonical_sha([(p.relative_to(root).as_posix(), hashlib.sha256(p.read_bytes()).hexdigest()) for p in files])


def lock(config: Configuration, labels: DataFrame) -> dict:
    """A protocol's, the sources' and a partition's fingerprints; verify with check_lock before the reference labels are read."""
    return {"protocol_sha256": canonical_sha(asdict(config)), "source_sha256": source_sha(), "partition_sha256": partition_sha(labels)}


def partition_sha(labels: DataFrame) -> str:
    """Independent of row order and partitioning: sums of 128 bits of row hashes, and the count."""
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), "i", F.col("label").cast("long")).cast("decimal(38,0)"))
    r = labels.agg(F.count("*").alias("n"), h(1).alias("a"), h(2).alias("b")).first()
    return canonical_sha([int(r["n"]), str(r["a"]), str(r["b"])])


def check_lock(locked: dict, config: Configuration, labels: DataFrame) -> None:
    for name, value in lock(config, labels).items():
        if locked.get(name) != value:
            raise ValueError(f"{name} differs from the lock")


def repeatability(a: DataFrame, b: DataFrame, truth: DataFrame | None = None, ignore: object = 0) -> DataFrame:
    """One row: n, ari, k_a, k_b, k_difference of two labelings (i, label), and with truth (i, gt) n_labelled and ari_labelled of the pixels whose gt isn't `ignore`."""
    both = a.select("i", F.col("label").alias("t")).join(b.select("i", F.col("label").alias("p")), "i")
    if truth is not None:
        both = both.join(truth.select("i", "gt"), "i")
    both = fresh(both)
    counts = both.agg(F.count("*").alias("n"), F.countDistinct("t").alias("k_a"), F.countDistinct("p").alias("k_b"))
    out = counts.crossJoin(partition.ari(partition.contingency(both, "t", "p"))).withColumn("k_difference", F.col("k_b") - F.col("k_a"))  # one-row frames
    if truth is not None:
        some = both.where(F.col("gt") != F.lit(ignore))
        out = out.crossJoin(some.agg(F.count("*").alias("n_labelled"))).crossJoin(partition.ari(partition.contingency(some, "t", "p")).withColumnRenamed("ari", "ari_labelled"))
    return out


def reproduction(a: DataFrame, b: DataFrame, least: float = 0.999) -> float:
    """Agreement of two labelings (i, label); an error under `least`."""
    both = a.select("i", F.col("label").alias("t")).join(b.select("i", F.col("label").alias("p")), "i")
    value = partition.ari(partition.contingency(both, "t", "p")).first()["ari"]
    if value < least:
        raise ValueError(f"agreement {value:.6f} is under {least}")
    return value


def add_noise(pixels: DataFrame, strength: float = 0.01, seed: int = 1) -> DataFrame:
    """Gaussian noise of `strength` times each band's population deviation; drawn by the MD5 of seed, id and band, so independent of partitioning."""
    stats = scene.band_stats(pixels).agg(F.array_sort(F.collect_list(F.struct("band", "std"))).alias("_s"))
    unit = lambda b, at: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "i", b).cast("binary")), at, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    normal = lambda b: F.sqrt(-2 * F.log(unit(b, 1))) * F.cos(2 * 3.141592653589793 * unit(b, 9))
    moved = F.zip_with("v", "_s", lambda v, s: v + strength * s["std"] * normal(s["band"]))
    return pixels.crossJoin(F.broadcast(stats)).withColumn("v", moved).drop("_s")  # one row


def replace_pixels(pixels: DataFrame, share: float = 0.05, seed: int = 1) -> DataFrame:
    """A share of pixels, drawn by the MD5 of seed and id, take another pixel's vector: that of the pixel `step` places on in the order of ids.

    Ids may have gaps and must be distinct. A scene of one pixel keeps its vector.
    """
    numbered = fresh(pixels.select("i", "v").join(modes.dense_numbers(pixels.select("i"), "i"), "i"))
    n = numbered.count()
    step = 1 + seed * 7919 % max(n - 1, 1)
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("i")).cast("binary")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    hit = numbered.where(drawn).select("i", ((F.col("label") + step) % n).alias("label"))
    given = hit.join(numbered.select("label", F.col("v").alias("_v")), "label").select("i", "_v")
    return pixels.join(given, "i", "left").withColumn("v", F.coalesce("_v", "v")).drop("_v")


def merge_to(features: DataFrame, labels: DataFrame, k: int, size_exponent: float = 0.0) -> DataFrame:
    """(i, label) with the least separated modes merged greedily until k are left."""
    table = prototypes.mode_prototypes(labels.join(features, "i"))
    ids, mu, disp, size = prototypes.modes_to_arrays(table)
    return prototypes.apply_groups(labels, prototypes.group_table(table, ids, prototypes.merge_until(mu, disp, size, k, size_exponent)))
