"""Damped diffusion on a weighted graph: by tiles of a raster with halos, or as DataFrame rounds where there are no coordinates or every movement counts."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.arrow import matrix
from rasterloom.functions.vector import distance, gaussian
from rasterloom.operators.modes import merge_modes
from rasterloom.session import fresh


def _check(anchor: float) -> None:
    if not 0 <= anchor < 1:
        raise ValueError("the anchor strength must be in [0, 1)")


def neighbour_means(state: DataFrame, edges: DataFrame) -> DataFrame:
    """A4: (i, m), the mean of the neighbours' y weighted by w; isolated pixels (weight sum up to 1e-12) are left out."""
    joined = edges.select("i", F.col("j").alias("_j"), "w").join(state.select(F.col("i").alias("_j"), "y"), "_j")
    mean = joined.groupBy("i").agg(Summarizer.mean(array_to_vector("y"), F.col("w")).alias("m"), F.sum("w").alias("t"))
    return mean.where("t > 1e-12").select("i", vector_to_array("m").alias("m"))


def _blend(y: Column, first: Column, mean: Column, alpha: float, anchor: float) -> Column:
    """K6: (1 - alpha) y + alpha (anchor x0 + (1 - anchor) mean)."""
    pulled = F.zip_with(first, mean, lambda a, b: anchor * a + (1 - anchor) * b)
    return F.zip_with(y, pulled, lambda a, b: (1 - alpha) * a + alpha * b)


def diffusion_step(state: DataFrame, edges: DataFrame, alpha: float = 0.5, anchor: float = 0.0) -> DataFrame:
    """state: (i, y, x0). The same after one round; isolated pixels stay."""
    _check(anchor)
    return state.join(neighbour_means(state, edges), "i", "left").select("i", _moved(alpha, anchor).alias("y"), "x0")


def _moved(alpha: float, anchor: float = 0.0) -> Column:
    return F.when(F.col("m").isNull(), F.col("y")).otherwise(_blend(F.col("y"), F.col("x0"), F.col("m"), alpha, anchor))


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """A5: the longest way that a pixel went."""
    both = before.select("i", F.col("y").alias("_a")).join(after.select("i", F.col("y").alias("_b")), "i")
    return both.agg(F.coalesce(F.max(distance("_a", "_b")), F.lit(0.0)).alias("movement"))


def diffuse(pixels: DataFrame, edges: DataFrame, *, max_iter: int = 50, tol: float = 1e-4, alpha: float = 0.5, anchor: float = 0.0, every: int = 4) -> tuple[DataFrame, list[float]]:
    """G3 as rounds over the cluster: ((i, y), movement of each round). Stops when a movement is under tol.

    With tol 0 nothing depends on the movements: a round adds its own to the rows, and lineage is cut every few rounds.
    """
    _check(anchor)
    state = pixels.select("i", F.col("v").alias("y"), F.col("v").alias("x0"))
    edges = fresh(edges.select("i", "j", "w"))
    return _rounds(state, lambda rows: neighbour_means(rows, edges), _moved(alpha, anchor), max_iter, tol, every)


def _rounds(state: DataFrame, means: Callable[[DataFrame], DataFrame], moved: Column, max_iter: int, tol: float, every: int) -> tuple[DataFrame, list[float]]:
    """Rounds of moving to the means: (i, y) and the longest way of every round. A row carries its way in each round since the last cut."""
    history: list[float] = []
    none = F.array().cast("array<double>")
    state, held = state.withColumn("way", none), 0
    for k in range(1, max_iter + 1):
        after = state.join(means(state), "i", "left").withColumn("_new", moved)
        state = after.select("i", F.col("_new").alias("y"), "x0", F.concat("way", F.array(distance("y", "_new"))).alias("way"))
        held += 1
        if tol > 0 or held == every or k == max_iter:
            state = fresh(state)
            history += list(state.agg(*[F.coalesce(F.max(F.get("way", F.lit(r))), F.lit(0.0)).alias(f"w{r}") for r in range(held)]).first())
            state, held = state.withColumn("way", none), 0
            if tol > 0 and history[-1] < tol:
                break
    return state.select("i", "y"), history


def _rows(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(values.ravel()))


#: Sides of a tile, values that a step holds at once, and the costs that weigh rounds in one go against the halo that they need (seconds of a job, of a pixel's round, of a pixel's way to a tile).
LEAST_TILE, MOST_TILE, HELD = 16, 128, 1 << 22
_JOB, _ROUND, _SENT = 0.5, 2e-6, 4e-6


def _depth(side: int, radius: int, height: int, width: int, rounds: int) -> int:
    """How many rounds a tile does in one go: its halo is so many radii wide."""

    def cost(depth: int) -> float:
        area = min(side + 2 * depth * radius, height) * min(side + 2 * depth * radius, width)
        return (_JOB + area * _SENT) / depth + area * _ROUND

    return min(range(1, min(rounds, 64) + 1), key=cost)


def _pack(pixels: pa.Table, edges: pa.Table) -> pa.Table:
    """A tile's pixels in order of i (own: not of the halo) and the rows of normalised weights among them, as one row of packed arrays."""
    ids = pixels.column("i").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    i, j, w = (edges.column(c).to_numpy() for c in ("i", "j", "w"))
    at, to = np.searchsorted(ids, i), np.minimum(np.searchsorted(ids, j), len(ids) - 1)
    held = ids[to] == j if len(j) else np.zeros(0, bool)  # others lie beyond the halo
    at, to, w = at[held], to[held], w[held]
    by = np.lexsort((to, at))
    at, to, w = at[by], to[by], w[by]
    total = np.bincount(at, w, len(ids)) if len(at) else np.zeros(len(ids))
    alive = total[at] > 1e-12
    at, to, w = at[alive], to[alive], (w / np.where(total > 0, total, 1)[at])[alive]
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, int)
    own, r, c = (pixels.column(n).to_numpy(zero_copy_only=False)[order] for n in ("own", "r", "c"))
    blobs = {"ids": ids, "own": own, "r": r, "c": c, "at": at[start].astype(np.int32), "start": start.astype(np.int64), "j": to.astype(np.int32), "w": w}
    return pa.table({"tile": pa.array([pixels.column("tile")[0].as_py()], pa.int64()), **{n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in blobs.items()}})


_PACKED = {"ids": np.int64, "own": np.bool_, "r": np.int64, "c": np.int64, "at": np.int32, "start": np.int64, "j": np.int32, "w": np.float64}


def _rounds_of(n: int, alpha: float, anchor: float):
    """A cogrouped function: n rounds over a tile and its halo; what comes back are the tile's own pixels."""

    def run(state: pa.Table, packed: pa.Table) -> pa.Table:
        if not state.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.float64())), "f": pa.array([], pa.list_(pa.float64()))})
        ids, own, r, c, at, start, j, w = (np.frombuffer(packed.column(k)[0].as_py(), t) for k, t in _PACKED.items())
        order = np.argsort(state.column("i").to_numpy())
        y = matrix(state.column("v"))[order]
        first = matrix(state.column("f"))[order] if anchor else None
        edge = np.append(start, len(j))
        step = max(1, HELD // max(1, y.shape[1]))
        for _ in range(n):
            new = y.copy()
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + step, "right")) - 1)
                k = slice(edge[lo], edge[hi])
                mean = np.add.reduceat(w[k, None] * y[j[k]], edge[lo:hi] - edge[lo], axis=0)
                rows = at[lo:hi]
                new[rows] = (1 - alpha) * y[rows] + alpha * (anchor * first[rows] + (1 - anchor) * mean if anchor else mean)
                lo = hi
            y = new
        return pa.table({"i": pa.array(ids[own]), "r": pa.array(r[own]), "c": pa.array(c[own]), "v": _rows(y[own]), "f": _rows(first[own] if anchor else np.zeros((int(own.sum()), 0)))})

    return run


def diffuse_tiled(pixels: DataFrame, edges: DataFrame, checkpoints: list[int] | tuple[int, ...], *, radius: int | None = None, alpha: float = 0.5, anchor: float = 0.0, side: int | None = None, depth: int | None = None) -> DataFrame:
    """(t, i, y), the states after the given rounds. pixels: (i, y, x, v); edges: (i, j, w) between pixels up to `radius` rows and columns apart (default: as far as they are).

    Rounds are blocked in time: a tile gets its pixels and a halo of depth x radius pixels once, does `depth` rounds, and
    keeps its own pixels, which the missing edges beyond the halo can't have reached. So `depth` rounds take one shuffle of
    the states (a halo's share more than once) instead of three each. The tiles' weights are packed once. Sums run over a
    pixel's neighbours in order, so results don't depend on side, depth or tasks. Pixels without neighbours stay.
    """
    _check(anchor)
    rounds = sorted(set(checkpoints))
    places = pixels.select("i", F.col("y").cast("long").alias("r"), F.col("x").cast("long").alias("c"))
    if radius is None:
        far = edges.join(places, "i").join(places.select(F.col("i").alias("j"), F.col("r").alias("_r"), F.col("c").alias("_c")), "j")
        radius = far.agg(F.max(F.greatest(F.abs(F.col("r") - F.col("_r")), F.abs(F.col("c") - F.col("_c")))).alias("m")).first()["m"] or 0
    radius = max(1, int(radius))
    ends = places.agg(F.count("*").alias("n"), *(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in "rc")).first()
    low, high = ({c: ends[c][end] or 0 for c in "rc"} for end in ("low", "high"))
    if side is None:
        side = min(MOST_TILE, max(LEAST_TILE, math.ceil(math.sqrt(ends["n"] / pixels.sparkSession.sparkContext.defaultParallelism))))
    depth = depth or _depth(side, radius, high["r"] - low["r"] + 1, high["c"] - low["c"] + 1, max([1, *rounds]))
    across = (high["c"] - low["c"]) // side + 1

    def place(c: str, shift: int) -> Column:
        return F.floor((F.least(F.lit(high[c]), F.greatest(F.lit(low[c]), F.col(c) + shift)) - low[c]) / side)

    def dealt(rows: DataFrame) -> DataFrame:
        """A row for each tile that a pixel belongs to, own or by its halo."""
        span = lambda c: F.explode(F.sequence(place(c, -depth * radius), place(c, depth * radius)))
        named = rows.withColumn("_a", span("r")).withColumn("_b", span("c"))
        own = (F.col("_a") == place("r", 0)) & (F.col("_b") == place("c", 0))
        return named.withColumn("tile", F.col("_a") * across + F.col("_b")).withColumn("own", own).drop("_a", "_b")

    lines = dealt(edges.select("i", "j", "w").join(places, "i")).select("tile", "i", "j", F.col("w").cast("double").alias("w"))
    packed = dealt(places).groupBy("tile").cogroup(lines.groupBy("tile")).applyInArrow(_pack, "tile long, " + ", ".join(f"{n} binary" for n in _PACKED))
    packed = fresh(packed)
    v = F.col("v").cast("array<double>")
    state = pixels.select("i", F.col("y").cast("long").alias("r"), F.col("x").cast("long").alias("c"), v.alias("v"), (v if anchor else F.array().cast("array<double>")).alias("f"))
    out, done = [], 0
    for t in rounds:
        while done < t:
            n = min(depth, t - done)
            state = fresh(dealt(state).select("tile", "i", "v", "f").groupBy("tile").cogroup(packed.groupBy("tile")).applyInArrow(_rounds_of(n, alpha, anchor), "i long, r long, c long, v array<double>, f array<double>"))
            done += n
        out.append(state.select(F.lit(t).cast("long").alias("t"), "i", F.col("v").alias("y")))
    return reduce(DataFrame.unionByName, out)


def diffuse_dynamic(pixels: DataFrame, edges: DataFrame, *, sigma_spectral: float, sigma_spatial: float, max_iter: int = 100, tol: float = 1e-4, alpha: float = 0.5, blurring: bool = True, use_spatial: bool = True, every: int = 4) -> tuple[DataFrame, list[float]]:
    """Mean shift whose weights are taken anew each round, between current states (blurring) or a state and the neighbours' first vectors. edges: (i, j, sp)."""
    state = pixels.select("i", F.col("v").alias("y"), F.col("v").alias("x0"))
    edges = fresh(edges.select("i", "j", "sp"))

    def means(rows: DataFrame) -> DataFrame:
        seen = "y" if blurring else "x0"
        both = edges.join(rows.select("i", F.col("y").alias("_a")), "i").join(rows.select(F.col("i").alias("j"), F.col(seen).alias("_b")), "j")
        w = gaussian(distance("_a", "_b"), F.lit(sigma_spectral)) * (gaussian("sp", F.lit(sigma_spatial)) if use_spatial else F.lit(1.0))
        return both.withColumn("w", w).groupBy("i").agg(Summarizer.mean(array_to_vector("_b"), F.col("w")).alias("m"), F.sum("w").alias("t")).where("t > 1e-12").select("i", vector_to_array("m").alias("m"))

    return _rounds(state, means, _moved(alpha), max_iter, tol, every)


def cluster(pixels: DataFrame, edges: DataFrame, *, max_iter: int = 50, tol: float = 1e-4, alpha: float = 0.5, anchor: float = 0.0, merge_tol: float = 0.15, merge_components: int = 10) -> DataFrame:
    """(i, label) of a weighted graph in one call: diffuse, then merge the modes."""
    state, _ = diffuse(pixels, edges, max_iter=max_iter, tol=tol, alpha=alpha, anchor=anchor)
    return merge_modes(fresh(state), merge_tol, pca_components=merge_components)
