"""Baseline clusterers over (i, v[, y, x]) rows; each returns (i, label) with labels from 0 (noise: -1)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.arrow import matrix
from rasterloom.functions.vector import squared_distance
from rasterloom.operators.components import connected_components
from rasterloom.operators.hierarchy import hdbscan, spanning_tree  # noqa: F401
from rasterloom.operators.partition import ari_of_cells
from rasterloom.operators.scene import minmax, pca, zscore
from rasterloom.operators.selectors import select_resolution
from rasterloom.session import fresh, settings


def features(pixels: DataFrame, components: int = 20, vector: str = "v") -> DataFrame:
    """P5: what the baselines see: bands scaled to unit population deviation, then at most `components` principal scores."""
    return fresh(pca(zscore(pixels, vector, least=1e-300), components, vector, out=vector))


def kmeans(points: DataFrame, k: int, *, seed: int = 0, n_init: int = 20, max_iter: int = 300, tol: float = 1e-4) -> DataFrame:
    """B1: the best of n_init k-means runs by training cost.

    Spark ML draws the starts (k-means||); the rounds of all runs that haven't settled then share one pass over the
    points, so there are as many passes as the longest run has rounds. A run settles, and is judged, as in Spark ML: no
    centre moves by more than tol; its cost is that of its last round's assignment.
    """
    rows = points.select("i", array_to_vector("v").alias("features")).persist()
    start = KMeans(k=k, maxIter=0, initMode="k-means||")
    runs = [np.array(start.copy({start.seed: seed * 1000 + run}).fit(rows).clusterCenters(), float) for run in range(n_init)]
    rows.unpersist()
    points = points.select("i", F.col("v").cast("array<double>").alias("v")).persist()
    cost, live = np.full(n_init, np.inf), list(range(n_init))
    for _ in range(max_iter):
        if not live:
            break
        ends = np.cumsum([0, *(len(runs[r]) for r in live)])
        told = points.mapInArrow(_round(np.concatenate([runs[r] for r in live]), ends), "c long, n long, s array<double>, cost double")
        sums = [F.sum(F.get("s", F.lit(j))) for j in range(runs[0].shape[1])]
        made = told.groupBy("c").agg(F.sum("n").alias("n"), F.array(*sums).alias("s"), F.sum("cost").alias("cost")).collect()  # a row a centre
        new = {r["c"]: (r["n"], np.array(r["s"]), r["cost"]) for r in made}
        still = []
        for r, first, end in zip(live, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = [c for c in range(first, end) if c in new]  # a centre without points stays
            centres = runs[r].copy()
            for c in at:
                centres[c - first] = new[c][1] / new[c][0]
            cost[r] = sum(new[c][2] for c in at)
            if ((centres - runs[r]) ** 2).sum(1).max() > tol * tol:
                still.append(r)
            runs[r] = centres
        live = still
    best = runs[int(cost.argmin())]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            own = np.concatenate([np.zeros(0, np.int32), *(_apart(x[at : at + 1024], best).argmin(1) for at in range(0, len(x), 1024))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32))], ["i", "label"])

    out = fresh(points.mapInArrow(label, f"i {points.schema['i'].dataType.simpleString()}, label int"))
    points.unpersist()
    return out


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centre."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _round(centres: np.ndarray, ends: np.ndarray):
    """Of each centre of several runs (run r has centres ends[r]..ends[r + 1] - 1) the number, sum and cost of the points that are nearest to it in its run; ties go to the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, cost = np.zeros(len(centres)), np.zeros_like(centres), np.zeros(len(centres))
        step = max(1, min(4096, (1 << 21) // len(centres)))
        for batch in batches:
            every = matrix(batch.column(1))
            for at in range(0, len(every), step):
                x = every[at : at + step]
                d = _apart(x, centres)
                row = np.arange(len(x))
                held = np.zeros_like(d)
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    held[row, a + d[:, a:b].argmin(1)] = 1
                n += held.sum(0)
                s += held.T @ x
                cost += (held * d).sum(0)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen].astype(np.int64)), pa.array(s[seen].tolist(), pa.list_(pa.float64())), pa.array(cost[seen])], ["c", "n", "s", "cost"])

    return run


def _nearest(vector: str, centres: np.ndarray):
    """Number of the nearest centre; ties go to the first."""
    d = [F.struct(squared_distance(vector, F.array(*map(F.lit, c))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres.tolist())]
    return (F.least(*d) if len(d) > 1 else d[0])["k"]


def _start(points: DataFrame, k: int, seed: int) -> np.ndarray:
    rows = points.orderBy(F.xxhash64(F.lit(seed), "i"), "i").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], float)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn by its squared distance from those before it."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(k, len(x)):
        total = near.sum()
        centres.append(x[rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


#: Values of mini-batches that one scan brings to the driver (32 MB).
TAKEN = 1 << 22


def minibatch_kmeans(points: DataFrame, k: int, *, seed: int = 0, batch: int = 4096, max_iter: int = 300, n_init: int = 20, n: int | None = None, tol: float = 1e-4) -> DataFrame:
    """B2: the best of n_init starts on a bounded sample, then steps that each see a hash sample of about `batch` rows and move the centres by running means.

    The samples of several steps, TAKEN values of them, come from one scan.
    """
    points = fresh(points)
    total = points.count() if n is None else n
    share = lambda rows: min(1.0, rows / max(total, 1)) * (1 << 20)
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), salt, "i"), F.lit(1 << 20))
    stacked = lambda own: np.stack(own.to_numpy()).astype(float) if len(own) else np.zeros((0, 0))

    centres, seen = _start(points, k, seed), np.zeros(k)
    held = stacked(points.where(draw(F.lit(-1)) < share(3 * batch)).select("v").toPandas().v)  # about 3 batches
    if len(held) >= k:
        rng = np.random.default_rng(seed)
        starts = [_spread(held, k, rng) for _ in range(n_init)]
        centres = min(starts, key=lambda c: sum(float(_least(held[at : at + 1024], c).sum()) for at in range(0, len(held), 1024)))
    whole = total <= batch
    ahead = 1 if whole else max(1, min(max_iter, TAKEN // max(1, batch * (held.shape[1] or 1))))
    taken: dict[int, np.ndarray] = {}
    for step in range(max_iter):
        if whole:
            x = taken.setdefault(0, held if len(held) else stacked(points.select("v").toPandas().v))
        else:
            if step % ahead == 0:
                steps = F.array(*[F.lit(t) for t in range(step, min(step + ahead, max_iter))])
                rows = points.select(F.explode(F.filter(steps, lambda t: draw(t) < share(batch))).alias("t"), "v").toPandas()  # about `ahead` batches
                taken = {t: stacked(own.v) for t, own in rows.groupby("t")}
            x = taken.get(step, np.zeros((0, 0)))
        if not len(x):
            continue
        own = np.concatenate([((x[at : at + 1024, None] - centres[None]) ** 2).sum(-1).argmin(1) for at in range(0, len(x), 1024)])
        count = np.bincount(own, minlength=k).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        seen += count
        new = centres + np.where(count[:, None] > 0, (sums - count[:, None] * centres) / np.maximum(seen, 1)[:, None], 0)
        moved = np.abs(new - centres).max()
        centres = new
        if moved < tol:
            break
    return points.select("i", _nearest("v", centres).alias("label"))


def _least(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(-1).min(1)


def fuzzy_cmeans(points: DataFrame, k: int, *, seed: int = 0, max_iter: int = 150, tol: float = 1e-4, least: float = 1e-12) -> DataFrame:
    """Fuzzy c-means with m = 2. A round sums k x bands weighted products; memberships are expressions of the centres and never stored."""
    points = fresh(points)
    d = points.select(F.size("v").alias("d")).first()["d"]

    def sums(centres: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, s, moved = np.zeros(k), np.zeros((k, d)), 0.0
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
                ids = b.column(0).to_numpy()
                u = member(x, ids, centres)
                if previous is not None:
                    moved = max(moved, float(np.abs(u - member(x, ids, previous[0])).max(initial=0)))
                w += (u * u).sum(0)
                s += (u * u).T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(w), pa.array(s.tolist()), pa.array([moved] * k)], ["c", "w", "s", "m"])

        return run

    def member(x: np.ndarray, ids: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
        if centres is None:
            u = np.stack([np.random.default_rng((seed, int(i))).random(k) for i in ids]) if len(ids) else np.zeros((0, k))
            return u / np.maximum(u.sum(1, keepdims=True), least)
        inv = 1 / np.maximum(((x[:, None] - centres[None]) ** 2).sum(-1), least)
        return inv / inv.sum(1, keepdims=True)

    previous: list | None = None
    centres: np.ndarray | None = None
    for _ in range(max_iter):
        total = points.select("i", F.col("v").cast("array<double>")).mapInArrow(sums(centres), "c long, w double, s array<double>, m double")
        rows = total.groupBy("c").agg(F.sum("w").alias("w"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(d)]).alias("s"), F.max("m").alias("m")).orderBy("c").collect()
        if previous is not None and rows[0]["m"] < tol:
            break
        previous, centres = [centres], np.array([np.array(r["s"]) / max(r["w"], least) for r in rows])
    return points.select("i", _nearest("v", centres).alias("label"))


def slic_kmeans(pixels: DataFrame, k: int, *, size: int = 100, compactness: float = 0.1, rounds: int = 10, seed: int = 0, n_init: int = 20) -> DataFrame:
    """Superpixels of about `size` pixels on the first five rescaled components, k-means on their means, labels back to pixels.

    A pixel only meets the seeds of its own and the eight surrounding grid cells.
    """
    full = fresh(minmax(pixels).select("i", "y", "x", "v"))
    step = max(1, int(round(size**0.5)))
    state = full.groupBy(F.floor(F.col("y") / step).alias("gy"), F.floor(F.col("x") / step).alias("gx")).agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.array(*[F.avg(F.get("v", F.lit(j))) for j in range(5)]).alias("cv"))
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    looks = full.withColumn("o", shifts).select("i", "y", "x", "v", (F.floor(F.col("y") / step) + F.col("o.a")).alias("gy"), (F.floor(F.col("x") / step) + F.col("o.b")).alias("gx"))
    owner = None
    for _ in range(rounds):
        d2 = squared_distance("v", F.slice("cv", 1, F.size("v"))) + (compactness / step) ** 2 * ((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2)
        near = looks.join(state, ["gy", "gx"]).withColumn("d", d2)
        owner = near.groupBy("i").agg(F.min_by(F.struct("gy", "gx", "y", "x", "v"), F.struct("d", "gy", "gx")).alias("s")).select("i", "s.*")
        new = owner.groupBy("gy", "gx").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.array(*[F.avg(F.get("v", F.lit(j))) for j in range(5)]).alias("cv"))
        state = fresh(new)
    owner = connected_regions(owner.select("i", "y", "x", "gy", "gx"), size)
    held = owner.join(pixels.select("i", "v"), "i")
    means = held.select("region", F.posexplode("v").alias("b", "u")).groupBy("region", "b").agg(F.avg("u").alias("u")).groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "u"))), lambda s: s["u"]).alias("v"))
    means = fresh(means.withColumnRenamed("region", "i"))  # a row a superpixel
    if k > means.count():
        raise ValueError("more clusters than superpixels")
    labels = kmeans(means, k, seed=seed, n_init=n_init)
    return owner.join(labels.withColumnRenamed("i", "region"), "region").select("i", "label")


def connected_regions(owner: DataFrame, size: int, least: float = 0.5) -> DataFrame:
    """(i, region): superpixels in one piece, named by their smallest pixel. owner: i, y, x and its superpixel (gy, gx).

    A superpixel falls into its 4-connected pieces. A piece under `least` times `size` pixels goes to the neighbouring
    piece with which it shares most sides (ties: the smallest name) until none is left that has a larger neighbour.
    """
    px = fresh(owner)
    other = px.select(F.col("i").alias("j"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("gy").alias("gy2"), F.col("gx").alias("gx2"))
    step = F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"))))
    sides = px.withColumn("o", step).select("i", "gy", "gx", (F.col("y") + F.col("o.a")).alias("y2"), (F.col("x") + F.col("o.b")).alias("x2"))
    sides = fresh(sides.join(other, ["y2", "x2"]).select("i", "j", ((F.col("gy") == F.col("gy2")) & (F.col("gx") == F.col("gx2"))).alias("same")))
    found = connected_components(sides.where("same"), "i", "j")
    piece = fresh(px.select("i").join(found.withColumnRenamed("node", "i"), "i", "left").select("i", F.coalesce("component", "i").alias("region")))
    while True:
        count = piece.groupBy("region").agg(F.count("*").alias("n"))
        touching = sides.join(piece, "i").join(piece.select(F.col("i").alias("j"), F.col("region").alias("to")), "j").where("region <> to")
        both = touching.select("region", "to").unionAll(touching.select(F.col("to").alias("region"), F.col("region").alias("to"))).groupBy("region", "to").agg(F.count("*").alias("shared"))
        small = count.where(F.col("n") < least * size)
        near = both.join(small.select("region", F.col("n").alias("own")), "region").join(count.select(F.col("region").alias("to"), "n"), "to")
        # towards the larger piece, or the smaller name among equals, so that no two take each other
        onward = near.where((F.col("n") > F.col("own")) | ((F.col("n") == F.col("own")) & (F.col("to") < F.col("region"))))
        into = fresh(onward.groupBy("region").agg(F.max_by("to", F.struct("shared", F.negative("to"))).alias("_to")))
        if into.isEmpty():
            return piece
        ends = connected_components(into, "region", "_to").withColumnRenamed("node", "region")
        piece = fresh(piece.join(ends, "region", "left").select("i", F.coalesce("component", "region").alias("region")))


#: So many directed edges fit one task.
FEW_EDGES = 4_500_000


def communities(edges: DataFrame, *, resolution: float = 1.0, seed: int = 0, levels: int = 3, rounds: int = 8, iterations: int = 2, few: int = FEW_EDGES) -> DataFrame:
    """(i, label): modularity communities (configuration model with a resolution) of a weighted graph, by Leiden's three phases.

    A graph of up to `few` directed edges is settled by one executor task, node by node (leiden_in_memory); a larger one by
    rounds over the cluster, with parallel moves and so with other communities of like quality. Local moves: in a round a hashed half of the nodes go to the neighbouring community with the largest gain. Refinement:
    within each community nodes begin alone and join well-connected parts of it, which become the nodes of the next level;
    there they begin in the communities found. A further iteration begins with the communities of the one before.
    edges: (i, j, w), each direction present. Deterministic for a seed.
    """
    base = _summed(edges)
    return _communities(base, base.count() <= few, resolution, seed, levels, rounds, iterations)


def _summed(edges: DataFrame) -> DataFrame:
    return fresh(edges.where("i <> j").groupBy("i", "j").agg(F.sum("w").alias("w")))


def _communities(base: DataFrame, few: bool, resolution: float, seed: int, levels: int = 3, rounds: int = 8, iterations: int = 2) -> DataFrame:
    if few:

        def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, j, w = (np.concatenate(x) for x in zip(*([b.column(c).to_numpy() for c in range(3)] for b in batches), strict=True))
            ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            label = leiden_in_memory(at[: len(i)], at[len(i) :], w, len(ids), resolution, seed, iterations)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["i", "label"])

        return base.coalesce(1).mapInArrow(settle, "i long, label long") if not base.isEmpty() else base.select("i", F.col("j").alias("label"))
    total = float(base.agg(F.sum("w").alias("m")).first()["m"] or 0.0)
    nodes = fresh(base.select("i").distinct())
    found = nodes.select("i", F.col("i").alias("c"))
    for turn in range(iterations if total else 0):
        level, loops = base, None
        path = nodes.select(F.col("i").alias("node"), "i")
        own = found
        for depth in range(levels):
            degree = level.groupBy("i").agg(F.sum("w").alias("k"))
            if loops is not None:
                degree = degree.unionByName(loops.select("i", F.col("w").alias("k"))).groupBy("i").agg(F.sum("k").alias("k"))
            degree = fresh(degree)
            own = _local_moves(level, degree, own, total, resolution, rounds, (seed, turn, depth))
            part = _refined(level, degree, own, total, resolution, rounds, (seed, turn, depth))
            found = fresh(path.join(own, "i").select(F.col("node").alias("i"), "c"))
            if part.agg(F.count_if(F.col("c") != F.col("i")).alias("n")).first()["n"] == 0:
                break
            path = fresh(path.join(part, "i").select("node", F.col("c").alias("i")))
            to, into = part.select("i", F.col("c").alias("a")), part.select(F.col("i").alias("j"), F.col("c").alias("b"))
            up = fresh(level.join(to, "i").join(into, "j").groupBy("a", "b").agg(F.sum("w").alias("w")))
            inner = up.where("a = b").select(F.col("a").alias("i"), "w")
            if loops is not None:
                inner = inner.unionByName(loops.join(to, "i").select(F.col("a").alias("i"), "w"))
            loops = fresh(inner.groupBy("i").agg(F.sum("w").alias("w")))
            own = fresh(own.join(to, "i").groupBy(F.col("a").alias("i")).agg(F.min("c").alias("c")))  # a part lies in one community
            level = up.where("a <> b").select(F.col("a").alias("i"), F.col("b").alias("j"), "w")
    return found.groupBy("c").agg(F.min("i").alias("label")).join(found, "c").select("i", "label")


def leiden_in_memory(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, resolution: float, seed: int, iterations: int) -> np.ndarray:
    """Of each node 0..n - 1 its community, named by its smallest node. Each direction of an edge is given."""
    rng = np.random.default_rng(seed)
    total = float(w.sum())
    found = np.arange(n)
    for _ in range(iterations if total else 0):
        order = np.lexsort((j, i))
        level = (i[order], j[order], w[order].astype(float))
        loops, node, own = np.zeros(n), np.arange(n), found
        while True:
            size = len(own)
            ends = np.searchsorted(level[0], np.arange(size + 1)).tolist()
            near = _Near(ends, level[1], level[2])
            degree = (np.bincount(level[0], level[2], size) + loops).tolist()
            own = _moved_in_memory(near, degree, own.tolist(), total, resolution, rng)
            found = np.array(own)[node]
            part = _refined_in_memory(near, degree, own, total, resolution, rng)
            names, part = np.unique(part, return_inverse=True)
            if len(names) == size:
                break
            own = np.array(own)[names]
            _, first, own = np.unique(own, return_index=True, return_inverse=True)
            own = first[own]
            node = part[node]
            a, b = part[level[0]], part[level[1]]
            loops = np.bincount(part, loops, len(names)) + np.bincount(a[a == b], level[2][a == b], len(names))
            key, at = np.unique(a[a != b] * len(names) + b[a != b], return_inverse=True)
            level = (key // len(names), key % len(names), np.bincount(at, level[2][a != b], len(key)))
        _, first, at = np.unique(found, return_index=True, return_inverse=True)
        found = first[at]
    return found


class _Near:
    """Of each node its neighbours and the weights to them, from flat arrays: 16 bytes an edge."""

    def __init__(self, ends: list[int], to: np.ndarray, weight: np.ndarray) -> None:
        self.ends, self.to, self.weight = ends, to, weight

    def __getitem__(self, v: int) -> Iterator[tuple[int, float]]:
        a, b = self.ends[v], self.ends[v + 1]
        return zip(self.to[a:b].tolist(), self.weight[a:b].tolist(), strict=True)


def _moved_in_memory(near: _Near, degree: list, own: list, total: float, resolution: float, rng: np.random.Generator) -> list:
    """Node by node to the neighbouring community of the largest gain, until no node would move."""
    mass: dict[int, float] = {}
    for v, c in enumerate(own):
        mass[c] = mass.get(c, 0.0) + degree[v]
    queue = deque(rng.permutation(len(own)).tolist())
    waiting = [True] * len(own)
    empty = [c for c in range(len(own)) if c not in mass]
    while queue:
        v = queue.popleft()
        waiting[v] = False
        now, k = own[v], degree[v]
        linked: dict[int, float] = {now: 0.0}
        for u, x in near[v]:
            linked[own[u]] = linked.get(own[u], 0.0) + x
        mass[now] -= k
        best, most = now, linked[now] - resolution * k * mass[now] / total
        for c, x in sorted(linked.items()):
            gain = x - resolution * k * mass[c] / total
            if gain > most + 1e-12:
                best, most = c, gain
        if most < -1e-12 and empty:  # better alone
            best = empty.pop()
            mass.setdefault(best, 0.0)
        if mass[now] <= 1e-12 and best != now:
            empty.append(now)
        mass[best] = mass.get(best, 0.0) + k
        own[v] = best
        if best != now:
            for u, _ in near[v]:
                if own[u] != best and not waiting[u]:
                    waiting[u] = True
                    queue.append(u)
    return own


def _refined_in_memory(near: _Near, degree: list, own: list, total: float, resolution: float, rng: np.random.Generator) -> np.ndarray:
    """Parts of each community: nodes begin alone, and those well connected to the rest of it join the well-connected part of the largest gain."""
    whole: dict[int, float] = {}
    for v, c in enumerate(own):
        whole[c] = whole.get(c, 0.0) + degree[v]
    part, mass, size = list(range(len(own))), list(degree), [1] * len(own)
    out = [sum(x for u, x in near[v] if own[u] == own[v]) for v in range(len(own))]  # weight to the rest of the community
    well = lambda p, c: out[p] >= resolution * mass[p] * (whole[c] - mass[p]) / total - 1e-12
    for v in rng.permutation(len(own)).tolist():
        c = own[v]
        if size[part[v]] > 1 or not well(v, c):
            continue
        linked: dict[int, float] = {}
        for u, x in near[v]:
            if own[u] == c and part[u] != v:
                linked[part[u]] = linked.get(part[u], 0.0) + x
        best, most = v, 0.0
        for p, x in sorted(linked.items()):
            gain = x - resolution * degree[v] * mass[p] / total
            if gain > most + 1e-12 and well(p, c):
                best, most = p, gain
        if best != v:
            part[v] = best
            size[best] += 1
            size[v] = 0
            mass[best] += degree[v]
            mass[v] = 0.0
            out[best] += out[v] - 2 * linked[best]
    return np.array(part)


def _best_moves(level: DataFrame, state: DataFrame, total: float, resolution: float, allowed: DataFrame | None = None) -> DataFrame:
    """(i, to): the community of each node's largest gain; its own on ties. state: i, k, c. allowed: if given, (i, to) that may be gone to besides one's own."""
    mass = state.groupBy("c").agg(F.sum("k").alias("s"))
    links = level.join(state.select(F.col("i").alias("j"), F.col("c").alias("to")), "j").groupBy("i", "to").agg(F.sum("w").alias("w"))
    if allowed is not None:
        links = links.join(allowed, ["i", "to"], "left_semi")
    options = links.unionByName(state.select("i", F.col("c").alias("to"), F.lit(0.0).alias("w"))).groupBy("i", "to").agg(F.sum("w").alias("w"))
    rated = options.join(state, "i").join(mass.withColumnRenamed("c", "to"), "to")
    rest = F.col("s") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - resolution * F.col("k") * rest / total
    return rated.withColumn("g", F.round(gain, 9)).groupBy("i").agg(F.max_by("to", F.struct("g", (F.col("to") == F.col("c")).alias("same"), F.negative("to"))).alias("to"))


def _turn(salt: tuple, r: int):
    return F.pmod(F.xxhash64(*map(F.lit, salt), F.lit(r), "i"), F.lit(2)) == 0


def _local_moves(level: DataFrame, degree: DataFrame, own: DataFrame, total: float, resolution: float, rounds: int, salt: tuple) -> DataFrame:
    still = 0
    for r in range(rounds):
        best = _best_moves(level, own.join(degree, "i"), total, resolution)
        go = _turn(salt, r) & (F.col("to") != F.col("c"))
        new = fresh(own.join(best, "i").select("i", F.when(go, F.col("to")).otherwise(F.col("c")).alias("c"), go.alias("m")))
        moved = new.agg(F.count_if("m").alias("n")).first()["n"]
        own = new.select("i", "c")
        still = 0 if moved else still + 1
        if still == 2:
            break
    return own


def _refined(level: DataFrame, degree: DataFrame, own: DataFrame, total: float, resolution: float, rounds: int, salt: tuple) -> DataFrame:
    """(i, c): each community in well-connected parts. Nodes that are still alone, and well connected to the rest of their community, join the part of the largest gain; only parts well connected to the rest are joined."""
    state = fresh(own.withColumnRenamed("c", "home").join(degree, "i"))
    inside = level.join(state.select("i", "home"), "i").join(state.select(F.col("i").alias("j"), F.col("home").alias("there")), "j").where("home = there").select("i", "j", "w")
    inside = fresh(inside)
    whole = fresh(state.groupBy("home").agg(F.sum("k").alias("whole")))
    part = state.select("i", F.col("i").alias("c"))
    still = 0
    for r in range(rounds):
        now = part.join(state, "i")
        out = inside.join(part, "i").join(part.select(F.col("i").alias("j"), F.col("c").alias("d")), "j").where("c <> d").groupBy("c").agg(F.sum("w").alias("out"))
        sized = now.groupBy("c", "home").agg(F.sum("k").alias("s"), F.count("*").alias("n")).join(out, "c", "left").join(whole, "home")
        well = fresh(sized.where(F.coalesce("out", F.lit(0.0)) >= resolution * F.col("s") * (F.col("whole") - F.col("s")) / total - 1e-12).select("c", "n"))
        alone = part.join(well.where("n = 1").select("c"), "c", "left_semi").where(_turn((*salt, 1), r)).select("i")
        # those that may move this round are nobody's goal, so that no two change places
        goals = well.join(alone.withColumnRenamed("i", "c"), "c", "left_anti").select(F.col("c").alias("to"))
        allowed = inside.join(alone, "i", "left_semi").join(part.select(F.col("i").alias("j"), F.col("c").alias("to")), "j").join(goals, "to", "left_semi").select("i", "to").distinct()
        best = _best_moves(inside, now.select("i", "k", "c"), total, resolution, allowed).join(alone, "i", "left_semi")
        new = fresh(part.join(best, "i", "left").select("i", F.coalesce("to", "c").alias("c"), F.coalesce(F.col("to") != F.col("c"), F.lit(False)).alias("m")))
        moved = new.agg(F.count_if("m").alias("n")).first()["n"]
        part = new.select("i", "c")
        still = 0 if moved else still + 1
        if still == 2:
            break
    return part


def leiden_protocol(edges: DataFrame, resolutions: list[float], seeds: list[int]) -> DataFrame:
    """(resolution, seed, i, label) of communities over a grid. Up to FEW_EDGES directed edges, a run is a task of its own."""
    base = _summed(edges)
    few = base.count() <= FEW_EDGES
    found = [_communities(base, few, gamma, seed).select(F.lit(float(gamma)).alias("resolution"), F.lit(seed).alias("seed"), "i", "label") for gamma in resolutions for seed in seeds]
    # Spark would put the only partitions of all runs together into one, whose task does one run after another
    with settings(edges.sparkSession, {"spark.sql.unionOutputPartitioning": "false"}):
        return fresh(reduce(DataFrame.unionByName, found))


# The protocol's resolutions and seeds.
RESOLUTIONS = (0.03, 0.06, 0.10, 0.18, 0.32, 0.56, 1.0, 1.8, 3.2, 5.6)
SELECTOR_SEEDS, EVALUATION_SEEDS = (0, 1), (0, 1, 2, 3, 4)


def leiden_selected(edges: DataFrame, resolutions: tuple[float, ...] = RESOLUTIONS, selector_seeds: tuple[int, ...] = SELECTOR_SEEDS, seeds: tuple[int, ...] = EVALUATION_SEEDS) -> tuple[float, DataFrame, DataFrame]:
    """(resolution, table of the resolutions, (seed, i, label) at the chosen one). Nothing but the graph is looked at."""
    runs = leiden_protocol(edges, list(resolutions), list(selector_seeds))
    spark = edges.sparkSession
    n = runs.where((F.col("resolution") == float(resolutions[0])) & (F.col("seed") == selector_seeds[0])).count()
    sizes = runs.groupBy("resolution", "seed", "label").agg(F.count("*").alias("n"))
    one = sizes.groupBy("resolution", "seed").agg(F.count("*").alias("k"), (F.max("n") / n).alias("largest"), F.when(F.count("*") <= 1, 0.0).otherwise((F.log(F.lit(float(n))) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / n) / F.log(F.count("*").cast("double"))).alias("entropy"))
    stats = one.where(F.col("seed") == selector_seeds[0]).select("resolution", "k", "largest", "entropy")
    place = {float(g): x for x, g in enumerate(sorted(resolutions))}
    at = F.create_map(*[F.lit(v) for kv in place.items() for v in kv])
    named = runs.withColumn("x", F.element_at(at, F.col("resolution"))).withColumn("run", F.col("x") * len(selector_seeds) + F.array_position(F.array(*map(F.lit, selector_seeds)), F.col("seed")) - 1)
    a = named.select(F.col("run").alias("a"), F.col("x").alias("xa"), F.col("seed").alias("sa"), "i", F.col("label").alias("t"))
    b = named.select(F.col("run").alias("b"), F.col("x").alias("xb"), F.col("seed").alias("sb"), "i", F.col("label").alias("p"))
    meets = (F.col("xa") == F.col("xb")) & (F.col("sa") < F.col("sb")) | (F.col("xb") == F.col("xa") + 1) & (F.col("sa") == F.col("sb"))
    cells = a.join(b, "i").where(meets).groupBy("a", "b", "t", "p").agg(F.count("*").alias("n"))
    ari = {(r["a"], r["b"]): r["ari"] for r in ari_of_cells(fresh(cells)).collect()}  # pairs of runs
    s = len(selector_seeds)
    rows = []
    for r in stats.collect():  # a row a resolution
        x = place[r["resolution"]]
        same = [v for (i, j), v in ari.items() if i // s == j // s == x]
        step = {d: [v for (i, j), v in ari.items() if i // s == min(x, x + d) and j // s == max(x, x + d)] for d in (-1, 1)}
        near = [sum(v) / len(v) for v in step.values() if v]
        rows.append((r["resolution"], r["k"], r["largest"], r["entropy"], sum(same) / len(same) if same else 1.0, sum(near) / len(near) if near else 1.0, 0 < x < len(place) - 1))
    table = spark.createDataFrame(sorted(rows), "resolution double, k long, largest double, entropy double, seed_ari double, adjacent_ari double, interior boolean")
    chosen = select_resolution(table).first()["resolution"]
    known, more = [x for x in seeds if x in selector_seeds], [x for x in seeds if x not in selector_seeds]
    labels = runs.where((F.col("resolution") == chosen) & F.col("seed").isin(known))
    if more:
        labels = labels.unionByName(leiden_protocol(edges, [chosen], more))
    return chosen, table, labels.drop("resolution")


def count_matched(points: DataFrame, k: int | None, method: str, *, seed: int = 0, most_cells: int = 80_000_000, partition: DataFrame | None = None, support: DataFrame | None = None) -> DataFrame:
    """A baseline with as many clusters as another partition has: k, or those of `partition` (i, label) over the scene, or with support (i) over these pixels."""
    if k is None:
        rows = partition if support is None else partition.join(support.select("i"), "i", "left_semi")
        k = rows.select("label").distinct().count()
    if method == "fcm" and points.count() * k > most_cells:
        raise ValueError("fuzzy memberships would exceed the limit")
    return {"kmeans": kmeans, "minibatch": minibatch_kmeans, "fcm": fuzzy_cmeans, "slic": slic_kmeans}[method](points, k, seed=seed)
