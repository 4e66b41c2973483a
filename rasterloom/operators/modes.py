"""Fine modes: exact nearest neighbours, radius graph, its components, and the local scale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.arrow import matrix
from rasterloom.functions.order import median
from rasterloom.operators.components import connected_components
from rasterloom.operators.scene import pca
from rasterloom.session import fresh

BLOCK, PIVOTS = 2048, 1024
#: So many points of either side meet in a task of the search for neighbours.
TASK = 16_384
#: So many copies of the points a round of the search sends at most, unless it has one lot alone.
SENT = 8
LISTS = "i long, j array<long>, d array<double>"


def _nearest(k: int):
    """A cogrouped function: of each left point its k nearest right points other than itself, ties to the smaller j; a row a point, with lists.

    Where the left points have a bound, points farther than that need not be found.
    """

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("i").to_numpy(), right.column("i").to_numpy()
        if not len(a) or not len(b):
            return pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.list_(pa.int64())), "d": pa.array([], pa.list_(pa.float64()))})
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        bound = left.column("bound").to_numpy() if "bound" in left.column_names else np.full(len(a), np.inf)
        # a first look in single precision around the centre: one product gives each squared distance but for the left point's own part
        centre = y.mean(0)
        u, w = x - centre, y - centre
        own_norm, norms = (u * u).sum(1), (w * w).sum(1)
        kind, fine = (np.float32, 1e-6 * (x.shape[1] + 8)) if max(own_norm.max(), norms.max()) < 1e30 else (np.float64, 1e-9)
        u = np.column_stack([-2 * u, np.ones(len(u))]).astype(kind)
        w = np.column_stack([w, norms]).T.astype(kind).copy()
        # ties and rounding at the border: whatever is within a hair of the worst pick is looked at exactly
        hair = fine * (own_norm + norms.max()) + 1e-12
        took, own_j, own_d = [], [], []
        take = min(k + 1, len(b))
        for at in range(0, len(a), 64):
            part, own = x[at : at + 64], a[at : at + 64]
            rough = u[at : at + 64] @ w
            limit = bound[at : at + 64] ** 2 - own_norm[at : at + 64] + hair[at : at + 64]
            wide = np.flatnonzero(~np.isfinite(limit))
            if len(wide):
                others = np.where(own[wide][:, None] == b, np.inf, rough[wide])
                limit[wide] = np.partition(others, take - 1, axis=1)[:, take - 1] + 2 * hair[at + wide]
            limit = np.nextafter(limit.astype(kind), kind(np.inf))
            r, near = np.nonzero(rough <= limit[:, None])
            other = own[r] != b[near]
            r, near = r[other], near[other]
            d = np.concatenate([np.zeros(0), *(np.sqrt(((part[r[z : z + 8192]] - y[near[z : z + 8192]]) ** 2).sum(1)) for z in range(0, len(r), 8192))])
            order = np.lexsort((b[near], d, r))
            r, near, d = r[order], near[order], d[order]
            first = np.searchsorted(r, np.arange(len(part)))
            kept = np.arange(len(r)) - first[r] < k
            took.append(np.bincount(r[kept], minlength=len(part)))
            own_j.append(b[near[kept]])
            own_d.append(d[kept])
        took = np.concatenate(took)
        ends = pa.array(np.concatenate(([0], np.cumsum(took[took > 0]))), pa.int32())
        return pa.table({"i": pa.array(a[took > 0]), **{n: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(z))) for n, z in (("j", own_j), ("d", own_d))}})

    return nearest


def knn(points: DataFrame, k: int, vector: str = "v", block: int = BLOCK, n: int | None = None) -> DataFrame:
    """(i, j, d, rank) of the k nearest other points, ties to the smaller j. Exact. n: the number of points if known.

    Beyond a block of points, each belongs to its nearest of up to PIVOTS points drawn by hash. Within a block of its own
    group a point finds k others, the farthest of which bounds its search: a group is out of reach if even the point of its
    ball next to this one is farther. Groups are gathered into lots of TASK points, so that a point is sent once to each lot
    with a group in reach; the partial lists are merged. Without any structure every two lots meet and n / TASK copies of
    the points are shuffled; they go in rounds of so few lots that no more than SENT copies are on disk at a time.
    """
    n = points.count() if n is None else n
    rows = points.select("i", F.col(vector).cast("array<double>").alias("v"))
    if n <= block:
        one = rows.withColumn("q", F.lit(0))
        parts = one.groupBy("q").cogroup(_again(one).groupBy("q")).applyInArrow(_nearest(k), LISTS)
        return _best(_apart(parts, n), k)
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("i"), "i").limit(min(PIVOTS, -(-n // block))).collect()], float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for at in range(0, len(x), 1024):
                d = _distances(x[at : at + 1024], pivots)
                own[at : at + 1024], far[at : at + 1024] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array(far)], ["i", "v", "g", "far"])

    placed = fresh(rows.mapInArrow(place, "i long, v array<double>, g long, far double"))
    groups = sorted(placed.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect())  # PIVOTS rows at most
    size = np.zeros(len(pivots), np.int64)
    radius = np.full(len(pivots), -np.inf)
    for r in groups:
        size[r["g"]], radius[r["g"]] = -(-r["n"] // block), r["radius"]
    size = np.maximum(size, 1)
    first = np.cumsum(size) - size  # the groups' blocks, numbered
    per = max(1, TASK // block)
    lots = np.zeros((len(size), int(size.sum() - 1) // per + 1))
    for g, (a, b) in enumerate(zip(first, first + size, strict=True)):
        lots[g, a // per : (b - 1) // per + 1] = 1
    of_group = lambda x: F.element_at(F.array(*[F.lit(int(z)) for z in x]), (F.col("g") + 1).cast("int"))
    dealt = placed.withColumn("s", F.pmod(F.xxhash64("i"), of_group(size)))

    def reach(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"))
        need, bounds = [], []
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            if len(x) > k:
                d = _distances(part, x)  # itself is among them, so the k + 1st is the k-th other
                bound = np.partition(d, k, axis=1)[:, k]
            else:
                bound = np.full(len(part), np.inf)
            away = _distances(part, pivots)
            hair = 1e-6 * (1 + np.abs(part).max(1) + np.abs(pivots).max())
            near = away - radius <= (bound + hair)[:, None]
            need += [np.flatnonzero(row).tolist() for row in near.astype(float) @ lots]
            bounds.append(bound + hair)
        return table.select(["i", "v", "g", "s"]).append_column("need", pa.array(need, pa.list_(pa.int64()))).append_column("bound", pa.array(np.concatenate(bounds)))

    asked = fresh(dealt.select("i", "v", "g", "s").groupBy("g", "s").applyInArrow(reach, "i long, v array<double>, g long, s long, need array<long>, bound double"))
    lot = F.floor((of_group(first) + F.col("s")) / per)
    own = asked.groupBy(lot.alias("h")).agg(F.count("*").alias("held"))
    counted = asked.select(F.explode("need").alias("h")).groupBy("h").agg(F.count("*").alias("n")).join(own, "h").select("h", "n", F.ceil(F.col("n") / TASK).alias("chunks"), "held").collect()  # a row a lot
    turns = _rounds([(r["h"], r["n"] + r["chunks"] * r["held"]) for r in sorted(counted)], SENT * n)
    cells = points.sparkSession.createDataFrame([(r["h"], r["chunks"], turns[r["h"]]) for r in counted], "h long, chunks long, turn int")
    deal = lambda rows, meetings: rows.select(*[c for c in ("i", "v", "bound") if c in rows.columns], "h", "c").repartition(meetings, "h", "c")
    best = None
    for turn in range(max(turns.values()) + 1):
        now = [r for r in counted if turns[r["h"]] == turn]
        meetings, met = sum(r["chunks"] for r in now), sum(r["n"] for r in now)
        here = F.broadcast(cells.where(F.col("turn") == turn).drop("turn"))
        asks = asked.select("i", "v", "bound", F.explode("need").alias("h")).join(here, "h").withColumn("c", F.pmod(F.xxhash64("i", F.lit(5)), F.col("chunks")))
        held = asked.select("i", "v", lot.alias("h")).join(here, "h").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        # as many partitions as meetings, told by number so that they are not put together again: what a task holds is one meeting's
        found = deal(asks, meetings).groupBy("h", "c").cogroup(_again(deal(held, meetings)).groupBy("h", "c")).applyInArrow(_nearest(k), LISTS)
        lists, met = (found, met) if best is None else (best.unionByName(found), met + n)
        if turn < max(turns.values()):
            best = fresh(_merged(lists, met, k))
    return _best(_apart(lists, met), k)


def _rounds(lots: list[tuple[int, int]], most: int) -> dict[int, int]:
    """Of each lot (its number, the copies that it takes) the round in which it is searched; a round takes `most` copies, or one lot."""
    turn, sent, turns = 0, 0, {}
    for h, copies in lots:
        if sent and sent + copies > most:
            turn, sent = turn + 1, 0
        turns[h], sent = turn, sent + copies
    return turns


def _again(df: DataFrame) -> DataFrame:
    """The same under columns of its own, so that Spark can tell both sides of a cogroup apart."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _best(parts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy("d", "j")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _dealt(lists: DataFrame, n: int) -> DataFrame:
    """n partial lists, dealt out as they are, about TASK to a task, so no task sorts what it has not yet sent."""
    return lists.repartition(max(1, -(-n // TASK)), "i")


def _apart(lists: DataFrame, n: int) -> DataFrame:
    """(i, j, d) of n partial lists, taken apart where they were sent."""
    return _dealt(lists, n).select("i", F.explode(F.arrays_zip("j", "d")).alias("_p")).select("i", F.col("_p.j").alias("j"), F.col("_p.d").alias("d"))


def _merged(lists: DataFrame, n: int, k: int) -> DataFrame:
    """One list a point, of its k nearest, from n partial lists."""
    near = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "j")))), 1, k)
    return _dealt(lists, n).groupBy("i").agg(near.alias("_p")).select("i", F.col("_p.j").alias("j"), F.col("_p.d").alias("d"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))


def compute_merge_neighbors(state: DataFrame, *, pca_components: int = 10, max_neighbors: int = 50) -> DataFrame:
    """PCA scores (standardised), then J7 with max_neighbors - 1 others of each pixel. state: (i, y)."""
    return knn(pca(state.select("i", F.col("y").alias("v")), pca_components, standardise=True), max_neighbors - 1, "p")


def merge_from_neighbors(neighbours: DataFrame, tol: float, pixels: DataFrame | None = None) -> DataFrame:
    """(i, label) of components of the graph of neighbours within tol; labels count from 0 by smallest member; pixels: to keep those alone."""
    joined = connected_components(neighbours.where(F.col("d") <= tol), "i", "j").select(F.col("node").alias("i"), "component")
    if pixels is None:
        pixels = neighbours.select("i").distinct()
    full = pixels.select("i").join(joined, "i", "left").select("i", F.coalesce("component", "i").alias("component"))
    return number_labels(full, "component")


def number_labels(df: DataFrame, column: str) -> DataFrame:
    """(i, label): the column's values numbered 0, 1, ... in order. Numbers come from counts of ranges, not from one sorted task."""
    values = df.select(F.col(column).alias("_c")).distinct()
    return df.join(dense_numbers(values, "_c"), F.col(column) == F.col("_c")).select("i", "label")


def dense_numbers(values: DataFrame, column: str) -> DataFrame:
    """(column, label) of distinct values: position in their order, from 0. Ranges are counted, then rows numbered within each."""
    dealt = values.repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    dealt = fresh(dealt)
    before = dealt.groupBy("_p").agg(F.count("*").alias("n")).collect()  # a row a partition
    start, total = {}, 0
    for r in sorted(before):
        start[r["_p"]] = total
        total += r["n"]
    if not start:
        return values.select(column, F.lit(0).cast("long").alias("label"))
    first = F.element_at(F.create_map(*[F.lit(x) for kv in start.items() for x in kv]), F.col("_p"))
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(column))
    return dealt.select(column, (first + rank - 1).cast("long").alias("label"))


def local_scale(neighbours: DataFrame, q: int = 10) -> float:
    """The median over pixels of the q-th other neighbour's distance, of those positive and finite."""
    far = neighbours.where((F.col("rank") == q) & (F.col("d") > 0) & (F.col("d") < float("inf"))).select("d")
    s = median(fresh(far), "d")  # read several times: the search behind it runs once
    if s is None:
        raise ValueError(f"no pixel has a {q}-th neighbour at a positive distance")
    return s


def merge_modes(state: DataFrame, tol: float = 0.15, *, pca_components: int = 10, max_neighbors: int = 50) -> DataFrame:
    """(i, label) straight from diffused states (i, y)."""
    return merge_from_neighbors(compute_merge_neighbors(state, pca_components=pca_components, max_neighbors=max_neighbors), tol, state)
