"""Density clusters (a hierarchy over mutual reachability, flat clusters by excess of mass), the tree and the hierarchy over the cluster.

The spanning tree grows by Boruvka rounds, with a search that is pruned by bounds. Its edges, in ascending order, are cut
into classes; a class is settled by joining what the classes before left, and the components of its edges are independent
of each other, so they are settled side by side. What is known of a component is a handful of sums. No task sees more than
about a class's edges, and the driver sees none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.arrow import matrix
from rasterloom.operators.components import connected_components
from rasterloom.operators.modes import BLOCK, PIVOTS, _distances, dense_numbers, knn
from rasterloom.session import fresh

#: Edges of the tree in a class, and edges settled together if their components are small.
CLASS, TOGETHER = 1_000_000, 50_000


class _Groups:
    """The pivots' groups as a round sees them: balls that hold their points, the least core distance in each, and the component if all points share one."""

    def __init__(self, pivots: np.ndarray, state: DataFrame, heads: DataFrame) -> None:
        n = len(pivots)
        self.pivots, self.radius, self.core = pivots, np.full(n, -np.inf), np.full(n, np.inf)
        self.only, self.size = np.full(n, -1), np.zeros(n, np.int64)
        for r in state.groupBy("g").agg(F.max("far").alias("far"), F.min("core").alias("core"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).collect():  # a row for each pivot
            self.radius[r["g"]], self.core[r["g"]], self.size[r["g"]] = r["far"], r["core"], r["n"]
            if r["low"] == r["high"]:
                self.only[r["g"]] = r["low"]
        self.head_c, self.head_core = np.full(n, -1), np.full(n, np.inf)
        for r in state.join(F.broadcast(heads), "i").select("head", "c", "core").collect():
            self.head_c[r["head"]], self.head_core[r["head"]] = r["c"], r["core"]

    def bounds(self, x: np.ndarray, core: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For points x: the least possible edge to each group's points of other components, and an edge that there is (to a pivot)."""
        away = _distances(x, self.pivots)
        hair = 1e-6 * (1 + np.abs(x).max(1, initial=0) + np.abs(self.pivots).max(initial=0))[:, None]
        low = np.maximum(np.maximum(away - self.radius - hair, core[:, None]), self.core)
        low[self.only == c[:, None]] = np.inf
        there = np.maximum(np.maximum(away + hair, core[:, None]), self.head_core)
        there[self.head_c == c[:, None]] = np.inf
        return low, there.min(1)


_POINT = "i long, v array<double>, core double, c long"


def _least(left: pa.Table, right: pa.Table) -> pa.Table:
    """(c, d, i, j): of each component on the left the least edge to a right point of another one, if it is within the left point's bound."""
    best: dict[int, tuple[float, int, int]] = {}
    if left.num_rows and right.num_rows:
        (ids, held), (c, g) = ([t.column(n).to_numpy() for t in (left, right)] for n in ("i", "c"))
        x, y, core, other, most = matrix(left.column("v")), matrix(right.column("v")), left.column("core").to_numpy(), right.column("core").to_numpy(), left.column("most").to_numpy()
        for r in range(len(ids)):
            d = np.maximum(np.maximum(np.sqrt(((x[r] - y) ** 2).sum(1)), core[r]), other)
            d[g == c[r]] = np.inf
            low = d.min()
            if np.isfinite(low) and low <= most[r]:
                for j in held[d == low].tolist():
                    edge = (float(low), min(int(ids[r]), j), max(int(ids[r]), j))
                    best[int(c[r])] = min(best.get(int(c[r]), edge), edge)
    return pa.table({"c": pa.array(list(best), pa.int64()), **{n: pa.array([e[k] for e in best.values()], t) for k, (n, t) in enumerate([("d", pa.float64()), ("i", pa.int64()), ("j", pa.int64())])}})


def _meet(asks: DataFrame, state: DataFrame, groups: _Groups, block: int) -> DataFrame:
    """Least edges by component from `asks` (i, v, core, c, most, h: the group asked) to the points of the groups asked, block against block."""
    pieces = F.element_at(F.array(*[F.lit(int(max(1, -(-s // block)))) for s in groups.size]), (F.col("h") + 1).cast("int")).cast("long")
    held = state.select("i", "v", "core", "c", F.col("g").alias("h")).withColumn("t", F.pmod(F.xxhash64("i"), pieces))
    dealt = asks.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    chunks = dealt.groupBy("h", "t").agg(F.ceil(F.count("*") / block).alias("chunks"))
    left = dealt.join(chunks.select(F.col("h").alias("h"), F.col("t").alias("t"), "chunks"), ["h", "t"]).withColumn("k", F.pmod(F.xxhash64("i", F.lit(5)), F.col("chunks")))
    right = held.join(chunks, ["h", "t"]).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in ("i", "v", "core", "c", "h", "t", "k")])
    found = left.select("i", "v", "core", "c", "most", "h", "t", "k").groupBy("h", "t", "k").cogroup(right.groupBy("h", "t", "k")).applyInArrow(_least, "c long, d double, i long, j long")
    return found.groupBy("c").agg(F.min(F.struct("d", "i", "j")).alias("s"))


def _outgoing(asks: DataFrame, state: DataFrame, groups: _Groups, block: int) -> DataFrame:
    """(c, s: (d, i, j)): the least edges of mutual reachability from `asks` to other components. asks: _POINT and most, an edge that the component has (null: none known).

    A component without a known edge takes the best one to a pivot, then the best one that its most promising point has in
    its most promising group. A point then asks only the groups whose least possible edge is within its component's bound.
    """

    def promise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                low, there = groups.bounds(matrix(part.column("v")), *(part.column(n).to_numpy() for n in ("core", "c")))
                pick = low.argmin(1)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("i", "v", "core", "c")), pa.array(pick), pa.array(low[np.arange(len(low)), pick]), pa.array(there)], ["i", "v", "core", "c", "h", "low", "there"])

    lost = asks.where("most is null").select("i", "v", "core", "c").mapInArrow(promise, f"{_POINT}, h long, low double, there double")
    first = fresh(lost.groupBy("c").agg(F.min("there").alias("there"), F.min_by(F.struct("i", "v", "core", "h"), F.struct("low", "i")).alias("p")))
    probes = first.select("p.i", "p.v", "p.core", "c", F.lit(float("inf")).alias("most"), "p.h")
    hit = _meet(probes, state, groups, block)
    bounds = first.select("c", "there").join(hit.select("c", F.col("s.d").alias("hit")), "c", "left").select("c", F.least("there", "hit").alias("bound"))
    bound = asks.join(bounds, "c", "left").withColumn("most", F.coalesce("most", "bound", F.lit(float("inf"))))

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                low, _ = groups.bounds(matrix(part.column("v")), *(part.column(n).to_numpy() for n in ("core", "c")))
                row, h = np.nonzero((low <= part.column("most").to_numpy()[:, None]) & np.isfinite(low))
                yield pa.RecordBatch.from_arrays([*(part.column(n).take(pa.array(row)) for n in ("i", "v", "core", "c", "most")), pa.array(h)], ["i", "v", "core", "c", "most", "h"])

    wanted = fresh(bound.select("i", "v", "core", "c", "most").mapInArrow(need, f"{_POINT}, most double, h long"))
    return _meet(wanted, state, groups, block)


def spanning_tree(points: DataFrame, min_size: int = 5, k: int = 32, block: int = BLOCK) -> DataFrame:
    """(i, j, d): a least spanning tree of mutual reachability over all pairs, by Boruvka rounds.

    A component's least outgoing edge comes from its points' k nearest neighbours where these decide it: others are no
    nearer than the k-th. The points that could have a lesser edge ask the groups of points (see knn) in reach. The largest
    component needs no edge of its own in a round, since all others find theirs.
    """
    k = max(k, min_size - 1)
    near = fresh(knn(points, k))
    core = near.where(F.col("rank") == min(min_size - 1, k)).select("i", F.col("d").alias("c"))
    a, b = core.select("i", F.col("c").alias("_a")), core.select(F.col("i").alias("j"), F.col("c").alias("_b"))
    edges = fresh(near.join(a, "i").join(b, "j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.greatest("d", "_a", "_b").alias("d")).distinct())
    reach = near.where(F.col("rank") == k).select("i", F.col("d").alias("reach"))  # without a k-th neighbour all others are listed
    full = points.join(core.withColumnRenamed("c", "core"), "i").join(reach, "i", "left").select("i", F.col("v").cast("array<double>").alias("v"), "core", "reach")
    n = points.count()
    drawn = full.orderBy(F.xxhash64("i"), "i").limit(min(PIVOTS, -(-n // block))).select("i", "v").collect()
    pivots = np.array([r["v"] for r in drawn], float)
    if not len(pivots):
        return edges.limit(0)
    heads = points.sparkSession.createDataFrame([(r["i"], h) for h, r in enumerate(drawn)], "i long, head long")  # PIVOTS rows at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = _distances(matrix(part.column("v")), pivots)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(d.argmin(1)), pa.array(d.min(1))], [*part.schema.names, "g", "far"])

    full = fresh(full.mapInArrow(place, "i long, v array<double>, core double, reach double, g long, far double"))
    label = points.select("i", F.col("i").alias("c"))
    tree = None
    for _ in range(64):
        sizes = label.groupBy("c").agg(F.count("*").alias("n"))
        many = sizes.agg(F.count("*").alias("n"), F.max_by("c", F.struct("n", F.negative("c"))).alias("largest")).first()
        if many["n"] < 2:
            break
        ends = edges.join(label.withColumnRenamed("c", "ci"), "i").join(label.select(F.col("i").alias("j"), F.col("c").alias("cj")), "j").where("ci <> cj")
        both = ends.select("i", "j", "d", F.col("ci").alias("c")).unionByName(ends.select("i", "j", "d", F.col("cj").alias("c")))
        listed = fresh(both.where(F.col("c") != many["largest"]).groupBy("c").agg(F.min(F.struct("d", "i", "j")).alias("s")))
        state = fresh(full.join(label, "i"))
        known = listed.select("c", F.col("s.d").alias("most"))
        asks = fresh(state.where(F.col("c") != many["largest"]).join(known, "c", "left").where(F.col("reach") <= F.coalesce("most", F.lit(float("inf")))))
        if not asks.isEmpty():
            listed = listed.unionByName(_outgoing(asks, state, _Groups(pivots, state, heads), block))
        best = fresh(listed.groupBy("c").agg(F.min("s").alias("s")).select("s.*").distinct())
        if best.isEmpty():
            break
        tree = best if tree is None else fresh(tree.unionByName(best).distinct())
        joined = connected_components(tree, "i", "j")
        label = fresh(points.select("i").join(joined.withColumnRenamed("node", "i"), "i", "left").select("i", F.coalesce("component", "i").alias("c")))
    return tree if tree is not None else edges.limit(0)


_SETTLED = "kind int, x long, y long, size long, s double, below double, cluster long, chosen boolean"


def _settle(min_size: int):
    """A cogrouped function that merges components along edges in their order. Edges: e, d, a, b. Components: node, size, s (see below), below, cluster.

    A component of min_size points or more carries a cluster: its number, s, the sum of 1/d over its points at the edge
    where each leaves it going down, and below, the mass of the best clusters inside (null: it never parted). When two such
    meet, both clusters end with the mass s - size / d. Rows out, by kind: 0, what is left (x: its smallest node); 1, an
    ended cluster, its parent (y) and whether it has more mass than what is below; 2, a small component's node (x) and
    the component that it is now in (y) or the cluster that took it.
    """

    def run(edges: pa.Table, parts: pa.Table) -> pa.Table:
        size, s, below, cluster = ({n: x for n, x in zip(parts.column("node").to_pylist(), parts.column(c).to_pylist(), strict=True)} for c in ("size", "s", "below", "cluster"))
        up = {n: n for n in size}
        small = {n: [n] for n, m in size.items() if m < min_size}
        rows: list[tuple] = []

        def find(x: int) -> int:
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def house(node: int, into: int) -> None:
            rows.extend((2, x, None, None, None, None, into, None) for x in small.pop(node))

        def end(node: int, lam: float, parent: int) -> float:
            mass = s[node] - size[node] * lam
            better = below[node] is not None and below[node] > mass
            rows.append((1, cluster[node], parent, None, None, None, None, not better))
            return below[node] if better else mass

        for e, d, a, b in zip(*(c.to_pylist() for c in edges.sort_by("e").select(["e", "d", "a", "b"]).columns), strict=True):
            a, b = sorted((find(a), find(b)))
            if a == b:
                continue
            lam = 1 / max(d, 1e-12)
            big = [x for x in (a, b) if size[x] >= min_size]
            if len(big) == 2:
                state = ((size[a] + size[b]) * lam, end(a, lam, e) + end(b, lam, e), e)
            elif big:
                other = b if big[0] == a else a
                house(other, cluster[big[0]])
                state = (s[big[0]] + size[other] * lam, below[big[0]], cluster[big[0]])
            elif size[a] + size[b] >= min_size:
                house(a, e)
                house(b, e)
                state = ((size[a] + size[b]) * lam, None, e)
            else:
                small[a] += small.pop(b)
                state = (0.0, None, None)
            up[b] = a
            size[a] += size[b]
            s[a], below[a], cluster[a] = state
        rows += [(0, n, None, size[n], s[n], below[n], cluster[n], None) for n in up if up[n] == n]
        rows += [(2, x, n, None, None, None, None, None) for n, own in small.items() for x in own]
        kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("kind", "x", "y", "size", "s", "below", "cluster", "chosen"), columns, kinds, strict=True)})

    return run


def density_clusters(points: DataFrame, tree: DataFrame, min_size: int = 5, most: int = CLASS) -> DataFrame:
    """(i, label) of every point: clusters of a spanning tree (i, j, d) by excess of mass, numbered from 0; -1 is noise. The whole tree is no cluster. most: edges of a class."""
    n = tree.count()
    classes = max(1, -(-n // most))
    ordered = tree.select("d", "i", "j").repartitionByRange(classes, "d", "i", "j").sortWithinPartitions("d", "i", "j")
    rest = fresh(ordered.select(F.spark_partition_id().alias("k"), F.monotonically_increasing_id().alias("e"), "d", F.col("i").alias("a"), F.col("j").alias("b")))  # e ascends with d, i, j
    inside = points.select("i", F.col("i").alias("at"))  # the small component that a point is in
    housed, ended, parts = None, None, None
    add = lambda x, y: y if x is None else x.unionByName(y)
    for k in range(classes):
        own = rest.where(F.col("k") == k)
        moved = fresh(connected_components(own, "a", "b"))
        buckets = max(1, -(-own.count() // TOGETHER))
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).alias("bucket")
        nodes = moved.select(bucket("component"), "node")
        if parts is None:
            nodes = nodes.select("bucket", "node", F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("below"), F.lit(None).cast("long").alias("cluster"))
        else:
            nodes = nodes.join(parts, "node", "left").select("bucket", "node", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("s", F.lit(0.0)).alias("s"), "below", "cluster")
        lines = own.join(moved.select(F.col("node").alias("a"), F.col("component").alias("of")), "a").select(bucket("of"), "e", "d", "a", "b")
        out = fresh(lines.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(_settle(min_size), _SETTLED))
        left = out.where("kind = 0").select(F.col("x").alias("node"), "size", "s", "below", "cluster")
        parts = left if parts is None else fresh(parts.join(moved, "node", "left_anti").unionByName(left))
        ended = add(ended, out.where("kind = 1").select(F.col("x").alias("cluster"), F.col("y").alias("up"), "chosen"))
        fate = out.where("kind = 2").select(F.col("x").alias("at"), F.col("y").alias("to"), F.col("cluster").alias("home"))
        known = fresh(inside.join(fate, "at", "left"))
        housed = add(housed, known.where("home is not null").select("i", "home"))
        inside = known.where("home is null").select("i", F.coalesce("to", "at").alias("at"))
        if k + 1 < classes:
            for side in ("a", "b"):
                rest = rest.where(F.col("k") > k).join(moved.select(F.col("node").alias(side), F.col("component").alias("_to")), side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
            rest = fresh(rest)
    roots = parts.where("cluster is not null").select("cluster", F.lit(None).cast("long").alias("up"), F.lit(False).alias("chosen"))
    # the topmost chosen cluster on the way up, by pointers that double their reach
    path = fresh(ended.unionByName(roots).select("cluster", "up", F.when(F.col("chosen"), F.col("cluster")).alias("top")))
    for _ in range(64):
        if path.where("up is not null").isEmpty():
            break
        far = path.select(F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top"))
        path = fresh(path.join(far, "up", "left").select("cluster", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")))
    found = fresh(housed.join(path.select(F.col("cluster").alias("home"), "top"), "home").where("top is not null").select("i", "top"))
    numbers = dense_numbers(found.select("top").distinct(), "top")
    labels = found.join(numbers, "top").select("i", F.col("label").cast("int").alias("label"))
    return points.select("i").join(labels, "i", "left").select("i", F.coalesce("label", F.lit(-1)).alias("label"))


def hdbscan(points: DataFrame, *, min_size: int = 5, k: int = 32) -> DataFrame:
    """(i, label), noise -1. points: i, v."""
    return density_clusters(points, spanning_tree(points, min_size, k), min_size)
