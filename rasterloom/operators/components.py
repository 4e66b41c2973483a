"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import fresh

#: So few edges that one task settles them at once (under 2 MB of ids).
FEW_EDGES = 100_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges given."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "up"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of the undirected edges; component is its smallest node.

    A round points each node at its smallest neighbour, follows the pointers four steps and contracts the edges by the
    result, so paths shrink sixteenfold and stars vanish at once. Pointers only go to smaller ids of the same
    component, and its smallest node points at itself, so it is what remains. Minima are taken with map-side
    combination and the joins have a unique key on one side, so a hub needs no task of its own. When no more than
    FEW_EDGES are left, one executor task settles them without further rounds. Nodes are 64-bit integers or smaller.
    """
    a, b = F.least(src, dst).cast("long").alias("a"), F.greatest(src, dst).cast("long").alias("b")
    left = fresh(edges.select(a, b).where("a is not null and b is not null and a < b").distinct())
    steps: list[DataFrame] = []
    for _ in range(most_rounds):
        n = left.count()
        if n <= FEW_EDGES:
            if n:
                steps.append(fresh(left.coalesce(1).mapInArrow(_settle, "node long, up long")))
            break
        up = left.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(left.select(F.col("a").alias("node"), F.col("a").alias("up"))).groupBy("node").agg(F.min("up").alias("up"))
        for _ in range(2):
            far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            up = up.join(far, "up").select("node", F.col("far").alias("up"))
        up = fresh(up)
        steps.append(up)
        ends = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = fresh(ends.where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    out = steps[0].select("node", F.col("up").alias("component"))
    for up in steps[1:]:
        out = out.join(up.select(F.col("node").alias("component"), F.col("up").alias("_up")), "component", "left").select("node", F.coalesce("_up", "component").alias("component"))
    return out
