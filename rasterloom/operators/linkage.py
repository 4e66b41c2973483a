"""Agglomeration of modes by single, average or complete linkage up to a threshold, without a matrix of all pairs.

All three linkages are reducible: merging every two groups that are each other's nearest, at once, gives the groups that
one merge at a time would give. Only pairs within reach of the threshold are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.arrow import matrix
from rasterloom.functions.vector import squared_distance
from rasterloom.operators.components import connected_components
from rasterloom.operators.modes import BLOCK, PIVOTS, dense_numbers
from rasterloom.operators.prototypes import adjusted_dispersions
from rasterloom.session import fresh

#: Under a scale of this size a separation divides by it instead.
LEAST_SCALE = 1e-8


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))


def pairs_within(modes: DataFrame, limit: float, *, size_exponent: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(a, b, sep), a < b: every two modes whose normalised separation is at most `limit`. modes: (mode, mu, disp, n).

    A mode belongs to its nearest of up to PIVOTS modes drawn by hash. It meets only the groups whose ball comes within
    limit times the largest scale it can have with another mode, block against block. Exact.
    """
    rows = fresh(adjusted_dispersions(modes, size_exponent).select(F.col("mode").cast("long").alias("i"), F.col("mu").cast("array<double>").alias("v"), F.col("s").cast("double").alias("s")))
    n, widest = rows.agg(F.count("*"), F.max("s")).first()
    if n == 0:
        return rows.select(F.col("i").alias("a"), F.col("i").alias("b"), F.col("s").alias("sep"))
    pivots = np.array([r["v"] for r in rows.orderBy(F.xxhash64("i"), "i").limit(min(PIVOTS, -(-n // block))).collect()], float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _far(matrix(batch.column(1)), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(1)), pa.array(away.min(1, initial=np.inf))], ["i", "v", "s", "g", "far"])

    placed = fresh(rows.mapInArrow(place, "i long, v array<double>, s double, g long, far double"))
    size, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in placed.groupBy("g").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect():  # PIVOTS rows at most
        size[r["g"]], radius[r["g"]] = -(-r["n"] // block), r["radius"]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, s = matrix(batch.column(1)), batch.column(2).to_numpy()
            bound = limit * np.maximum(np.sqrt((s * s + widest * widest) / 2), LEAST_SCALE)
            hair = 1e-6 * (1 + np.abs(x).max(1, initial=0) + np.abs(pivots).max(initial=0))
            near = _far(x, pivots) - radius <= (bound + hair)[:, None]
            need = pa.array([np.flatnonzero(row).tolist() for row in near], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], need], ["i", "v", "s", "need"])

    parts = F.array(*[F.lit(int(max(s, 1))).cast("long") for s in size])
    parts_of = lambda g: F.element_at(parts, (F.col(g) + 1).cast("int"))
    asks = placed.mapInArrow(reach, "i long, v array<double>, s double, need array<long>").withColumn("h", F.explode("need")).drop("need")
    asks = fresh(asks.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), parts_of("h") - 1))))
    cells = asks.groupBy("h", "t").agg(F.ceil(F.count("*") / block).alias("chunks"))
    held = placed.select("i", "v", "s", F.col("g").alias("h"), F.pmod(F.xxhash64("i"), parts_of("g")).alias("t")).join(cells, ["h", "t"])
    held = held.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    cells = cells.select(*[F.col(c).alias(c) for c in cells.columns])
    asks = asks.join(cells, ["h", "t"]).withColumn("c", F.pmod(F.xxhash64("i", F.lit(5)), F.col("chunks"))).drop("chunks")
    columns = ["h", "t", "c", "i", "v", "s"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("i").to_numpy(), right.column("i").to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(a) and len(b):
            x, y, s, t = matrix(left.column("v")), matrix(right.column("v")), left.column("s").to_numpy(), right.column("s").to_numpy()
            for at in range(0, len(a), 256):
                part = x[at : at + 256]
                scale = np.maximum(np.sqrt((s[at : at + 256, None] ** 2 + t * t) / 2), LEAST_SCALE)
                hair = 1e-6 * (1 + np.abs(part).max(1, initial=0)[:, None] + np.abs(y).max(initial=0))
                p, q = np.nonzero((a[at : at + 256, None] < b) & (_far(part, y) <= limit * scale + hair))
                for some in range(0, len(p), 65536):
                    u, w = p[some : some + 65536], q[some : some + 65536]
                    sep = np.sqrt(((part[u] - y[w]) ** 2).sum(1)) / scale[u, w]
                    ok = sep <= limit
                    out.append((a[at + u[ok]], b[w[ok]], sep[ok]))
        return pa.table([np.concatenate(z) for z in zip(*out, strict=True)], names=["a", "b", "sep"])

    right = held.select(*[F.col(c).alias(c) for c in columns])
    return asks.select(columns).groupBy("h", "t", "c").cogroup(right.groupBy("h", "t", "c")).applyInArrow(meet, "a long, b long, sep double")


def linkage_groups(modes: DataFrame, threshold: float, linkage: str = "average", *, size_exponent: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(mode, group), groups numbered from 0 by their smallest mode: agglomeration of the modes' separations up to the threshold.

    single: components of the pairs within the threshold. complete: two groups can only merge while every pair between
    them is listed. average: pairs within twice the threshold are listed; the others count at least that much, so two
    groups whose mean may still be within the threshold have at least half of their pairs listed, and only for such
    groups are the others computed. So the work grows with the listed pairs, whatever the number of modes. Means are
    rounded to 12 digits. Of equal distances the pair with the smaller names comes first. No modes: no groups.
    """
    if linkage not in ("single", "average", "complete"):
        raise ValueError(f"unknown linkage {linkage}")
    modes = fresh(modes)
    limit = 2 * threshold if linkage == "average" else threshold
    pairs = fresh(pairs_within(modes, limit, size_exponent=size_exponent, block=block))
    if linkage == "single":
        found = connected_components(pairs, "a", "b").withColumnRenamed("node", "mode")
        named = modes.select("mode").join(found, "mode", "left").select("mode", F.coalesce("component", F.col("mode").cast("long")).alias("group"))
    else:
        named = _merged(modes, pairs, threshold, limit, linkage == "average", size_exponent)
    named = fresh(named)
    return named.join(dense_numbers(named.select("group").distinct(), "group"), "group").select("mode", F.col("label").cast("long").alias("group"))


def _merged(modes: DataFrame, pairs: DataFrame, threshold: float, limit: float, average: bool, size_exponent: float) -> DataFrame:
    """(mode, group), groups named by their smallest mode, by rounds of reciprocal nearest groups."""
    points = adjusted_dispersions(modes, size_exponent).select(F.col("mode").cast("long").alias("i"), F.col("mu").cast("array<double>").alias("v"), "s")
    group = modes.select("mode", F.col("mode").cast("long").alias("group"))
    together = F.sum if average else F.max
    # a cell: what is known of the pairs between two groups; total: their sum or greatest, c: how many are listed
    cells = pairs.select("a", "b", F.col("sep").alias("total"), F.lit(1).cast("long").alias("c"))
    while True:
        size = group.groupBy("group").agg(F.count("*").alias("n"))
        sized = cells.join(size.select(F.col("group").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("group").alias("b"), F.col("n").alias("nb")), "b")
        all_ = F.col("na") * F.col("nb")
        if average:
            missing = F.when(F.col("c") < all_, (all_ - F.col("c")) * F.lit(float(limit))).otherwise(0.0)
            near = (F.col("total") + missing) / all_ <= F.lit(float(threshold) + 1e-9)
            sized = fresh(sized.withColumn("short", (F.col("c") < all_) & near))
            cells = sized.where("not short").select("a", "b", "total", "c", (F.col("c") == all_).alias("whole"))
            short = sized.where("short").select("a", "b")
            if not short.isEmpty():
                member = group.select(F.col("mode").cast("long").alias("i"), "group").join(points, "i")
                left = member.select(F.col("group").alias("a"), F.col("v").alias("x"), F.col("s").alias("s"))
                right = member.select(F.col("group").alias("b"), F.col("v").alias("y"), F.col("s").alias("t"))
                scale = F.greatest(F.sqrt((F.col("s") * F.col("s") + F.col("t") * F.col("t")) / 2), F.lit(LEAST_SCALE))
                sep = F.sqrt(squared_distance("x", "y")) / scale
                full = short.join(left, "a").join(right, "b").groupBy("a", "b").agg(F.sum(sep).alias("total"), F.count("*").alias("c"))
                cells = cells.unionByName(full.withColumn("whole", F.lit(True)))
            cells = fresh(cells)
            value = F.when(F.col("whole"), F.round(F.col("total") / F.col("c"), 12))
        else:
            # an unlisted pair is beyond the threshold and stays between the two groups, however they grow
            cells = fresh(sized.where(F.col("c") == all_).select("a", "b", "total", "c"))
            value = F.col("total")
        close = cells.select("a", "b", value.alias("d")).where(F.col("d") <= threshold)
        best = close.select(F.explode(F.array("a", "b")).alias("g"), F.struct("d", "a", "b").alias("p")).groupBy("g").agg(F.min("p").alias("p"))
        mutual = fresh(best.groupBy("p").agg(F.count("*").alias("k")).where("k = 2").select("p.a", "p.b"))
        if mutual.isEmpty():
            return group
        into = mutual.select(F.col("b").alias("group"), F.col("a").alias("_to"))
        group = fresh(group.join(into, "group", "left").select("mode", F.coalesce("_to", "group").alias("group")))
        moved = cells.select("a", "b", "total", "c")
        for end in ("a", "b"):
            moved = moved.join(into.select(F.col("group").alias(end), "_to"), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        cells = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(together("total").alias("total"), F.sum("c").alias("c"))
