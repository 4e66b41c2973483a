"""Near-duplicate embeddings by an inverted multi-index.

Unit vectors are cut into halves; each half has its own codebook (k-means on a bounded sample: `sample_rows` vectors, or
16 for each entry of a codebook if that is more), and the product of both codebooks is a grid of cells, about `cell_size`
vectors each. Every vector is filed under its cell. A vector looks for partners in the cells nearest to it: the
multi-sequence walk yields cells by ascending sum of the two halves' squared distances, until the sum exceeds that of
its nearest cell by a margin. A pair counts if either side meets the other; every pair met is verified by its cosine in
double precision. The margin is fitted so that a share `target` of pairs is met: of made pairs with cosines from the
least on, and of the pairs that the sample itself holds, whichever asks for more.

Equal vectors are joined first, as one with a multiplicity. A cell with many members or visitors is dealt into blocks
of BLOCK by hash, so that every member block meets every visitor block; nothing is capped. A visit carries the vector as
it is stored (4 bytes a component of floats), since it must be compared where the cell's members are.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
vectors of different lengths with each other. A null id has no links and a null component. Rows that share an id are
vectors of their own; links are between vectors, and components are named by the smallest id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators.components import connected_components
from rasterloom.session import materialise

LEAST_COSINE = 0.9
BLOCK = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_squared(x[at : at + 2048], centres).argmin(1) for at in range(0, len(x), 2048))])


def walk(a: np.ndarray, b: np.ndarray, margin: float) -> list[tuple[int, int]]:
    """Cells (i, j) by ascending a[i] + b[j], as far as the first sum plus margin (multi-sequence algorithm)."""
    least_a, least_b = a.min(), b.min()
    near_a, near_b = np.flatnonzero(a <= least_a + margin), np.flatnonzero(b <= least_b + margin)  # no other entry is in any such cell
    by_a, by_b = near_a[np.argsort(a[near_a], kind="stable")], near_b[np.argsort(b[near_b], kind="stable")]
    most = least_a + least_b + margin
    sa, sb = a[by_a].tolist(), b[by_b].tolist()
    heap, out = [(sa[0] + sb[0], 0, 0)], []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > most:
            break
        out.append((int(by_a[i]), int(by_b[j])))
        if j + 1 < len(sb):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(sa):
            heapq.heappush(heap, (sa[i + 1] + sb[0], i + 1, 0))
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, cells_a_side: int, *, least: float, target: float, seed: int = 7) -> None:
        self.half = sample.shape[1] // 2
        self.books = [kmeans(sample[:, s].copy(), cells_a_side) for s in (slice(0, self.half), slice(self.half, None))]
        rng = np.random.default_rng(seed)
        x = sample[rng.permutation(len(sample))[:4000]]
        self.margin = max(self._reach(*pairs, target) for pairs in (self._made(x, least, rng), self._held(x, least)) if len(pairs[0])) + 1e-12

    @staticmethod
    def _made(x: np.ndarray, least: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Each vector with a partner in a direction of its own, at a cosine spread over least..1."""
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1), 1e-12)[:, None]
        cos = rng.uniform(least, 1.0, len(x))[:, None]
        return x, cos * x + np.sqrt(1 - cos * cos) * noise

    @staticmethod
    def _held(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different vectors in x with the least cosine or more; none if there are too few to tell."""
        i, j = (np.concatenate(k) for k in zip(*((r + at, c) for at in range(0, len(x), 1024) for r, c in [np.nonzero(x[at : at + 1024] @ x.T >= least)]), strict=True))
        i, j = i[i < j], j[i < j]
        return (x[i], x[j]) if len(i) >= 50 else (x[:0], x[:0])

    def _reach(self, x: np.ndarray, y: np.ndarray, target: float) -> float:
        """The margin at which a share `target` of the pairs is met from one of both sides."""
        return float(np.quantile(np.minimum(self._over(x, y), self._over(y, x)), target))

    def _over(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(x), 2048):
            a, b = self.distances(x[at : at + 2048])
            i, j = self.home(y[at : at + 2048])
            rows = np.arange(len(a))
            out.append(a[rows, i] + b[rows, j] - a.min(1) - b.min(1))
        return np.concatenate(out)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squared(x[:, : self.half], self.books[0]), _squared(x[:, self.half :], self.books[1])

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(1), b.argmin(1)


def _units(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1)[:, None]
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _pairs(reps: DataFrame, index: MultiIndex, least: float, stored: type) -> DataFrame:
    """(src, dst, n): dst null: src has n links to other vectors than its copies; else src and dst link (a forest of each block's links)."""
    side = len(index.books[1])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                raw = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                a, b = index.distances(_units(raw))
                own = a.argmin(1) * side + b.argmin(1)
                met = [[i * side + j for i, j in walk(a[r], b[r], index.margin)] for r in range(len(raw))]
                kept = np.ascontiguousarray(raw, stored)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own), pa.array(met, pa.list_(pa.int64())), pa.array([v.tobytes() for v in kept], pa.binary())], ["rep", "m", "home", "met", "x"])

    placed = materialise(reps.select("rep", "m", "e").mapInArrow(place, "rep long, m long, home long, met array<long>, x binary"))
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    visits = placed.select(F.explode("met").alias("cell"), "rep", "m", "home", "x")
    visitors = visits.groupBy("cell").agg(F.count("*").alias("visitors"))
    cells = members.join(visitors, "cell").select("cell", F.ceil(F.col("members") / BLOCK).alias("mb"), F.ceil(F.col("visitors") / BLOCK).alias("vb"))
    part = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    filed = placed.withColumnRenamed("home", "cell").join(cells, "cell").select("cell", part(F.col("mb"), 1).alias("mp"), spread("vb").alias("vp"), "rep", "m", F.col("cell").alias("home"), "met", "x", F.lit(True).alias("filed"))
    asks = visits.join(cells, "cell").select("cell", spread("mb").alias("mp"), part(F.col("vb"), 2).alias("vp"), "rep", "m", "home", F.lit(None).cast("array<long>").alias("met"), "x", F.lit(False).alias("filed"))

    def meet(table: pa.Table) -> pa.Table:
        is_filed = table.column("filed").to_numpy()
        rep, m, home = (table.column(c).to_numpy() for c in ("rep", "m", "home"))
        x = _units(np.frombuffer(b"".join(table.column("x").to_pylist()), stored).reshape(len(rep), -1))
        f, v = np.flatnonzero(is_filed), np.flatnonzero(~is_filed)
        met = table.column("met").to_pylist()
        count: dict[int, int] = {}
        up: dict[int, int] = {}

        def find(k: int) -> int:
            while up.setdefault(k, k) != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        src, dst = [], []
        good = (x[v] @ x[f].T >= least) & (rep[v][:, None] != rep[f])
        for k in np.flatnonzero(good.any(1)):
            own = f[good[k]]
            me = int(rep[v[k]])
            count[me] = count.get(me, 0) + int(m[own].sum())
            for o in own.tolist():
                if int(home[v[k]]) not in met[o]:  # it won't come by itself
                    count[int(rep[o])] = count.get(int(rep[o]), 0) + int(m[v[k]])
                a, b = find(me), find(int(rep[o]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    src.append(me)
                    dst.append(int(rep[o]))
        n = len(count)
        return pa.table({"src": pa.array([*count, *src], pa.int64()), "dst": pa.array([*[None] * n, *dst], pa.int64()), "n": pa.array([*count.values(), *[0] * len(src)], pa.int64())})

    return filed.unionByName(asks).groupBy("cell", "mp", "vp").applyInArrow(meet, "src long, dst long, n long")


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE, target: float = 0.995, sample_rows: int = 20_000, cell_size: int = 32) -> DataFrame:
    """(key, n_links, component_id, kept) of every row. cell_size: members wanted in a cell."""
    e = F.col("e")
    stored = np.float32 if vectors.schema[vector].dataType.elementType.simpleString() == "float" else np.float64
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
    sound = F.coalesce(F.size(e) > 0, F.lit(False)) & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False))
    named = rows.where("id is not null").withColumn("ok", sound)
    reps = materialise(named.where("ok").groupBy("e").agg(F.min("id").alias("rep"), F.count("*").alias("m")))
    found = None
    for size in [r["d"] for r in reps.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).where("n > 1 and d > 1").select("d").collect()]:
        own = reps.where(F.size("e") == size)
        n = own.count()
        side = max(2, round((n / cell_size) ** 0.5))
        share = min(1.0, max(sample_rows, 16 * side) / n)
        drawn = own.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < max(1, round(share * (1 << 20)))).select("e").toPandas().e
        sample = np.stack(drawn.to_numpy()) if len(drawn) > 1 else np.stack(own.limit(2).toPandas().e.to_numpy())
        sample = sample / np.abs(sample).max(1)[:, None]
        sample /= np.linalg.norm(sample, axis=1)[:, None]
        some = _pairs(own, MultiIndex(sample, side, least=least, target=target), least, stored)
        found = some if found is None else found.unionByName(some)
    single = reps.where(F.size("e") == 1).groupBy((F.get("e", F.lit(0)) > 0).alias("sign")).agg(F.min("rep").alias("dst"), F.sum("m").alias("all"))
    if not single.isEmpty():  # one component: the sign decides
        ones = reps.where(F.size("e") == 1).withColumn("sign", F.get("e", F.lit(0)) > 0).join(single, "sign")
        links = ones.select(F.col("rep").alias("src"), F.lit(None).cast("long").alias("dst"), (F.col("all") - F.col("m")).alias("n")).unionByName(ones.select(F.col("rep").alias("src"), "dst", F.lit(0).cast("long").alias("n")))
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = reps.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(0).cast("long").alias("n"))
    found = materialise(found)
    linked = connected_components(found.where("dst is not null"), "src", "dst")
    counts = found.where("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("n"))
    known = reps.join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("e", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    good = named.where("ok").join(known, "e").select("id", "n_links", "component_id")
    rest = named.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    nameless = rows.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return good.unionByName(rest).unionByName(nameless).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
