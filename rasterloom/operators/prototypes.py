"""Mode prototypes and their consolidation.

Prototypes: (mode, mu array<double>, disp, n). Aggregation over pixels is distributed. Consolidation works on modes, not
pixels: up to MOST_MODES of them as arrays, beyond that in rounds over the cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.vector import squared_distance, squared_norm
from rasterloom.operators.modes import dense_numbers, knn
from rasterloom.session import fresh


def mode_prototypes(pixels: DataFrame, vector: str = "v", label: str = "label", floored: bool = True) -> DataFrame:
    """Mean, dispersion sqrt(sum of population variances) and count of each label, the dispersion not under the floor."""
    squares = F.transform(vector, lambda p: p * p)
    s = pixels.groupBy(F.col(label).alias("mode")).agg(Summarizer.mean(array_to_vector(vector)).alias("m"), Summarizer.mean(array_to_vector(squares)).alias("q"), F.count("*").alias("n"))
    rows = s.select("mode", vector_to_array("m").alias("mu"), vector_to_array("q").alias("q"), "n")
    spread = F.aggregate(F.zip_with("q", "mu", lambda q, m: F.greatest(q - m * m, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select("mode", "mu", F.sqrt(spread).alias("disp"), "n")
    if not floored:
        return rows
    return rows.crossJoin(F.broadcast(dispersion_floor(rows))).withColumn("disp", F.greatest("disp", "floor")).drop("floor")  # one row


def dispersion_floor(modes: DataFrame) -> DataFrame:
    """The 25th percentile of dispersions over 1e-6 of modes with 5 pixels or more, else 1e-3."""
    return modes.agg(F.coalesce(F.percentile(F.when((F.col("disp") > 1e-6) & (F.col("n") >= 5), F.col("disp")), F.lit(0.25)), F.lit(1e-3)).alias("floor"))


def adjusted_dispersions(modes: DataFrame, size_exponent: float) -> DataFrame:
    """A10: s = disp / (n / median n)^beta."""
    if size_exponent == 0:
        return modes.withColumn("s", F.col("disp"))
    mid = F.broadcast(modes.agg(F.greatest(F.median("n"), F.lit(1.0)).alias("_m")))
    return modes.crossJoin(mid).withColumn("s", F.col("disp") / F.pow(F.greatest(F.col("n") / F.col("_m"), F.lit(1e-8)), F.lit(size_exponent))).drop("_m")


#: So many modes fit a matrix of all pairs (128 MB).
MOST_MODES = 4096


def prototype_distances(modes: DataFrame, size_exponent: float = 0.0, least: float = 1e-8) -> DataFrame:
    """(a, b, raw, sep) of every two modes, as many rows as a distance matrix has cells; modes meet block against block."""
    return _separated(modes, knn(modes.select(F.col("mode").cast("long").alias("i"), F.col("mu").alias("v")), max(1, modes.count() - 1)), size_exponent, least).drop("rank")


def prototype_edges(modes: DataFrame, k: int = 30, size_exponent: float = 0.0) -> DataFrame:
    """(a, b, raw, sep, rank): of each mode its k nearest others by raw distance, with their normalised separation."""
    return _separated(modes, knn(modes.select(F.col("mode").cast("long").alias("i"), F.col("mu").alias("v")), k), size_exponent)


def _separated(modes: DataFrame, near: DataFrame, size_exponent: float, least: float = 1e-8) -> DataFrame:
    m = adjusted_dispersions(modes, size_exponent)
    a, b = m.select(F.col("mode").alias("i"), F.col("s").alias("_s")), m.select(F.col("mode").alias("j"), F.col("s").alias("_t"))
    sep = F.col("d") / F.greatest(F.sqrt((F.col("_s") * F.col("_s") + F.col("_t") * F.col("_t")) / 2), F.lit(least))
    return near.join(a, "i").join(b, "j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.col("d").alias("raw"), sep.alias("sep"), "rank")


def mutual_best_pairs(edges: DataFrame, tau: float) -> DataFrame:
    """(a, b), a < b, that are each other's least separated mode, at most tau apart. Ties: raw distance, then id."""
    order = Window.partitionBy("a").orderBy("sep", "raw", "b")
    best = edges.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("a", "b", "sep").where(F.col("sep") <= tau)
    back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["a", "b"]).where("a < b").select("a", "b")


def pooled_merge(modes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Modes with each pair pooled under the smaller id."""
    to = pairs.select(F.col("b").alias("mode"), F.col("a").alias("_to"))
    m = modes.join(to, "mode", "left").withColumn("mode", F.coalesce("_to", "mode")).drop("_to")
    grouped = m.groupBy("mode").agg(
        Summarizer.mean(array_to_vector("mu"), F.col("n").cast("double")).alias("m"), F.sum(F.col("n") * (F.col("disp") * F.col("disp") + squared_norm("mu"))).alias("q"), F.sum("n").alias("n")
    )
    rows = grouped.select("mode", vector_to_array("m").alias("mu"), "q", "n")
    return rows.select("mode", "mu", F.sqrt(F.greatest(F.col("q") / F.col("n") - squared_norm("mu"), F.lit(0.0))).alias("disp"), "n")


def _separations(mu: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.sqrt(((mu[:, None] - mu[None]) ** 2).sum(-1)) if len(mu) <= 512 else np.stack([np.sqrt(((row - mu) ** 2).sum(1)) for row in mu])
    return raw, raw / np.maximum(np.sqrt((s[:, None] ** 2 + s[None] ** 2) / 2), 1e-8)


def _adjust(disp: np.ndarray, n: np.ndarray, beta: float) -> np.ndarray:
    return disp if beta == 0 else disp / np.maximum(n / max(float(np.median(n)), 1.0), 1e-8) ** beta


def reciprocal_consolidate(mu: np.ndarray, disp: np.ndarray, n: np.ndarray, threshold: float, *, k: int = 30, size_exponent: float = 0.0) -> tuple[np.ndarray, int]:
    """G8 over arrays of modes: (group of each mode, numbered by its smallest member; rounds that merged).

    In a round every mode points at the least separated of its k nearest others; pairs that point at each other, at
    most threshold apart, merge into their pooled mean and dispersion. It ends when no pair is left.
    """
    m = len(mu)
    group = np.arange(m)
    mu, disp, n = mu.astype(float).copy(), disp.astype(float).copy(), n.astype(float).copy()
    ids = np.arange(m)
    rounds = 0
    while threshold > 0 and len(ids) > 1:
        raw, sep = _separations(mu, _adjust(disp, n, size_exponent))
        np.fill_diagonal(raw, np.inf)
        take = min(k, len(ids) - 1)
        order = np.lexsort((np.broadcast_to(np.arange(len(ids)), raw.shape), raw), axis=1)[:, :take]
        own = np.take_along_axis(sep, order, 1)
        first = np.lexsort((order, np.take_along_axis(raw, order, 1), own), axis=1)[:, 0]
        at = np.arange(len(ids))
        best, value = order[at, first], own[at, first]
        a = np.flatnonzero((best[best] == at) & (at < best) & (value <= threshold) & (value[best] <= threshold))
        if not len(a):
            break
        b = best[a]
        total = n[a] + n[b]
        mean = (n[a, None] * mu[a] + n[b, None] * mu[b]) / total[:, None]
        var = sum(n[x] * (disp[x] ** 2 + ((mu[x] - mean) ** 2).sum(1)) for x in (a, b)) / total
        into = ids.copy()
        into[b] = ids[a]
        lookup = np.arange(m)
        lookup[ids] = into
        group = lookup[group]
        mu[a], disp[a], n[a] = mean, np.sqrt(var), total
        stay = np.ones(len(ids), bool)
        stay[b] = False
        mu, disp, n, ids = mu[stay], disp[stay], n[stay], ids[stay]
        rounds += 1
    return np.unique(group, return_inverse=True)[1], rounds


def consolidate_rounds(modes: DataFrame, threshold: float, *, k: int = 30, size_exponent: float = 0.0) -> DataFrame:
    """G8 over the cluster: (mode, group), a group being named by its smallest mode."""
    group = fresh(modes.select("mode", F.col("mode").alias("group")))
    while threshold > 0:
        pairs = fresh(mutual_best_pairs(prototype_edges(modes, k, size_exponent), threshold))
        if pairs.isEmpty():
            break
        into = pairs.select(F.col("b").alias("group"), F.col("a").alias("_to"))
        group = fresh(group.join(into, "group", "left").select("mode", F.coalesce("_to", "group").alias("group")))
        modes = fresh(pooled_merge(modes, pairs))
    return group


def consolidate_modes(modes: DataFrame, threshold: float, *, k: int = 30, size_exponent: float = 0.0, most: int = MOST_MODES) -> DataFrame:
    """(mode, group), groups numbered from 0 by their smallest mode. Up to `most` modes are merged as arrays, more in rounds over the cluster."""
    modes = fresh(modes)
    if modes.count() > most:
        named = consolidate_rounds(modes, threshold, k=k, size_exponent=size_exponent)
        numbers = dense_numbers(named.select("group").distinct(), "group")
        return named.join(numbers, "group").select("mode", F.col("label").cast("long").alias("group"))
    ids, mu, disp, n = modes_to_arrays(modes)
    group, _ = reciprocal_consolidate(mu, disp, n, threshold, k=k, size_exponent=size_exponent)
    return group_table(modes, ids, group)


def group_table(modes: DataFrame, ids: list, group: np.ndarray) -> DataFrame:
    kind = modes.schema["mode"].dataType.simpleString()
    return modes.sparkSession.createDataFrame([(m, int(g)) for m, g in zip(ids, group, strict=True)], f"mode {kind}, group long")


def merge_until(mu: np.ndarray, disp: np.ndarray, n: np.ndarray, k: int, size_exponent: float = 0.0) -> np.ndarray:
    """T8 over arrays: the group of each mode when the least separated two have merged again and again until k are left."""
    m = len(mu)
    if m > MOST_MODES:
        raise ValueError(f"{m} modes exceed the matrix of {MOST_MODES}")
    mu, disp, n = mu.astype(float).copy(), disp.astype(float).copy(), n.astype(float).copy()
    group, live = np.arange(m), np.ones(m, bool)
    raw, sep = _separations(mu, _adjust(disp, n, size_exponent))
    np.fill_diagonal(sep, np.inf)
    for _ in range(m - max(k, 1)):
        a, b = sorted(int(x) for x in np.unravel_index(sep.argmin(), sep.shape))
        total = n[a] + n[b]
        mean = (n[a] * mu[a] + n[b] * mu[b]) / total
        disp[a] = np.sqrt(sum(n[x] * (disp[x] ** 2 + ((mu[x] - mean) ** 2).sum()) for x in (a, b)) / total)
        mu[a], n[a], live[b] = mean, total, False
        group[group == b] = a
        raw[a] = raw[:, a] = np.sqrt(((mu - mean) ** 2).sum(1))
        s = disp.copy()
        if size_exponent:  # the median size has changed, and with it every separation
            s[live] = _adjust(disp[live], n[live], size_exponent)
            sep = raw / np.maximum(np.sqrt((s[:, None] ** 2 + s[None] ** 2) / 2), 1e-8)
            np.fill_diagonal(sep, np.inf)
            sep[~live], sep[:, ~live] = np.inf, np.inf
        else:
            row = raw[a] / np.maximum(np.sqrt((s[a] ** 2 + s**2) / 2), 1e-8)
            row[~live] = np.inf
            row[a] = np.inf
            sep[a], sep[:, a] = row, row
            sep[b], sep[:, b] = np.inf, np.inf
    return np.unique(group, return_inverse=True)[1]


def modes_to_arrays(modes: DataFrame, most: int = MOST_MODES) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, mu, disp, n) on the driver; an error for more than `most` modes."""
    rows = sorted(modes.select("mode", "mu", "disp", "n").limit(most + 1).collect())
    if len(rows) > most:
        raise ValueError(f"more than {most} modes")
    return [r["mode"] for r in rows], np.array([r["mu"] for r in rows], float), np.array([r["disp"] for r in rows]), np.array([r["n"] for r in rows], float)


def apply_groups(pixels: DataFrame, groups: DataFrame, label: str = "label") -> DataFrame:
    """Pixels with their label replaced by its group; groups: (mode, group)."""
    to = groups.select(F.col("mode").alias(label), F.col("group").alias("_g"))
    return pixels.join(to, label).drop(label).withColumnRenamed("_g", label)  # one row a mode: Spark broadcasts it while it is small


def nearest_prototype(pixels: DataFrame, modes: DataFrame, vector: str = "v", digits: int | None = None, most: int = MOST_MODES) -> DataFrame:
    """pixels with `mode` and `distance` of the nearest prototype (mode, mu); of equal distances (rounded to `digits`) the lowest mode, and null without any mode.

    The prototypes go to every task as one row: a frozen model of up to `most` modes, which is checked.
    """
    n = modes.count()
    if n > most:
        raise ValueError(f"{n} prototypes; a model has {most} at most")
    model = modes.agg(F.collect_list(F.struct("mode", "mu")).alias("_modes"))
    far = lambda m: F.sqrt(squared_distance(vector, m["mu"]))
    near = F.array_min(F.transform("_modes", lambda m: F.struct((F.round(far(m), digits) if digits is not None else far(m)).alias("d"), m["mode"].alias("m"))))
    return pixels.crossJoin(F.broadcast(model)).withColumn("_near", near).withColumns({"mode": F.col("_near.m"), "distance": F.col("_near.d")}).drop("_modes", "_near")
