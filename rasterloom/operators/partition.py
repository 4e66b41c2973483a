"""Partition algebra: statistics of one labelling and comparison of two, all from the contingency table."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, true: str, pred: str, ignore: object | None = None) -> DataFrame:
    """M1: (t, p, n). Rows whose true label is `ignore` are left out."""
    rows = df.select(F.col(true).alias("t"), F.col(pred).alias("p"))
    if ignore is not None:
        rows = rows.where(F.col("t") != F.lit(ignore))
    return rows.groupBy("t", "p").agg(F.count("*").alias("n"))


def _pairs(n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return n * (n - 1) / 2.0


def _margins(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group (by default for all): total and the sums over cells and margins that the metrics need."""
    log = lambda c: F.col(c) * F.log(F.col(c).cast("double"))
    cells = table.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(_pairs("n")).alias("pairs"), F.sum(log("n")).alias("logs"), F.max("n").alias("top"))
    side = lambda c, s: table.groupBy(*by, c).agg(F.sum("n").alias("m")).groupBy(*by).agg(F.sum(_pairs("m")).alias(f"pairs_{s}"), F.sum(log("m")).alias(f"logs_{s}"), F.count("*").alias(f"k_{s}"))
    if by:
        return cells.join(side("t", "t"), list(by)).join(side("p", "p"), list(by))
    return cells.crossJoin(side("t", "t")).crossJoin(side("p", "p"))  # three one-row frames


def _ari() -> Column:
    whole = _pairs("n")
    expected = F.col("pairs_t") * F.col("pairs_p") / whole
    most = (F.col("pairs_t") + F.col("pairs_p")) / 2.0
    return F.when((F.coalesce("n", F.lit(0)) < 2) | (most == expected), 1.0).otherwise((F.col("pairs") - expected) / (most - expected))


def ari(table: DataFrame) -> DataFrame:
    """M7: adjusted Rand index; two one-cluster partitions agree fully."""
    return _margins(table).select(_ari().alias("ari"))


def _entropy(s: str) -> Column:
    """Of a margin, in nats."""
    n = F.col("n").cast("double")
    return F.greatest(F.lit(0.0), F.log(n) - F.col(f"logs_{s}") / n)


def _information() -> dict[str, Column]:
    n = F.col("n").cast("double")
    mi = F.greatest(F.lit(0.0), F.log(n) + (F.col("logs") - F.col("logs_t") - F.col("logs_p")) / n)
    one = lambda s: F.col(f"k_{s}") <= 1  # noqa: E731  (none: an empty table agrees with itself)
    hom = F.when(one("t"), 1.0).otherwise(mi / _entropy("t"))
    com = F.when(one("p"), 1.0).otherwise(mi / _entropy("p"))
    nmi = F.when(one("t") & one("p"), 1.0).when(one("t") | one("p"), 0.0).otherwise(2 * mi / (_entropy("t") + _entropy("p")))
    return {"homogeneity": hom, "completeness": com, "nmi": nmi, "v_measure": F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com))}


def information(table: DataFrame) -> DataFrame:
    """M6, M9: nmi (arithmetic mean), homogeneity, completeness, v_measure."""
    return _margins(table).select(*(c.alias(name) for name, c in _information().items()))


#: What agreement() and running_agreement() tell besides their keys.
AGREEMENT = ("n", "k_true", "k_pred", "entropy_true", "entropy_pred", "ari", "nmi", "homogeneity", "completeness", "v_measure")


def _agreement(sums: DataFrame, *keys: str) -> DataFrame:
    return sums.select(*keys, F.col("n").cast("long").alias("n"), F.col("k_t").cast("long").alias("k_true"), F.col("k_p").cast("long").alias("k_pred"), _entropy("t").alias("entropy_true"), _entropy("p").alias("entropy_pred"), _ari().alias("ari"), *(c.alias(name) for name, c in _information().items()))


def agreement(table: DataFrame, *by: str) -> DataFrame:
    """M5-M9 for each group of a contingency table (by..., t, p, n): by and AGREEMENT; one plan for all groups."""
    return _agreement(_margins(table, by), *by)


def running_agreement(deltas: DataFrame, by: str, batch: str = "batch") -> DataFrame:
    """(by, batch, AGREEMENT) after each batch of a contingency table that grows: deltas are (by, batch, t, p, n), the rows that a batch adds to a cell.

    A cell's or margin's share in the sums of pairs and of n ln n changes only where it grows, so each batch has the
    changes' sum, and sums over batches give the state after each: work is linear in the deltas, whatever the number of
    batches. Windows hold one cell, or the batches of one group.
    """
    f = {"pairs": _pairs, "logs": lambda n: F.when(n > 0, n * F.log(n.cast("double"))).otherwise(0.0)}

    def changes(suffix: str, *cell: str) -> DataFrame:
        grown = deltas.groupBy(by, *cell, batch).agg(F.sum("n").alias("_d"))
        now = F.sum("_d").over(Window.partitionBy(by, *cell).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        grown = grown.withColumn("_now", now).withColumn("_old", F.col("_now") - F.col("_d"))
        sums = [F.sum(g(F.col("_now")) - g(F.col("_old"))).alias(name + suffix) for name, g in f.items()]
        return grown.groupBy(by, batch).agg(F.sum("_d").alias("n" + suffix), F.count_if(F.col("_old") == 0).alias("k" + suffix), *sums)

    parts = changes("", "t", "p").join(changes("_t", "t"), [by, batch]).join(changes("_p", "p"), [by, batch])
    so_far = Window.partitionBy(by).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ["n", *(f"{name}{s}" for name in f for s in ("", "_t", "_p")), "k_t", "k_p"]
    return _agreement(parts.select(by, batch, *(F.sum(c).over(so_far).alias(c) for c in names)), by, batch)


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """log(x!) of whole numbers: exact sums below 256, Stirling's series above."""
    x = np.asarray(x, float)
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))
    z = np.maximum(x, 255) + 1
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(x < 256, small[np.minimum(x, 255).astype(int)], series)


def expected_mi(rows: list[int] | dict[int, int], cols: list[int] | dict[int, int], deviations: float = 40.0) -> float:
    """Expected mutual information of random tables with these margins (hypergeometric).

    rows, cols: the margins, or how often each margin occurs. Equal margins are computed once. A cell's overlap is summed within `deviations` standard deviations (and 64) of its
    mean: what lies beyond weighs less than the rounding of a double.
    """
    rows, cols = Counter(rows), Counter(cols)
    n = sum(size * times for size, times in rows.items())
    total = 0.0
    (a_of, a_times), (b_of, b_times) = (np.array(sorted(x.items()), float).reshape(-1, 2).T for x in (rows, cols))
    for a, times in zip(a_of, a_times, strict=True):
        fixed = _log_factorial(a) + _log_factorial(b_of) + _log_factorial(n - a) + _log_factorial(n - b_of) - _log_factorial(n)
        for b, also, log in zip(b_of, b_times, fixed, strict=True):
            mean = a * b / n
            spread = deviations * math.sqrt(max(mean * (1 - a / n) * (1 - b / n) * n / max(n - 1, 1), 0.0)) + 64
            low, high = max(1, a + b - n, math.floor(mean - spread)), min(a, b, math.ceil(mean + spread))
            for at in range(int(low), int(high) + 1, 1 << 20):
                k = np.arange(at, min(at + (1 << 20), int(high) + 1), dtype=float)
                logs = log - _log_factorial(k) - _log_factorial(a - k) - _log_factorial(b - k) - _log_factorial(n - a - b + k)
                total += times * also * float((k / n * np.log(n * k / (a * b)) * np.exp(logs)).sum())
    return total


def ami(table: DataFrame) -> float:
    """M8: adjusted mutual information. Of classes and clusters only their sizes matter: each distinct size comes to the driver once, with how many have it, so about sqrt(2 n) numbers at most."""
    r = _margins(table).first()
    n = r["n"] or 0
    if n == 0 or r["k_t"] == r["k_p"] == 1:
        return 1.0
    times = lambda c: {x["m"]: x["times"] for x in table.groupBy(c).agg(F.sum("n").alias("m")).groupBy("m").agg(F.count("*").alias("times")).collect()}
    mi = math.log(n) + (r["logs"] - r["logs_t"] - r["logs_p"]) / n
    entropy = [math.log(n) - r[c] / n for c in ("logs_t", "logs_p")]
    e = expected_mi(times("t"), times("p"))
    below = sum(entropy) / 2 - e
    return float((mi - e) / (below if abs(below) > 1e-15 else math.copysign(1e-15, below or 1.0)))


def partition_stats(df: DataFrame, label: str, tiny: int = 20) -> DataFrame:
    """K, largest fraction, normalised entropy (0 for one cluster), share of rows in clusters under `tiny`."""
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return stats_of_sizes(sizes, F.col("n") < tiny)


def stats_of_sizes(sizes: DataFrame, is_tiny: Column) -> DataFrame:
    n = F.col("total").cast("double")
    sums = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.max("n").alias("top"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("logs"), F.coalesce(F.sum(F.when(is_tiny, F.col("n"))), F.lit(0)).alias("small"))
    entropy = F.when(F.col("k") <= 1, 0.0).otherwise((F.log(n) - F.col("logs") / n) / F.log(F.col("k").cast("double")))
    return sums.select("k", (F.col("top") / n).alias("largest_fraction"), entropy.alias("normalized_entropy"), (F.col("small") / n).alias("microcluster_mass"))


def partition_diagnostics(df: DataFrame, label: str, share: float = 0.005) -> DataFrame:
    """As partition_stats, tiny being under a share of all rows; also the number of tiny clusters."""
    sizes = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    rows = sizes.crossJoin(F.broadcast(total)).withColumn("tiny", F.col("n") < share * F.col("total")).drop("total")  # one row
    main = stats_of_sizes(rows, F.col("tiny"))
    return main.crossJoin(rows.agg(F.count_if("tiny").alias("tiny_clusters")))


def fragmentation(table: DataFrame, mass: float = 0.9) -> DataFrame:
    """A row for each true class: purity share, fragments for `mass` of the class (W5), dominant share, normalised entropy."""
    total = Window.partitionBy("t")
    order = Window.partitionBy("t").orderBy(F.desc("n"), "p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table.withColumn("class_n", F.sum("n").over(total)).withColumn("run", F.sum("n").over(order)).withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("n"), "p")))
    share = F.col("n") / F.col("class_n")
    per = rows.groupBy("t").agg(
        F.min("class_n").alias("class_n"),
        F.min(F.when(F.col("run") >= mass * F.col("class_n") - 1e-9, F.col("rank"))).alias("fragments"),
        F.max(share).alias("dominant_fraction"),
        F.count("*").alias("clusters"),
        (-F.sum(share * F.log(share))).alias("entropy"),
    )
    return per.select("t", "class_n", "fragments", "dominant_fraction", F.when(F.col("clusters") <= 1, 0.0).otherwise(F.col("entropy") / F.log(F.col("clusters").cast("double"))).alias("normalized_entropy"))


def purity(table: DataFrame) -> DataFrame:
    return table.groupBy("p").agg(F.max("n").alias("m"), F.sum("n").alias("n")).agg((F.sum("m") / F.sum("n")).alias("purity"))


def oversegmentation_counts(table: DataFrame, share: float = 0.005) -> DataFrame:
    """Numbers of classes and clusters, their difference, rows, and the share of clusters under `share` of the rows."""
    by_p = table.groupBy("p").agg(F.sum("n").alias("m"))
    total = table.agg(F.sum("n").alias("n_labelled"), F.countDistinct("t").alias("k_true"))
    tiny = by_p.crossJoin(F.broadcast(total.select("n_labelled"))).agg(F.count("*").alias("k_pred"), F.avg(F.when(F.col("m") < share * F.col("n_labelled"), 1.0).otherwise(0.0)).alias("tiny_fraction"))
    return total.crossJoin(tiny).select("k_true", "k_pred", (F.col("k_pred") - F.col("k_true")).alias("k_difference"), "n_labelled", "tiny_fraction")


def oversegmentation_ratios(table: DataFrame, fine: int, final: int) -> DataFrame:
    """Clusters for each class, fine modes for each final cluster, and purity, of a scene with `fine` and `final` clusters."""
    counts = oversegmentation_counts(table).crossJoin(purity(table))
    return counts.select((F.lit(final) / F.col("k_true")).alias("full_ratio"), (F.col("k_pred") / F.col("k_true")).alias("labelled_ratio"), F.lit(fine / max(final, 1)).alias("fine_to_final"), "purity")


def noise_accounting(df: DataFrame, label: str, labelled: Column, noise: int = -1) -> DataFrame:
    """Noise share over all rows and over labelled rows, clusters without the noise label."""
    is_noise = F.col(label) == noise
    return df.agg(F.avg(is_noise.cast("double")).alias("noise_fraction"), F.avg(F.when(labelled, is_noise.cast("double"))).alias("noise_fraction_labelled"), F.countDistinct(F.when(~is_noise, F.col(label))).alias("n_clusters"))


def pairwise_ari(labels: DataFrame, run: str, item: str, label: str) -> DataFrame:
    """(a, b, ari) for each two runs a < b over the same items, from one self-join."""
    a = labels.select(F.col(run).alias("a"), item, F.col(label).alias("t"))
    b = labels.select(F.col(run).alias("b"), item, F.col(label).alias("p"))
    return ari_of_cells(a.join(b, item).where("a < b").groupBy("a", "b", "t", "p").agg(F.count("*").alias("n")))


def ari_of_cells(cells: DataFrame) -> DataFrame:
    """(a, b, ari) of the contingency tables (a, b, t, p, n) of many pairs at once."""
    base = cells.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(_pairs("n")).alias("pairs"))
    side = lambda c: cells.groupBy("a", "b", c).agg(F.sum("n").alias("m")).groupBy("a", "b").agg(F.sum(_pairs("m")).alias(f"pairs_{c}"))
    return base.join(side("t"), ["a", "b"]).join(side("p"), ["a", "b"]).select("a", "b", _ari().alias("ari"))


def mean_pairwise_ari(labels: DataFrame, run: str, item: str, label: str) -> DataFrame:
    """1 where there are fewer than two runs."""
    return pairwise_ari(labels, run, item, label).agg(F.coalesce(F.avg("ari"), F.lit(1.0)).alias("mean_ari"))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of a one-to-one matching with the largest total gain (shortest augmenting paths, O(n^3))."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            slack = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = least[nxt]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
            if match[j] == 0:
                break
        while j:
            match[j], j = match[way[j]], way[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if turned else sorted(pairs)


def matched_pairs(table: DataFrame) -> list[tuple]:
    """M2: (class, cluster) pairs of a one-to-one matching with the largest total overlap.

    With k labels on the side that has fewer, a label needs only its k largest cells: were it matched outside them, one of
    them would be free and no worse. So at most k^2 + k cells come to the driver, however many labels the other side has.
    Its k smallest labels are candidates too, so every label of the smaller side is matched, if need be without overlap.
    Of equal cells the smaller label counts as larger. Null labels are not matched.
    """
    cells = table.where("t is not null and p is not null")
    k = {c: cells.select(c).distinct().count() for c in ("t", "p")}
    few, many = ("t", "p") if k["t"] <= k["p"] else ("p", "t")
    if not k[few]:
        return []
    order = Window.partitionBy(few).orderBy(F.desc("n"), many)
    top = cells.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k[few]).select(few, many, "n").collect()
    rows = sorted({c[few] for c in top})
    cols = sorted({c[many] for c in top} | {r[0] for r in cells.select(many).distinct().orderBy(many).limit(k[few]).collect()})
    at_row, at_col = ({x: i for i, x in enumerate(side)} for side in (rows, cols))
    gain = np.zeros((len(rows), len(cols)))
    for c in top:
        gain[at_row[c[few]], at_col[c[many]]] = c["n"]
    pairs = [(rows[i], cols[j]) for i, j in assignment(gain)]
    return sorted(pairs if few == "t" else [(t, p) for p, t in pairs])


def hungarian_match(table: DataFrame) -> dict:
    """M2: cluster -> class with the largest total overlap; unmatched clusters -> -1. The clusters' names come to the driver."""
    return {r["p"]: -1 for r in table.select("p").distinct().collect()} | {p: t for t, p in matched_pairs(table)}


def evaluate(df: DataFrame, true: str, pred: str, ignore: object | None = 0) -> dict:
    """M1-M10 of labelled rows. `cluster_to_class_mapping` has the matched clusters; any other belongs to no class (-1).

    Sums over the contingency table stay on the cluster; the driver gets one-row aggregates, the cells that matched_pairs
    needs, and the distinct sizes of classes and clusters.
    """
    table = contingency(df, true, pred, ignore).persist()
    try:
        spark, kind = df.sparkSession, {f.name: f.dataType.simpleString() for f in table.schema}
        pairs = matched_pairs(table)
        mapping = spark.createDataFrame(pairs, f"m {kind['t']}, p {kind['p']}")
        named = table.join(mapping, "p", "left")  # one row a matched cluster: Spark broadcasts it while it is small
        by_class = named.groupBy("t").agg(F.sum("n").alias("size"), F.sum(F.when(F.col("m") == F.col("t"), F.col("n")).otherwise(0)).alias("right"))
        guessed = named.where("m is not null").groupBy(F.col("m").alias("t")).agg(F.sum("n").alias("guessed"))
        share = F.col("size").cast("double") * F.coalesce("guessed", F.lit(0))
        r = by_class.join(guessed, "t", "left").agg(F.sum("size").alias("n"), F.sum("right").alias("right"), F.avg(F.col("right") / F.col("size")).alias("ba"), F.sum(share).alias("share")).first()
        n = r["n"] or 0
        oa = r["right"] / n if n else 0.0
        chance = r["share"] / n**2 if n else 0.0
        info = information(table).first().asDict()
        counts = oversegmentation_counts(table).first().asDict()
        return {
            "overall_accuracy": oa,
            "balanced_accuracy": r["ba"] or 0.0,
            "kappa": (oa - chance) / (1 - chance) if chance < 1 else 1.0,
            "ari": ari(table).first()["ari"],
            "ami": ami(table),
            **info,
            **counts,
            "cluster_to_class_mapping": {p: t for t, p in pairs},
        }
    finally:
        table.unpersist()
