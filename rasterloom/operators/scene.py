"""Scenes: a row for each pixel, and the projections over its feature vector."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scene_from_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label") -> DataFrame:
    """(i, y, x, v[, gt]) of vectors numbered 0..N-1, laid out row by row on a raster W = round(sqrt(1.25 N)) wide."""
    width = F.round(F.sqrt(1.25 * F.count("*"))).cast("long")
    w = int(df.agg(F.greatest(width, F.lit(1)).alias("w")).first()["w"])
    i = F.col(key)
    columns = [i.alias("i"), F.floor(i / w).cast("long").alias("y"), (i % w).alias("x"), F.col(vector).cast("array<double>").alias("v")]
    return df.select(*columns, *([F.col(label).alias("gt")] if label else []))


def crop(scene: DataFrame, size: int) -> DataFrame:
    """The top left size x size pixels; reaches the scan as a filter."""
    return scene.where((F.col("y") < size) & (F.col("x") < size))


def flat_index(y: Column, x: Column, width: int) -> Column:
    return y * width + x


def band_stats(scene: DataFrame, vector: str = "v") -> DataFrame:
    """(band, mean, std) with the population standard deviation."""
    bands = scene.select(F.posexplode(vector).alias("band", "value"))
    return bands.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def zscore(scene: DataFrame, vector: str = "v", least: float = 1e-8) -> DataFrame:
    """Vector standardised band by band; a band with std under `least` is only centred. One row of statistics is broadcast."""
    stats = band_stats(scene, vector).agg(F.array_sort(F.collect_list(F.struct("band", "mean", "std"))).alias("_s"))  # one entry a band
    scaled = F.zip_with(vector, "_s", lambda v, s: (v - s["mean"]) / F.when(s["std"] < least, 1.0).otherwise(s["std"]))
    return scene.crossJoin(F.broadcast(stats)).withColumn(vector, scaled).drop("_s")


def minmax(scene: DataFrame, vector: str = "v", first: int = 5, least: float = 1e-8) -> DataFrame:
    """P10: the first few bands rescaled to 0..1."""
    cut = scene.withColumn(vector, F.slice(vector, 1, first))
    ranges = cut.select(F.posexplode(vector).alias("band", "value")).groupBy("band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    ranges = ranges.agg(F.array_sort(F.collect_list(F.struct("band", "lo", "hi"))).alias("_s"))
    return cut.crossJoin(F.broadcast(ranges)).withColumn(vector, F.zip_with(vector, "_s", lambda v, s: (v - s["lo"]) / F.greatest(s["hi"] - s["lo"], F.lit(least)))).drop("_s")


def covariance(scene: DataFrame, vector: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population covariance). Each partition adds up its bands x bands products; their sums are merged by groups."""
    bands = scene.select(F.size(vector).alias("d")).first()
    if bands is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = bands["d"]
    import pyarrow as pa

    def partial(batches):
        n, s, p = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([n] * d), pa.array(s), pa.array(p.tolist())], ["band", "n", "s", "p"])

    def merge(table):
        rows = np.array(table.column("p").to_pylist()).sum(0)
        return pa.table({"band": table.column("band")[:1], "n": pa.array([sum(table.column("n").to_pylist())]), "s": pa.array([sum(table.column("s").to_pylist())]), "p": pa.array([rows.tolist()])})

    kind = "band long, n long, s double, p array<double>"
    rows = sorted(scene.select(vector).mapInArrow(partial, kind).groupBy("band").applyInArrow(merge, kind).collect())
    n = rows[0]["n"]
    mean = np.array([r["s"] for r in rows]) / n
    return n, mean, np.array([r["p"] for r in rows]) / n - np.outer(mean, mean)


def pca(scene: DataFrame, components: int, vector: str = "v", out: str = "p", standardise: bool = False) -> DataFrame:
    """Centred scores on the leading min(components, bands, rows) axes; signs make each axis's largest entry positive.

    standardise: scores over their population standard deviation (under 1e-8: unchanged).
    """
    n, mean, cov = covariance(scene, vector)
    if n == 0:
        return scene.withColumn(out, F.col(vector))
    k = min(components, len(mean), n - 1 if standardise and n > 1 else n)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])
    if standardise:
        std = np.sqrt(np.maximum(values[order], 0))
        axes = axes / np.where(std < 1e-8, 1.0, std)
    centred = lambda axis: F.aggregate(F.zip_with(vector, F.array(*map(F.lit, axis.tolist())), lambda a, b: a * b), F.lit(-float(mean @ axis)), lambda s, v: s + v)
    return scene.withColumn(out, F.array(*[centred(axes[:, j]) for j in range(k)]))
