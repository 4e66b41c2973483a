"""The sparse neighbour graph of a raster: windowed candidates, top k, reciprocal gate, repair, affinities.

Pixels: (i, y, x, v). Edges: (i, j, ...) directed, both directions present once symmetrised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.arrow import matrix
from rasterloom.functions.order import median
from rasterloom.functions.vector import distance, gaussian, grid_distance, squared_distance
from rasterloom.operators.scene import pca


def _check(radius: int, k: int) -> None:
    if radius < 1 or k < 1:
        raise ValueError("the window radius and k must be at least 1")


def window_candidates(pixels: DataFrame, radius: int, vector: str = "v") -> DataFrame:
    """(i, j, d2) of every two pixels at most `radius` rows and columns apart, by an equi-join on shifted coordinates."""
    _check(radius, 1)
    shifts = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy or dx]
    to = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in shifts]))
    a = pixels.select("i", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(vector).alias("_v"), to.alias("o"))
    a = a.select("i", "_v", (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x"))
    b = pixels.select(F.col("i").alias("j"), "y", "x", F.col(vector).alias("_w"))
    return a.join(b, ["y", "x"]).select("i", "j", squared_distance("_v", "_w").alias("d2"))


def local_topk(candidates: DataFrame, k: int, radius: int) -> DataFrame:
    """Of each i the min(k, (radius + 1)^2 - 1) nearest j, rank from 1; ties go to the smaller j."""
    _check(radius, k)
    order = Window.partitionBy("i").orderBy("d2", "j")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(k, (radius + 1) ** 2 - 1))


def tiled_topk(pixels: DataFrame, radius: int, k: int, vector: str = "v", tile: int = 64) -> DataFrame:
    """J1 and J2 at once, for large scenes: (i, j, d2, rank) as local_topk gives, without a row for each candidate.

    A pixel goes to its own tile and to those within `radius`, so the shuffle is (1 + 2 radius / tile)^2 of the scene
    instead of (2 radius + 1)^2; each tile is compared in numpy, offset by offset.
    """
    _check(radius, k)
    most = min(k, (radius + 1) ** 2 - 1)
    lo, hi = (lambda c: F.floor((F.col(c) - radius) / tile)), (lambda c: F.floor((F.col(c) + radius) / tile))
    rows = pixels.select("i", "y", "x", F.col(vector).alias("v")).withColumn("ty", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("tx", F.explode(F.sequence(lo("x"), hi("x"))))

    def nearest(table: pa.Table) -> pa.Table:
        y, x, i = (table.column(c).to_numpy() for c in ("y", "x", "i"))
        v = matrix(table.column("v"))
        y0, x0 = table.column("ty")[0].as_py() * tile - radius, table.column("tx")[0].as_py() * tile - radius
        side = tile + 2 * radius
        at = np.full((side + 2 * radius, side + 2 * radius), -1)
        at[y - y0 + radius, x - x0 + radius] = np.arange(len(i))
        own = np.flatnonzero((y >= y0 + radius) & (y < y0 + radius + tile) & (x >= x0 + radius) & (x < x0 + radius + tile))
        py, px = y[own] - y0 + radius, x[own] - x0 + radius
        near, dist = [], []
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                if dy or dx:
                    other = at[py + dy, px + dx]
                    d = np.full(len(own), np.inf)
                    have = other >= 0
                    d[have] = ((v[own[have]] - v[other[have]]) ** 2).sum(1)
                    near.append(other)
                    dist.append(d)
        near_, dist_ = np.array(near).T, np.array(dist).T
        ids = np.where(near_ >= 0, i[near_], np.iinfo(np.int64).max)
        order = np.lexsort((ids, dist_), axis=1)[:, :most]
        d, j = np.take_along_axis(dist_, order, 1), np.take_along_axis(ids, order, 1)
        good = np.isfinite(d)
        rank = np.broadcast_to(np.arange(1, order.shape[1] + 1), d.shape)
        return pa.table({"i": pa.array(np.broadcast_to(i[own][:, None], d.shape)[good]), "j": pa.array(j[good]), "d2": pa.array(d[good]), "rank": pa.array(rank[good].astype(np.int32))})

    return rows.groupBy("ty", "tx").applyInArrow(nearest, "i long, j long, d2 double, rank int")


def _swapped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"))


def mutual_edges(topk: DataFrame) -> DataFrame:
    """Candidates whose reverse is a candidate too."""
    return topk.select("i", "j").join(_swapped(topk), ["i", "j"], "left_semi")


def union_edges(topk: DataFrame) -> DataFrame:
    """Candidates and their reverses."""
    return topk.select("i", "j").union(_swapped(topk)).distinct()


def repaired_edges(topk: DataFrame, mutual: DataFrame, min_degree: int, k: int) -> DataFrame:
    """Nodes of mutual degree under min_degree get their nearest missing candidates, both ways. Degrees are those before any addition."""
    if min_degree <= 0:
        return mutual
    if min_degree > k:
        raise ValueError("the least degree exceeds k")
    degree = topk.select("i").distinct().join(mutual.groupBy("i").agg(F.count("*").alias("deg")), "i", "left").select("i", F.coalesce("deg", F.lit(0)).alias("deg")).where(F.col("deg") < min_degree)
    missing = topk.join(degree, "i").join(mutual, ["i", "j"], "left_anti")
    order = Window.partitionBy("i").orderBy("rank")
    added = missing.withColumn("n", F.row_number().over(order)).where(F.col("n") <= min_degree - F.col("deg")).select("i", "j")
    return mutual.union(added).union(_swapped(added)).distinct()


def undirected_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, its smaller end first, without loops."""
    return edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def grid_edges(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """K3: edges with sp, the distance on the raster."""
    a = pixels.select("i", F.col("y").alias("_y1"), F.col("x").alias("_x1"))
    b = pixels.select(F.col("i").alias("j"), F.col("y").alias("_y2"), F.col("x").alias("_x2"))
    return edges.where("i <> j").join(a, "i").join(b, "j").withColumn("sp", grid_distance(*map(F.col, ("_y1", "_x1", "_y2", "_x2")))).drop("_y1", "_x1", "_y2", "_x2")


def build_graph(pixels: DataFrame, *, pca_components: int | None = 30, k: int = 20, window_radius: int = 7, mutual: bool = True, min_degree: int = 0, tile: int = 64) -> DataFrame:
    """G1: (i, j, sp) of the neighbour graph; neighbours are searched in PCA space (None: in the full vectors)."""
    _check(window_radius, k)
    found = pca(pixels, pca_components, out="p") if pca_components else pixels.withColumn("p", F.col("v"))
    top = tiled_topk(found.select("i", "y", "x", "p"), window_radius, k, "p", tile)
    if mutual:
        edges = repaired_edges(top, mutual_edges(top), min_degree, min(k, (window_radius + 1) ** 2 - 1))
    else:
        edges = union_edges(top)
    return grid_edges(edges, pixels)


def spectral_edges(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """Edges with d, the distance between their ends' full vectors."""
    a = pixels.select("i", F.col("v").alias("_a"))
    b = pixels.select(F.col("i").alias("j"), F.col("v").alias("_b"))
    return edges.join(a, "i").join(b, "j").withColumn("d", distance("_a", "_b")).drop("_a", "_b")


def bandwidths(edges: DataFrame, least: float = 1e-6) -> DataFrame:
    """A2: one row, the exact medians of the spectral and of the grid distances over all edges. The edges are read several times: give a materialised table."""
    middle = lambda c: max(m, least) if (m := median(edges, c)) is not None else least
    return edges.sparkSession.createDataFrame([(middle("d"), middle("sp"))], "sigma_spectral double, sigma_spatial double")


def affinities(edges: DataFrame, sigma_spectral: float | None = None, sigma_spatial: float | None = None, use_spatial: bool = True) -> DataFrame:
    """Edges (with d and sp) and their Gaussian weights w; bandwidths default to the medians (one row, broadcast)."""
    if sigma_spectral is None or sigma_spatial is None:
        sigmas = F.broadcast(bandwidths(edges))
    else:
        sigmas = F.broadcast(edges.sparkSession.createDataFrame([(float(sigma_spectral), float(sigma_spatial))], "sigma_spectral double, sigma_spatial double"))
    s = F.col("sigma_spectral") if sigma_spectral is None else F.lit(float(sigma_spectral))
    t = F.col("sigma_spatial") if sigma_spatial is None else F.lit(float(sigma_spatial))
    w = gaussian("d", s) * (gaussian("sp", t) if use_spatial else F.lit(1.0))
    return edges.crossJoin(sigmas).withColumn("w", w).drop("sigma_spectral", "sigma_spatial")


def transition_rows(edges: DataFrame, least: float = 1e-12) -> DataFrame:
    """A3: (i, j, p), weights over their row's sum; rows with a sum of `least` or less are isolated and left out."""
    total = F.sum("w").over(Window.partitionBy("i"))
    return edges.withColumn("_t", total).where(F.col("_t") > least).select("i", "j", (F.col("w") / F.col("_t")).alias("p"))


def degree_stats(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """Least, median, 90th percentile and largest degree; number of isolated pixels."""
    degree = pixels.select("i").join(edges.groupBy("i").agg(F.count("*").alias("deg")), "i", "left").select(F.coalesce("deg", F.lit(0)).alias("deg"))
    return degree.agg(F.min("deg").alias("degree_min"), F.median("deg").alias("degree_median"), F.percentile("deg", F.lit(0.9)).alias("degree_p90"), F.max("deg").alias("degree_max"), F.count_if(F.col("deg") == 0).alias("isolated_nodes"))
