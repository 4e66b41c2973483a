"""The majority filter of a label raster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def majority_filter(pixels: DataFrame, radius: int = 3, label: str = "label", tile: int = 64) -> DataFrame:
    """(i, y, x, label): each pixel's most frequent label in a window of radius rows and columns.

    Beyond the border the nearest pixel counts again (so border pixels count repeatedly); a position without a pixel has
    no vote. The pixel's own label wins ties it is part of, else the smallest label does. A radius of 0 or less changes
    nothing. Pixels go to their tile and to those within the radius, and each tile is counted in numpy, so the shuffle is
    (1 + 2 radius / tile)^2 of the scene.
    """
    rows = pixels.select("i", "y", "x", F.col(label).alias("label"))
    if radius <= 0:
        return rows
    size = rows.agg(F.max("y").alias("h"), F.max("x").alias("w")).first()
    if size["h"] is None:
        return rows
    h, w = size["h"], size["w"]
    lo, hi = (lambda c: F.floor((F.col(c) - radius) / tile)), (lambda c: F.floor((F.col(c) + radius) / tile))
    dealt = rows.withColumn("ty", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("tx", F.explode(F.sequence(lo("x"), hi("x"))))
    kind = rows.schema["label"].dataType.simpleString()

    def count(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        values, code = np.unique(table.column("label").to_numpy(), return_inverse=True)
        y0, x0 = table.column("ty")[0].as_py() * tile - radius, table.column("tx")[0].as_py() * tile - radius
        side = tile + 2 * radius
        at = np.full((side, side), -1)
        at[y - y0, x - x0] = code
        own = np.flatnonzero((y >= y0 + radius) & (y < y0 + radius + tile) & (x >= x0 + radius) & (x < x0 + radius + tile))
        seen = [at[np.clip(y[own] + dy, 0, h) - y0, np.clip(x[own] + dx, 0, w) - x0] for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
        votes = np.array(seen).T
        most, best = np.zeros(len(own), np.int64), np.full(len(own), len(values))
        mine = code[own]
        for c in range(votes.shape[1]):  # the number of votes for what this position says
            told = votes[:, c]
            n = np.where(told < 0, 0, (votes == told[:, None]).sum(1))
            better = (n > most) | ((n == most) & (n > 0) & (best != mine) & ((told == mine) | (told < best)))
            most, best = np.where(better, n, most), np.where(better, told, best)
        taken = pa.array(values[best]).cast(table.schema.field("label").type)
        return pa.table({**{c: table.column(c).take(pa.array(own)) for c in ("i", "y", "x")}, "label": taken})

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return dealt.groupBy("ty", "tx").applyInArrow(count, f"i {types['i']}, y {types['y']}, x {types['x']}, label {kind}")
