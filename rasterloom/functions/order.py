"""Order statistics of a column without one task that holds all its values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many values may meet in one task.
FEW = 1_000_000


def median(df: DataFrame, column: str, few: int = FEW) -> float | None:
    """The exact median of a numeric column's values (nulls are skipped), or None without any.

    Beyond `few` values, approximate quantiles bracket the middle; only the counts around the bracket and the values
    within it are looked at, again and again until few are left.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = values.count()
    if not n:
        return None
    if n <= few:
        return float(values.agg(F.median("x").alias("m")).first()["m"])
    low, high = (_smallest(values, (n - 1) // 2, n, few), _smallest(values, n // 2, n, few))
    return (low + high) / 2


def _smallest(values: DataFrame, rank: int, n: int, few: int) -> float:
    """The value at `rank` (from 0) in ascending order."""
    while n > few:
        share = (rank + 0.5) / n
        a, b = values.agg(F.percentile_approx("x", [max(0.0, share - 0.001), min(1.0, share + 0.001)], 10_000).alias("q")).first()["q"]
        below, within = values.agg(F.count_if(F.col("x") < a).alias("below"), F.count_if(F.col("x").between(a, b)).alias("within")).first()
        if rank < below:
            values, n = values.where(F.col("x") < a), below
        elif rank >= below + within:
            values, rank, n = values.where(F.col("x") > b), rank - below - within, n - below - within
        elif a == b:
            return float(a)
        elif within < n:
            values, rank, n = values.where(F.col("x").between(a, b)), rank - below, within
        else:  # a few values repeat so often that the bracket holds all: part it at its lower end
            least = values.agg(F.count_if(F.col("x") == a).alias("n")).first()["n"]
            if rank < least:
                return float(a)
            values, rank, n = values.where(F.col("x") > a), rank - least, n - least
    row = values.groupBy("x").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(Window.orderBy("x"))).where(F.col("end") > rank).agg(F.min("x").alias("x")).first()
    return float(row["x"])
