"""Statistics over tables of repeated runs: aggregates, ranks and rank tests, bootstrap, correlations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialise


def repeat_aggregate(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for one run) and count; nulls are skipped."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(value).alias("n_repeats"))


def mean_deltas(rows: DataFrame, by: str, variant: str, base: str, value: str) -> DataFrame:
    """Each variant's mean and its difference from the variant `base` of the same group."""
    mean = rows.groupBy(by, variant).agg(F.avg(value).alias("mean"))
    full = mean.where(F.col(variant) == base).select(by, F.col("mean").alias("_full"))
    return mean.join(full, by, "left").withColumn("delta", F.col("mean") - F.col("_full")).drop("_full")


def best_other(rows: DataFrame, by: str, method: str, own: str, value: str) -> DataFrame:
    """Own value, the best other method and its value (ties: first name), and the difference."""
    other = rows.where(F.col(method) != own).groupBy(by).agg(F.max_by(F.struct(method, value), F.struct(F.col(value), F.lit(0))).alias("_b"), F.max(value).alias("best_value"))
    first = rows.where(F.col(method) != own).join(other.select(by, "best_value"), by).where(F.col(value) == F.col("best_value")).groupBy(by).agg(F.min(method).alias("best_method"), F.max("best_value").alias("best_value"))
    mine = rows.where(F.col(method) == own).select(by, F.col(value).alias("own_value"))
    return mine.join(first, by).withColumn("delta", F.col("own_value") - F.col("best_value"))


def empirical_scaling(runs: DataFrame, stages: tuple[str, ...] = ()) -> DataFrame:
    """Pixels a second and microseconds an edge from mean runtimes; runs: scene, n_pixels, n_edges, seconds, and a column of seconds for each stage.

    Of the whole runtime also the sample deviation (null for a single run), of each stage its mean and its share of the
    mean runtime. Zero times or edges give null rates.
    """
    mean = runs.groupBy("scene").agg(F.max("n_pixels").alias("n"), F.max("n_edges").alias("e"), F.avg("seconds").alias("s"), F.stddev_samp("seconds").alias("seconds_std"), *(F.avg(c).alias(f"{c}_mean") for c in stages))
    parts = [x for c in stages for x in (F.col(f"{c}_mean"), F.try_divide(f"{c}_mean", "s").alias(f"{c}_share"))]
    return mean.select("scene", F.col("s").alias("seconds"), "seconds_std", F.try_divide("n", "s").alias("pixels_per_second"), F.try_divide(1e6 * F.col("s"), F.col("e")).alias("us_per_edge"), *parts)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """A18."""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def _value_ranks(df: DataFrame, by: list[str], value: str, descending: bool, out: str, times: str | None = None) -> DataFrame:
    """(by..., value, out): the mean rank of each value in its group, from two levels of prefix sums.

    Values are counted, then dealt by ranges of (by, value). A range adds up its own counts; ranges, of which a group has as
    many as there are partitions at most, add up their totals. So no task holds a group, however large it is.
    """
    order = F.desc(value) if descending else F.asc(value)
    counts = df.groupBy(*by, value).agg((F.sum(times) if times else F.count("*")).alias("__n")).repartitionByRange(*by, order)
    ranged = materialise(counts.withColumn("__p", F.spark_partition_id()))  # both levels must see the same ranges
    so_far = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ranged.groupBy(*by, "__p").agg(F.sum("__n").alias("__t"))
    below = F.sum("__t").over(so_far.partitionBy(*by).orderBy("__p")) - F.col("__t")
    totals = whole.select(F.col("__p").alias("__q"), below.alias("__below"), *(F.col(c).alias(f"__{k}") for k, c in enumerate(by)))
    rows = ranged.withColumn("__end", F.sum("__n").over(so_far.partitionBy(*by, "__p").orderBy(order)))
    same = [F.col("__p") == F.col("__q"), *(F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(by))]
    rank = F.col("__below") + F.col("__end") - (F.col("__n") - 1) / 2.0
    return rows.join(totals, reduce(Column.__and__, same)).select(*by, value, rank.alias(out))


def average_rank(df: DataFrame, by: list[str], value: str, descending: bool = True, out: str = "rank", times: str | None = None) -> DataFrame:
    """Ranks within by, ties sharing their mean rank. times: a column that says how many rows a row stands for. Nulls rank as one value, below all others. Ranks belong to values: rows look theirs up."""
    keys = [*by, value]
    ranks = _value_ranks(df, by, value, descending, "__rank", times).select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(keys)), "__rank")
    same = [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(keys)]
    return df.join(ranks, reduce(Column.__and__, same)).select(*df.columns, F.col("__rank").alias(out))


def method_ranks(scores: DataFrame) -> DataFrame:
    """(method, datasets, average_rank, rank_std) from (dataset, method, score)."""
    return average_rank(scores, ["dataset"], "score").groupBy("method").agg(F.count("*").alias("datasets"), F.avg("rank").alias("average_rank"), F.coalesce(F.stddev_samp("rank"), F.lit(0.0)).alias("rank_std"))


def friedman(scores: DataFrame) -> DataFrame:
    """(datasets, methods, statistic) from average ranks."""
    r = method_ranks(scores).agg(F.max("datasets").alias("datasets"), F.count("*").alias("methods"), F.sum(F.col("average_rank") * F.col("average_rank")).alias("q"))
    n, k = F.col("datasets"), F.col("methods")
    return r.select("datasets", "methods", (12.0 * n / (k * (k + 1)) * (F.col("q") - k * (k + 1) * (k + 1) / 4.0)).alias("statistic"))


def chi2_survival(x: float, dof: int) -> float:
    """P(chi2 > x): by recurrence from dof 1 or 2."""
    if x <= 0:
        return 1.0
    if dof % 2 == 0:
        term = total = math.exp(-x / 2)
        for k in range(1, dof // 2):
            term *= x / 2 / k
            total += term
        return total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, dof, 2):
        total += term
        term *= x / (k + 2)
    return total


def wilcoxon_exact(differences: list[float]) -> tuple[float, float]:
    """(min(W+, W-), exact two-sided p) of paired differences; zeros are dropped, tied sizes share ranks. The null distribution is counted over doubled ranks."""
    d = [x for x in differences if x != 0]
    size = sorted(abs(x) for x in d)
    doubled = {v: 2 * size.index(v) + size.count(v) + 1 for v in set(size)}
    ranks = [doubled[abs(x)] for x in d]
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    low = min(plus, sum(ranks) - plus)
    ways = {0: 1}
    for r in ranks:
        new = dict(ways)
        for s, c in ways.items():
            new[s + r] = new.get(s + r, 0) + c
        ways = new
    p = 2 * sum(c for s, c in ways.items() if s <= low) / 2 ** len(ranks)
    return low / 2, min(1.0, p)


def holm(tests: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjusted p over all rows. The tests are a handful; they share one window."""
    order = Window.orderBy(p, key)
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_s", step).withColumn("pvalue_holm", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def block_size(n_pixels: int) -> int:
    """Side of a bootstrap block."""
    return max(8, round(math.sqrt(n_pixels) / 20))


def block_bootstrap(pixels: DataFrame, right: str, block: int, samples: int = 300, seed: int = 0) -> DataFrame:
    """T4: (mean, std, lower, upper) of the share of right pixels when blocks of the raster are drawn with replacement.

    Blocks are summed first; a replicate weighs each block by a Poisson draw from the MD5 of (seed, replicate, block), so
    replicates need no sequential generator. Only blocks, never pixels, are multiplied by the replicates.
    """
    own = pixels.groupBy(F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(F.sum(F.col(right).cast("double")).alias("hit"), F.count("*").alias("n"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "r", "by", "bx").cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    weight = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= u))
    drawn = own.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("w", weight)
    value = drawn.groupBy("r").agg((F.sum(F.col("w") * F.col("hit")) / F.sum(F.col("w") * F.col("n"))).alias("v"))
    return value.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.percentile("v", F.lit(0.025)).alias("ci95_lower"), F.percentile("v", F.lit(0.975)).alias("ci95_upper"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """T5: rank correlation within each group; null where x or y has one value. Equal pairs are counted first; the mean rank is known, (n + 1) / 2, so one pass over them gives the sums."""
    pairs = average_rank(average_rank(df.groupBy(*by, x, y).agg(F.count("*").alias("__m")), by, x, False, "__x", "__m"), by, y, False, "__y", "__m")
    sizes = df.groupBy(*by).agg(F.count("*").alias("n"))
    own = sizes.select((F.col("n") + 1).alias("__two"), "n", *(F.col(c).alias(f"__b{k}") for k, c in enumerate(by)))
    rows = pairs.join(own, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__b{k}")) for k, c in enumerate(by)], F.lit(True)))
    dx, dy, m = (F.col("__x") - F.col("__two") / 2, F.col("__y") - F.col("__two") / 2, F.col("__m"))
    sums = rows.groupBy(*by).agg(F.sum(m * dx * dy).alias("__xy"), F.sum(m * dx * dx).alias("__xx"), F.sum(m * dy * dy).alias("__yy"), F.sum(m).alias("n"))
    return sums.select(*by, (F.col("__xy") / F.nullif(F.sqrt(F.col("__xx") * F.col("__yy")), F.lit(0.0))).alias("rho"), "n")


def win_counts(rows: DataFrame, by: str, method: str, own: str, value: str) -> DataFrame:
    """Of each other method how often `own` is better, equal and worse."""
    mine = rows.where(F.col(method) == own).select(by, F.col(value).alias("_m"))
    d = rows.where(F.col(method) != own).join(mine, by).withColumn("_d", F.col("_m") - F.col(value))
    return d.groupBy(method).agg(F.count_if(F.col("_d") > 0).alias("wins"), F.count_if(F.col("_d") == 0).alias("ties"), F.count_if(F.col("_d") < 0).alias("losses"))
