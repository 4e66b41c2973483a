"""Session defaults. On a cluster the submit configuration wins; these fill the gaps."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "rasterloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names. Only a local session may go without one; it gets a folder that goes with the process."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rasterloom-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings within; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def sieve(keys: int) -> dict[str, str]:
    """Settings under which a shuffled join with about so many keys, read from files by a comparison, shuffles of the other side only what Spark's Bloom filter of these keys lets through.

    A byte a key, up to Spark's limit of 8 MB; beyond 8 million keys more rows pass. The join itself stays exact.
    """
    own = "spark.sql.optimizer.runtime.bloomFilter."
    n = str(max(1, keys))
    return {f"{own}enabled": "true", f"{own}applicationSideScanSizeThreshold": "0", f"{own}creationSideThreshold": str(1 << 40), f"{own}expectedNumItems": n, f"{own}maxNumItems": n, f"{own}numBits": str(8 * max(1024, keys))}


#: Spark removes the shuffle files of a plan made under this setting at the end of its execution.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder, so that a lost executor costs no recomputation.

    The rows are in that folder then, so the shuffle files behind them go at once, not when the driver's heap is collected.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with settings(spark, {CLEANUP: "true"}):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting


def fresh(df: DataFrame) -> DataFrame:
    """Materialise, for loops and what they call: without the estimated size that a checkpoint takes over from its plan.

    A join's estimate is the product of both sides', so where a round joins what stems from the round before, the number of
    its digits multiplies with each round, until multiplying them takes all of the driver's time and memory.
    """
    kept = materialise(df)
    return DataFrame(kept.sparkSession._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), kept.sparkSession)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows as Parquet in a new folder beside the checkpoints, and that folder, for `discard` when they are no longer read.

    For tables with whole texts or sets: they take less room than a checkpoint's plain rows, Spark knows their size, and
    they go when told, not when the driver's heap is collected.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    with settings(spark, {CLEANUP: "true"}):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove what `stored` wrote."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did. Where they don't share its path, submit it with --py-files."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, paths)])
