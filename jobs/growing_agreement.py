"""Agreement of labellings over a table of documents that grows by files.

    python -m jobs.growing_agreement --documents PATH --out PATH --checkpoint PATH [--config FILE]

Each run takes only the files that no run before took: a file stream with its checkpoint, ended when all files there are
through. Each of its batches adds a piece to the contingency tables of some pairs of labellings (SQL expressions over a
row), written under the batch's number; a batch that is done again after a failure replaces its own piece. Entropies,
ARI, NMI and the like after every batch then follow from the pieces alone, which hold cells, not documents.

    OUT/counts/batch=.../pair=.../ t, p, n: the rows that the batch adds to a cell
    OUT/agreement/pair=.../        the metrics after each batch

config: pairs (name -> two expressions, the reference first), max_files (files a batch takes at most; null: all).
Rows where either labelling is null take no part in a pair. Repeated rows count as often as they come. With an empty
table, or while there is nothing new, the output stays as it is.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import partition
from rasterloom.session import get_session
from rasterloom.streaming.contingency import file_stream

log = logging.getLogger("jobs.growing_agreement")

COUNTS = "t string, p string, n long, batch long, pair string"
AGREEMENT = "batch long, n long, k_true long, k_pred long, entropy_true double, entropy_pred double, ari double, nmi double, homogeneity double, completeness double, v_measure double, pair string"


def read_config(path: str | None = None) -> dict:
    return json.loads(Path(path or Path(__file__).with_suffix(".json")).read_text())


def cells(rows: DataFrame, pairs: dict[str, list[str]]) -> DataFrame:
    """(pair, t, p, n) of all pairs in one pass over the rows."""
    each = F.array(*(F.struct(F.lit(name).alias("pair"), F.expr(t).cast("string").alias("t"), F.expr(p).cast("string").alias("p")) for name, (t, p) in pairs.items()))
    return rows.select(F.explode(each).alias("_c")).select("_c.*").where("t is not null and p is not null").groupBy("pair", "t", "p").agg(F.count("*").alias("n"))


def counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(COUNTS).parquet(f"{out}/counts")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Take what is new, bring the metrics up to date; returns what stands in `out` (see read_back)."""
    config = config or read_config()
    options = {"maxFilesPerTrigger": str(config["max_files"])} if config.get("max_files") else {}

    def add(batch: DataFrame, number: int) -> None:
        piece = cells(batch, config["pairs"]).withColumn("batch", F.lit(number).cast("long"))
        piece.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "pair").parquet(f"{out}/counts")
        log.info("wrote batch %d to %s/counts", number, out)

    stream = file_stream(spark, documents, **options)
    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %d new rows of %s", sum(p["numInputRows"] for p in query.recentProgress), documents)
    # the folder is there from here on, also where no batch came or none had a row
    spark.createDataFrame([], COUNTS).write.mode("append").partitionBy("batch", "pair").parquet(f"{out}/counts")
    partition.running_agreement(counts(spark, out), "pair").write.mode("overwrite").partitionBy("pair").parquet(f"{out}/agreement")
    log.info("wrote %s/agreement", out)
    return read_back(spark, out)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """All that stands in `out` as (pair, batch, t, p, item, value): the pieces of the tables (item "rows"), and each batch's metrics."""
    pieces = counts(spark, out).select("pair", "batch", "t", "p", F.lit("rows").alias("item"), F.col("n").cast("double").alias("value"))
    metrics = F.explode(F.array(*(F.struct(F.lit(m).alias("item"), F.col(m).cast("double").alias("value")) for m in partition.AGREEMENT)))
    none = F.lit(None).cast("string")
    rows = spark.read.schema(AGREEMENT).parquet(f"{out}/agreement").select("pair", "batch", none.alias("t"), none.alias("p"), metrics.alias("_m")).select("pair", "batch", "t", "p", "_m.*")
    return pieces.unionByName(rows)


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.growing_agreement")
    for name in ("documents", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("growing_agreement")
    try:
        run(spark, args.documents, args.out, args.checkpoint, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
