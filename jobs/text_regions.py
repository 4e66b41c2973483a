"""Regions of a text table and how they agree with reference labels.

    python -m jobs.text_regions --documents PATH --labels PATH --out PATH [--config FILE]

Each document becomes a vector (the shares of some letters), standardised band by band. The largest sources' mean
vectors are the prototypes; every document belongs to the nearest one. No reference label is read until the regions
are written. Then each reference (a column of documents or of labels) is compared with the regions as written.

Written, each by Spark's own writers and in full on every run, so that a rerun gives the same:
    OUT/regions/region=.../      doc_id, source, distance
    OUT/agreement/reference=.../ the metrics of each reference (only the references of this run are replaced)
    OUT/classes/reference=.../   of each class: rows, fragments for 90 % of them, share of its dominant region

Null texts count as empty, documents without any of the letters have zero shares. Documents without a source get a
region but make no prototype; rows that share an id are documents of their own. Rows without a reference label take no
part in its metrics. Empty tables give empty results.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.text import letter_shares
from rasterloom.operators import partition, prototypes, scene
from rasterloom.session import get_session, materialise

log = logging.getLogger("jobs.text_regions")

REGIONS = "doc_id long, source string, distance double, region string"
AGREEMENT = "n long, k_true long, k_pred long, entropy_true double, entropy_pred double, ari double, nmi double, homogeneity double, completeness double, v_measure double, reference string"
CLASSES = "t string, class_n long, fragments int, dominant_fraction double, normalized_entropy double, reference string"


def read_config(path: str | None = None) -> dict:
    return json.loads(Path(path or Path(__file__).with_suffix(".json")).read_text())


def assign_regions(documents: DataFrame, letters: str, regions: int) -> DataFrame:
    """(doc_id, source, distance, region) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), letter_shares(F.col("text").cast("string"), letters).alias("v"))
    scaled = materialise(scene.zscore(materialise(rows)))
    largest = scaled.where("source is not null").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(regions)
    modes = prototypes.mode_prototypes(scaled.join(F.broadcast(largest.select("source")), "source"), label="source", floored=False)  # `regions` rows
    return prototypes.nearest_prototype(scaled, modes, digits=6).select("doc_id", "source", "distance", F.col("mode").alias("region"))


def reference_cells(regions: DataFrame, documents: DataFrame, labels: DataFrame, references: list[str]) -> DataFrame:
    """(reference, t, p, n): the contingency tables of all references. A column is looked for in documents first."""
    own = [r for r in references if r in documents.columns]
    other = [r for r in references if r not in own]
    pairs = lambda names: F.explode(F.array(*(F.struct(F.lit(r).alias("reference"), F.col(r).cast("string").alias("t")) for r in names)))
    told = [table.select(F.col("doc_id").cast("long").alias("doc_id"), pairs(names).alias("_r")).select("doc_id", "_r.*").where("t is not null") for table, names in ((documents, own), (labels, other)) if names]
    joined = reduce(DataFrame.unionByName, told).join(regions.select("doc_id", F.col("region").alias("p")), "doc_id")
    return joined.groupBy("reference", "t", "p").agg(F.count("*").alias("n"))


def run(spark: SparkSession, documents: str, labels: str, out: str, config: dict | None = None) -> DataFrame:
    """Do the job; returns what stands in `out` (see read_back)."""
    config = config or read_config()
    table, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    log.info("read %s and %s", documents, labels)
    assign_regions(table, config["letters"], config["regions"]).write.mode("overwrite").partitionBy("region").parquet(f"{out}/regions")
    regions = spark.read.schema(REGIONS).parquet(f"{out}/regions")
    log.info("wrote %s/regions: %d documents", out, regions.count())
    cells = materialise(reference_cells(regions, table, marks, config["references"]))
    writer = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("reference")
    writer(partition.agreement(cells, "reference")).parquet(f"{out}/agreement")
    per_class = reduce(DataFrame.unionByName, (partition.fragmentation(cells.where(F.col("reference") == r)).withColumn("reference", F.lit(r)) for r in config["references"]))
    writer(per_class.withColumn("fragments", F.col("fragments").cast("int"))).parquet(f"{out}/classes")
    log.info("wrote %s/agreement and %s/classes for %s", out, out, ", ".join(config["references"]))
    return read_back(spark, out)


def read_back(spark: SparkSession, out: str) -> DataFrame:
    """All that stands in `out` as (part, name, item, value): documents' distances by region, metrics by reference, shares of dominant regions by reference."""
    regions, agreement, classes = (spark.read.schema(s).parquet(f"{out}/{p}") for p, s in (("regions", REGIONS), ("agreement", AGREEMENT), ("classes", CLASSES)))
    metrics = F.explode(F.array(*(F.struct(F.lit(m).alias("item"), F.col(m).cast("double").alias("value")) for m in partition.AGREEMENT)))
    shares = F.explode(F.array(*(F.struct(F.concat_ws("/", "t", F.lit(m)).alias("item"), F.col(m).cast("double").alias("value")) for m in ("class_n", "fragments", "dominant_fraction", "normalized_entropy"))))
    return (
        regions.select(F.lit("region").alias("part"), F.col("region").alias("name"), F.col("doc_id").cast("string").alias("item"), F.col("distance").alias("value"))
        .unionByName(agreement.select(F.lit("agreement").alias("part"), F.col("reference").alias("name"), metrics.alias("_m")).select("part", "name", "_m.*"))
        .unionByName(classes.select(F.lit("class").alias("part"), F.col("reference").alias("name"), shares.alias("_m")).select("part", "name", "_m.*"))
    )


def main() -> None:
    parser = argparse.ArgumentParser(prog="jobs.text_regions")
    for name in ("documents", "labels", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = get_session("text_regions")
    try:
        run(spark, args.documents, args.labels, args.out, read_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
