"""Contingency counts kept up over a stream of rows (Structured Streaming)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def streaming_contingency(stream: DataFrame, true: Column, pred: Column, time: str | None = None, delay: str = "10 minutes", window: str | None = None) -> DataFrame:
    """(t, p, n) so far; with a time column and window, counts of each window, whose state ends `delay` after it."""
    rows = stream.select(true.alias("t"), pred.alias("p"), *([F.col(time).alias("at")] if time else []))
    if time and window:
        return rows.withWatermark("at", delay).groupBy(F.window("at", window), "t", "p").agg(F.count("*").alias("n"))
    return rows.groupBy("t", "p").agg(F.count("*").alias("n"))


def file_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of the Parquet files of a table: a folder that grows, or a single file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).options(**options)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())  # a stream watches folders


def contingency_of_files(spark: SparkSession, path: str, true: Column, pred: Column) -> DataFrame:
    """The counts after all files at the path have gone through the stream once."""
    stream = file_stream(spark, path)
    name = f"contingency_{uuid.uuid4().hex}"
    running = streaming_contingency(stream, true, pred).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)
