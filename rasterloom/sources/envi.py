"""Raster scenes in ENVI files (a text header and a raw cube) through Spark's Python data source API."""

from __future__ import annotations

import io
import os
import re
from collections.abc import Iterator
from itertools import permutations
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Numpy types of the format's data type codes.
TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2"}


def parse_header(text: str) -> dict[str, str]:
    """Lower-cased keys; a value in braces may span lines and loses them."""
    out: dict[str, str] = {}
    lines = iter(text.splitlines())
    for line in lines:
        key, sep, value = line.partition("=")
        if not sep:
            continue
        value = value.strip()
        while value.startswith("{") and "}" not in value:
            more = next(lines, None)
            if more is None:
                break
            value += " " + more.strip()
        out[key.strip().lower()] = value.strip("{}").strip()
    return out


def read_header(spark: SparkSession, path: str) -> dict[str, str]:
    row = spark.read.text(path, wholetext=True).first()
    return parse_header(row["value"] if row else "")


def align_axes(shape: tuple[int, ...], raster: tuple[int, int]) -> tuple[int, int, int]:
    """The order of axes that turns a cube of this shape into (height, width, bands); an error unless there is just one."""
    found = {p for p in permutations(range(3)) if (shape[p[0]], shape[p[1]]) == tuple(raster)}
    if len(found) != 1:
        raise ValueError("no order of axes fits the raster" if not found else "more than one order of axes fits the raster")
    return found.pop()


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, h = options["path"], options
        self.lines, self.samples, self.bands = int(h["lines"]), int(h["samples"]), int(h["bands"])
        self.kind = np.dtype((">" if h.get("byte order", "0") == "1" else "<") + TYPES[int(h["data type"])])
        self.offset, self.interleave = int(h.get("header offset", "0")), h.get("interleave", "bsq").lower()
        self.block = int(h.get("rows", "64"))
        if self.interleave != "bsq":
            raise ValueError("only band-sequential cubes are read")

    def partitions(self) -> list[InputPartition]:
        return [_Rows(a, min(a + self.block, self.lines)) for a in range(0, self.lines, self.block)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            yield self.block_of(f, partition)

    def block_of(self, f: BinaryIO, partition: _Rows) -> pa.RecordBatch:
        a, b = partition.first, partition.last
        n = (b - a) * self.samples
        v = np.empty((n, self.bands), np.float32)
        for band in range(self.bands):
            f.seek(self.offset + (band * self.lines + a) * self.samples * self.kind.itemsize, os.SEEK_SET)
            v[:, band] = np.frombuffer(f.read(n * self.kind.itemsize), self.kind)
        i = np.arange(a * self.samples, b * self.samples)
        flat = pa.array(v.ravel())
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.bands + 1, self.bands), pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(i // self.samples), pa.array(i % self.samples), cells], ["i", "y", "x", "v"])


class EnviCube(DataSource):
    """S3: format `envi_bsq`; options are the header's entries, `path` and `rows` (raster rows a partition). Bytes after the cube are ignored."""

    @classmethod
    def name(cls) -> str:
        return "envi_bsq"

    def schema(self) -> str:
        return "i bigint, y bigint, x bigint, v array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def load_cube(spark: SparkSession, header: str, cube: str, rows: int = 64) -> DataFrame:
    """S3: (i, y, x, v) of a cube: blocks of raster rows where the executors can open its path, else (a path with a scheme, say hdfs://) through Spark's binary reader as one value, up to 2 GB."""
    if re.match(r"(?!file:)[a-z][a-z0-9+.-]*://", cube):
        facts = read_header(spark, header)

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column(0):
                    reader = _Reader(facts | {"path": "", "rows": str(rows)})
                    for part in reader.partitions():
                        yield reader.block_of(io.BytesIO(value.as_buffer()), part)

        return spark.read.format("binaryFile").load(cube).select("content").mapInArrow(unpack, EnviCube({}).schema())
    cube = re.sub("^file:(//)?(?=/)", "", cube)
    spark.dataSource.register(EnviCube)
    reader = spark.read.format("envi_bsq").option("rows", str(rows))
    for key, value in read_header(spark, header).items():
        if key in ("lines", "samples", "bands", "data type", "header offset", "interleave", "byte order"):
            reader = reader.option(key, value)
    return reader.load(cube)
