"""Numeric arrays of MATLAB level 5 files (the published MAT-file format), without further libraries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rasterloom.sources.envi import align_axes

# Numpy types of the format's data types, and the numeric array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED = 14, 15


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, content) of the data elements in a row; a small one has its content within its tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size
            if kind != COMPRESSED:
                at += -size % 8


def read_arrays(content: bytes) -> dict[str, np.ndarray]:
    """The real numeric arrays of a file by name. Other contents (cells, structures, sparse or complex arrays) are left out."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB level 5 file")
    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(memoryview(content)[128:], order):
        if kind == COMPRESSED:
            kind, body = next(_elements(memoryview(zlib.decompress(body)), order))
        if kind != MATRIX:
            continue
        parts = list(_elements(body, order))
        flags = struct.unpack_from(order + "I", parts[0][1])[0]
        if flags & 0xFF not in CLASSES or flags & 0x0800 or len(parts) < 4:
            continue
        shape = np.frombuffer(parts[1][1], order + "i4")
        values = np.frombuffer(parts[3][1], order + TYPES[parts[3][0]])
        out[bytes(parts[2][1]).decode("ascii")] = values.astype(CLASSES[flags & 0xFF]).reshape(shape, order="F")
    return out


def choose_array(arrays: dict[str, np.ndarray], key: str | None, ndim: int) -> np.ndarray:
    """The array of that name, or the only one with that many dimensions."""
    if key is not None:
        if key not in arrays:
            raise ValueError(f"no array is named {key}")
        return arrays[key]
    some = [a for a in arrays.values() if a.ndim == ndim]
    if len(some) != 1:
        raise ValueError(f"expected one array with {ndim} dimensions, found {len(some)}")
    return some[0]


def load_matlab(spark: SparkSession, cube: str, key: str | None = None, truth: str | None = None, truth_key: str | None = None, shape: tuple[int, int] | None = None, bytes_a_task: int = 32 << 20) -> DataFrame:
    """(i, y, x, v[, gt]) of a cube, and of its reference labels if their file is given. Files come through Spark's readers, so any store will do.

    The axes are put in the order (height, width, bands): as they are if the first two are `shape`, else by the one order
    that fits the shape or the reference labels. The file is one value, read by the driver; its rows are then dealt out.
    """
    read = lambda path: read_arrays(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))
    values = choose_array(read(cube), key, 3)
    labels = None if truth is None else choose_array(read(truth), truth_key, 2)
    raster = shape or (labels.shape if labels is not None else values.shape[:2])
    if shape is None or values.shape[:2] != tuple(shape):
        if labels is not None or shape is not None:
            values = np.transpose(values, align_axes(values.shape, tuple(raster)))
    height, width, bands = values.shape
    rows = max(1, bytes_a_task // max(1, width * bands * 4))
    blocks = [(a, min(a + rows, height)) for a in range(0, height, rows)]
    schema = "i bigint, y bigint, x bigint, v array<float>" + (", gt int" if labels is not None else "")
    parts = []
    for a, b in blocks:
        n = (b - a) * width
        i = np.arange(a * width, b * width)
        v = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(np.ascontiguousarray(values[a:b], np.float32).ravel()))
        columns = [pa.array(i), pa.array(i // width), pa.array(i % width), v]
        if labels is not None:
            columns.append(pa.array(labels[a:b].astype(np.int32).ravel()))
        parts.append(pa.RecordBatch.from_arrays(columns, schema.replace(" bigint", "").replace(" array<float>", "").replace(" int", "").split(", ")))
    return spark.createDataFrame(pa.Table.from_batches(parts))
