"""Vectorised text primitives shared by the operators: Arrow batches in, numpy arrays out.

Words are maximal runs outside ASCII white space (0x20, 0x09-0x0D) and are compared after lower-casing A-Z.
A word is represented by 64 bits. A word of up to eight bytes has a number of its own; longer ones are hashed, eight bytes
at a time through a full-avalanche mix, and those over LANES lanes by keyed BLAKE2b. With a key that is drawn for each
run, nobody can prepare different words with one number. Temporaries are bounded by SEGMENT bytes, or a few times the
longest word, however long a text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SEGMENT = 1 << 20
#: Of a batch so many rows are worked on at a time, so that their copies stay small beside the batch.
SLICE = 1000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257).astype(np.uint8)  # no byte of UTF-8 is 255, so that 0 can mean "no byte"
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more lanes of eight bytes go to BLAKE2b.
LANES = 16


def crc_mod(column: Column, modulus: int) -> Column:
    """crc32 of the id's text form, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def unused_name(name: str, df: DataFrame) -> str:
    """name, with underscores before it until no column of df is called so (in whichever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucket_count(df: DataFrame, mb: int = 16) -> int:
    """Into how many groups what is gathered from df by hash goes: as many as keep a group's share of the tables read, by the optimiser's sizes, under `mb` MB, and twice the shuffle partitions at least."""
    least = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(least, min(sum(x for x in sizes if x < 1 << 60) // (mb << 20), 1 << 20))  # an unknown size is given as the largest long


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets (one more than rows); nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(data)
    while at < n:
        end = min(at + SEGMENT, n)
        while end < n and not _SPACE[data[end]]:  # never cut a word in two
            k = np.searchsorted(offsets, end)
            if k < len(offsets) and offsets[k] == end:
                break
            step = np.flatnonzero(_SPACE[data[end : end + SEGMENT]])
            end = min(n, end + (int(step[0]) if len(step) else SEGMENT))
        yield at, end
        at = end


def _codes(piece: np.ndarray, start: np.ndarray, size: np.ndarray, key: int) -> np.ndarray:
    """64 bits for each word of piece, the same for the same bytes after lower-casing."""
    raw = np.zeros(len(piece) + 8, np.uint8)
    raw[:-8] = _LOWER[piece]
    eight = np.ndarray(len(piece) + 1, "<u8", raw, strides=(1,))  # the eight bytes from each place on
    seed = mix64(np.array([key & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    code = mix64((eight[start] & _FIRST[np.minimum(size, 8)]) ^ seed)
    long = np.flatnonzero(size > 8)
    giant = long[size[long] > 8 * LANES]
    k = 8
    while len(long) and k < 8 * LANES:
        code[long] = mix64(code[long] * np.uint64(0x9E3779B97F4A7C15) + (eight[start[long] + k] & _FIRST[np.minimum(size[long] - k, 8)]))
        k += 8
        long = long[size[long] > k]
    for i in giant.tolist():
        made = hashlib.blake2b(raw[start[i] : start[i] + size[i]], digest_size=8, key=seed.tobytes())
        code[i] = int.from_bytes(made.digest(), "little")
    return code


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE, key: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, row, start, end) of every word in order; start and end are byte positions in data.

    space: for each byte, whether it parts words; at least the ASCII white space does. key: codes under different keys differ.
    """
    parts: list[tuple[np.ndarray, ...]] = []
    bounds = offsets[:-1][offsets[1:] > offsets[:-1]]
    for at, end in _segments(data, offsets):
        piece = data[at:end]
        inside = ~space[piece]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        cuts = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)] - at
        before[cuts] = False
        start = np.flatnonzero(inside & ~before)
        if not len(start):
            continue
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[cuts[cuts > 0] - 1] = False
        stop = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(offsets, start + at, "right") - 1
        parts.append((_codes(piece, start, stop - start, key), row, start + at, stop + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words each row has."""
    total = np.zeros(len(offsets) - 1, np.int64)
    for at in range(0, len(data), SEGMENT):
        inside = ~_SPACE[data[at : at + SEGMENT]]
        before = np.empty_like(inside)
        before[0] = at > 0 and not _SPACE[data[at - 1]]
        before[1:] = inside[:-1]
        lo, hi = np.searchsorted(offsets, [at, at + SEGMENT])
        cuts = offsets[lo:hi] - at
        before[cuts[cuts < len(before)]] = False
        row = np.searchsorted(offsets, np.flatnonzero(inside & ~before) + at, "right") - 1
        if len(row):
            total[row[0] : row[-1] + 1] += np.bincount(row - row[0])
    return total


def row_bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin in the arrays of words(), one more than rows."""
    return np.searchsorted(row, np.arange(rows + 1))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, list | np.ndarray | pa.Array]], fields: str, keep: list[str] | None = None, drop_if_false: str | None = None
) -> DataFrame:
    """Append fn's columns to the rows of df, SLICE rows of an Arrow batch at a time.

    keep: the input columns that stay (default all); one whose name clashes with a new field gives way to it.
    drop_if_false: name of a boolean that fn returns besides fields; rows where it is false go.
    """
    out = T._parse_datatype_string(fields) if fields else T.StructType([])
    stay = [f for f in df.schema.fields if f.name not in out.fieldNames() and (keep is None or f.name in keep)]
    schema = T.StructType([*stay, *out.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in stay]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                got = fn(batch)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names] + [got[f.name] for f in out.fields]
                table = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == t.type else pa.array(c.to_pylist() if isinstance(c, pa.Array) else c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)
                yield table.filter(pa.array(got[drop_if_false])) if drop_if_false else table

    return df.mapInArrow(run, schema)
