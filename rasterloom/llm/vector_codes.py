"""Product codes of vectors in exact integer arithmetic.

Each component x becomes the integer floor(256 * x); vectors are cut into PARTS equal consecutive parts, and each part
position has a codebook that starts as that part of the first vectors by id. A round assigns every part to the nearest
entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floored mean of its parts; an
unused entry stays. After the rounds, parts are assigned once more.

The codebooks (`entries` vectors, so bounded by the vectors' length alone) are broadcast as integers. An Arrow batch takes
all distances at once as |x|^2 - 2 x.c + |c|^2 by int64 matrix products, and the first least one. A task sums its parts by
entry, and one shuffle adds the tasks' sums; the driver gets one row for each component of each entry.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped; so are those with a
component too large for exact distances in 64 bits (from 2^19 in absolute value on for vectors of 33 to 128 components; the
error of such a row could not be told in a long). Vectors that are shorter than the longest, or whose length isn't a
multiple of PARTS, count as filled up with zeros; an empty vector is all zeros. Rows sharing an id are vectors of their
own. Rows without an id get codes, but are no first entries; equal ids are put in the order of their integers there. With
fewer than `entries` rows the codebooks have as many entries as there are rows with ids; with no such row, or an empty
table, the result is empty. Null labels count as one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.session import materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows of a batch whose distances are held at once.
ROWS = 2048
#: Rows of one label are dealt into so many groups before they are summed and joined.
SALTS = 32


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x), a row for each vector, filled up with zeros to width."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for x of shape (rows, parts, width) and books of (parts, entries, width); int64 throughout."""
    rows = x.transpose(1, 0, 2)
    far = (rows * rows).sum(2)[:, :, None] - 2 * np.matmul(rows, books.transpose(0, 2, 1)) + (books * books).sum(2)[:, None, :]
    near = far.argmin(2)
    return near.T, np.take_along_axis(far, near[:, :, None], 2)[:, :, 0].T


def _slices(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            piece = batch.slice(at, ROWS)
            yield piece, integers(piece.column("e"), width).reshape(piece.num_rows, parts, -1)


def _sums(rows: DataFrame, books: Broadcast, parts: int, width: int) -> DataFrame:
    """(place, n, total): place numbers part, entry and position of the entries that have parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        entries, own = book.shape[1:]
        count, total = np.zeros(parts * entries, np.int64), np.zeros(parts * entries * own, np.int64)
        for _, x in _slices(batches, parts, width):
            slot = assign(x, book)[0] + np.arange(parts) * entries
            count += np.bincount(slot.ravel(), minlength=len(count))
            np.add.at(total, (slot[:, :, None] * own + np.arange(own)).ravel(), x.ravel())
        n = np.repeat(count, own)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used])], ["place", "n", "total"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.select("e").mapInArrow(run, "place long, n long, total long").groupBy("place").agg(F.sum("n").alias("n"), wide("total").alias("total"))


def _sound(e: Column, most: float) -> Column:
    return e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))


def encode(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, codes array<int>, error long, kept columns) and the final codebooks (parts, entries, width). keep: names other than these three."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("e"), *keep)
    longest = rows.where(_sound(F.col("e"), float("inf"))).agg(F.max(F.size("e")).alias("d")).first()["d"] or 0
    width = max(parts, -(-longest // parts) * parts)
    rows = rows.where(_sound(F.col("e"), 2.0 ** ((61 - (width - 1).bit_length()) // 2) / SCALE))
    whole = F.transform("e", lambda x: F.floor(x.cast("double") * SCALE))
    first = rows.where("id is not null").select("id", whole.alias("e")).orderBy("id", "e").limit(entries).collect()
    book = np.zeros((len(first), width), np.int64)
    for k, r in enumerate(first):
        book[k, : len(r["e"])] = r["e"]
    book = np.ascontiguousarray(book.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    fields = ", ".join([f"id {kinds['id'].simpleString()}", "codes array<int>", "error long", *(f"`{c}` {kinds[c].simpleString()}" for c in keep)])
    if not first:
        return spark.createDataFrame([], fields), book
    for _ in range(rounds):
        for r in _sums(rows, spark.sparkContext.broadcast(book), parts, width).collect():  # entries x components
            book.reshape(-1)[r["place"]] = int(r["total"]) // r["n"]
        book = book.copy()
    books = spark.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, parts, width):
            near, error = assign(x, books.value)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * parts, pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), codes, pa.array(error.sum(1)), *(batch.column(c) for c in keep)], ["id", "codes", "error", *keep])

    return rows.mapInArrow(run, fields), book


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of error over rows of an equal label. A label's rows are dealt into SALTS groups, so that none is gathered in one task."""
    salted = coded.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    some = salted.groupBy("label", "salt").agg(F.sum("error").alias("some"))
    sums = some.select(F.col("label").alias("of"), F.col("salt").alias("group"), F.sum("some").over(Window.partitionBy("label")).alias("label_error"))
    return salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("group"))).drop("salt", "of", "group")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    coded, books = encode(table.select("vec_id", "embedding", "label"), keep=("label",))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = label_errors(materialise(coded.select("id", code.alias("code"), "error", "label")))
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
