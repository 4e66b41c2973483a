"""Best-fit packing of documents into training sequences of several permitted lengths.

Lengths are words plus one end mark (or a given column of token counts). A document longer than the largest capacity
is cut into pieces. Each partition packs its own pieces, longest first: a piece goes into the open bin whose gap it
leaves smallest; if none holds it, a bin of the permitted size with the least expected cost for each token is opened,
given the pieces still to come; at the end each bin shrinks to the smallest permitted size that holds its contents.
There is no shuffle: hot sources or keys don't matter, and a partition wastes at most its last few bins.

Defined cases: an empty or null text is one piece of the end mark alone. Repeated rows are packed as often as they
occur. Ties keep the order of rows. An empty table packs into nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.llm.textops import column_bytes, count_words

CAPACITIES = (512, 1024, 2048, 4096)


def step_cost(capacity: int) -> float:
    """Work for a sequence: linear in its length, plus attention's square, plus a fixed part."""
    return 64.0 + capacity * (1.0 + capacity / 16384.0)


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = step_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset of each piece in its bin, capacity of each bin). No length exceeds max(capacities)."""
    sizes = sorted(capacities)
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable").tolist()
    left = int(lengths.sum())
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    size: list[int] = []
    gaps: list[int] = []  # distinct gaps of open bins, ascending
    open_at: dict[int, list[int]] = {}
    for piece in order:
        n = int(lengths[piece])
        left -= n
        k = bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps[k]
            own = open_at[gap]
            b = own.pop()
            if not own:
                del gaps[k], open_at[gap]
        else:
            b = len(used)
            used.append(0)
            size.append(min((c for c in sizes if c >= n), key=lambda c: (cost(c) / (n + min(c - n, left)), c)))
        bin_of[piece], offset[piece] = b, used[b]
        used[b] += n
        gap = size[b] - used[b]
        if gap:
            if gap not in open_at:
                insort(gaps, gap)
            open_at.setdefault(gap, []).append(b)
    final = np.asarray(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return bin_of, offset, final


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, *, text: str = "text", key: str = "doc_id", length: str | None = None, cost: Callable[[int], float] = step_cost) -> DataFrame:
    """A row for each piece: key, piece (0, 1, ...), start (tokens into the document), n_tokens, bin_id, bin_offset, bin_capacity and row,
    a number that all pieces of one row of docs share and no other, so that rows with one key can be told apart.

    length: a column of token counts, the end mark included; by default words are counted in the whole text.
    """
    top = max(capacities)
    columns = [key, length or text]
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(n, T.LongType()) for n in ("piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_capacity", "row"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = [], []
        for batch in batches:
            keys.append(pc.take(batch.column(0), pa.array(np.arange(batch.num_rows))))  # a copy: the column itself would keep the batch's texts in memory
            sizes.append(np.maximum(1, batch.column(1).fill_null(1).to_numpy(zero_copy_only=False).astype(np.int64)) if length else count_words(*column_bytes(batch.column(1))) + 1)
        if not keys:
            return
        total = np.concatenate(sizes)
        pieces = -(-total // top)
        row = np.repeat(np.arange(len(total)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * top
        n = np.minimum(top, total[row] - start)
        bin_of, offset, size = best_fit(n, capacities, cost)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 33
        ids = pa.chunked_array(keys).combine_chunks().take(pa.array(row))
        for at in range(0, len(row), 20_000):
            cut = slice(at, at + 20_000)
            yield pa.RecordBatch.from_arrays([ids[cut].cast(arrow.field(0).type), *(pa.array(x[cut]) for x in (piece, start, n, bin_of + first, offset, size[bin_of] if len(size) else bin_of, row + first))], schema=arrow)

    return docs.select(*columns).mapInArrow(run, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
