"""Byte-level BPE by a rank file: texts to token ids and back.

A text is cut by the tokenizer's pattern; each match is encoded for itself. A match that is a token of the vocabulary
becomes that token. Otherwise a segment tree over the match's byte positions holds, for each live token's first byte, the
rank of the token that it makes with its right neighbour; the root names the least rank, the leftmost of equal ones. A
merge unlinks the right token and sets three leaves (the merged token, the unlinked one, the left neighbour), each in a
logarithmic number of steps. So a match of n bytes takes n log n steps, also one of millions.

Texts are read in segments that end where a white space follows another character, which always parts two matches, so
that what is held at once is bounded by the longest match besides the ids. The vocabulary is read from `path` once in each
worker; nothing is shuffled. Ids of short matches are kept in a table of bounded size.

Defined cases: a null or empty text has no ids and decodes into no bytes. Bytes that are no UTF-8 are replaced by U+FFFD
before encoding. Special tokens are ordinary text. Ids that the vocabulary lacks, or null ids, fail in decode(). Rows are
kept as they come, repeated ones too; null keys stay null.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "byte_bpe_50k.tiktoken"
#: Characters read at once, matches listed at once, bytes of a match that is kept with its ids, matches kept in each of two generations, ids given back at once.
SEGMENT, LISTED, SHORT, KEPT, GIVEN = 1 << 16, 1 << 16, 64, 1 << 18, 1 << 20
#: Above all ranks; and the bytes from which on a match's tree is kept in packed arrays.
_NO_RANK, _LONG = 1 << 24, 1 << 16


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one match of two bytes or more: the pair of least rank, the leftmost of equal ones, is merged until no pair has a rank.

    pairs: the rank of each pair of bytes, at 256 times the first plus the second. A leaf holds rank * size + position.
    """
    n = len(piece)
    bits = (n - 1).bit_length()
    size = 1 << bits
    none, low = _NO_RANK << bits, size - 1
    pack = (lambda x: array("q", x)) if n >= _LONG else list
    tree = pack([none]) * (2 * size)
    tree[size : size + n - 1] = pack([pairs[a << 8 | b] << bits | i for i, (a, b) in enumerate(zip(piece, piece[1:]))])  # noqa: B905
    for k in range(low, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before, rank = pack(range(1, n + 2)), pack(range(-1, n)), ranks.get
    while tree[1] < none:
        i = tree[1] & low
        gone = after[i]
        end = after[i] = after[gone]
        before[end] = i
        left = before[i]
        leaves = [(gone, none), (i, rank(piece[i : after[end]], _NO_RANK) << bits | i if end < n else none)]
        if left >= 0:
            leaves.append((left, rank(piece[left:end], _NO_RANK) << bits | left))
        for leaf, value in leaves:
            k = size + leaf
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Ids by match; ids() of a text. Short matches are kept with their ids; when KEPT are new, those of before go."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks, self.older = ranks, {}
        self.pairs = [ranks.get(bytes((a, b)), _NO_RANK) for a in range(256) for b in range(256)]
        self.pattern, self.gap = regex.compile(pattern), regex.compile(r"(?<=\S)\s")

    def __missing__(self, match: str) -> tuple[int, ...]:
        made = self.older.get(match)
        piece = b""
        if made is None:
            piece = match.encode()
            known = self.ranks.get(piece)
            made = (known,) if known is not None else tuple(merge(piece, self.ranks, self.pairs))
        if len(piece) <= SHORT:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[match] = made
        return made

    def _matches(self, text: str) -> Iterator[list[str]]:
        at = 0
        while at < len(text):
            cut = self.gap.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
            end = cut.start() if cut else len(text)
            segment = text[at:end]
            if len(segment) <= 4 * SEGMENT:
                yield self.pattern.findall(segment)
            else:
                found = self.pattern.finditer(segment)
                while some := [m.group() for m in islice(found, LISTED)]:
                    yield some
            at = end

    def ids(self, text: str) -> array:
        out = array("i")
        for matches in self._matches(text):
            out.extend(chain.from_iterable(map(self.__getitem__, matches)))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load(path), pattern)


@lru_cache(maxsize=2)
def tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load(path).items()}


def encode(docs: DataFrame, *, path: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row. path: a rank file that every worker can open."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            names, size, ids, at = batch.column(0), [0], array("i"), 0
            for k, raw in enumerate(batch.column(1), 1):
                ids.extend(own.ids((raw.as_py() or b"").decode("utf-8", "replace")))
                size.append(len(ids))
                if len(ids) >= GIVEN or k == batch.num_rows:
                    lists = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
                    yield pa.RecordBatch.from_arrays([names.slice(at, k - at), lists], [key, "ids"])
                    size, ids, at = [0], array("i"), k

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(key, F.col(text).cast("binary")).mapInArrow(run, schema)


def decode(rows: DataFrame, *, path: str | None = None, ids: str = "ids") -> DataFrame:
    """rows with `decoded`, the bytes that the ids stand for; a column of that name gives way."""
    path = path or public_tokenizers.path(RANKS)
    stay = [f for f in rows.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(path)
        for batch in batches:
            made = [b"".join(map(known.__getitem__, row.values.to_numpy().tolist())) if row.is_valid else b"" for row in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"])

    return rows.select(*(f.name for f in stay)).mapInArrow(run, T.StructType([*stay, T.StructField("decoded", T.BinaryType())]))


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
