"""op11 against plain loops over Python integers, op12 against the tokenizer library and an exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rasterloom.llm import byte_bpe, vector_codes


def plain_codes(rows, entries=64, parts=16, rounds=2):
    """(codes by row, error by row, label errors, codebooks) of [(id, vector, label)], all rows sound."""
    ints = [[int(np.floor(256 * float(x))) for x in v] for _, v, _ in rows]
    width = max(map(len, ints))
    width += -width % parts
    ints = [v + [0] * (width - len(v)) for v in ints]
    own = width // parts
    cut = lambda v, p: v[p * own : (p + 1) * own]
    first = sorted((rows[k][0], ints[k]) for k in range(len(rows)) if rows[k][0] is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: [min((far(cut(v, p), c), k) for k, c in enumerate(books[p])) for p in range(parts)]
    for _ in range(rounds):
        found = [near(v) for v in ints]
        new = []
        for p in range(parts):
            of = {}
            for v, f in zip(ints, found, strict=True):
                of.setdefault(f[p][1], []).append(cut(v, p))
            new.append([[sum(x) // len(of[k]) for x in zip(*of[k], strict=True)] if k in of else c for k, c in enumerate(books[p])])
        books = new
    found = [near(v) for v in ints]
    error = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        by[label] = by.get(label, 0) + e
    return ["".join(f"{k:02x}" for _, k in f) for f in found], error, by, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


@pytest.mark.parametrize(("n", "width", "entries"), [(300, 32, 64), (40, 16, 64), (90, 21, 64)])
def test_codes(spark, tmp_path, n, width, entries):
    draw = np.random.default_rng(n)
    base = draw.standard_normal((12, width))
    rows = [(int(i), (base[i % 12] + draw.standard_normal(width) * 0.1).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 3)) for i in draw.permutation(n)]
    rows += [rows[0], rows[1], (None, rows[2][1], 5), (2 * n, rows[3][1][: width // 2], None)]  # repeated rows, no id, a shorter vector
    odd = [(-1, None, 0), (-2, [None] * width, 0), (-3, [float("nan")] + [0.0] * (width - 1), 0), (-4, [float("inf")] * width, 1), (-5, [1e30] * width, 1)]
    spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, label int, codes string, salt int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    code, error, by, sha = plain_codes(rows, entries)
    want = sorted((str(r[0]), c, e, by[r[2]], sha) for r, c, e in zip(rows, code, error, strict=True))
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_codes_ties_and_unused():
    books = np.array([[[0], [2], [2], [9]]])
    near, error = vector_codes.assign(np.array([[[1]], [[2]], [[3]], [[-5]]]), books)
    assert near.ravel().tolist() == [0, 1, 1, 0] and error.ravel().tolist() == [1, 0, 1, 25]


def test_codes_exact():
    """Distances that doubles can't tell apart."""
    big = 1 << 27
    near, error = vector_codes.assign(np.array([[[big, 1]]]), np.array([[[-big + 1, 0], [-big + 1, 1]]]))
    assert near.ravel().tolist() == [1] and error.ravel().tolist() == [(2 * big - 1) ** 2]


def test_codes_general(spark):
    """Other numbers of parts, entries and rounds, and kept columns."""
    rows = [(i, [float(i % 5), float(i % 3), 0.5, 1.0], "a" * (i % 2)) for i in range(50)]
    coded, books = vector_codes.encode(spark.createDataFrame(rows, "k long, v array<double>, note string"), key="k", vector="v", keep=("note",), parts=2, entries=4, rounds=1)
    code, error, _, sha = plain_codes([(i, v, None) for i, v, _ in rows], 4, 2, 1)
    got = {r["id"]: ("".join(f"{c:02x}" for c in r["codes"]), r["error"], r["note"]) for r in coded.collect()}
    assert got == {r[0]: (c, e, r[2]) for r, c, e in zip(rows, code, error, strict=True)}
    assert vector_codes.digest(books) == sha and books.shape == (2, 4, 2)


PATH = public_tokenizers.path(byte_bpe.RANKS)
POOL = "aeiost nTHé ßж中文字　\n\t\r\x1c\x85\xa0 '!?.,#1234٣Ⅷ\U0001f600‍🏽_-ſK𝟘"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(PATH), special_tokens={})


def made_texts(n, seed=0):
    draw = random.Random(seed)
    return ["".join(draw.choice(POOL) for _ in range(draw.randint(0, 300))) for _ in range(n)]


def test_merge(library):
    """Each match by the tree alone, tokens of the vocabulary too."""
    own = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    draw = random.Random(5)
    matches = {m for t in made_texts(200) for m in own.pattern.findall(t)} | {"".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 90))) for _ in range(500)}
    for match in matches:
        piece = match.encode()
        if len(piece) > 1:
            assert byte_bpe.merge(piece, own.ranks, own.pairs) == library.encode_ordinary(match) if own.pattern.findall(match) == [match] else True
    assert all(byte_bpe.merge(t, own.ranks, own.pairs) == [r] for t, r in list(own.ranks.items())[::97] if len(t) > 1)


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 100_000 + "a", "é" * 70_000, "!a\n" * 150_000, ("ab " * 30_000 + "\n\n  c") * 2, "　" * 70_000 + "1" * 70_000, "-=" * 70_000 + " " * 3])
def test_long_texts(library, text):
    own = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    assert list(own.ids(text)) == library.encode_ordinary(text)


def test_small_tables(library, monkeypatch):
    """Segments, lists and the table of known matches end everywhere."""
    monkeypatch.setattr(byte_bpe, "SEGMENT", 3)
    monkeypatch.setattr(byte_bpe, "LISTED", 2)
    monkeypatch.setattr(byte_bpe, "KEPT", 4)
    monkeypatch.setattr(byte_bpe, "_LONG", 5)
    own = byte_bpe.Encoder(byte_bpe.load(PATH), public_tokenizers.PATTERN)
    for text in made_texts(300, 1):
        assert list(own.ids(text)) == library.encode_ordinary(text)


def test_every_character(library):
    own = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)
    for at in range(0, 0x110000, 97):
        chars = [chr(c) for c in range(at, min(at + 97, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}a1{c}1 {c}! {c}" for c in chars[:: 1 if at < 0x3000 else 12])
        assert list(own.ids(text)) == library.encode_ordinary(text)


def test_bpe_query(spark, tmp_path, library):
    texts = [*made_texts(120, 2), None, "", "<|endoftext|> don't", "x" * 50_000]
    rows = [(i if i % 9 else None, t, "old", "z") for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, ids string, decoded string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = byte_bpe.op12_byte_bpe(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in [*rows, rows[1]]:
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_bpe_operators(spark, library):
    """The ids themselves, bytes that are no UTF-8, another vocabulary, small batches out."""
    bad = spark.createDataFrame([(1, b"ab\xff cd"), (2, "Grüße".encode())], "k long, raw binary").select("k", F.col("raw").cast("string").alias("t"))
    got = {r.k: r for r in byte_bpe.decode(byte_bpe.encode(bad, key="k", text="t")).collect()}
    assert got[1].ids == library.encode_ordinary("ab� cd") and bytes(got[1].decoded) == "ab� cd".encode()
    assert bytes(got[2].decoded).decode() == "Grüße"
    multi = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(multi), special_tokens={})
    texts = [(i, t) for i, t in enumerate(made_texts(60, 4))]
    rows = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(texts, "k long, t string"), path=multi, key="k", text="t"), path=multi).collect()
    assert {r.k: (r.ids, bytes(r.decoded)) for r in rows} == {i: (other.encode_ordinary(t), t.encode()) for i, t in texts}
