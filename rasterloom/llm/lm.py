"""Language-model scores by a class-factored log-bilinear model.

Tokens are words and one end mark a text. The most frequent training tokens are classes of their own, HEADS for each
doubling of the vocabulary; every other token belongs to one of TAILS classes by its first and last letters. A log-bilinear neural model predicts the class from
the classes of the last CONTEXT tokens; within a tail class a token has its smoothed share of the class's training
tokens. It is trained in numpy by noise-contrastive estimation, in PASSES passes over all training tokens. These are
dealt in pieces to trainers of at least SHARE tokens each (one trainer if there are fewer), however the table is
partitioned, so that every trainer makes enough steps. A pass has ROUNDS rounds: each trainer learns from its share of
the round, and the weighted mean of the trainers' parameters and AdaGrad sums (a tree of FAN a node) starts the next
round. Scoring normalises over all classes, by batched matrix products over the distinct contexts of a block.

Counts cover all training documents: blocks of documents are coded once (distinct token hashes and indices into
them), each block's counts go by hash bucket to where they are summed, and the totals come back to the blocks that
hold the token, so no task or broadcast grows with the vocabulary.

Defined cases: a null or empty text is its end mark. Without training documents all counts are 0 and the base score
follows its formula. Repeated rows are scored (and learnt from) each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.textops import bucket_count, column_bytes, crc_mod, mix64, row_bounds, words
from rasterloom.session import materialise

HEADS, TAILS, CONTEXT, WIDTH = 41, 64, 2, 32
BLOCK = 1_500_000
PASSES, ROUNDS = 2, 4
#: So many sets of parameters are added up by one task.
FAN = 32
#: Tokens of a trainer at least; a piece has about a 64th.
SHARE = 1 << 22
SMOOTH = 0.1
END = np.uint64(0x9D7F3B5A1C2E4F61)


def code_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its tail class, tokens of each row), an end mark last in each row."""
    data, offsets = column_bytes(column)
    code, row, start, end = words(data, offsets)
    bounds = row_bounds(row, len(column))
    if len(code):
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) if len(data) else data
        size = end - start
        last = low[end - 1]
        before = np.where(size > 1, low[np.maximum(end - 2, 0)], np.uint64(0))
        letter = np.isin(last, [ord(c) for c in ".,;:!?"])  # punctuation tells less than the letters before it
        third = np.where(size > 2, low[np.maximum(end - 3, 0)], np.uint64(0))
        key = np.where(letter, before << np.uint64(8) | third, last << np.uint64(8) | before)
        tail = (mix64(key) % np.uint64(TAILS)).astype(np.uint8)
    else:
        tail = np.zeros(0, np.uint8)
    at = bounds[1:]
    return np.insert(code, at, END), np.insert(tail, at, 0), np.diff(bounds) + 1


def _blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of about BLOCK tokens: block, ids, held, lens, uniq, tail (of uniq), tok (indices into uniq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        codes, tails, lens, ids, held, total = [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            uniq, where, tok = np.unique(np.concatenate(codes), return_index=True, return_inverse=True)
            tail = np.concatenate(tails)[where]
            made += 1
            cells = (uniq, tail, tok.astype(np.uint32), np.concatenate(lens))
            return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["block", "ids", "held", "uniq", "tail", "tok", "lens"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                code, tail, n = code_texts(part.column(1))
                codes.append(code)
                tails.append(tail)
                lens.append(n)
                ids += part.column(0).to_pylist()
                held += part.column(2).to_pylist()
                total += len(code)
                if total >= BLOCK:
                    yield flush()
                    codes, tails, lens, ids, held, total = [], [], [], [], [], 0
        if codes:
            yield flush()

    return docs.mapInArrow(run, "block long, ids array<long>, held array<boolean>, uniq binary, tail binary, tok binary, lens binary")


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    kinds = {"uniq": np.uint64, "tail": np.uint8, "tok": np.uint32, "lens": np.int64}
    return tuple(np.frombuffer(row[k], t) for k, t in kinds.items())


def _by_bucket(uniq: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (uniq % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _totals(blocks: DataFrame, buckets: int, heads: int) -> DataFrame:
    """Rows of three kinds. Reply: block, b, c (training counts of the block's tokens in bucket b). Class: tail, n, v. Candidates for heads: c alone (n, hash, tail of the bucket's most frequent tokens)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uniq, tail, tok, lens = _unpack(row)
                learn = np.repeat(~np.array(row["held"], bool), lens)
                count = np.bincount(tok[learn], minlength=len(uniq)).astype(np.uint32)
                order, cut = _by_bucket(uniq, buckets)
                rows = [b for b in range(buckets) if cut[b] < cut[b + 1]]
                cells = [pa.array([x[order[cut[b] : cut[b + 1]]].tobytes() for b in rows], pa.binary()) for x in (uniq, count, tail)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([row["block"]] * len(rows), pa.int64()), *cells], ["b", "block", "h", "c", "t"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("h")]
        h = np.concatenate(parts)
        c = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("c")])
        t = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("t")])
        uniq, first, at = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(at, c, len(uniq)).astype(np.int64)
        tail, known = t[first], total > 0
        own = total[at]
        width = np.uint32 if total.max() < 1 << 32 else np.uint64
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        reply = [own[a:b].astype(width).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n, v = np.bincount(tail, total, TAILS).astype(np.int64), np.bincount(tail[known], minlength=TAILS)
        top = np.argsort(-total, kind="stable")[:heads]
        top = top[total[top] > 0]
        b, z = table.column("b")[0].as_py(), lambda k, t: pa.nulls(k, t)
        r, k = len(reply), 1
        best = np.column_stack([total[top], uniq[top].view(np.int64), tail[top].astype(np.int64)]).tobytes()
        join = lambda kind, *x: pa.concat_arrays([pa.array(y, kind) if not isinstance(y, int) else z(y, kind) for y in x])
        return pa.table(
            {
                "block": join(pa.int64(), table.column("block").to_pylist(), TAILS, k),
                "b": join(pa.int32(), [b] * r, TAILS, k),
                "c": join(pa.binary(), reply, TAILS, [best]),
                "tail": join(pa.int32(), r, np.arange(TAILS, dtype=np.int32), k),
                "n": join(pa.int64(), r, n, k),
                "v": join(pa.int64(), r, v.astype(np.int64), k),
            }
        )

    packed = blocks.mapInArrow(emit, "b int, block long, h binary, c binary, t binary")
    return packed.groupBy("b").applyInArrow(meet, "block long, b int, c binary, tail int, n long, v long")


def _most_frequent(packed: DataFrame, heads: int) -> list:
    """(n, hash, tail) of the most frequent tokens, from each bucket's own."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((0, 3), np.int64)
        for batch in batches:
            for x in batch.column(0):
                rows = np.concatenate([rows, np.frombuffer(x.as_py(), np.int64).reshape(-1, 3)])
                rows = rows[np.lexsort((rows[:, 1], -rows[:, 0]))[:heads]]
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["n", "hash", "tail"])

    return packed.mapInArrow(best, "n long, hash long, tail long").orderBy(F.desc("n"), "hash").limit(heads).collect()


class LogBilinear:
    """Class scores: sum over the context of position-weighted embeddings, times the class's embedding, plus its bias."""

    def __init__(self, classes: int, unigram: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.unigram = (unigram + 0.5) / (unigram + 0.5).sum()
        self.p = [rng.normal(0, 0.1, (classes + 1, WIDTH)), rng.normal(0, 0.1, (classes, WIDTH)), np.log(self.unigram), np.ones((CONTEXT, WIDTH)) / CONTEXT]
        self.p = [x.astype(np.float32) for x in self.p]
        self.square = [np.full_like(x, 1e-2) for x in self.p]

    def train(self, seen: np.ndarray, target: np.ndarray, *, batch: int = 2048, noise: int = 96, rate: float = 0.4, seed: int = 1) -> None:
        """One pass of noise-contrastive estimation with AdaGrad. seen: CONTEXT class numbers of each target (number of classes: none)."""
        rng = np.random.default_rng(seed)
        table = np.searchsorted(np.cumsum(self.unigram), (np.arange(1 << 16) + 0.5) / (1 << 16)).clip(0, len(self.unigram) - 1)
        log_noise = np.log(noise * self.unigram).astype(np.float32)
        order = rng.permutation(len(target))
        context, output, bias, weight = self.p
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            w, c = target[own], seen[own]
            e = [context.take(c[:, k], 0) for k in range(CONTEXT)]
            q = sum(x * weight[k] for k, x in enumerate(e))
            sample = table[rng.integers(0, 1 << 16, noise)]
            out_w, out_s = output.take(w, 0), output.take(sample, 0)
            right = 1 - _sigmoid(np.einsum("ij,ij->i", q, out_w) + bias[w] - log_noise[w])
            half = q @ (0.5 * out_s).T
            half += 0.5 * (bias[sample] - log_noise[sample])
            np.tanh(half, out=half)  # a noise token's push is -sigmoid(x) = -(1 + tanh(x / 2)) / 2; the sums over it are taken apart
            dq = right[:, None] * out_w
            dq -= 0.5 * (half @ out_s + out_s.sum(0))
            d_out = _scatter(w, right[:, None] * q, len(output))
            np.add.at(d_out, sample, -0.5 * (half.T @ q + q.sum(0)))
            d_bias = np.bincount(w, right, len(bias)) + np.bincount(sample, -0.5 * (half.sum(0) + len(own)), len(bias))
            d_context = sum(_scatter(c[:, k], dq, len(context)) * weight[k] for k in range(CONTEXT))
            d_weight = np.stack([np.einsum("ij,ij->j", dq, x) for x in e])
            for x, g, s in zip(self.p, (d_context, d_out, d_bias, d_weight), self.square, strict=True):
                g = np.divide(g, len(own), dtype=np.float32)
                step = g * g
                s += step
                np.sqrt(s, out=step)
                np.divide(g, step, out=step)
                step *= rate
                x += step

    def log_normal(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(q, log of the normaliser) for rows of contexts."""
        context, output, bias, weight = self.p
        q = np.empty((len(seen), WIDTH), np.float32)
        z = np.empty(len(seen), np.float32)
        for at in range(0, len(seen), 4096):
            q[at : at + 4096] = (context[seen[at : at + 4096]] * weight).sum(1)
            s = q[at : at + 4096] @ output.T + bias
            top = s.max(1)
            z[at : at + 4096] = top + np.log(np.exp(s - top[:, None]).sum(1))
        return q, z

    def log_prob(self, seen: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of P(target class | context), normalised over all classes."""
        classes = len(self.p[2])
        key = seen[:, 0].astype(np.int64)
        for k in range(1, CONTEXT):
            key = key * (classes + 1) + seen[:, k]
        key, first, at = np.unique(key, return_index=True, return_inverse=True)
        q, z = self.log_normal(seen[first])
        out = np.empty(len(target), np.float64)
        for a in range(0, len(target), 1 << 17):
            w, i = target[a : a + (1 << 17)], at[a : a + (1 << 17)]
            out[a : a + (1 << 17)] = (q[i] * self.p[1][w]).sum(1) + self.p[2][w] - z[i]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = np.exp(-x)
        y += 1
        return np.reciprocal(y, out=y)


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of rows by number."""
    at = at.astype(np.uint16)  # few enough classes for a radix sort
    order = np.argsort(at, kind="stable")
    at = at[order]
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros((n, WIDTH), np.float32)
    out[at[edge]] = np.add.reduceat(rows.take(order, 0), edge, axis=0)
    return out


def contexts(classes: np.ndarray, lens: np.ndarray, none: int) -> np.ndarray:
    """Of each token the classes of the CONTEXT tokens before it in its row, nearest first."""
    out = np.full((len(classes), CONTEXT), none, np.int32)
    place = np.arange(len(classes)) - np.repeat(np.cumsum(lens) - lens, lens)
    for k in range(CONTEXT):
        have = np.flatnonzero(place > k)
        out[have, k] = classes[have - k - 1]
    return out


class Coder:
    def __init__(self, heads: list[int]) -> None:
        self.heads = np.sort(np.array([h & 0xFFFFFFFFFFFFFFFF for h in heads], np.uint64))

    def classes(self, uniq: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.heads):
            return tail.astype(np.int32)
        at = np.minimum(np.searchsorted(self.heads, uniq), len(self.heads) - 1)
        return np.where(self.heads[at] == uniq, at, len(self.heads) + tail.astype(np.int64)).astype(np.int32)


def _deal(blocks: DataFrame, coder: Coder, trainers: int, rounds: int, size: int) -> DataFrame:
    """Pieces of whole training texts (about `size` tokens), dealt by hash: trainer, turn (round of a pass), piece, target (classes), lens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uniq, tail, tok, lens = _unpack(row)
                own = ~np.array(row["held"], bool)
                target = coder.classes(uniq, tail)[tok][np.repeat(own, lens)].astype(np.uint16)
                lens = lens[own]
                if not len(lens):
                    continue
                start = np.cumsum(lens) - lens
                first = np.flatnonzero(np.diff(start // size, prepend=-1))
                piece = mix64(np.uint64(row["block"]) + (np.arange(len(first), dtype=np.uint64) << np.uint64(48)))
                cell = (piece % np.uint64(trainers * rounds)).astype(np.int64)
                cells = [[x.tobytes() for x in np.split(y, at[1:])] for y, at in ((target, start[first]), (lens, first))]
                yield pa.RecordBatch.from_arrays([pa.array(cell // rounds), pa.array(cell % rounds), pa.array(piece.view(np.int64)), *(pa.array(x, pa.binary()) for x in cells)], ["trainer", "turn", "piece", "target", "lens"])

    return blocks.select("block", "held", "uniq", "tail", "tok", "lens").mapInArrow(run, "trainer long, turn long, piece long, target binary, lens binary")


def _train(pieces: DataFrame, model: LogBilinear, seed: int, trainers: int) -> LogBilinear:
    """The mean of the models that the trainers make of it, weighted by their tokens; so are the AdaGrad sums."""
    classes = len(model.p[2])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("piece")
        target, lens = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(k)]) for k, t in (("target", np.uint16), ("lens", np.int64)))
        target = target.astype(np.int32)
        own = LogBilinear.__new__(LogBilinear)
        own.unigram, own.p, own.square = model.unigram, [x.copy() for x in model.p], [x.copy() for x in model.square]
        own.train(contexts(target, lens, classes), target, seed=seed)
        flat = np.concatenate([x.ravel() for x in own.p + own.square])
        return pa.table({"lane": pa.array([table.column("trainer")[0].as_py() // FAN]), "n": pa.array([len(target)]), "p": pa.array([flat.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")  # one order of adding, whichever comes first
        n = table.column("n").to_pylist()
        mean = sum(np.frombuffer(x.as_py(), np.float32) * (k / sum(n)) for x, k in zip(table.column("p"), n, strict=True)).astype(np.float32)
        return pa.table({"lane": pa.array([table.column("lane")[0].as_py() // FAN], pa.int64()), "n": pa.array([sum(n)], pa.int64()), "p": pa.array([mean.tobytes()], pa.binary())})

    kind = "lane long, n long, p binary"
    sums, left = pieces.groupBy("trainer").applyInArrow(run, kind), trainers
    while left > 1:
        sums, left = sums.groupBy("lane").applyInArrow(add, kind), -(-left // FAN)
    got = sums.first()
    if got is not None:
        flat, at = np.frombuffer(got["p"], np.float32), 0
        for group in (model.p, model.square):
            for k, x in enumerate(group):
                group[k] = flat[at : at + x.size].reshape(x.shape)
                at += x.size
    return model


def score_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", held_out: str = "held_out", heads: int | None = None, passes: int = PASSES, rounds: int = ROUNDS, share: int = SHARE) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row; what isn't held out is learnt from. A single trainer needs no rounds within a pass.

    heads: tokens that are classes of their own; by default HEADS for each doubling of the vocabulary.
    """
    buckets = bucket_count(docs)
    blocks = materialise(_blocks(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))))
    most = heads or HEADS * 64
    totals = materialise(_totals(blocks, buckets, most))
    by_tail = {r["tail"]: r for r in totals.where("tail is not null").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for k, r in by_tail.items():
        tail_n[k], tail_v[k] = r["n"], r["v"]
    tokens, types = float(tail_n.sum()), float(tail_v.sum())
    head = _most_frequent(totals.where("block is null and tail is null").select("c"), heads or int(HEADS * np.log2(types + 2)))
    coder = Coder([r["hash"] for r in head])
    for r in head:
        tail_n[r["tail"]] -= r["n"]
        tail_v[r["tail"]] -= 1
    count = {r["hash"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in head}
    classes = len(head) + TAILS
    model = LogBilinear(classes, np.concatenate([[count[int(h)] for h in coder.heads], tail_n]))
    trainers = max(1, int(tokens) // share)
    rounds = rounds if trainers > 1 else 1
    if tokens:
        pieces = materialise(_deal(blocks, coder, trainers, rounds, max(1, share // 64)))
        for k in range(passes * rounds):
            model = _train(pieces.where(F.col("turn") == k % rounds), model, k, trainers)
    base = np.log10(tokens + SMOOTH * (types + 1)) if tokens or types else np.log10(SMOOTH)
    rest = np.log(np.maximum(tail_n + SMOOTH * (tail_v + 1), SMOOTH))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        row = left.to_pylist()[0]
        uniq, tail, tok, lens = _unpack(row)
        order, cut = _by_bucket(uniq, buckets)
        c = np.zeros(len(uniq))
        for b, raw in zip(right.column("b").to_pylist(), right.column("c").to_pylist(), strict=True):
            size = cut[b + 1] - cut[b]
            c[order[cut[b] : cut[b + 1]]] = np.frombuffer(raw, np.uint32 if len(raw) == 4 * size else np.uint64)
        cls = coder.classes(uniq, tail)
        inside = np.where(cls >= len(coder.heads), np.log(c + SMOOTH) - rest[tail], 0.0)
        target = cls[tok]
        logs = model.log_prob(contexts(target, lens, classes), target) + inside[tok]
        start = np.cumsum(lens) - lens
        add = lambda x: np.add.reduceat(x, start)
        flat = (np.log10(c + SMOOTH) - base)[tok]
        cells = (row["ids"], row["held"], lens, add((c > 0)[tok].astype(np.int64)), np.full(len(lens), int(tokens)), add(flat), add(logs) / np.log(10))
        return pa.table({n: pa.array(x, t) for n, t, x in zip(names, kinds, cells, strict=True)})

    names = [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = f"`{key}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = totals.where("block is not null").select("block", "b", "c")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


FOLDS = 10


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs.withColumn("held_out", crc_mod(F.col("doc_id"), FOLDS) == 0))
