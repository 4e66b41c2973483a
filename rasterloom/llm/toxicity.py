"""Toxic passages by maximum-scoring segment search.

Words (parted by white space and ASCII punctuation, lower-cased) get log-odds of standing in toxic rather than clean
documents, with an informative Dirichlet prior in proportion to their overall frequency; those that stand out
(z >= `least_z`) form the lexicon, every other word costs `drift`. One linear-time scan finds all maximal segments
with a positive score (the sparse form of the Ruzzo-Tompa scan: only lexicon words are visited). Segment scores are
calibrated by extreme-value theory: lambda solves E[exp(lambda s)] = 1 over clean text, K to how many clean
documents reach the score of one hit, so a segment of score S in n words is expected K n exp(-lambda S) times by chance. A
document's evidence is the sum of its segments' excess over chance, and a logistic curve makes it a probability.

All is fitted on a bounded sample of about `sample_rows` labelled rows, chosen by hash of the id; scoring reads every
whole text. Defined cases: a null or empty text has no evidence and gets the curve's base value; without labelled rows
of both kinds every score is 0. Rows are scored one by one, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.textops import _SPACE, column_bytes, crc_mod, map_batches, row_bounds, words
from rasterloom.session import materialise

#: Evidence, in natural logarithms of odds against chance, that is as good as certainty.
ENOUGH = 30.0
_PARTS = _SPACE.copy()
_PARTS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, last, score) of a text whose word at positions[i] scores scores[i] > 0 and every other -drift.

    One pass with the stack of candidates by cumulative totals (Ruzzo and Tompa 1999); first and last are indices into positions.
    """
    stack: list[list] = []  # [total before, total after, first, last]
    total = 0.0
    before = -1
    for k, (at, s) in enumerate(zip(positions, scores, strict=True)):
        total -= drift * (at - before - 1)
        before = at
        item = [total, total + s, k, k]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= item[0]:
                j -= 1
            if j < 0 or stack[j][1] >= item[1]:
                stack.append(item)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
    return [(a, b, hi - lo) for lo, hi, a, b in stack]


class Model:
    def __init__(self, lexicon: dict[int, float], drift: float, lam: float = 1.0, k: float = 1.0, curve: tuple[float, float] | None = None) -> None:
        self.codes = np.array(sorted(lexicon), np.uint64)
        self.scores = np.array([lexicon[int(c)] for c in self.codes])
        self.drift, self.lam, self.k, self.curve = drift, lam, k, curve

    def segments(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
        """Of each row: number of words, segments as (first, last word, score), words' starts and ends in the row's bytes."""
        data, offsets = column_bytes(column)
        code, row, start, end = words(data, offsets, _PARTS)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[at] == code)
        else:
            hit = at = np.zeros(0, np.int64)
        bounds, hits = row_bounds(row, len(column)), row_bounds(row[hit], len(column))
        for r in range(len(column)):
            own = hit[hits[r] : hits[r + 1]]
            cut = slice(bounds[r], bounds[r + 1])
            place = (own - bounds[r]).tolist()
            found = [(place[a], place[b], s) for a, b, s in maximal_segments(place, self.scores[at[own]].tolist(), self.drift)] if place else []
            yield int(bounds[r + 1] - bounds[r]), found, start[cut] - offsets[r], end[cut] - offsets[r]

    def excess(self, n: int, score: float) -> float:
        """-ln of how often a segment of this score is expected by chance in n words."""
        return self.lam * score - math.log(max(self.k * max(n, 1), 1e-300))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return sum(max(0.0, self.excess(n, s)) for _, _, s in found)

    @staticmethod
    def strength(evidence: float) -> float:
        """What the curve is over: beyond ENOUGH more evidence changes nothing."""
        return min(evidence, ENOUGH) / 10

    def probability(self, evidence: float) -> float:
        if self.curve is None:
            return 0.0
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, a + b * self.strength(evidence)))))


def _root(clean: np.ndarray, scores: np.ndarray, drift: float) -> float:
    """lambda > 0 with E[exp(lambda s)] = 1 for words that score `scores` with probabilities `clean`, else -drift."""
    rest = 1 - clean.sum()
    f = lambda x: float((clean * np.exp(x * scores)).sum() + rest * math.exp(-x * drift) - 1)
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton's method for P(y) = 1 / (1 + exp(-(a + b x))), lightly ridged."""
    w = np.array([math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)), 0.0])
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        grad = design.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = 12_000, least_z: float = 4.0, prior_share: float = 0.1, drift: float = 0.03) -> Model:
    """A model of label from the labelled rows of docs. The sample's ids (bounded by sample_rows) are broadcast."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("double").alias("y"))
    n = known.count()
    share = min(1.0, sample_rows / max(n, 1))
    taken = known.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 20)) < share * (1 << 20))
    sample = docs.select(F.col(key), F.col(text)).join(F.broadcast(taken), key).select("y", text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy() > 0
            data, offsets = column_bytes(batch.column(1))
            code, row, _, _ = words(data, offsets, _PARTS)
            bounds = row_bounds(row, len(y))
            seen = {True: [], False: []}
            for r in range(len(y)):  # a document counts once for each word, so one long text doesn't rule
                seen[bool(y[r])].append(np.unique(code[bounds[r] : bounds[r + 1]]))
            for kind, parts in seen.items():
                if parts:
                    c, m = np.unique(np.concatenate(parts), return_counts=True)
                    zero = np.zeros(len(c), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(m if kind else zero), pa.array(zero if kind else m), pa.array(zero)], ["w", "t", "c", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([int(y.sum())]), pa.array([int((~y).sum())]), pa.array([len(code)])], ["w", "t", "c", "n"])

    counts = sample.mapInArrow(count, "w long, t long, c long, n long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    counts = materialise(counts)
    sums = counts.where("w is not null").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    rows = counts.where("w is null").first()
    if rows is None or not rows["t"] or not rows["c"]:
        return Model({}, drift)
    nt, nc = float(sums["t"]), float(sums["c"])
    prior = prior_share * (nt + nc)  # pseudo-counts, dealt over the words as their overall frequency
    a = (F.col("t") + F.col("c")) * F.lit(prior_share)
    odds = lambda own, total: F.log((F.col(own) + a) / (F.lit(total + prior) - F.col(own) - a))
    delta = odds("t", nt) - odds("c", nc)
    z = delta / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    top = counts.where("w is not null and t > 1").select("w", "c", delta.alias("d"), z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "w").collect()  # words of the bounded sample
    if not top:
        return Model({}, drift, curve=_logistic(np.zeros(2), np.array([1.0, 0.0])))
    model = Model({r["w"] & 0xFFFFFFFFFFFFFFFF: r["d"] for r in top}, drift)
    clean = np.array([r["c"] + 0.1 for r in top]) / max(rows["n"], 1)
    model.lam = _root(clean, np.array([r["d"] for r in top]), drift)

    def found(batch: pa.RecordBatch) -> dict:
        got = [(n, [s for _, _, s in f]) for n, f, _, _ in model.segments(batch.column(1))]
        return {"n": [g[0] for g in got], "s": [g[1] for g in got]}

    fitted = map_batches(sample, found, "n long, s array<double>", ["y"]).select("y", "n", "s").toPandas()  # sample_rows rows
    y, n_words, segments = fitted.y.to_numpy(), fitted.n.to_numpy(), fitted.s.tolist()
    best = np.array([max(s, default=0.0) for s in segments])
    quiet = y == 0
    # K from the tail: as many clean documents reach the least score of a single hit as there are
    least = float(model.scores.min())
    model.k = float(((best[quiet] >= least).sum() + 0.5) * math.exp(model.lam * least) / max(n_words[quiet].sum(), 1))
    x = np.array([model.strength(model.evidence(int(n), [(0, 0, s) for s in ss])) for n, ss in zip(n_words, segments, strict=True)])
    model.curve = _logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, most_chance: float = 0.05) -> DataFrame:
    """docs with score (0 to 1), evidence and passages: each significant one's first and last word (from 0), code points, score and number expected by chance."""

    def fn(batch: pa.RecordBatch) -> dict:
        column = batch.column(batch.schema.get_field_index(text)).fill_null("")
        out: dict[str, list] = {"score": [], "evidence": [], "passages": []}
        for r, (n, found, start, end) in enumerate(model.segments(column)):
            own = []
            chances = [math.exp(-model.excess(n, s)) for _, _, s in found]
            if any(c <= most_chance for c in chances):
                raw = np.frombuffer(column[r].as_buffer(), np.uint8)
                point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
            for (a, b, s), chance in zip(found, chances, strict=True):
                if chance <= most_chance:
                    own.append({"first_word": a, "last_word": b, "start": int(point[start[a]]), "end": int(point[end[b]]), "score": s, "chance": chance})
            e = model.evidence(n, found)
            out["score"].append(model.probability(e))
            out["evidence"].append(e)
            out["passages"].append(own)
        return out

    return map_batches(docs, fn, "score double, evidence double, passages array<struct<first_word:bigint,last_word:bigint,start:bigint,end:bigint,score:double,chance:double>>", keep)


FOLDS, HELD_OUT, CUT = 4, 2, 0.3


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    fold = crc_mod(F.col("doc_id"), FOLDS)
    model = fit(docs, labels.where(fold != HELD_OUT))
    rows = docs.withColumn("held_out", fold == HELD_OUT)
    scored = score(rows, model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
