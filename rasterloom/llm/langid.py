"""Language identification by rank-order profiles of character n-grams.

A language's profile is its `profile_size` most frequent n-grams (1 to 3 letters, a space marks a word's edge),
ranked. A text's own profile is compared with each by out-of-place distance: the sum over the text's n-grams of how
far their ranks differ, `profile_size` for one that the language's profile lacks.

Profiles are a classifier fitted on a bounded sample: about `sample_rows` labelled rows of each language, chosen by
hash of the id. Prediction reads every whole text.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; so is any text if there are no
labelled rows. Ties go to the language first in order. Repeated rows each get a row. Null labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.textops import crc_mod, map_batches

UNDETERMINED = "und"
CHUNK = 1 << 19
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams, ascending, and their counts. A code holds 21 bits for each letter."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(text), CHUNK):
        begin = max(0, at - 2)  # n-grams across the cut
        points = np.frombuffer(text[begin : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        points[~letters()[points]] = 32
        edge = [np.array([32])]
        points = np.concatenate(([] if at else edge) + [points] + (edge if at + CHUNK >= len(text) else []))
        old = at - begin
        stay = np.ones(len(points), bool)
        stay[1:] = (points[1:] != 32) | (points[:-1] != 32)
        new = np.flatnonzero(stay) >= old
        p = points[stay]
        b = (p[:-1] << 21) | p[1:]
        c = (b[:-1] << 21) | p[2:]
        codes = np.concatenate([p[new & (p != 32)], b[new[1:]], c[new[2:] & (p[1:-1] != 32)]])
        if len(codes):
            parts.append(np.unique(codes, return_counts=True))
        if len(parts) > 16:
            parts = [_merge(parts)]
    return _merge(parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def has_letter(codes: np.ndarray) -> bool:
    return bool(len(codes)) and bool((codes[: np.searchsorted(codes, 1 << 21)] != 32).any())


class Profiles:
    """Ranks of the known n-grams in each language; those absent have rank `size`."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        best = {g: sorted((-n, c) for lang, c, n in rows if lang == g)[:size] for g in self.langs}
        self.codes = np.unique(np.array([c for top in best.values() for _, c in top], np.int64))
        self.ranks = np.full((len(self.codes), len(self.langs)), size, np.int32)
        for k, g in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, [c for _, c in best[g]]), k] = np.arange(len(best[g]))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin over the next)."""
        codes, counts = ngrams(text or "")
        if not self.langs or not has_letter(codes):
            return UNDETERMINED, 0.0, 0.0
        top = codes[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = self.codes[at] == top
        own = np.flatnonzero(known)
        out = np.abs(self.ranks[at[own]] - own[:, None].astype(np.int32))
        out[self.ranks[at[own]] == self.size] = self.size
        distance = out.sum(0) + (len(top) - len(own)) * self.size
        order = np.argsort(distance, kind="stable")
        worst = len(top) * self.size
        first = distance[order[0]]
        second = distance[order[1]] if len(order) > 1 else worst
        return self.langs[order[0]], float(max(0.0, 1 - first / worst)), float((second - first) / worst)


def fit_profiles(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", profile_size: int = 400, sample_rows: int = 2000) -> Profiles:
    """Profiles of the languages in `labelled`. Of each language about `sample_rows` rows are read, by hash of the key.

    The driver gets, of each language and each of 16 shares of the n-grams, the `profile_size` most frequent.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("g"), F.xxhash64(F.col(key).cast("string"), F.length(text)).alias("h")).where("t is not null and g is not null")
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], profile_size)
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, sample_rows / n))])
    taken = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("g")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = parts.setdefault(g, [])
                own.append(ngrams(t))
                if len(own) > 64:
                    own[:] = [_merge(own)]
            for g, own in parts.items():
                codes, n = _merge(own)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["g", "code", "n"])

    summed = taken.select("t", "g").mapInArrow(count, "g string, code long, n long").groupBy("g", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("g", F.pmod("code", F.lit(16))).orderBy(F.desc("n"), "code")
    best = summed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= profile_size)
    return Profiles([(r["g"], r["code"], r["n"]) for r in best.select("g", "code", "n").collect()], profile_size)


def _predict(profiles: Profiles, text: str):
    def fn(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        got = [profiles.predict(t) for t in texts]
        return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "margin": [g[2] for g in got], "known": [g[0] != UNDETERMINED or has_letter(ngrams(t or "")[0]) for g, t in zip(got, texts, strict=True)]}

    return fn


def detect(docs: DataFrame, profiles: Profiles, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred, score (1: ranks equal) and margin; columns of these names give way."""
    return map_batches(docs, _predict(profiles, text), "lang_pred string, score double, margin double", keep)


def drop_undetermined(docs: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """The rows whose text has a letter, with their own columns, be there profiles or not."""
    return map_batches(docs, _predict(profiles, text), "", None, "known")


FOLDS = 3


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = crc_mod(F.col("doc_id"), FOLDS)
    profiles = fit_profiles(docs.where(fold != 1))
    rows = docs.select("doc_id", "text", (fold == 1).alias("held_out"))
    return detect(rows, profiles, keep=["doc_id", "held_out"])
