"""Every query over tables with nulls, empty and very long texts, repeated rows, clashing columns, and over empty ones."""

import pytest

import corpus_pipeline
from rasterloom.llm.queries import QUERIES

ROWS = {"op1_mixing": 16, "op2_lm": 16, "op3_secrets": 16, "op4_toxicity": 16, "op5_jaccard": 15, "op6_embedding_dedup": 15, "op7_langid": 16, "op8_quality": 16, "op10_chat": 7}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name in ROWS:
        assert len(rows) == ROWS[name]
    if name == "op7_langid":
        by = {(r.doc_id, r.lang_pred) for r in rows}
        assert {(4, "und"), (5, "und"), (6, "und"), (8, "und")} <= by
        assert all(0 <= r.score <= 1 for r in rows)
    if name == "op4_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    if name == "op6_embedding_dedup":
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows if r.vec_id}
        assert got[1] == (3, 1, True) and got[3][:2] == (3, 1) and got[10][:2] == (3, 1)
        assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 13, 14))
        assert got[11] == (1, 11, True) and got[12] == (1, 11, False)
    if name == "op5_jaccard":
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id}
        assert got[2][1] == got[3][1] == 1 and got[4] == (0, 4) and got[7] == (1, 7) and got[12] == (1, 12)
        assert sum(r.doc_id is None for r in rows) == 2 and all(r.component_id is None for r in rows if r.doc_id is None)
    if name == "op2_lm":
        assert all(r.base_score < 0 and r.score < 0 for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (4, 5, 6)} == {1}
    if name == "op9_packing":
        use: dict = {}
        for r in rows:
            use[r.bin_id, r.bin_capacity] = use.get((r.bin_id, r.bin_capacity), 0) + r.n_tokens
        assert all(u <= c for (_, c), u in use.items())
    if name == "op10_chat":
        text = "".join(r.rendered for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.turn))
        assert text.startswith("<|user|>\nHello?") and text.endswith("<|end|>\n")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() > 0


def test_pipeline_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


CLASHING = ["_h", "_row", "_copies", "_key", "_hash", "_k", "row", "ROW", "own", "copies", "Key", "hashed", "times", "n", "low", "component_id", "n_shingles", "known", "spans", "lang_pred", "_text", "_p", "_n", "_steps"]


def test_pipeline_clashing_names(spark, odd):
    """Every stage hands the caller's columns on as they are, whatever their names."""
    from pyspark.sql import functions as F

    names = [c for k, c in enumerate(CLASHING) if c.lower() not in {x.lower() for x in CLASHING[:k]}]
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({c: F.concat_ws("|", F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("lang", F.lit("-"))) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = stage(spark, docs, odd)
        assert docs.columns == columns
        rows = docs.collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}|{'none' if r.doc_id is None else r.doc_id}|{r.lang or '-'}" for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() > 0
