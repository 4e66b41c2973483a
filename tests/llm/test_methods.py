"""The operators' methods against brute force, round trips and held-out accuracy on small fixtures."""

import io
import itertools
import random
import re
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import chat, embedding_dedup, jaccard, langid, lm, mixing, packing, quality, secrets, textops, toxicity
from rasterloom.session import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(80)]
    return [rng.choice(["", " "]) + rng.choice([" ", "\n", "\t "]).join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(n)] + [None, "", " \n"]


def test_words_match_regex(monkeypatch):
    rows = texts() + ["A" * 100, "Zé\x0b\x0cÀ b"]
    for segment in (textops.SEGMENT, 16):
        monkeypatch.setattr(textops, "SEGMENT", segment)
        data, offsets = textops.column_bytes(pa.array(rows, pa.string()))
        code, row, start, end = textops.words(data, offsets)
        want = [(r, w) for r, t in enumerate(rows) for w in WORD.findall((t or "").translate(LOWER))]
        got = [(int(r), bytes(data[s:e]).decode().translate(LOWER)) for r, s, e in zip(row, start, end, strict=True)]
        assert got == want
        assert len(set(code.tolist())) == len({w for _, w in want})
        assert textops.count_words(data, offsets).tolist() == [len(WORD.findall(t or "")) for t in rows]


def similar(n=120, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 70))]
        for _ in range(n // 12):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 30)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [64, 4])
def test_jaccard_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    docs = list(enumerate(similar()))
    sets = {}
    for i, t in docs:
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    up = {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i, _ in docs}
    assert len({c for _, c in got.values()}) < 110


def brute_components(sets):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_long_words_that_a_polynomial_confuses(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    z = "z" * 6000
    swapped = [z[:500] + p + z[501:4596] + q + z[4597:] for p, q in ("xy", "yx")]
    rows = [thue, other, *swapped, swapped[0].upper(), "abcdefgh", "abcdefghi", "abcdefgh " + "b" * 129, "abcdefgh " + "b" * 130]
    got = jaccard.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: 2 if i == 4 else i for i in range(len(rows))}


@pytest.mark.parametrize("sharing", [24, 30, 33])
def test_chain_of_documents(spark, sharing):
    """A family at the real block size without a central text: each document shares a run of words with the next; only long runs link."""
    rng = random.Random(sharing)
    words = [f"u{i}" for i in range(40 * 400)]
    rows, at = [], 0
    for _ in range(330):
        rows.append(" ".join(words[at : at + 40]))
        at += 40 - (sharing if rng.random() < 0.7 else 36)
    sets = [shingles(t) for t in rows]
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_components(sets)))


def test_near_duplicates_by_row(spark):
    """Repeated rows, a shared id with another text, and rows without an id."""
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [(5, long), (5, long), (7, long + " end"), (8, other), (8, third), (9, third + " x"), (None, other + " y"), (None, "alone in here and no copy of it"), (None, "alone in here and no copy of it"), (-3, "a text of its own, quite short")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, long), (8, other), (8, third), (None, rows[7][1]), (-3, rows[9][1])], key=str)
    unique = docs.where("doc_id not in (5, 8)")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, unique, "").collect()} == {7, 9, -3}


def test_near_duplicates_keep_little_on_disk(spark, tmp_path):
    """the sets go when the links are known, and while few documents go, the texts are filtered without a shuffle of them."""
    from pathlib import Path

    from rasterloom.session import shared_folder

    text = " ".join(f"word{k}" for k in range(40))
    spark.createDataFrame([(k, f"{text} {k % 7}") for k in range(30)] + [(99, "something else altogether, in six words")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    there = lambda: {p for p in Path(shared_folder(spark).removeprefix("file:")).glob("rows-*")}
    before = there()
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
    assert {r.doc_id for r in kept.collect()} == {0, 99}
    assert len(there() - before) == 1  # the ids that go
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pipeline_discards_earlier_stages(spark, tmp_path, monkeypatch):
    """a stage's documents are removed once those of the next are complete."""
    from pathlib import Path

    spark.createDataFrame([(k, f"a text of some words {k}") for k in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read = []

    def stage(s, docs, d):
        read.append([Path(f.removeprefix("file:").replace("///", "/")).parent for f in docs.inputFiles()][0])
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage) for n in "abcd"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5
    assert [p.exists() for p in read] == [True, False, False, True] and read[0].name == "documents.parquet"


def test_merge_short_counts():
    rng = np.random.default_rng(0)
    for _ in range(2000):
        lists, weight = [], {}
        low, high = sorted(rng.integers(0, 16, 2).tolist())
        for _ in range(rng.integers(1, 9)):
            ids, w = np.unique(rng.integers(0, 14, rng.integers(0, 14))).tolist(), int(rng.integers(1, 4))
            starts = [i for i in ids if i - 1 not in ids]
            lists.append((starts, [i + 1 for i in ids if i + 1 not in ids], w))
            for i in ids:
                weight[i] = weight.get(i, 0) + w
        need = int(rng.integers(1, 12))
        ids, n = jaccard.merge_short(lists, need, low, high)
        assert dict(zip(ids.tolist(), n.tolist(), strict=True)) == {i: w for i, w in weight.items() if w >= need and low <= i < high} and sorted(ids.tolist()) == ids.tolist()


def test_secrets_against_plain_scan():
    rng = random.Random(4)
    parts = ["Password: hunter2x", "api_key='abc/DEF=123'", "secret=abc", "TOKEN = zzzzzz_1", "AKIA" + "A1" * 9, "AKIASHORT", "deadbeef" * 4, "0123abc", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "é ſecret: abcdefg", "x", "https://u:pass@h"]
    rows = [" ".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(300)] + [None, ""]
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    want = [sorted((a, k, b) for k, r in enumerate(rules) for m in re.finditer(r.pattern, t or "", re.ASCII) if r.accept is None or r.accept(m) for a, b in (r.parts(m) if r.parts else [m.span()])) for t in rows]
    assert secrets.Scanner(rules).scan(pa.array(rows, pa.string())) == want
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is True
    assert secrets.named(secrets.trigram_query("AKIA[A-Z0-9]+")) == {"aki", "kia"}


def test_signed_tokens_in_linear_time():
    """The rule by runs against the plain pattern, and its time on a text that a plain scan reads again from every start."""
    plain = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
    rule = next(r for r in secrets.MORE_RULES if r.kind == "jwt")
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(["eyJ", "abcdefgh", "x", ".", ".", " ", "eyJabcdefghi", "-_"], k=rng.randint(0, 14)))
        assert [s for m in re.finditer(rule.pattern, text) for s in rule.parts(m)] == [m.span() for m in plain.finditer(text)], text
    scanner = secrets.Scanner((rule,))
    took = []
    for size in (1, 4):
        text = pa.array(["eyJ" * (size * 250_000)])
        scanner.scan(text)
        began = time.perf_counter()
        scanner.scan(text)
        took.append(time.perf_counter() - began)
    assert took[1] < max(12 * took[0], 1.0)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdef1 and password: qwertyui."), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {1: "a <SECRET:assign> and <SECRET:assign>", 2: None, 3: "clean"}


def test_whole_keys_and_long_logins_are_redacted(spark):
    body = "\n".join(["MIIEow+/" * 8] * 3 + ["q83vAb=="])
    head, foot = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    pem = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011\n\n"
    rows = [f"a {head}\n{body}\n{foot} b", f"a {head}\n{body}", "a " + f"{head}\n{body}\n{foot}".replace("\n", "\\n") + " b", f"a {head}\n{pem}{body}\n{foot} b", f"a {head}\n{body}\nand so it goes", f"a {head} is how a key starts", f"a {head}\n{pem}{body}", f"https://{'u' * 90}:{'Zt' * 60}@host/x", f"{head}\n{body}\n{foot}\nmid\n{head}\n{body}\n{foot}"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]
    key = "<SECRET:private_key>"
    assert got == [f"a {key} b", f"a {key}", f"a {key} b", f"a {key} b", f"a {key}\nand so it goes", f"a {key} is how a key starts", f"a {key}", "<SECRET:url_login>host/x", f"{key}\nmid\n{key}"]


def test_segments_against_all_intervals():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 30)
        score = [rng.choice([-0.3, -0.3, -0.3, 1.0, 2.0]) for _ in range(n)]
        place = [i for i, s in enumerate(score) if s > 0]
        found = toxicity.maximal_segments(place, [score[i] for i in place], 0.3) if place else []
        best = max((sum(score[a : b + 1]) for a in range(n) for b in range(a, n)), default=0)
        if place:
            assert max(s for _, _, s in found) == pytest.approx(best)
            assert sum(s > 0 for s in score) == sum(b - a + 1 for a, b, _ in found)


def test_language_profiles(spark):
    rng = random.Random(6)
    stems = {"aa": ["lor", "mi", "ta"], "bb": ["kwe", "zu", "ph"], "cc": ["xi", "ég", "ün"]}
    rows = [(i, " ".join("".join(rng.choices(stems[g], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), g) for i, g in enumerate(rng.choices(list(stems), k=150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit_profiles(df.where("doc_id % 2 = 0"))
    got = langid.detect(df.where("doc_id % 2 = 1"), profiles).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_letters_stay_without_labels(spark):
    rows = [(i, t, None) for i, t in enumerate(["a clean text", "été", "12 34 !", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.languages(spark, df, "").collect()} == {0, 1}
    named = df.withColumn("lang", F.lit("und"))
    assert {r.doc_id for r in langid.drop_undetermined(named, langid.fit_profiles(named)).collect()} == {0, 1}


def test_language_chunks(monkeypatch):
    text = "Ab c, dé fgh ij! " * 9
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert all(np.array_equal(a, b) for a, b in zip(langid.ngrams(text), whole, strict=True))


@pytest.mark.parametrize("few", [0, 3, 16])
def test_quality_counts(spark, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW_REPEATED", few)
    rows = [(i, t) for i, t in enumerate(texts(200, 7) + ["a b c a b c", "x x x x", "1\n1\n 1\n\n2 #$"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        covered = {k + d for v in at.values() if len(v) > 1 for k in v for d in range(3)}
        assert got[i] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))


def test_packing_invariants():
    rng = random.Random(8)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(0, 80))]
        bins, offset, size = packing.best_fit(lengths, (10, 20, 40))
        used = np.bincount(bins, lengths, len(size)) if lengths else np.zeros(0)
        assert (used <= size).all() and all(size[b] == min(c for c in (10, 20, 40) if c >= used[b]) for b in range(len(size)))
        for b in range(len(size)):
            own = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
            assert all(o == sum(n for _, n in own[:k]) for k, (o, _) in enumerate(own))
        assert sum(used) <= sum(size) <= sum(lengths) + 40 * max(1, len(size))


def test_packing_keeps_every_token(spark):
    rows = [(i, t) for i, t in enumerate(texts(100, 9))] + [(999, "w " * 10_000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), (64, 256)).toPandas()
    per = got.groupby("doc_id").n_tokens.sum().to_dict()
    assert per == {i: len(WORD.findall(t or "")) + 1 for i, t in rows}
    long = got[got.doc_id == 999].sort_values("piece")
    assert (long.start.to_numpy()[1:] == np.cumsum(long.n_tokens)[:-1]).all()


def test_mixing_reaches_targets(spark):
    rng = random.Random(10)
    rows = [(i, ("plain words here " * rng.randint(5, 40)) if i % 4 else ("$$ %% ## " * rng.randint(5, 40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 4 else "bad") for i in range(0, 400, 3)], "doc_id long, domain string")
    mixed, reached = mixing.mix(docs, labels, {"good": 0.9, "bad": 0.1}, anchor="good")
    assert reached["good"] == pytest.approx(0.9, abs=0.01)
    rows = mixed.collect()
    total = sum(r.rate * r.n_tokens for r in rows)
    assert sum(r.rate * r.n_tokens * r.domains["bad"] for r in rows) / total == pytest.approx(0.1, abs=0.01)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)


def test_cells_by_ascending_distance():
    rng = np.random.default_rng(11)
    a, b = rng.random(6), rng.random(5)
    got = embedding_dedup.walk(a, b, 0.7)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and len(got) == int((a[:, None] + b <= a.min() + b.min() + 0.7).sum())


def test_embedding_links(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.15, 0.3)] + [base[:5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    real = u @ u.T >= 0.9
    np.fill_diagonal(real, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df, cell_size=8).collect()}
    assert all(got[i] <= real[i].sum() for i in got) and sum(got.values()) >= 0.9 * real.sum()


@pytest.mark.parametrize("kind", ["isotropic", "anisotropic", "clustered"])
def test_embedding_recall_on_planted_pairs(spark, kind):
    """Pairs planted at cosines from 0.9 on, many just above it, against brute force: nearly all are met, and none below is linked."""
    rng = np.random.default_rng(40)
    n, d = 1500, 32
    base = rng.normal(size=(n, d))
    if kind == "anisotropic":
        base *= np.geomspace(3, 0.1, d)
    if kind == "clustered":
        base = base * 0.35 + rng.normal(size=(30, d))[rng.integers(30, size=n)]
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cos = rng.choice([0.9005, 0.91, 0.95, 0.99, 0.85], n)[:, None]
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * noise]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    real = u @ u.T >= 0.9
    np.fill_diagonal(real, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= real.sum(1)).all() and links.sum() >= 0.98 * real.sum(), (links.sum(), real.sum())
    parts = brute_parts(real)
    assert all(got[i].component_id >= parts[i] and parts[got[i].component_id] == parts[i] for i in got)


def brute_parts(linked):
    out = list(range(len(linked)))
    for i in range(len(linked)):
        if out[i] == i:
            stack = [i]
            while stack:
                for j in np.flatnonzero(linked[stack.pop()]).tolist():
                    if out[j] == j and j > i:
                        out[j] = i
                        stack.append(j)
    return out


def test_language_model(spark):
    rng = random.Random(13)
    words = {k: [f"{k}{i}" for i in range(30)] for k in "xyz"}
    rows = [(i, " ".join(rng.choices(words[rng.choice("xyz")], k=rng.randint(1, 40)))) for i in range(300)] + [(1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 5 == 0)
    got = {r.doc_id: r for r in lm.score_texts(df, rounds=4, heads=20).collect()}
    seen = {}
    for i, t in rows:
        for w in [*(t or "").split(), "<end>"] if i % 5 else []:
            seen[w] = seen.get(w, 0) + 1
    n, v = sum(seen.values()), len(seen)
    for i, t in rows:
        own = [*(t or "").split(), "<end>"]
        assert got[i].base_score == pytest.approx(sum(np.log10((seen.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(w in seen for w in own), n)
    model = lm.LogBilinear(7, np.arange(7.0))
    seen_ = np.array([[a, b] for a in range(8) for b in range(8)])
    total = sum(np.exp(model.log_prob(seen_, np.full(64, w))) for w in range(7))
    assert np.allclose(total, 1, atol=1e-5)


@pytest.mark.parametrize("production", [True, False])
def test_language_model_in_many_partitions(spark, production):
    rng = random.Random(5)
    after = {w: rng.sample(range(60), 3) for w in range(60)}
    rows = []
    for i in range(1500):
        w, own = rng.randrange(60), []
        for _ in range(60):
            own.append(f"w{w}")
            w = rng.choice(after[w])
        rows.append((i, " ".join(own), i % 5 == 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    gain = []
    for parts in (2, 60):
        r = lm.score_texts(df.repartition(parts, "doc_id"), **({} if production else {"share": 20_000})).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
        gain.append((r["s"] - r["b"]) / r["n"])
    assert min(gain) > (0.2 if production else 0.02) and abs(gain[0] - gain[1]) < 0.05, gain


def chat_rows(n, seed=14):
    rng = random.Random(seed)
    return [(c, i, rng.choice(["user", None]) if i % 2 == 0 else rng.choice(["assistant", None]), rng.choice(["what is it?", "a long answer " * 9, "User: hm\nmore"])) for c, size in n for i in range(size)]


def test_transcripts_across_partitions(spark):
    rows = chat_rows([(1, 200), (2, 7), (3, 1)])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit_model(chat.dealt_rows(df, "conv_id", "turn", "text", "role"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = chat.parse_transcripts(df, model=model).orderBy("conv_id", "turn").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, blind = [], []
    for c in (1, 2, 3):
        own = [r for r in rows if r[0] == c]
        cut = [chat.lines_of(r[3], r[2]) for r in own]
        for hide, out in ((False, want), (True, blind)):
            seen = [chat.blinded(ls, r[3]) if hide else ls for ls, r in zip(cut, own, strict=True)]
            path = model.decode([x for ls in seen for x in ls])
            at = np.cumsum([0, *map(len, seen)])[:-1]
            out += [chat.ROLES[path[k]] for k in at]
    assert [r.role for r in many] == want and [r.blind_role for r in many] == blind
    assert "".join(r.rendered for r in many).count("<|end|>") == sum(r.n_turns for r in many)


def test_viterbi_against_all_paths():
    rng = random.Random(21)
    for _ in range(60):
        model = chat.Model({(w, a, b): rng.randint(0, 30) for w in range(5) for a in range(3) for b in range(chat.KINDS if w == chat.KIND else 4)})
        lines = [(rng.choice([0, 1, 2, chat.NONE, chat.HIDDEN]), rng.randrange(chat.KINDS), k == 0 or rng.random() < 0.5, "") for k in range(rng.randint(1, 6))]
        best = max(model.score(lines, list(p)) for p in itertools.product(range(3), repeat=len(lines)))
        assert model.score(lines, model.decode(lines)) == pytest.approx(best)
        cut = rng.randint(0, len(lines))
        if 0 < cut < len(lines):  # in two fragments, joined by the max-plus matrix
            head = model.begin(lines[0])
            for line in lines[1:cut]:
                head, _ = model.step(head, line)
            m = model.matrix(lines[cut:])
            assert max(head[q] + m[q][r] for q in range(3) for r in range(3)) == pytest.approx(best)


def test_hidden_roles_and_false_markers(spark):
    """Speakers are withheld from whole conversations, and some are named falsely: sizes and the sequence tell."""
    rng = random.Random(22)
    rows = []
    for c in range(300):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(1, 4)
        for t, role in enumerate(roles):
            size = {"system": 40, "user": 50, "assistant": 300}[role]
            rows.append((c, t, role, " ".join("w" * rng.randint(2, 8) for _ in range(max(3, int(rng.gauss(size, size / 4)))))))
    false = {k for k in range(len(rows)) if rng.random() < 0.02}
    named = [(c, t, None if c % 5 == 0 else "assistant" if k in false and r == "user" else r, x) for k, (c, t, r, x) in enumerate(rows)]
    df = spark.createDataFrame(named, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.parse_transcripts(df).collect()}
    hidden = [got[c, t].role == r for c, t, r, _ in rows if c % 5 == 0]
    assert sum(hidden) >= 0.97 * len(hidden)
    assert sum(got[c, t].blind_role == r for c, t, r, _ in rows) >= 0.97 * len(rows)
    lied = [got[rows[k][:2]].role == rows[k][2] for k in false if rows[k][2] == "user" and rows[k][0] % 5]
    assert len(lied) > 10 and sum(lied) >= 0.9 * len(lied)


def test_toxicity_learns(spark):
    rng = random.Random(15)
    plain = [f"p{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(plain, k=60)
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            w[rng.randrange(60)] = rng.choice(["Vile!", "nasty", "awful,"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab.where("doc_id % 4 <> 2"))
    got = toxicity.score(docs.where("doc_id % 4 = 2"), model).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in got)
    hit = next(r for r in got if r.passages)
    words = re.findall(r"\w+", rows[hit.doc_id][1][hit.passages[0].start : hit.passages[0].end].lower())
    assert words[0] in ("vile", "nasty", "awful") and words[-1] in ("vile", "nasty", "awful")


def test_packed_longs_shrink(spark):
    """Ascending ids take a fraction of their bytes once compressed (F1, F2); any longs come back as they were."""
    ids = np.sort(np.random.default_rng(3).integers(0, 1 << 27, 2000))
    assert len(pa.compress(jaccard._packed(ids), "lz4", asbytes=True)) < 0.5 * len(pa.compress(ids.tobytes(), "lz4", asbytes=True))
    for x in (ids, ids[::-1].copy(), np.array([np.iinfo(np.int64).min, np.iinfo(np.int64).max, -1, 0]), np.zeros(0, np.int64)):
        assert np.array_equal(jaccard._unpacked(jaccard._packed(x)), x)


def test_materialised_tables_leave_no_shuffle_files(spark):
    """the shuffles behind a checkpoint go with it; a plan used before can still be run again."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in blocks.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before = files()
    odd = spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count()
    kept = materialise(odd.join(odd.withColumnRenamed("count", "n"), "k").repartition(3, "n"))
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == odd.count() == 7


def shuffled_bytes(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_jaccard_shuffles_only_texts_that_may_link(spark, tmp_path):
    rng = random.Random(7)
    text = lambda: " ".join(f"{rng.getrandbits(480):x}" for _ in range(60))
    rows = [(i, text()) for i in range(600)]
    rows += [(600, rows[3][1] + " more"), (601, rows[9][1]), (602, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    name = "spark.sql.autoBroadcastJoinThreshold"
    held = {k: spark.conf.get(k, None) for k in (name, "spark.sql.optimizer.runtime.bloomFilter.numBits")}
    spark.conf.set(name, "-1")
    try:
        before = shuffled_bytes(spark)
        got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.read.parquet(str(tmp_path / "d"))).collect()}
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.unset(name) if held[name] is None else spark.conf.set(name, held[name])
    assert got == {i: {600: 3, 601: 9}.get(i, i) for i, _ in rows}
    assert moved < 0.5 * sum(len(t or "") for _, t in rows) / 2, moved  # hex texts shrink to about half
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.numBits", None) == held["spark.sql.optimizer.runtime.bloomFilter.numBits"]


class Caught:
    """Stands for a table; keeps the function that would run over its batches."""

    def __init__(self, schema=None):
        self.schema = schema

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def groupBy(self, *columns):  # noqa: N802
        return self

    def applyInArrow(self, *a):  # noqa: N802
        return self


def test_packing_keeps_no_texts(spark):
    """the keys that a task holds until its end don't keep the batches, with their texts, in memory."""
    caught = Caught(spark.createDataFrame([], "doc_id long, text string").schema)
    packing.pack(caught)
    grown = []
    held = lambda: pa.total_allocated_bytes() + tracemalloc.get_traced_memory()[0]

    def batches():
        made = pa.BufferOutputStream()
        with pa.ipc.new_stream(made, pa.schema({"doc_id": pa.int64(), "text": pa.string()})) as out:
            for k in range(12):
                out.write_batch(pa.record_batch({"doc_id": pa.array([k, -k]), "text": pa.array(["a b " * 250_000] * 2)}))
        before = held()
        for batch in pa.ipc.open_stream(io.BytesIO(made.getvalue().to_pybytes())):  # a batch is one buffer, as from Spark
            yield batch
            grown.append(held() - before)

    tracemalloc.start()
    try:
        got = pa.Table.from_batches(list(caught.run(batches())))
    finally:
        tracemalloc.stop()
    assert sorted(set(got["doc_id"].to_pylist())) == list(range(-11, 12))
    assert grown[-1] - grown[0] < 8_000_000, grown


def test_batches_are_worked_on_in_slices(spark, monkeypatch):
    """what is made of a batch is made of few rows at a time."""
    seen = textops.map_batches(spark.range(2500).coalesce(1), lambda b: {"rows": [b.num_rows] * b.num_rows}, "rows long")
    assert seen.agg(F.max("rows"), F.count("*"), F.countDistinct("id")).first()[:] == (1000, 2500, 2500)


def test_postings_take_little_beside_themselves():
    """a task's memory for postings is a few times their bytes, and their sets go."""
    caught = Caught()
    jaccard._prefix_table(caught, 75, 5, 24, 1)
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10_000, 600).tolist())) for _ in range(4500)]
    batch = pa.record_batch([pa.array(range(4500)), pa.array(texts)], ["doc", "t"])
    postings = 4500 * 209  # 596 shingles each, of which 149 + 60 are in a prefix
    tracemalloc.start()
    try:
        sent = [x for x in caught.run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(len(x) for b in sent for x in b.column(1).to_pylist()) == pytest.approx(4 * postings, rel=0.01)
    assert peak < 80 * postings, peak / postings


def near_copies(m):
    """m texts of 60 words of which up to a few are changed, so that some link and some don't."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    out = []
    for i in range(m):
        text = list(base)
        for k in rng.sample(range(60), rng.randint(0, 4)):
            text[k] = f"x{i}y{k}"
        out.append(" ".join(text))
    return out


def met_rows(spark, monkeypatch, texts):
    """(rows that met in blocks once pivots and first blocks were compared, rounds that it took, whether the components are right)."""
    met, join = [], jaccard._join_groups

    def seen(rows, percent):
        met.append(rows.count())
        return join(rows, percent)

    with monkeypatch.context() as m:
        m.setattr(jaccard, "_join_groups", seen)
        got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return sum(met[1:]), len(met) - 1, [got[i] for i in range(len(texts))] == brute_components([shingles(t) for t in texts])


def test_meetings_grow_with_the_family_not_its_square(spark, monkeypatch):
    """twice the near copies, about twice the rows with sets on disk."""
    for name, value in (("BLOCK", 3), ("PIVOTS", 1), ("COPIES", 5), ("HELD", 1 << 19)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    small, large = (met_rows(spark, monkeypatch, near_copies(m)) for m in (45, 90))
    assert small[2] and large[2] and small[0] > 45
    assert large[0] < 2.7 * small[0], (small, large)


def test_meetings_go_in_rounds(spark, monkeypatch):
    """where blocks can't grow, no round sends more than COPIES rows an open document, and no link is lost."""
    for name, value in (("BLOCK", 2), ("PIVOTS", 1), ("COPIES", 4), ("HELD", 1), ("ROUND", 1)):
        monkeypatch.setattr(jaccard, name, value, raising=False)
    rows, rounds, right = met_rows(spark, monkeypatch, near_copies(40))
    assert right and rounds > 1 and rows > 4 * 40, (rows, rounds)


def test_texts_stay_where_they_are_while_few_ids_go(spark, tmp_path):
    """near_duplicates filters the texts without a shuffle of them whatever Spark's own threshold is."""
    spark.createDataFrame([(k, f"{' '.join(f'word{x}' for x in range(40))} {k % 7}") for k in range(30)] + [(99, "something else")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(name, None)
    spark.conf.set(name, "1")
    try:
        kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "")
        assert {r.doc_id for r in kept.collect()} == {0, 99}
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(name) if held is None else spark.conf.set(name, held)
