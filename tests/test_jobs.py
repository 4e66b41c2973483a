"""Both jobs: against SQL, rerun, over growing input, after a failure, on odd and empty tables, and from the command line."""

import math
import os
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import growing_agreement, text_regions
from jobs.queries import ORACLE, QUERIES
from rasterloom.operators import partition, prototypes

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, region string, distance double, batch long, pair string, t string"
PAIRS = {"a": ["lang", "source"], "b": ["source", "cast(n_chars % 3 as string)"]}


def plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, int | float) else str(x)


def listed(df):
    return sorted(map(repr, (tuple(map(plain, r)) for r in df.select(sorted(df.columns)).collect())))


def documents(n, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = " ".join("".join(draw.choice("aeinorstlhdcuxyz") for _ in range(draw.randint(1, 8))) for _ in range(draw.randint(0, 12)))
        rows.append((i, draw.choice([words, words, words, None, ""]), draw.choice(["en", "fr", None]), draw.choice(["s1", "s2", "s3", None]), draw.choice([len(words), None]), "r", 0.5, 9, "q", "z"))
    return rows


def write(spark, folder, rows, labels=()):
    spark.createDataFrame(rows, DOCS).write.mode("append").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, region string").write.mode("overwrite").parquet(f"{folder}/labels.parquet")


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    state = lambda: (sorted(map(tuple, spark.sql("SET").where("key like 'spark.sql.%'").collect())), [t.name for t in spark.catalog.listTables()], len(spark.streams.active))
    before = state()
    ours = QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    theirs = con.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert listed(ours) == sorted(map(repr, (tuple(None if x is None or x != x else plain(x) for x in r) for r in theirs[sorted(theirs.columns)].itertuples(index=False))))
    assert before == state()


def test_regions(spark, tmp_path):
    rows = documents(200)
    write(spark, tmp_path, [*rows, rows[3], (None, "tea", "en", "s1", 3, "r", 0.5, 9, "q", "z")], [(i, i % 2, None if i % 5 else 1, "x") for i in range(0, 200, 3)])
    config = {"letters": "aeinor", "regions": 2, "references": ["lang", "quality", "toxic"]}
    args = f"{tmp_path}/documents.parquet", f"{tmp_path}/labels.parquet", f"{tmp_path}/out"
    first = listed(text_regions.run(spark, *args, config))
    assert listed(text_regions.run(spark, *args, config)) == first
    got = spark.read.parquet(f"{tmp_path}/out/regions").collect()
    assert len(got) == 202

    # by plain loops
    share = {}
    for k, (i, text, _, source, *_) in enumerate([*rows, rows[3], (None, "tea", "en", "s1")]):
        n = [(text or "").count(c) for c in "aeinor"]
        share[k] = i, source, [c / max(1, sum(n)) for c in n]
    mean = [sum(v[d] for _, _, v in share.values()) / len(share) for d in range(6)]
    std = [math.sqrt(sum((v[d] - mean[d]) ** 2 for _, _, v in share.values()) / len(share)) for d in range(6)]
    z = {k: (i, s, [(v[d] - mean[d]) / std[d] for d in range(6)]) for k, (i, s, v) in share.items()}
    size = {}
    for _, s, _ in z.values():
        size[s] = size.get(s, 0) + (s is not None)
    top = sorted((s for s in size if s), key=lambda s: (-size[s], s))[:2]
    mu = {s: [sum(v[d] for _, o, v in z.values() if o == s) / size[s] for d in range(6)] for s in top}
    want = sorted((str(i), *reversed(min((round(math.dist(v, m), 6), s) for s, m in mu.items()))) for i, _, v in z.values())
    assert sorted((str(r.doc_id), r.region, r.distance) for r in got) == want

    # a run over one reference leaves the others
    text_regions.run(spark, *args, config | {"references": ["lang"]})
    assert {r.reference for r in spark.read.parquet(f"{tmp_path}/out/agreement").collect()} == {"lang", "quality", "toxic"}


def test_regions_empty(spark, tmp_path):
    write(spark, tmp_path, [])
    assert text_regions.run(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/labels.parquet", f"{tmp_path}/out").collect() == []
    write(spark, tmp_path, [(1, None, None, None, None, "r", 0.5, 9, "q", "z")])
    rows = text_regions.run(spark, f"{tmp_path}/documents.parquet", f"{tmp_path}/labels.parquet", f"{tmp_path}/out").collect()
    assert [(r.part, r.name, r.item, r.value) for r in rows] == [("region", None, "1", None)]


def final(spark, out):
    """The metrics after the last batch, rounded."""
    rows = spark.read.schema(growing_agreement.AGREEMENT).parquet(f"{out}/agreement").collect()
    last = max((r.batch for r in rows), default=None)
    return {r.pair: [round(r[m], 9) for m in partition.AGREEMENT] for r in rows if r.batch == last}


def at_once(spark, folder):
    table = growing_agreement.cells(spark.read.parquet(f"{folder}/documents.parquet"), PAIRS)
    return {r.pair: [round(r[m], 9) for m in partition.AGREEMENT] for r in partition.agreement(table, "pair").collect()}


def test_growing(spark, tmp_path):
    args = f"{tmp_path}/documents.parquet", f"{tmp_path}/out", f"{tmp_path}/mark", {"pairs": PAIRS, "max_files": 1}
    write(spark, tmp_path, [])
    assert growing_agreement.run(spark, *args).collect() == []
    write(spark, tmp_path, documents(40, 1))
    first = growing_agreement.run(spark, *args)
    assert final(spark, args[1]) == at_once(spark, tmp_path)
    before, batches = listed(first), {r.batch for r in growing_agreement.counts(spark, args[1]).collect()}
    assert listed(growing_agreement.run(spark, *args)) == before  # nothing new
    write(spark, tmp_path, documents(60, 2))
    after = listed(growing_agreement.run(spark, *args))
    assert final(spark, args[1]) == at_once(spark, tmp_path)
    assert set(before) <= set(after)  # earlier batches and their metrics stay
    assert {r.batch for r in growing_agreement.counts(spark, args[1]).collect()} > batches

    # the end of the last batch gets lost: it is done again, and replaces itself
    done = sorted((p for p in Path(args[2], "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    os.remove(done[-1])
    (done[-1].parent / f".{done[-1].name}.crc").unlink(missing_ok=True)
    assert listed(growing_agreement.run(spark, *args)) == after


def test_growing_odd(spark, tmp_path):
    write(spark, tmp_path, [(1, None, None, None, None, None, None, None, None, None)] * 3)
    args = f"{tmp_path}/documents.parquet", f"{tmp_path}/out", f"{tmp_path}/mark", {"pairs": PAIRS, "max_files": None}
    assert growing_agreement.run(spark, *args).collect() == []
    write(spark, tmp_path, [(1, None, "en", "s1", 4, None, None, None, None, None)] * 3)
    growing_agreement.run(spark, *args)
    assert final(spark, args[1]) == at_once(spark, tmp_path)
    assert final(spark, args[1])["a"][:5] == [3, 1, 1, 0, 0]


def test_running_agreement(spark):
    """After each batch, what the table so far says."""
    draw = random.Random(3)
    rows = [(draw.choice("xy"), draw.randint(0, 5), draw.choice("abc"), draw.choice("pqrs"), draw.randint(1, 4)) for _ in range(80)]
    deltas = spark.createDataFrame(rows, "g string, batch long, t string, p string, n long")
    got = {(r.g, r.batch): r for r in partition.running_agreement(deltas, "g").collect()}
    for g, batch in {(r[0], r[1]) for r in rows}:
        so_far = deltas.where((F.col("g") == g) & (F.col("batch") <= batch)).groupBy("g", "t", "p").agg(F.sum("n").alias("n"))
        want = partition.agreement(so_far, "g").first()
        assert all(got[g, batch][m] == pytest.approx(want[m], abs=1e-9) for m in partition.AGREEMENT)
    assert len(got) == len({(r[0], r[1]) for r in rows})


def test_nearest_prototype(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])], "i long, v array<double>")
    modes = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [0.0, 0.0])], "mode string, mu array<double>")
    got = {r.i: (r["mode"], r.distance) for r in prototypes.nearest_prototype(points, modes, digits=6).collect()}
    assert got == {1: ("a", 0.0), 2: ("a", 1.0), 3: ("b", round(math.dist((5, 5), (2, 0)), 6))}
    with pytest.raises(ValueError, match="2 prototypes"):
        prototypes.nearest_prototype(points, modes, most=1)


def test_command_line(spark, tmp_path):
    write(spark, tmp_path, documents(20), [(1, 1, 0, "x")])
    out = f"{tmp_path}/out"
    run = subprocess.run([sys.executable, "-m", "jobs.growing_agreement", "--documents", f"{tmp_path}/documents.parquet", "--out", out, "--checkpoint", f"{tmp_path}/mark"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "new rows" in run.stderr and "wrote batch 0" in run.stderr
    assert spark.read.schema(growing_agreement.AGREEMENT).parquet(f"{out}/agreement").count() == 3
