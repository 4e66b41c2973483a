"""Hand-sized cases and properties of the library's operators."""

import hashlib
import itertools
import math
import random
import struct
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

from rasterloom.functions import order
from rasterloom.operators import automatic, baselines, components, diffusion, graph, modes, partition, prototypes, scene, selectors, spatial, stats, study
from rasterloom.operators import linkage as linkage_module
from rasterloom.session import fresh
from rasterloom.sources import envi, files, matlab, scenes


def table(spark, true, pred):
    return partition.contingency(spark.createDataFrame(list(zip(true, pred, strict=True)), "t int, p int"), "t", "p")


def test_metrics(spark):
    t = table(spark, [0, 0, 1, 1], [0, 0, 1, 2])
    assert partition.ari(t).first()["ari"] == pytest.approx(4 / 7)
    i = partition.information(t).first()
    assert (i["homogeneity"], i["completeness"], i["v_measure"], i["nmi"]) == pytest.approx((1, 2 / 3, 0.8, 0.8))
    assert partition.ari(table(spark, [1, 1, 1], [4, 4, 4])).first()["ari"] == 1
    e = partition.evaluate(spark.createDataFrame([(0, 99), (1, 4), (1, 4), (2, 8), (2, 8)], "t int, p int"), "t", "p")
    assert e["overall_accuracy"] == e["balanced_accuracy"] == e["kappa"] == e["nmi"] == e["ari"] == 1 and e["ami"] == pytest.approx(1)


def test_matching_beats_greedy(spark):
    rows = [(0, 0)] * 5 + [(0, 1)] * 4 + [(1, 0)] * 4
    assert partition.evaluate(spark.createDataFrame(rows, "t int, p int"), "t", "p", None)["overall_accuracy"] == pytest.approx(8 / 13)
    m = partition.hungarian_match(table(spark, [1, 1, 1], [5, 6, 7]))
    assert sorted(m.values()) == [-1, -1, 1]


@pytest.mark.parametrize(("classes", "clusters"), [(4, 40), (30, 5), (6, 6)])
def test_evaluation_against_plain_loops(spark, classes, clusters):
    """Matching by the largest cells alone loses nothing; every metric that hangs on it agrees with loops over the whole table."""
    rng = random.Random(classes)
    pairs = [(rng.randrange(classes), rng.randrange(clusters)) for _ in range(300)]
    pairs += [(c % classes, c % clusters) for c in range(200)]
    t = partition.contingency(spark.createDataFrame(pairs, "t int, p int"), "t", "p")
    gain = np.zeros((classes, clusters))
    for a, b in pairs:
        gain[a, b] += 1
    best = sum(gain[a, b] for a, b in partition.assignment(gain))
    found = partition.matched_pairs(t)
    assert len(found) == min(classes, clusters) == len({a for a, _ in found}) == len({b for _, b in found})
    assert sum(gain[a, b] for a, b in found) == best
    e = partition.evaluate(spark.createDataFrame(pairs, "t int, p int"), "t", "p", None)
    of = {b: a for a, b in found}
    assert e["cluster_to_class_mapping"] == of and e["overall_accuracy"] == pytest.approx(best / 500)
    size, guessed = gain.sum(1), [sum(gain[:, b].sum() for b in of if of[b] == a) for a in range(classes)]
    right = [sum(gain[a, b] for b in of if of[b] == a) for a in range(classes)]
    chance = sum(s * g for s, g in zip(size, guessed, strict=True)) / 500**2
    assert e["balanced_accuracy"] == pytest.approx(np.mean([r / s for r, s in zip(right, size, strict=True)]))
    assert e["kappa"] == pytest.approx((best / 500 - chance) / (1 - chance))
    assert {k: v for k, v in partition.hungarian_match(t).items() if v >= 0} == of


def test_evaluation_of_nothing_and_of_nulls(spark):
    e = partition.evaluate(spark.createDataFrame([], "t int, p int"), "t", "p", None)
    assert e["overall_accuracy"] == e["balanced_accuracy"] == 0 and e["ari"] == e["ami"] == e["nmi"] == 1 and e["cluster_to_class_mapping"] == {}
    t = partition.contingency(spark.createDataFrame([(1, None), (None, 3), (2, 3)], "t int, p int"), "t", "p")
    assert partition.matched_pairs(t) == [(2, 3)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
def test_assignment_is_best(rows, cols, random):
    gain = np.array([[random.randint(0, 9) for _ in range(cols)] for _ in range(rows)])
    got = partition.assignment(gain)
    k = min(rows, cols)
    best = max(sum(gain[a, b] for a, b in zip(r, c, strict=True)) for r in itertools.permutations(range(rows), k) for c in itertools.combinations(range(cols), k))
    assert sum(gain[a, b] for a, b in got) == best and len(got) == k


def test_expected_mi():
    """Against all arrangements of a small table."""
    t = [0, 0, 0, 1, 1]
    p = [0, 0, 1, 1, 1]
    total, n = 0.0, 0
    for q in itertools.permutations(p):
        for a, b in itertools.product((0, 1), repeat=2):
            k = sum(x == a and y == b for x, y in zip(t, q, strict=True))
            total += k / 5 * math.log(5 * k / (t.count(a) * p.count(b))) if k else 0
        n += 1
    assert partition.expected_mi([3, 2], [2, 3]) == pytest.approx(total / n)


def test_partition_stats(spark):
    s = lambda labels: partition.partition_stats(spark.createDataFrame([(x,) for x in labels], "l int"), "l").first()
    assert s([1, 1, 2, 2])[:3] == (2, 0.5, pytest.approx(1))
    assert s([1, 1, 1, 1])[:3] == (1, 1.0, 0.0)


def raster(spark, values, radius=None):
    rows = [(y * len(r) + x, y, x, [float(v)], int(v)) for y, r in enumerate(values) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, "i long, y long, x long, v array<double>, label int")


def test_majority(spark):
    got = {r.i: r.label for r in spatial.majority_filter(raster(spark, [[1, 1, 2], [1, 3, 2], [2, 2, 2]]), 1).collect()}
    assert [got[i] for i in range(9)] == [1, 1, 2, 1, 2, 2, 2, 2, 2]
    same = {r.i: r.label for r in spatial.majority_filter(raster(spark, [[1, 3], [2, 1]]), 0).collect()}
    assert [same[i] for i in range(4)] == [1, 3, 2, 1]


def test_topk_cap_and_tiles(spark):
    px = raster(spark, np.arange(9).reshape(3, 3) ** 2)
    top = graph.local_topk(graph.window_candidates(px, 1), 20, 1)
    assert {r["i"]: r["count"] for r in top.groupBy("i").count().collect()} == dict.fromkeys(range(9), 3)
    key = lambda df: sorted((r.i, r.j, r.rank, round(r.d2, 9)) for r in df.collect())
    big = raster(spark, np.random.default_rng(1).integers(0, 50, (7, 9)))
    for tile in (2, 5, 64):
        assert key(graph.tiled_topk(big, 2, 6, tile=tile)) == key(graph.local_topk(graph.window_candidates(big, 2), 6, 2))
    with pytest.raises(ValueError):
        graph.window_candidates(px, 0)


def test_mutual_and_repair(spark):
    px = raster(spark, np.random.default_rng(2).integers(0, 99, (6, 6)))
    top = graph.tiled_topk(px, 2, 4).persist()
    m = graph.mutual_edges(top)
    pairs = {(r.i, r.j) for r in m.collect()}
    assert pairs == {(b, a) for a, b in pairs}
    fixed = {(r.i, r.j) for r in graph.repaired_edges(top, m, 3, 4).collect()}
    degree = [sum(a == i for a, _ in fixed) for i in range(36)]
    assert min(degree) >= 3 and pairs <= fixed and fixed == {(b, a) for a, b in fixed}
    assert graph.repaired_edges(top, m, 0, 4) is m
    with pytest.raises(ValueError):
        graph.repaired_edges(top, m, 5, 4)


def path_graph(spark):
    px = spark.createDataFrame([(0, 0, 0, [0.0]), (1, 0, 1, [1.0]), (2, 0, 2, [0.0]), (3, 0, 3, [7.0])], "i long, y long, x long, v array<double>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)], "i long, j long, w double")
    return px, edges


def test_diffusion(spark):
    px, edges = path_graph(spark)
    state, history = diffusion.diffuse(px, edges, max_iter=1, tol=0.0)
    assert [r.y for r in state.orderBy("i").collect()] == [[0.5], [0.5], [0.5], [7.0]] and history == [0.5]
    for side, depth in ((None, None), (1, 1), (2, 2), (1, 4)):
        tiled = diffusion.diffuse_tiled(px, edges, [3, 6], anchor=0.2, side=side, depth=depth)
        for t in (3, 6):
            far, _ = diffusion.diffuse(px, edges, max_iter=t, tol=0.0, anchor=0.2)
            assert np.allclose([r.y for r in tiled.where(f"t = {t}").orderBy("i").collect()], [r.y for r in far.orderBy("i").collect()], atol=1e-12)
    with pytest.raises(ValueError):
        diffusion.diffusion_step(px, edges, anchor=1.0)
    early, seen = diffusion.diffuse(px, edges, max_iter=50, tol=0.6)
    assert len(seen) == 1


@pytest.mark.parametrize(("side", "depth", "held"), [(4, 1, 1 << 22), (5, 3, 8), (3, 7, 1), (64, 9, 1 << 22), (None, None, 1 << 22)])
def test_tiled_diffusion(spark, monkeypatch, side, depth, held):
    """Any tiles, any rounds in one go: the same as whole-scene rounds in numpy; holes, isolated pixels, an origin that isn't 0, edges up to three pixels long."""
    monkeypatch.setattr(diffusion, "HELD", held)
    rng = np.random.default_rng(5)
    yx = [(y, x) for y in range(-3, 14) for x in range(7, 20) if rng.random() < 0.85]
    n = len(yx)
    v = rng.normal(size=(n, 3))
    w = np.zeros((n, n))
    for a in range(n):
        for b in range(n):
            if a != b and a % 11 and max(abs(yx[a][0] - yx[b][0]), abs(yx[a][1] - yx[b][1])) <= 3 and rng.random() < 0.3:
                w[a, b] = rng.random()
    px = spark.createDataFrame([(10 + 2 * k, *yx[k], v[k].tolist()) for k in range(n)], PIXEL)
    edges = spark.createDataFrame([(10 + 2 * int(a), 10 + 2 * int(b), float(w[a, b])) for a, b in np.argwhere(w)], "i long, j long, w double")
    got = diffusion.diffuse_tiled(px, edges, [2, 9], side=side, depth=depth, radius=3 if side == 5 else None).collect()
    y, has = v.copy(), w.sum(1) > 1e-12
    for t in range(1, 10):
        y = np.where(has[:, None], 0.5 * y + 0.5 * (w @ y) / np.where(has, w.sum(1), 1)[:, None], y)
        if t in (2, 9):
            assert np.allclose([r.y for r in sorted((r for r in got if r.t == t), key=lambda r: r.i)], y, atol=1e-12)
    assert len(got) == 2 * n


def test_depth():
    """Small scenes do all rounds in one go, large ones as many as the halo is worth."""
    assert diffusion._depth(16, 7, 40, 50, 25) == 25
    assert 2 <= diffusion._depth(128, 7, 10**5, 10**5, 100) <= 12
    assert diffusion._depth(128, 7, 10**5, 10**5, 1) == 1


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(40)] + [(int(a), int(b)) for a, b in rng.integers(100, 200, (70, 2))] + [(500, 500 + k) for k in range(30)] + [(None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    few = {r.node: r.component for r in components.connected_components(df).collect()}
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == few
    assert few[40] == 0 and few[529] == 500
    assert components.connected_components(df.limit(0)).count() == 0


def test_knn_and_scale(spark):
    x = np.random.default_rng(3).normal(size=(60, 3)).round(1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = sorted((i, j) for i in range(60) for j in sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4])
    assert sorted((r.i, r.j) for r in modes.knn(df, 4, block=17).collect()) == want
    near = modes.knn(df, 4)
    assert modes.local_scale(near, 3) > 0
    with pytest.raises(ValueError):
        modes.local_scale(near, 30)


def test_prototypes():
    mu, disp, n = np.array([[0.0], [1.0], [10.0]]), np.ones(3), np.ones(3)
    assert prototypes.reciprocal_consolidate(mu, disp, n, 0.75)[0].tolist() == [0, 1, 2]
    group, rounds = prototypes.reciprocal_consolidate(mu, disp, n, 1.0)
    assert group.tolist() == [0, 0, 1] and rounds == 1
    assert prototypes.reciprocal_consolidate(mu, disp, n, 0.0)[0].tolist() == [0, 1, 2]


def test_dispersion_floor(spark):
    rows = [(0, [0.0], 0.0, 1), (1, [0.0], 0.5, 5), (2, [0.0], 1.0, 6), (3, [0.0], 2.0, 4)]
    assert prototypes.dispersion_floor(spark.createDataFrame(rows, "mode int, mu array<double>, disp double, n long")).first()["floor"] == pytest.approx(0.625)


def test_golden_selections(spark):
    from golden import PIXELS, curves
    from pyspark.sql import functions as F

    n = F.when(F.col("curve") == "longkou", PIXELS["longkou"]).otherwise(PIXELS["trento"])
    v1 = {r["curve"]: (r["tau"], r["k"]) for r in selectors.select_consolidation(curves(spark), n).collect()}
    assert v1 == {"longkou": (0.3, 221), "trento": (0.75, 68)}
    seg = {r["curve"]: (r["tau"], r["k"]) for r in selectors.select_segment(curves(spark)).collect()}
    assert seg == {"longkou": (0.5, 110), "trento": (0.75, 68)}
    assert selectors.select_v2([selectors.Candidate(0, 0, 0.0, 0.1, 5)], {}) is None
    assert selectors.choose_across_scales([selectors.Candidate(0, 0, 0.0, 0.1, 5)], {}) is None


def test_rank_tests(spark):
    assert stats.wilcoxon_exact([1, 2, 3, 4, 5, 6, 7, 8, 9]) == (0.0, 0.00390625)
    assert stats.wilcoxon_exact([-1, 2, 3, 4, -5, 6, 7, 8, 9]) == (6.0, 0.0546875)
    assert stats.chi2_survival(8.888889, 4) == pytest.approx(0.0639375, abs=1e-6)
    assert stats.chi2_survival(3.84145882, 1) == pytest.approx(0.05, abs=1e-6) and stats.chi2_survival(7.81472790, 3) == pytest.approx(0.05, abs=1e-6)
    p = [0.00390625] * 4 + [0.01953125, 0.02734375] + [0.9] * 10
    got = stats.holm(spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(p)], "t string, p double"), "p", "t")
    held = [r.pvalue_holm for r in got.orderBy("t").collect()]
    assert held[:6] == pytest.approx([0.0625] * 4 + [0.234375, 0.30078125])
    assert stats.block_size(99_600) == 16


def test_locks_and_perturbation(spark):
    labels = spark.createDataFrame([(i, i % 3) for i in range(50)], "i long, label int")
    c = study.Configuration()
    locked = study.lock(c, labels)
    study.check_lock(locked, c, labels.repartition(7))
    with pytest.raises(ValueError):
        study.check_lock(locked, c, labels.where("i <> 4"))
    assert study.reproduction(labels, labels) == 1.0
    px = spark.createDataFrame([(i, 0, i, [float(i), 1.0]) for i in range(400)], "i long, y long, x long, v array<double>")
    moved = study.replace_pixels(px, 0.2).where("v[0] <> i").count()
    assert 40 < moved < 120
    gapped = study.replace_pixels(px.withColumn("i", px.i * 2 + 7), 0.2)
    assert gapped.count() == 400 and gapped.where("v[0] <> (i - 7) / 2").count() > 40
    assert study.add_noise(px).where("v[1] = 1").count() == 400
    with pytest.raises(ValueError):
        study.discover(px.withColumn("gt", px.i))


def test_pca_keeps_distances(spark):
    x = np.random.default_rng(5).normal(size=(30, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    p = np.array([r.p for r in scene.pca(df, 4).orderBy("i").collect()])
    assert np.allclose(((p[:, None] - p[None]) ** 2).sum(-1), ((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.array([r.p for r in scene.pca(df, 3, standardise=True).orderBy("i").collect()])
    assert np.allclose(s.mean(0), 0) and np.allclose(s.std(0), 1)


def test_envi(spark, tmp_path):
    cube = np.arange(2 * 5 * 3, dtype="<i2").reshape(3, 5, 2)  # bands, lines, samples
    (tmp_path / "s.img").write_bytes(b"HEAD" + cube.tobytes() + b"trailing")
    (tmp_path / "s.hdr").write_text("ENVI\nlines = 5\nsamples = 2\nbands = 3\ndata type = 2\nheader offset = 4\nband names = {a,\n b,\n c}\n")
    assert envi.parse_header((tmp_path / "s.hdr").read_text())["band names"] == "a, b, c"
    got = envi.load_cube(spark, str(tmp_path / "s.hdr"), str(tmp_path / "s.img"), rows=2).orderBy("i").collect()
    assert [r.v for r in got] == cube.transpose(1, 2, 0).reshape(10, 3).tolist() and got[3].y == 1 and got[3].x == 1
    assert envi.align_axes((3, 5, 2), (5, 2)) == (1, 2, 0)
    with pytest.raises(ValueError):
        envi.align_axes((5, 5, 2), (5, 5))
    reader = envi._Reader({"path": "", "lines": 5, "samples": 2, "bands": 3, "data type": 2, "header offset": "4"})
    with open(tmp_path / "s.img", "rb") as f:
        assert reader.block_of(f, reader.partitions()[0]).column("v").to_pylist() == cube.transpose(1, 2, 0).reshape(10, 3).tolist()
    (tmp_path / "g.img").write_bytes(np.arange(10, dtype="u1").tobytes())
    (tmp_path / "g.hdr").write_text("ENVI\nlines = 5\nsamples = 2\nbands = 1\ndata type = 1\n")
    files_ = {"header": str(tmp_path / "s.hdr"), "cube": str(tmp_path / "s.img"), "truth_header": str(tmp_path / "g.hdr"), "truth": str(tmp_path / "g.img")}
    assert [r.gt for r in scenes.load_scene(spark, "envi", **files_).orderBy("i").collect()] == list(range(10))
    assert "gt" not in scenes.load_scene(spark, "envi", labels=False, **files_).columns
    with pytest.raises(ValueError):
        scenes.load_scene(spark, "none")
    facts = scenes.load_scene_facts(spark, "envi", **files_).first()
    assert (facts.height, facts.width, facts.bands, facts.pixels) == (5, 2, 3, 10)
    assert facts.wavelengths == [0, 1, 2] and facts.class_names == [str(c) for c in range(10)]
    (tmp_path / "s.hdr").write_text("ENVI\nlines = 5\nsamples = 2\nbands = 3\ndata type = 2\nheader offset = 4\nwavelength = {401.5,\n 410, 420.25}\n")
    facts = scenes.load_scene_facts(spark, "envi", labels=False, subsample=2, **files_).first()
    assert facts.wavelengths == [401.5, 410, 420.25] and facts.class_names is None and facts.pixels == 4
    empty = scenes.scene_facts(spark.createDataFrame([], "i long, y long, x long, v array<double>, gt int"), "whu_hi_honghu").first()
    assert empty.pixels == 0 and empty.height is None and empty.wavelengths is None and empty.class_names is None
    named = scenes.scene_facts(spark.createDataFrame([(0, 0, 0, [1.0], 3)], "i long, y long, x long, v array<double>, gt int"), "whu_hi_honghu").first()
    assert len(named.class_names) == 23 and named.class_names[3] == "Bare soil"


def test_empirical_scaling_of_odd_runs(spark):
    rows = [("a", 100, 50, 2.0, 1.0), ("a", 100, 50, 4.0, 2.0), ("b", 10, 0, 0.0, 0.0)]
    got = {r.scene: r for r in stats.empirical_scaling(spark.createDataFrame(rows, "scene string, n_pixels long, n_edges long, seconds double, graph double"), ("graph",)).collect()}
    assert (got["a"].seconds, got["a"].graph_mean, got["a"].graph_share) == (3, 1.5, 0.5) and got["a"].seconds_std == pytest.approx(math.sqrt(2))
    assert got["a"].pixels_per_second == pytest.approx(100 / 3) and got["a"].us_per_edge == pytest.approx(60000)
    assert got["b"].us_per_edge is None and got["b"].pixels_per_second is None and got["b"].seconds_std is None


def mat_file(arrays, order="<", compress=True):
    """A MATLAB level 5 file of numeric arrays, by the published format."""
    kinds = {"f8": (9, 6), "f4": (7, 7), "i2": (3, 10), "u1": (2, 9)}
    out = b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")

    def element(kind, data):
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    for name, a in arrays.items():
        kind, number = kinds[a.dtype.str[1:]]
        name_ = struct.pack(order + "HH", *((1, len(name)) if order == "<" else (len(name), 1))) + name.encode().ljust(4, b"\0") if len(name) <= 4 else element(1, name.encode())
        body = element(6, struct.pack(order + "II", number, 0)) + element(5, np.array(a.shape, order + "i4").tobytes()) + name_ + element(kind, a.astype(order + a.dtype.str[1:]).tobytes(order="F"))
        whole = element(14, body)
        if compress:
            packed = zlib.compress(whole)
            whole = struct.pack(order + "II", 15, len(packed)) + packed
        out += whole
    return out


@pytest.mark.parametrize(("order", "compress"), [("<", True), (">", True), ("<", False)])
def test_matlab(spark, tmp_path, order, compress):
    rng = np.random.default_rng(1)
    cube, truth = rng.integers(0, 900, (4, 6, 3)).astype("i2"), rng.integers(0, 5, (4, 6)).astype("u1")
    moved = np.ascontiguousarray(cube.transpose(2, 0, 1)).astype("f8")  # bands first
    (tmp_path / "c.mat").write_bytes(mat_file({"long_name": moved, "x": truth}, order, compress))
    (tmp_path / "KSC").mkdir()
    (tmp_path / "KSC/KSC_data.mat").write_bytes(mat_file({"KSC": moved}, order, compress))
    (tmp_path / "KSC/KSC_gt.mat").write_bytes(mat_file({"KSC_gt": truth}, order, compress))
    got = scenes.load_scene(spark, "ksc", data_dir=str(tmp_path)).orderBy("i").collect()
    assert [r.v for r in got] == cube.reshape(24, 3).tolist() and [r.gt for r in got] == truth.ravel().tolist() and (got[7].y, got[7].x) == (1, 1)
    blind = scenes.load_scene(spark, "matlab", labels=False, cube=str(tmp_path / "c.mat"), shape=(4, 6), subsample=2)
    assert "gt" not in blind.columns and blind.count() == 4
    with pytest.raises(ValueError):
        matlab.choose_array({"a": cube, "b": cube}, None, 3)
    with pytest.raises(ValueError):
        matlab.read_arrays(b"HDF" * 60)


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,n\nx,1\n".encode())
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "n"]
    assert df.collect()[0].asDict() == {"name": "x", "n": "1"}


def test_command_line(spark, tmp_path, capsys):
    import json

    from rasterloom.__main__ import main

    x = np.random.default_rng(9).normal(size=(60, 3))
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "scene"))
    spark.createDataFrame([(i, i % 3) for i in range(60)], "i long, gt int").write.parquet(str(tmp_path / "truth"))
    config = json.dumps({"pca_components": None, "k": 4, "window_radius": 2, "min_degree": 1, "checkpoint": 2, "max_neighbors": 6, "merge_components": 2})
    main(["select", str(tmp_path / "scene"), "--out", str(tmp_path / "out"), "--config", config])
    lock = capsys.readouterr().out.strip().splitlines()[-1]
    main(["evaluate", str(tmp_path / "out"), str(tmp_path / "truth"), "--lock", lock, "--config", config])
    assert 0 < json.loads(capsys.readouterr().out.strip().splitlines()[-1])["overall_accuracy"] <= 1
    with pytest.raises(ValueError):
        main(["evaluate", str(tmp_path / "out"), str(tmp_path / "truth"), "--lock", lock])
    main(["baseline", str(tmp_path / "scene"), "--out", str(tmp_path / "km"), "--clusters", "3", "--method", "fcm"])
    assert spark.read.parquet(str(tmp_path / "km")).count() == 60


def test_hdbscan_joins_separated_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0.0, 20.0, 60.0)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    tree = baselines.spanning_tree(points, k=10).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, 4]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, low = np.zeros(len(x), bool), reach[0].copy()
    inside[0], weight = True, 0.0
    for _ in range(len(x) - 1):
        at = int(np.where(inside, np.inf, low).argmin())
        weight += low[at]
        inside[at], low = True, np.minimum(low, reach[at])
    assert len(tree) == len(x) - 1 and sum(r["d"] for r in tree) == pytest.approx(weight)
    label = {r["i"]: r["label"] for r in baselines.hdbscan(points, k=10).collect()}
    parts = [{label[i] for i in range(a, a + 40) if label[i] >= 0} for a in (0, 40, 80)]
    assert all(parts) and not (parts[0] & parts[1] or parts[0] & parts[2] or parts[1] & parts[2])
    assert sum(v < 0 for v in label.values()) < 40


def partition_of(labels):
    """Sets of members of each cluster, and the noise."""
    sets: dict = {}
    for i, c in labels.items():
        sets.setdefault(c, set()).add(i)
    return set(map(frozenset, (s for c, s in sets.items() if c >= 0))), sets.get(-1, set())


def least_tree(x, min_size):
    """Edges of a least spanning tree of mutual reachability by Prim's algorithm, and its weight."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, 1)[:, min_size - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    inside, low, near, edges = np.zeros(len(x), bool), reach[0].copy(), np.zeros(len(x), int), []
    inside[0] = True
    for _ in range(len(x) - 1):
        at = int(np.where(inside, np.inf, low).argmin())
        edges.append((min(at, int(near[at])), max(at, int(near[at])), float(low[at])))
        inside[at] = True
        near = np.where(reach[at] < low, at, near)
        low = np.minimum(low, reach[at])
    return edges, reach


@pytest.mark.parametrize(("seed", "min_size", "most"), [(0, 5, 1000), (1, 5, 60), (2, 3, 45), (4, 2, 70)])
def test_hierarchy_in_classes(spark, monkeypatch, seed, min_size, most):
    """The same clusters as edge by edge, however the edges are cut into classes and buckets; ties too."""
    from rasterloom.operators import hierarchy

    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in ((0, 0.3, 60), (3, 0.2, 40), (3.8, 0.2, 30), (9, 1.5, 50))]).round(1)
    edges, _ = least_tree(x, min_size)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    want = brute.condense(edges, list(range(len(x))), min_size)
    monkeypatch.setattr(hierarchy, "TOGETHER", 30)
    got = {r["i"]: r["label"] for r in hierarchy.density_clusters(points, spark.createDataFrame(edges, "i long, j long, d double"), min_size, most).collect()}
    assert partition_of(got) == partition_of(want) and len(got) == len(x)
    assert sorted(set(got.values()) - {-1}) == list(range(len(set(got.values()) - {-1})))


def test_spanning_tree_by_groups(spark):
    """Groups and blocks give a tree of the least weight, also where components are far apart, nested, or of equal points."""
    from rasterloom.operators import hierarchy

    rng = np.random.default_rng(8)
    ring = rng.normal(size=(60, 3))
    x = np.concatenate([rng.normal(0, 0.1, (50, 3)), 8 * ring / np.linalg.norm(ring, axis=1)[:, None], rng.normal(30, 0.5, (40, 3)), np.full((12, 3), -20.0)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    edges, reach = least_tree(x, 5)
    tree = hierarchy.spanning_tree(points, 5, 6, 20).collect()
    assert len(tree) == len(x) - 1 and sum(r["d"] for r in tree) == pytest.approx(sum(e[2] for e in edges))
    assert all(r["d"] == pytest.approx(reach[r["i"], r["j"]]) for r in tree)


def test_hdbscan_small(spark):
    none = spark.createDataFrame([], "i long, v array<double>")
    assert baselines.hdbscan(none).collect() == []
    one = spark.createDataFrame([(7, [1.0, 2.0])], "i long, v array<double>")
    assert [tuple(r) for r in baselines.hdbscan(one).collect()] == [(7, -1)]


def test_baseline_queries_do_the_whole_job(monkeypatch):
    """The registered baselines leave the operators' numbers of steps and starts alone."""
    from rasterloom.plans import study_queries

    given_ = {}
    for name in ("kmeans", "minibatch_kmeans", "fuzzy_cmeans", "slic_kmeans", "communities"):
        monkeypatch.setattr(baselines, name, lambda *a, _n=name, **kw: given_.setdefault(_n, set(kw)))
    for name in ("_features", "_graph"):
        monkeypatch.setattr(study_queries, name, lambda *a: None)
    for q in (study_queries.kmeans_baseline, study_queries.minibatch_baseline, study_queries.fcm_baseline, study_queries.slic_baseline, study_queries.leiden_baseline):
        q(None, "")
    assert len(given_) == 5 and not set().union(*given_.values()) & {"n_init", "max_iter", "rounds", "levels"}


def regions(seed=1, side=14, bands=6, noise=0.35):
    """A raster of three regions: (rows, vectors, positions, truth)."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1.5, (3, bands))
    yx = [(y, x) for y in range(side) for x in range(side)]
    truth = [1 + (x >= side // 2) + (x >= side // 2 and y >= side // 2) for y, x in yx]
    v = np.array([centre[t - 1] for t in truth]) + rng.normal(0, noise, (len(yx), bands))
    return [(i, y, x, v[i].tolist()) for i, (y, x) in enumerate(yx)], v, yx, truth


PIXEL = "i long, y long, x long, v array<double>"
SMALL = study.Configuration(pca_components=4, k=8, window_radius=3, min_degree=3, checkpoint=6, fine_radius=0.5, filter_radius=1, max_neighbors=9, merge_components=3, prototype_threshold=0.8, size_exponent=0.5)


@pytest.mark.parametrize(("seed", "tile"), [(1, 128), (2, 128), (1, 3)])
def test_discovery_against_plain_loops(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(diffusion, "LEAST_TILE", min(16, tile))
    monkeypatch.setattr(diffusion, "MOST_TILE", tile)
    rows, v, yx, truth = regions(seed)
    got = study.discover(spark.createDataFrame(rows, PIXEL), SMALL).orderBy("i").collect()
    fine, final = brute.discover(v, yx, components_=4, k=8, radius=3, least=3, rounds=6, space_components=3, neighbours=8, fine_radius=0.5, filter_radius=1, tau=0.8, beta=0.5)
    assert brute.same_partition([r.fine for r in got], fine) and brute.same_partition([r.label for r in got], final)
    assert 1 < len(set(final)) <= len(set(fine)) < len(rows)
    if tile > 3:
        e = partition.evaluate(spark.createDataFrame([(t, r.label) for t, r in zip(truth, got, strict=True)], "gt int, label int"), "gt", "label", 0)
        pairs = [max(itertools.permutations(sorted(set(final)), min(3, len(set(final)))), key=lambda c: sum(a == dict(zip(c, (1, 2, 3), strict=False)).get(b) for a, b in zip(truth, final, strict=True)))]
        to = dict(zip(pairs[0], (1, 2, 3), strict=False))
        assert e["overall_accuracy"] == pytest.approx(sum(t == to.get(b) for t, b in zip(truth, final, strict=True)) / len(truth)) or len(set(final)) > 3
        assert e["ari"] == pytest.approx(brute.ari(truth, final))


def test_one_call_clustering_against_plain_loops(spark):
    rows, v, yx, _ = regions(3, side=10)
    df = spark.createDataFrame(rows, PIXEL)
    edges = graph.build_graph(df, pca_components=None, k=6, window_radius=2, min_degree=2)
    weighted = graph.affinities(graph.spectral_edges(edges, df))
    got = [r.label for r in diffusion.cluster(df, weighted.select("i", "j", "w"), max_iter=3, tol=0.0, merge_tol=0.6, merge_components=3).orderBy("i").collect()]
    e = brute.graph(v, yx, 6, 2, 2)
    assert {(r.i, r.j) for r in edges.collect()} == e
    space = brute.scores(brute.diffuse(v, brute.weights(v, yx, e), 3), 3, True)
    assert got == brute.fine_modes(space, 49, 0.6)


def test_movement_of_every_round(spark):
    rows, v, yx, _ = regions(4, side=6)
    df = spark.createDataFrame(rows, PIXEL)
    e = brute.graph(v, yx, 5, 2, 1)
    w = brute.weights(v, yx, e)
    edges = spark.createDataFrame([(i, j, float(w[i, j])) for i, j in e], "i long, j long, w double")
    state, history = diffusion.diffuse(df, edges, max_iter=6, tol=0.0)
    steps = [brute.diffuse(v, w, t) for t in range(7)]
    assert history == pytest.approx([np.linalg.norm(b - a, axis=1).max() for a, b in itertools.pairwise(steps)])
    assert np.allclose([r.y for r in state.orderBy("i").collect()], steps[-1])
    _, short = diffusion.diffuse(df, edges, max_iter=50, tol=history[2] * 1.0001)
    assert short == pytest.approx(history[:3])


def test_automatic_selection_against_plain_loops(spark):
    rows, v, yx, truth = regions(5, side=12, noise=0.6)
    grid = automatic.Grid(checkpoints=(2, 5), gammas=(0.6, 0.8), taus=(0.0, 0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5), betas=(0.0, 0.5), rank=3)
    config = study.Configuration(pca_components=None, k=6, window_radius=2, min_degree=2, filter_radius=1, max_neighbors=7, merge_components=3)
    found = automatic.candidates(spark.createDataFrame(rows, PIXEL), config, grid)
    z = brute.zscore(v)
    w = brute.weights(z, yx, brute.graph(z, yx, 6, 2, 2))
    want, labels, surface = [], [], {}
    for beta in grid.betas:
        for t, rounds in enumerate(grid.checkpoints):
            space = brute.scores(brute.diffuse(z, w, rounds), 3, True)
            scale = brute.local_scale(space, 3)
            for g, gamma in enumerate(grid.gammas):
                fine = brute.majority(brute.fine_modes(space, 6, gamma * scale), yx, 1)
                curve = [[group[m] for m in fine] for group in (brute.consolidate(brute.prototypes(space, fine), tau, 30, beta) for tau in grid.taus)]
                pick, told = brute.local_endpoint(curve, len(set(fine)))
                surface |= {(t, g, beta, tau): (n, pytest.approx(s)) for tau, (n, s) in zip(grid.taus, told, strict=True)}
                if pick is not None:
                    want.append((t, g, beta, grid.taus[pick], told[pick][0]))
                    labels.append(curve[pick])
    assert {(r.t_index, r.g_index, r.beta, r.tau): (r.k, r.stability) for r in found.surface.collect()} == surface
    assert [(c.t, c.g, c.beta, c.tau, c.k) for c in found.entries] == want and len(want) >= 3
    for k, own in enumerate(labels):
        assert brute.same_partition([r.label for r in found.labels(k).orderBy("i").collect()], own)
    assert found.ari == {(a, b): pytest.approx(brute.ari(labels[a], labels[b])) for a, b, _ in selectors._peers(found.entries)}
    gt = spark.createDataFrame(list(enumerate(truth)), "i long, gt int")
    ranked = automatic.calibrate({"one": (found, gt), "two": (found, gt.withColumn("gt", gt.gt % 2))}).collect()
    assert len(ranked) == 75 and [r.position for r in ranked] == list(range(1, 76))
    order = [(-r.coverage, -(r.structural_score if r.structural_score is not None else -1), -r.stability_min, r.compression_max, -r.beta_agreement_min) for r in ranked]
    assert order == sorted(order)
    for r in ranked[::25]:
        pick = selectors.select_v2(found.entries, found.ari, selectors.Rule(r.stability_min, r.compression_max, r.beta_agreement_min))
        assert r.coverage == (0 if pick is None else 2)
        if pick is not None:
            assert r.mean_ari == pytest.approx((brute.ari(truth, labels[pick]) + brute.ari([x for x in (t % 2 for t in truth) if x], [b for b, t in zip(labels[pick], truth, strict=True) if t % 2])) / 2)


def test_protocol_grids():
    c = study.Configuration()
    a = study.ablations(c)
    assert a["graph_no_mutual_gate"].min_degree == 0 and a["mode_no_fine_grouping"].filter_radius == 0 and len(a) == 8
    s = study.sensitivity(c)
    assert list(s) == ["window_radius=3", "window_radius=5", "window_radius=7", "window_radius=9", "pca_components=10", "pca_components=20", "pca_components=30", "pca_components=40", "checkpoint=6", "checkpoint=12", "checkpoint=25", "checkpoint=50", "fine_radius=0.075", "fine_radius=0.1125", "fine_radius=0.15", "fine_radius=0.1875", "fine_radius=0.225"]
    assert len(study.sensitivity(c, fast=True)) == 12
    assert len(selectors.all_rules()) == 75 and selectors.RULE_GRID["stability_min"][1] == 0.825


def test_pruned_neighbours_are_exact(spark, monkeypatch):
    monkeypatch.setattr(modes, "PIVOTS", 7)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.5, (90, 3)) for c in (0.0, 6.0, 20.0)] + [np.zeros((5, 3))])
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    want = sorted((3 * i, 3 * j, r + 1) for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:5]))
    assert sorted((r.i, r.j, r["rank"]) for r in modes.knn(df, 5, block=25).collect()) == want


def test_median_of_many(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=4001), rng.integers(0, 5, 3000).astype(float), np.concatenate([np.ones(2000), rng.random(1999)])):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        assert order.median(df, "x", few=100) == pytest.approx(float(np.median(values)))
    assert order.median(df.limit(0), "x") is None


@pytest.mark.parametrize(("radius", "tile"), [(1, 4), (2, 5), (3, 64)])
def test_majority_against_plain_loops(spark, radius, tile):
    rng = random.Random(radius)
    yx = [(y, x) for y in range(11) for x in range(9) if rng.random() < 0.9]
    labels = [rng.randint(0, 3) for _ in yx]
    df = spark.createDataFrame([(i, y, x, c) for i, ((y, x), c) in enumerate(zip(yx, labels, strict=True))], "i long, y long, x long, label int")
    assert [r.label for r in spatial.majority_filter(df, radius, tile=tile).orderBy("i").collect()] == brute.majority(labels, yx, radius)


def test_expected_mi_of_large_tables():
    """The bounded sums against all terms."""
    rows, cols = [700, 300, 1500], [1200, 1000, 200, 100]
    n = sum(rows)
    lg = math.lgamma
    total = 0.0
    for a, b in itertools.product(rows, cols):
        for k in range(max(1, a + b - n), min(a, b) + 1):
            total += k / n * math.log(n * k / (a * b)) * math.exp(lg(a + 1) + lg(b + 1) + lg(n - a + 1) + lg(n - b + 1) - lg(n + 1) - lg(k + 1) - lg(a - k + 1) - lg(b - k + 1) - lg(n - a - b + k + 1))
    assert partition.expected_mi(rows, cols) == pytest.approx(total, rel=1e-9)


@pytest.mark.parametrize("beta", [0.0, 0.5])
def test_consolidation_against_plain_loops(spark, beta):
    rng = np.random.default_rng(6)
    modes_ = {3 * m: [rng.normal(size=3), float(rng.uniform(0.5, 1.5)), int(rng.integers(1, 60))] for m in range(25)}
    df = spark.createDataFrame([(m, x[0].tolist(), x[1], x[2]) for m, x in modes_.items()], "mode long, mu array<double>, disp double, n long")
    want = brute.consolidate(modes_, 1.2, 6, beta)
    assert 1 < len(set(want.values())) < 20
    assert {r["mode"]: r.group for r in prototypes.consolidate_rounds(df, 1.2, k=6, size_exponent=beta).collect()} == want
    number = {g: k for k, g in enumerate(sorted(set(want.values())))}
    for most in (4096, 0):
        assert {r["mode"]: r.group for r in prototypes.consolidate_modes(df, 1.2, k=6, size_exponent=beta, most=most).collect()} == {m: number[g] for m, g in want.items()}


@pytest.mark.parametrize("beta", [0.0, 0.5])
def test_merge_until_against_plain_loops(beta):
    rng = np.random.default_rng(7)
    mu, disp, n = rng.normal(size=(18, 3)), rng.uniform(0.5, 1.5, 18), rng.integers(1, 50, 18).astype(float)
    modes_ = {m: [mu[m], disp[m], n[m]] for m in range(18)}
    group = {m: m for m in modes_}
    while len(modes_) > 5:
        mid = max(float(np.median([x[2] for x in modes_.values()])), 1.0)
        s = {m: x[1] / (x[2] / mid) ** beta for m, x in modes_.items()}
        a, b = min(itertools.combinations(modes_, 2), key=lambda p: float(np.linalg.norm(modes_[p[0]][0] - modes_[p[1]][0])) / math.sqrt((s[p[0]] ** 2 + s[p[1]] ** 2) / 2))
        (u, x, p), (v, y, q) = modes_[a], modes_.pop(b)
        mean = (p * u + q * v) / (p + q)
        modes_[a] = [mean, math.sqrt((p * (x * x + ((u - mean) ** 2).sum()) + q * (y * y + ((v - mean) ** 2).sum())) / (p + q)), p + q]
        group = {k: a if g == b else g for k, g in group.items()}
    assert brute.same_partition(prototypes.merge_until(mu, disp, n, 5, beta).tolist(), [group[m] for m in range(18)])


@pytest.mark.parametrize(("linkage", "block"), [("single", 2048), ("average", 2048), ("average", 9), ("complete", 9)])
def test_linkages_against_plain_loops(spark, linkage, block):
    """The groups of one merge at a time, also where modes meet block against block."""
    rng = np.random.default_rng(9)
    n = 50
    x, disp = rng.normal(size=(n, 2)), rng.uniform(0.5, 1.5, n)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) / np.sqrt((disp[:, None] ** 2 + disp**2) / 2)
    groups = [[i] for i in range(n)]
    how = {"single": np.min, "average": np.mean, "complete": np.max}[linkage]
    while len(groups) > 1:
        value, a, b = min((float(how(d[np.ix_(p, q)])), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(groups), 2))
        if value > 0.6:
            break
        groups[a] += groups.pop(b)
    want = {3 * i: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    modes_ = spark.createDataFrame([(3 * i, x[i].tolist(), float(disp[i]), i + 1) for i in range(n)], "mode int, mu array<double>, disp double, n long")
    assert {r["mode"]: r.group for r in linkage_module.linkage_groups(modes_, 0.6, linkage, block=block).collect()} == want


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkages_of_equal_and_no_modes(spark, linkage):
    rows = [(m, [float(v)], 1.0, 2) for m, v in [(5, 0), (1, 0), (9, 0), (2, 7), (4, 7), (3, 20)]]
    kind = "mode long, mu array<double>, disp double, n long"
    modes_ = spark.createDataFrame(rows, kind)
    got = {r["mode"]: r.group for r in linkage_module.linkage_groups(modes_, 0.0, linkage).collect()}
    assert got == {1: 0, 5: 0, 9: 0, 2: 1, 4: 1, 3: 2}
    assert {r.group for r in linkage_module.linkage_groups(modes_, 1e9, linkage).collect()} == {0}
    assert linkage_module.linkage_groups(spark.createDataFrame([], kind), 1.0, linkage).collect() == []
    with pytest.raises(ValueError):
        linkage_module.linkage_groups(modes_, 1.0, "ward")


def test_baseline_features_are_truncated_scores(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6)) * np.array([1, 5, 1, 1, 0.1, 1])
    x[:, 5] = 2.0
    got = np.array([r.v for r in baselines.features(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>"), 3).orderBy("i").collect()])
    z = (x - x.mean(0)) / np.where(x.std(0) == 0, 1, x.std(0))
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]))


def blobs(n=40, seed=11, centres=(0.0, 8.0, 30.0)):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, 0.6, (n, 3)) for c in centres]), np.repeat(range(len(centres)), n).tolist()


def test_kmeans_baselines(spark):
    x, truth = blobs()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    best = sum(((x[np.array(truth) == c] - x[np.array(truth) == c].mean(0)) ** 2).sum() for c in range(3))
    for run in (lambda: baselines.kmeans(df, 3, n_init=3), lambda: baselines.minibatch_kmeans(df, 3), lambda: baselines.minibatch_kmeans(df, 3, batch=30), lambda: baselines.count_matched(df, None, "kmeans", partition=df.selectExpr("i", "i % 3 as label"))):
        label = np.array([r.label for r in run().orderBy("i").collect()])
        cost = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))
        assert brute.same_partition(label.tolist(), truth) and cost == pytest.approx(best)
    support = df.where("i < 40")
    two = baselines.count_matched(df, None, "minibatch", partition=df.selectExpr("i", "case when i < 40 then i % 2 else i end as label"), support=support)
    assert two.select("label").distinct().count() == 2
    with pytest.raises(ValueError):
        baselines.count_matched(df, 3, "fcm", most_cells=10)


def test_fuzzy_cmeans_against_numpy(spark):
    x, _ = blobs(20, 12, (0.0, 3.0))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").repartition(5)
    u = np.stack([np.random.default_rng((0, i)).random(3) for i in range(len(x))])
    u /= u.sum(1, keepdims=True)
    for _ in range(150):
        centres = (u * u).T @ x / (u * u).sum(0)[:, None]
        inv = 1 / np.maximum(((x[:, None] - centres[None]) ** 2).sum(-1), 1e-12)
        new = inv / inv.sum(1, keepdims=True)
        moved, u = np.abs(new - u).max(), new
        if moved < 1e-4:
            break
    got = [r.label for r in baselines.fuzzy_cmeans(df, 3).orderBy("i").collect()]
    assert got == u.argmax(1).tolist()


def test_superpixels_are_connected(spark):
    rng = random.Random(13)
    owner = [(y * 12 + x, y, x, rng.randint(0, 1), 0) for y in range(12) for x in range(12)]
    regions_ = {r.i: r.region for r in baselines.connected_regions(spark.createDataFrame(owner, "i long, y long, x long, gy long, gx long"), 10).collect()}
    near = lambda i, j: abs(i // 12 - j // 12) + abs(i % 12 - j % 12) == 1
    for name in set(regions_.values()):
        own = [i for i, r in regions_.items() if r == name]
        assert len(set(brute.components(144, [(i, j) for i in own for j in own if near(i, j)])[i] for i in own)) == 1 and min(own) == name
    sizes = [list(regions_.values()).count(r) for r in set(regions_.values())]
    assert min(sizes) >= 5 or len(sizes) == 1
    rows, _, _, truth = regions(14, side=16, noise=0.2)
    got = [r.label for r in baselines.slic_kmeans(spark.createDataFrame(rows, PIXEL), 3, size=16, rounds=4, n_init=4).orderBy("i").collect()]
    assert brute.ari(truth, got) > 0.7
    with pytest.raises(ValueError):
        baselines.slic_kmeans(spark.createDataFrame(rows, PIXEL), 300, size=64, rounds=1)


def modularity(edges, labels, resolution=1.0):
    total = sum(w for *_, w in edges)
    degree = {}
    for i, _, w in edges:
        degree[i] = degree.get(i, 0) + w
    inside = sum(w for i, j, w in edges if labels[i] == labels[j])
    return inside / total - resolution * sum(sum(degree[i] for i in degree if labels[i] == c) ** 2 for c in set(labels.values())) / total**2


@pytest.mark.parametrize("few", [400_000, 0])
def test_communities(spark, few):
    """Planted groups are found, communities are connected, and merging two of them improves nothing (in one task, and by rounds)."""
    rng = random.Random(15)
    n, group = (48, 8) if few else (12, 6)
    pairs = {(a, b) for a in range(n) for b in range(a) if rng.random() < (0.6 if few else 0.9) and a // group == b // group or rng.random() < 0.03}
    edges = [(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))]
    df = spark.createDataFrame(edges, "i long, j long, w double")
    label = {r.i: r.label for r in baselines.communities(df, rounds=8 if few else 3, levels=3 if few else 1, iterations=2 if few else 1, few=few).collect()}
    planted = {i: i // group for i in label}
    assert modularity(edges, label) >= modularity(edges, planted) - (1e-9 if few else 0.2)
    assert not few or brute.ari([label[i] for i in sorted(label)], [planted[i] for i in sorted(label)]) > 0.9
    for c in set(label.values()):
        own = [i for i in label if label[i] == c]
        assert min(own) == c and few == 0 or len({x for i, x in enumerate(brute.components(n, [(a, b) for a, b in pairs if label[a] == label[b] == c])) if i in own}) == 1
    if few:
        for a, b in itertools.combinations(set(label.values()), 2):
            assert modularity(edges, {i: b if c == a else c for i, c in label.items()}) <= modularity(edges, label) + 1e-9


def test_leiden_protocol(spark):
    rng = random.Random(16)
    pairs = {(a, b) for a in range(24) for b in range(a) if rng.random() < (0.8 if a // 8 == b // 8 else 0.05)}
    df = spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "i long, j long, w double")
    chosen, table, labels = baselines.leiden_selected(df, (0.2, 1.0, 3.0), (0, 1), (0,))
    rows = {r.resolution: r for r in table.collect()}
    assert chosen == 1.0 and rows[1.0].k == 3 and rows[1.0].interior and not rows[0.2].interior
    runs = {(r.resolution, r.seed, r.i): r.label for r in baselines.leiden_protocol(df, [0.2, 1.0, 3.0], [0, 1]).collect()}
    one = lambda g, s: [runs[g, s, i] for i in range(24)]
    assert rows[1.0].seed_ari == pytest.approx(brute.ari(one(1.0, 0), one(1.0, 1)))
    assert rows[1.0].adjacent_ari == pytest.approx(sum(sum(brute.ari(one(a, s), one(b, s)) for s in (0, 1)) / 2 for a, b in ((0.2, 1.0), (1.0, 3.0))) / 2)
    assert brute.same_partition([r.label for r in labels.orderBy("i").collect()], [i // 8 for i in range(24)])


def test_leiden_takes_every_batch_of_edges_and_each_run_a_task(spark):
    """beyond one Arrow batch all edges count, and the runs of a grid don't wait for each other in one task."""
    pairs = [(8 * c + a, 8 * c + b) for c in range(6) for a in range(8) for b in range(a)] + [(8 * c, 8 * c + 8) for c in range(5)]
    df = spark.createDataFrame([(x, y, 1.0) for a, b in pairs for x, y in ((a, b), (b, a))], "i long, j long, w double")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, "25")
    try:
        found = {r.i: r.label for r in baselines.communities(df).collect()}
        runs = baselines.leiden_protocol(df, [0.5, 1.0], [0, 1])
        assert runs.rdd.getNumPartitions() == 4 and runs.count() == 4 * 48
    finally:
        spark.conf.set(name, held)
    assert brute.same_partition([found.get(i) for i in range(48)], [i // 8 for i in range(48)])
    chosen, _, labels = baselines.leiden_selected(df, (0.5, 1.0), (0, 1), (0, 2))
    own = {(r.seed, r.i): r.label for r in labels.collect()}
    for seed in (0, 2):  # a seed of both lists is not run again
        assert {i: own[seed, i] for i in range(48)} == {r.i: r.label for r in baselines.communities(df, resolution=chosen, seed=seed).collect()}
    assert len(own) == 96


def test_files(spark, tmp_path):
    (tmp_path / "w/data").mkdir(parents=True)
    (tmp_path / "w/release").mkdir()
    contents = {"a.PY": b"x", "data/b.bin": b"yy", "release/c.zip": b"z", "n b+%1.ipynb": b"{}", ".hidden": b"h", "d.tar.zip": b""}
    for name, content in contents.items():
        (tmp_path / "w" / name).write_bytes(content)
    got = {r.relative_path: r for r in files.manifest(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.size_bytes, r.sha256) for k, r in got.items()} == {k: (len(c), hashlib.sha256(c).hexdigest()) for k, c in contents.items()}
    assert {k: (r.suffix, r.category) for k, r in got.items()} == {"a.PY": (".py", "supplied_code_or_output"), "data/b.bin": (".bin", "third_party_or_raw_data"), "release/c.zip": (".zip", "included_release"), "n b+%1.ipynb": (".ipynb", "historical_notebook"), ".hidden": ("", "other_excluded"), "d.tar.zip": (".zip", "historical_archive")}
    sizes = spark.createDataFrame([("big.py", 25 * 1024 * 1024), ("x/tmp/y.md", 5), ("q.log", 1)], "p string, n long")
    from pyspark.sql import functions as F

    assert [r.c for r in sizes.select(files.file_class(F.col("p"), F.col("n")).alias("c")).collect()] == ["large_excluded", "temporary_or_build", "temporary_or_build"]
    assert {r.relative_path for r in files.list_files(spark, str(tmp_path / "w"), skip=("data", "release")).collect()} == set(contents) - {"data/b.bin", "release/c.zip"}


def test_manifest_in_pieces(spark, tmp_path, monkeypatch):
    """no task reads a large file whole: pieces by one task after another give the digest of the whole, also under a mount; elsewhere the driver's JVM digests what the reader passes over."""
    rng = random.Random(21)
    sizes = {"none": 0, "one": 1, "piece": 1000, "more": 1001, "two": 2000, "large +%1.bin": 4_321, ".git/large": 2_999, "_few": 7, "sub/block": 64}
    contents = {name: rng.randbytes(n) for name, n in sizes.items()}
    for name, content in contents.items():
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_bytes(content)
    (tmp_path / "io").mkdir()
    plain, notes = files.digest_further, str(tmp_path / "io")

    def watched(path, size, at, state, piece):
        out = plain(path, size, at, state, piece)
        context = TaskContext.get()
        with open(f"{notes}/{context.stageId()}-{context.partitionId()}", "a") as f:
            f.write(f"{out[2] - at}\n")
        return out

    monkeypatch.setattr(files, "digest_further", watched)
    want = {name: (len(content), hashlib.sha256(content).hexdigest()) for name, content in contents.items()}
    got = files.manifest(spark, str(tmp_path / "w"), piece=1000).collect()
    assert len(got) == len(want) and {r.relative_path: (r.size_bytes, r.sha256) for r in got} == want
    tasks = [[int(n) for n in p.read_text().split()] for p in (tmp_path / "io").iterdir()]
    assert sum(map(sum, tasks)) == sum(sizes[n] for n in ("more", "two", "large +%1.bin", ".git/large", "_few"))
    assert max(map(max, tasks)) <= 1000 and max(map(sum, tasks)) < 2000
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pieces.link./w", f"file://{tmp_path}/w")
    got = files.manifest(spark, "viewfs://pieces/w", piece=1000).collect()
    assert len(got) == len(want) and {r.relative_path: (r.size_bytes, r.sha256) for r in got} == want
    assert sum(int(n) for p in (tmp_path / "io").iterdir() for n in p.read_text().split()) == 2 * sum(map(sum, tasks))  # opened where the mount leads
    got = {r.relative_path: (r.size_bytes, r.sha256) for r in files.manifest(spark, "viewfs://pieces/", piece=1000).collect()}  # no folder of file:
    assert {name: got[f"w/{name}"] for name in ("none", ".git/large", "_few")} == {name: want[name] for name in ("none", ".git/large", "_few")}
    assert {r.relative_path for r in files.manifest(spark, str(tmp_path / "w"), skip=(".git",), piece=1000).collect()} == set(sizes) - {".git/large"}


def test_digest_further(tmp_path, monkeypatch):
    """pieces that end within a block of SHA-256, a file that became shorter, Python without OpenSSL's library."""
    path, content = str(tmp_path / "f"), random.Random(22).randbytes(3 * 1024 * 1024 + 5)
    (tmp_path / "f").write_bytes(content)
    for piece in (999_983, 1024 * 1024, len(content), len(content) + 1):
        row, calls = files.digest_further(path, len(content), piece=piece), 1
        while row[4] is None:
            assert row[2] == calls * piece
            row, calls = files.digest_further(*row[:4], piece=piece), calls + 1
        assert row[4] == hashlib.sha256(content).hexdigest() and calls == -(-len(content) // piece)
    with pytest.raises(OSError, match="shorter"):
        files.digest_further(path, len(content) + 1)
    half = files.digest_further(path, len(content), piece=1024 * 1024)
    monkeypatch.setattr(files, "_openssl", lambda: None)
    assert [files.digest_further(*row, piece=1000)[4] for row in ((path, len(content)), half[:4])] == [hashlib.sha256(content).hexdigest()] * 2


def test_states_tables_and_fairness(spark, tmp_path):
    path = str(tmp_path / "states")
    for k in (1, 2):
        files.write_states(spark.range(6).selectExpr("id % 2 as t", "id as i", f"array(id * {k}.0D) as v"), path, "t", about={"round": k})
        rows, about = files.read_states(spark, path)
        assert about == {"round": k} and {r.i: r.v[0] for r in rows.collect()} == {i: i * k for i in range(6)}
    assert [p.name for p in tmp_path.iterdir()] == ["states"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"a": 1,\n "b": [1, 2]}')
    assert files.read_json(spark, str(tmp_path / "j")).first().b == [1, 2]
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("y", 2.5)], "s string, f double")
    files.write_csv([a, b], str(tmp_path / "u"))
    back = files.read_csv(spark, str(tmp_path / "u"))
    assert back.columns == ["n", "s", "f"] and {(r.n, r.s, r.f) for r in back.collect()} == {("1", "x", None), (None, "y", "2.5")}
    rows = spark.createDataFrame([("b", "m1"), ("a", "m2"), ("z", "m1"), ("a", "m1"), ("a", "other")], "dataset string, method string")
    assert [tuple(r) for r in files.export_table(rows, ["m2", "m1"], order=["z", "a"]).collect()] == [("z", "m1"), ("a", "m2"), ("a", "m1"), ("b", "m1")]
    fair = files.fairness(spark).collect()
    assert len(fair) == 7 and [r.receives_true_K for r in fair] == ["no"] + ["yes"] * 6 and {r.labelled_tuning for r in fair} == {"no"}


def test_profile_and_repeatability(spark):
    rows, _, _, truth = regions(17, side=8)
    got = study.profile(spark.createDataFrame(rows, PIXEL), SMALL, 1)
    assert {"load_graph", "affinity", "diffusion", "modes_merge", "total", "peak_memory_mb", "fine_modes", "clusters"} <= got[0].keys() and got[0]["n_pixels"] == 64 and got[0]["peak_memory_mb"] > 100
    a = spark.createDataFrame([(i, i % 4) for i in range(64)], "i long, label int")
    r = study.repeatability(a, a.withColumn("label", a.label % 2), spark.createDataFrame([(i, t % 3) for i, t in enumerate(truth)], "i long, gt int")).first()
    own = [(i % 4, i % 2) for i in range(64) if truth[i] % 3]
    assert (r.k_difference, r.n_labelled) == (-2, len(own)) and r.ari_labelled == pytest.approx(brute.ari(*zip(*own, strict=True)))


def plain_ranks(values, descending=False):
    """Mean ranks; nulls below all."""
    key = lambda x: (x is not None, x if x is not None else 0)
    order = sorted(map(key, values), reverse=descending)
    return [order.index(key(x)) + (order.count(key(x)) + 1) / 2 for x in values]


def test_ranks_by_prefix_sums(spark):
    """Ties, nulls, groups over all partitions, null groups; rows keep their columns."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 0.5, *map(float, range(40))]), rng.choice([1, 1, 1, 2, 3]), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y long, k long").repartition(7)
    for value, col, down in (("x", 1, False), ("x", 1, True), ("y", 2, True)):
        got = {r.k: r["rank"] for r in stats.average_rank(df, ["g"], value, down).collect()}
        for g in ("a", "b", None):
            own = [r for r in rows if r[0] == g]
            assert [got[r[3]] for r in own] == plain_ranks([r[col] for r in own], down)
    rho = {r.g: (r.rho, r.n) for r in stats.spearman(df, ["g"], "x", "y").collect()}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        want = np.corrcoef(plain_ranks([r[1] for r in own]), plain_ranks([r[2] for r in own]))[0, 1]
        assert rho[g][0] == pytest.approx(want) and rho[g][1] == len(own)
    assert stats.spearman(df.where("g = 'b'").withColumn("y", df["k"] * 0), ["g"], "x", "y").first()["rho"] is None
    windows = stats.average_rank(df, ["g"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in windows and "rank(" not in windows


def test_grid_peers_are_linear(spark):
    cells = [(0.5 * b, t, g, 100 * b + 10 * t + g) for b in range(2) for t in range(4) for g in range(4)]
    df = spark.createDataFrame([*cells, (0.0, 1, 1, 999)], "beta double, t_index long, g_index long, candidate long")
    got = {(r.a, r.b): (r.a_members, r.b_members, r.axis) for r in selectors.grid_peers(df).collect()}
    want = {(100 * b + 10 * t + g, 100 * b + 10 * u + h): "t" if u > t else "gamma" for b in range(2) for t in range(4) for g in range(4) for u, h in ((t + 1, g), (t, g + 1)) if u < 4 and h < 4}
    assert {k: v[2] for k, v in got.items()} == want and got[11, 21][:2] == (2, 1)
    assert {(r.a, r.b, r.a_members) for r in selectors.beta_peers(df).collect()} == {(10 * t + g, 100 + 10 * t + g, 2 if (t, g) == (1, 1) else 1) for t in range(4) for g in range(4)}


def test_bandwidths_are_medians_of_all_edges(spark):
    """Beyond 50,000 edges too, and with few distinct grid distances."""
    edges = spark.range(120_001).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("d"), F.when(F.col("id") % 5 < 2, 1.0).otherwise(F.sqrt(F.lit(2.0))).alias("sp"))
    got = graph.bandwidths(edges).first()
    d = np.sort([r["d"] for r in edges.select("d").collect()])
    assert got["sigma_spectral"] == d[60_000] and got["sigma_spatial"] == pytest.approx(2**0.5, abs=1e-15)
    assert tuple(graph.bandwidths(edges.limit(0)).first()) == (1e-6, 1e-6)


def test_estimated_sizes_stay_bounded_in_loops(spark):
    """A round that joins what stems from the round before must not multiply the estimate's digits."""
    df = spark.range(5).withColumn("n", F.col("id") + 1)
    for _ in range(8):
        df = fresh(df.join(df.select("id", F.col("n").alias("m")), "id").join(df.select("id"), "id").select("id", (F.col("n") + F.col("m")).alias("n")))
    assert int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 10**40
    assert sorted(r["n"] for r in df.collect()) == [256 * k for k in range(1, 6)]


def test_linkage_of_a_long_chain_of_merges(spark):
    """one merge a round for 12 rounds; the distances grow along the line."""
    at = [0.0]
    for k in range(12):
        at.append(at[-1] + 1 + 0.5 * k)
    df = spark.createDataFrame([(k, [x], 100.0, 1) for k, x in enumerate(at)], "mode long, mu array<double>, disp double, n long")
    for how in ("average", "complete"):
        assert {r["group"] for r in linkage_module.linkage_groups(df, 1e6, how).collect()} == {0}


def test_peers_list_every_pair(spark, monkeypatch):
    """All candidates of a cell, not its lowest one alone; in chunks too."""
    rows = [(u, u % 4, u // 4 % 4, u // 16 % 2) for u in range(0, 300, 2)] + [(u, u % 4, u // 4 % 4, u // 16 % 2) for u in range(1, 90, 2)]
    df = spark.createDataFrame(rows, "candidate long, t_index long, g_index long, beta long")
    near = lambda x, y: abs(x[1] - y[1]) + abs(x[2] - y[2])
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0]]
    for together in (4096, 3):
        monkeypatch.setattr(selectors, "TOGETHER", together)
        got = sorted(map(tuple, selectors.grid_pairs(df).collect()))
        assert got == sorted((x[0], y[0], "t" if x[1] != y[1] else "gamma") for x, y in pairs if x[3] == y[3] and near(x, y) == 1)
        assert sorted(map(tuple, selectors.beta_pairs(df).collect())) == sorted((x[0], y[0]) for x, y in pairs if x[3] != y[3] and near(x, y) == 0)


_plain_best = modes._best


def test_neighbours_meet_in_lots(spark, monkeypatch):
    """A point goes once to each lot of groups in reach, however small the blocks; the lists are exact."""
    x = np.random.default_rng(8).normal(size=(600, 3))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "i long, v array<double>")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = {(k, int(j), r + 1) for k in range(600) for r, j in enumerate(np.argsort(far[k], kind="stable")[:5])}
    met = []
    for task in (16_384, 120):
        monkeypatch.setattr(modes, "TASK", task)
        rows = []
        monkeypatch.setattr(modes, "_best", lambda parts, k: rows.append(parts.count()) or _plain_best(parts, k))
        got = modes.knn(df, 5, block=20)
        assert {(r["i"], r["j"], r["rank"]) for r in got.collect()} == want
        met.append(rows[0])
    assert met[0] == 600 * 5 < met[1]  # one lot: no more lists than points


def test_neighbours_sort_nothing_before_they_are_sent(spark, monkeypatch):
    """a task holds one meeting of lots; its lists are sent as they are, without a sort of what it found."""
    x = np.random.default_rng(9).normal(size=(400, 3))
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "i long, v array<double>")
    monkeypatch.setattr(modes, "TASK", 100)
    found = modes.knn(df, 5, block=20)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 400 * 5
    above = plan.index("Window")
    below = plan.index("FlatMapCoGroupsInArrow")
    exchange = plan.rindex("Exchange", 0, below)
    assert above < exchange and "Sort" not in plan[exchange:below] and "WindowGroupLimit" not in plan[exchange:below]
    assert "REPARTITION_BY_NUM" in plan[exchange:below] and plan[below:].count("REPARTITION_BY_NUM") == 2


def test_neighbours_are_searched_in_rounds(spark, monkeypatch):
    """the copies of a round grow with the points, not with their square; the lists are exact, ties and repeated vectors too."""
    for n in (40, 160):  # lots that all points ask
        lots = [(h, 100 * n + n * 100) for h in range(n)]
        turns = modes._rounds(lots, 8 * 100 * n)
        assert sorted(turns) == list(range(n)) and max(turns.values()) == n // 4 - 1
        assert max(sum(c for h, c in lots if turns[h] == t) for t in set(turns.values())) <= 8 * 100 * n
    assert modes._rounds([(0, 9), (1, 2), (2, 50), (3, 1)], 10) == {0: 0, 1: 1, 2: 2, 3: 3}
    x = np.random.default_rng(18).normal(size=(300, 30)).round(1)
    x[200:260] = x[:60]
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "i long, v array<double>")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(far, np.inf)
    want = {(k, int(j), r + 1) for k in range(300) for r, j in enumerate(np.argsort(far[k], kind="stable")[:5])}
    monkeypatch.setattr(modes, "TASK", 40)
    kept = []
    monkeypatch.setattr(modes, "_merged", lambda lists, n, k, one=modes._merged: kept.append(n) or one(lists, n, k))
    assert {(r["i"], r["j"], r["rank"]) for r in modes.knn(df, 5, block=20).collect()} == want
    assert kept and max(kept) <= (1 + modes.SENT) * 300


def test_neighbours_beyond_the_bound_are_not_sorted():
    """a meeting looks only within a point's bound, in single precision first; what it finds is exact, near the origin and far from it."""
    rng = np.random.default_rng(5)
    for shift, scale in ((0.0, 1.0), (1e6, 1.0), (0.0, 1e-9), (3e20, 1e19)):
        x = rng.normal(size=(400, 6)) * scale + shift
        x[390:] = x[:10]
        far = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
        np.fill_diagonal(far, np.inf)
        table = lambda own: pa.table({"i": pa.array(own), "v": pa.array(x[own].tolist(), pa.list_(pa.float64()))})
        left, right, bound = np.arange(0, 400, 7), np.arange(400), np.sort(far, 1)[::7, 2]
        whole = modes._nearest(5)(table(left), table(right))
        within = modes._nearest(5)(table(left).append_column("bound", pa.array(bound)), table(right))
        want = {i: sorted(zip(far[i].tolist(), range(400), strict=True))[:5] for i in left.tolist()}
        lists = lambda t: {i: list(zip(d, j, strict=True)) for i, j, d in zip(*(t.column(c).to_pylist() for c in "ijd"), strict=True)}
        assert lists(whole) == want
        assert all(found == want[i][: len(found)] and len(found) >= 3 for i, found in lists(within).items()) and len(lists(within)) == len(left)
        if (shift, scale) == (0.0, 1.0):
            assert sum(map(len, lists(within).values())) < 4 * len(left)


def test_local_scale_searches_once(spark):
    """the search behind the median runs once, not once for each look at its values."""
    runs = spark.sparkContext.accumulator(0)

    def once(batches):
        runs.add(1)
        yield from batches

    near = spark.createDataFrame([(k, k + 1, float(k), 2) for k in range(9)], "i long, j long, d double, rank int").coalesce(1).mapInArrow(once, "i long, j long, d double, rank int").repartition(2, "i")
    assert modes.local_scale(near, 2) == 4.5
    assert runs.value == 1
    modes.median(near, "d")
    assert runs.value >= 3  # as it was


def test_kmeans_runs_share_their_passes(spark, monkeypatch):
    """a pass over the points serves a round of all runs; the result is the best of Spark ML's own runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(14).normal(size=(90, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    rows = df.select("i", array_to_vector("v").alias("features")).persist()
    models = [KMeans(k=4, seed=run, maxIter=300, initMode="k-means||").fit(rows) for run in range(3)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    want = [r.prediction for r in best.transform(rows).orderBy("i").collect()]
    rows.unpersist()
    passes, one = [], baselines._round
    monkeypatch.setattr(baselines, "_round", lambda centres, ends: passes.append(len(ends) - 1) or one(centres, ends))
    assert [r.label for r in baselines.kmeans(df, 4, n_init=3).orderBy("i").collect()] == want
    assert passes[0] == 3 and len(passes) == max(m.summary.numIter for m in models)
