"""Mixing documents to target domain weights, by soft membership and in DataFrame operations only.

A classifier fitted on a labelled table (Gaussian naive Bayes over surface features; its statistics are one group
aggregate, a row for each domain) gives every document a posterior over domains. Document rates r >= 0 are then fitted
so that the expected tokens of each domain, sum r n p_d, match the targets: accelerated projected-gradient least
squares in the token-weighted norm, from r = 1. A step needs one D-vector of totals over all documents, and a
document's rate after k steps follows from the k totals so far, so no state is stored between the steps.

Rates become whole copies by a hash draw: floor(r) plus one with probability frac(r). Defined cases: a null or empty
text has one token (its end) and posteriors by its features; without labelled rows (or in domains without any) the
posterior is the prior of the domains that have some, and one `unlabelled` domain if there are none. A target for a
domain without mass is dropped and the others rescaled. Repeated rows get equal rates; their draws differ by text and
id only. A null id draws like the empty text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.quality import count_of, surface_features
from rasterloom.session import materialise

#: Letters that set languages apart.
LETTERS = {"f_grave": "[éèêçÉÈÊÇ]", "f_umlaut": "[äöüßÄÖÜ]", "f_acute": "[ñóíáÑÓÍÁ]"}
FEATURES = ("f_size", "f_symbols", "f_capitals", "f_shouting", "f_repeats", "f_word", *LETTERS)


def _features(docs: DataFrame, text: str) -> DataFrame:
    """docs with _n (tokens) and the classifier's features."""
    rows = surface_features(docs, text)
    rows = rows.withColumns({name: count_of(F.col("_t"), letters) for name, letters in LETTERS.items()})
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    share = lambda c, of: F.least(F.lit(1.0), F.sqrt(F.col(c) / of))
    return rows.withColumns(
        {
            "_n": F.col("n_words") + 1,
            "f_size": F.log1p("n_words"),
            "f_symbols": share("n_symbols", words),
            "f_capitals": share("n_upper", F.greatest(F.col("word_chars"), F.lit(1)).cast("double")),
            "f_shouting": share("n_exclaim", words),
            "f_repeats": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
            "f_word": F.log1p(F.col("word_chars") / words),
            **{name: share(name, F.greatest(F.col("word_chars"), F.lit(1)).cast("double")) for name in LETTERS},
        }
    )


class Domains:
    """prior, means and variances of each domain's features."""

    def __init__(self, rows: list, least_var: float = 1e-3) -> None:
        rows = sorted(rows, key=lambda r: r["domain"])
        total = sum(r["n"] for r in rows)
        self.names = [r["domain"] for r in rows] or ["unlabelled"]
        self.prior = [r["n"] / total for r in rows] or [1.0]
        self.stats = [[(r[f"{f}_m"], max(r[f"{f}_v"] or 0.0, least_var)) for f in FEATURES] for r in rows] or [[]]

    def posterior(self) -> Column:
        """An array of probabilities in the order of names."""
        logs = [sum((-((F.col(f) - m) * (F.col(f) - m)) / (2 * v) - 0.5 * math.log(v) for f, (m, v) in zip(FEATURES, s, strict=False)), F.lit(math.log(p))) for p, s in zip(self.prior, self.stats, strict=True)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        parts = [F.exp(x - top) for x in logs]
        whole = sum(parts[1:], parts[0])
        return F.array(*[x / whole for x in parts])


def fit_domains(labelled: DataFrame) -> Domains:
    """labelled: FEATURES and `domain`, a row for each labelled document."""
    aggs = [a for f in FEATURES for a in (F.avg(f).alias(f"{f}_m"), F.var_pop(f).alias(f"{f}_v"))]
    return Domains(labelled.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), *aggs).collect())


_STEPS = "array<struct<d:array<double>,m:double>>"


def _steps(points: list[list[float]], momenta: list[float]) -> Column:
    return F.array(*[F.struct(F.array(*map(F.lit, d)).alias("d"), F.lit(m).alias("m")) for d, m in zip(points, momenta, strict=True)]).cast(_STEPS)


def _walk(steps: Column) -> Column:
    """A document's rate after the steps taken so far, and the one before, as struct<r, b>; each step has the D differences of totals from targets, and its momentum."""
    pull = lambda d: F.aggregate(F.zip_with(d, F.col("_p"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def step(s: Column, x: Column) -> Column:
        looked = s["r"] + x["m"] * (s["r"] - s["b"])
        return F.struct(F.greatest(F.lit(0.0), looked - pull(x["d"])).alias("r"), s["r"].alias("b"))

    return F.aggregate(steps, F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("b")), step)


def fit_rates(rows: DataFrame, names: list[str], targets: dict[str, float], *, anchor: str | None = None, rounds: int = 40, tolerance: float = 1e-3) -> tuple[Column, dict[str, float]]:
    """(the rate as a column over `_p`, each domain's share of tokens reached). rows: `_n` tokens and `_p` posteriors.

    The budget of tokens is that at which the anchor domain keeps what it has (default: all tokens there are).
    """
    cols = [F.sum(F.col("_n") * F.get("_p", k)).alias(f"t{k}") for k in range(len(names))]
    have = rows.agg(F.sum("_n").alias("n"), *cols).first()
    total = float(have["n"] or 0)
    if not total:
        return F.lit(1.0), {}
    mass = [float(have[f"t{k}"]) / total for k in range(len(names))]
    want = [max(0.0, targets.get(n, 0.0)) if m > 0 else 0.0 for n, m in zip(names, mass, strict=True)]
    if sum(want) <= 0:
        return F.lit(1.0), dict(zip(names, mass, strict=True))
    want = [w / sum(want) for w in want]
    if anchor in names and want[names.index(anchor)] > 0:
        budget = mass[names.index(anchor)] / want[names.index(anchor)]
        want = [w * budget for w in want]
    points: list[list[float]] = []
    momenta: list[float] = []
    t = 1.0
    reached = mass
    for _ in range(rounds):
        # totals at the point ahead of the last two rates, where the gradient is taken
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / after if points else 0.0
        # the steps come as a row of a broadcast table (an aggregate, so that they aren't folded into the plan as literals): all rounds run the same compiled code
        taken = F.broadcast(rows.sparkSession.range(1).agg(F.first(_steps(points, momenta)).alias("_steps"), F.first(F.lit(m)).alias("_m")))
        walked = rows.select("_n", "_p").crossJoin(taken).select("_n", "_p", "_m", _walk(F.col("_steps")).alias("_w"))
        ahead = walked.select("_n", "_p", (F.col("_w.r") + F.col("_m") * (F.col("_w.r") - F.col("_w.b"))).alias("_a"), F.col("_w.r").alias("_r"))
        got = ahead.agg(*[F.sum(F.col("_n") * F.get("_p", k) * F.col(f"_{a}")).alias(f"{a}{k}") for k in range(len(names)) for a in "ar"]).first()
        reached = [float(got[f"r{k}"]) / total for k in range(len(names))]
        if max(abs(x - w) for x, w in zip(reached, want, strict=True)) <= tolerance * sum(want):
            break
        points.append([float(got[f"a{k}"]) / total - w for k, w in enumerate(want)])
        momenta.append(m)
        t = after
    return _walk(_steps(points, momenta))["r"], {n: x / max(sum(reached), 1e-12) for n, x in zip(names, reached, strict=True)}


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], *, text: str = "text", key: str = "doc_id", anchor: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(key, _h (hash of the text), n_tokens, domains, rate, copies for each row of docs; shares of tokens reached).

    labels: key and `domain`, some of the documents' domains.
    """
    rows = _features(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text").select("_key", F.xxhash64("_t").alias("_h"), "_n", *FEATURES)
    rows = materialise(rows)
    known = labels.where(F.col("domain").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("domain").alias("domain"))
    model = fit_domains(rows.join(known, "_key").select("domain", *FEATURES))
    soft = materialise(rows.select("_key", "_h", "_n", model.posterior().alias("_p")))
    rate, reached = fit_rates(soft.select("_n", "_p"), model.names, targets, anchor=anchor)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("_key").cast("string"), F.lit("")), "_h", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    mixed = soft.withColumn("rate", rate).select(
        F.col("_key").alias(key), "_h", F.col("_n").alias("n_tokens"), F.map_from_arrays(F.array(*map(F.lit, model.names)), F.col("_p")).alias("domains"), "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies")
    )
    return mixed, reached


#: Share of tokens that each domain shall have: languages, and text of low quality in whichever language.
TARGETS = {"en": 0.55, "fr": 0.17, "de": 0.15, "es": 0.11, "low": 0.02}
ANCHOR = "en"


def label_domains(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Domains of the labelled documents."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, F.col("lang"))
    return labels.select("doc_id", "quality").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", domain.alias("domain"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    mixed, _ = mix(docs, labels, TARGETS, anchor=ANCHOR)
    p = lambda d: F.coalesce(F.element_at("domains", d), F.lit(0.0)).alias(f"p_{d}")
    return mixed.select("doc_id", "n_tokens", *map(p, TARGETS), "rate", "copies")
