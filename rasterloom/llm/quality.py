"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good, bad or abstains on a document. How often each rule votes what on good and on bad documents is
estimated by expectation-maximisation over the counts of vote patterns (at most 3^rules rows, whatever the corpus),
and a document is kept if its posterior probability of being good is at least one half, unless it fails the base
rules. The corpus is read once; its features, a few numbers a document, go to the checkpoint folder.

Defined cases: a null or empty text has no words and fails. A document on which all rules abstain has the prior as its
posterior. An empty table gives an empty result. Repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import materialise

SPACE = " \t\n\x0b\f\r"
SYMBOLS, UPPER = "[#*$%&|<>]", "[A-Z]"


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a class the text has; the matcher skips the rest without making strings."""
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def word_array(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def surface_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column `_w` (array of words) and counts of characters, words and lines; `_t` is the text, null as empty."""
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumns({"_w": word_array(t), "_l": lines})
    return rows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": count_of(t, SYMBOLS),
            "n_upper": count_of(t, UPPER),
            "n_exclaim": count_of(t, "!"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        }
    ).drop("_l")


def repeated_words(rows: DataFrame) -> DataFrame:
    """rows of surface_features with n_repeat_words: words in 3-word windows that the text holds twice or more.

    The windows' hashes are sorted as plain numbers; those beside an equal one repeat. Where none does, which is the rule,
    that is all; few different ones are looked up window by window; many are found by sorting hashes with their places.
    """
    places = F.when(F.size("_w") >= 3, F.sequence(F.lit(0), F.size("_w") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_h", F.transform(places, lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    rows = rows.withColumn("_s", F.sort_array("_h"))
    rows = rows.withColumn("_d", F.array_distinct(F.filter("_s", lambda x, k: x == F.get("_s", k - 1))))
    looked_up = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_d", F.get("_h", i)))
    rows = rows.withColumn("_p", F.when(F.size("_d") > FEW_REPEATED, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda k: F.get("_p", k)["h"]
    twice = F.filter("_p", lambda x, k: F.coalesce(near(k - 1) == x["h"], F.lit(False)) | F.coalesce(near(k + 1) == x["h"], F.lit(False)))
    at = F.when(F.size("_d") == 0, F.array().cast("array<int>")).when(F.size("_d") <= FEW_REPEATED, looked_up).otherwise(F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    n = F.aggregate(at, start, lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])
    return rows.withColumn("n_repeat_words", n.cast("long")).drop("_h", "_s", "_d", "_p")


#: So many different repeated windows are looked up one by one; more are found by sorting, with the same result.
FEW_REPEATED = 16
GOOD, BAD, ABSTAIN = 1, 0, 2


def _votes(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes by the features of a document."""
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    per = lambda c: F.col(c) / words
    mean, capitals, never = per("word_chars"), F.col("n_upper") / F.col("word_chars"), F.lit(False)
    prose = (per("n_symbols") < 0.02) & (capitals < 0.12) & (per("n_exclaim") < 0.02) & mean.between(3.0, 12.0) & (per("n_repeat_words") < 0.30)
    return {
        "length": _votes(F.col("n_words"), F.col("n_words") < 20, F.col("n_words") >= 100),
        "repetition": _votes(words, per("n_repeat_words") > 0.30, never),
        "symbols": _votes(words, per("n_symbols") > 0.10, never),
        "lines": _votes(F.col("n_lines"), (F.col("n_lines") >= 4) & (F.col("n_dup_lines") / F.col("n_lines") > 0.30), never),
        "capitals": _votes(words, capitals > 0.30, never),
        "shouting": _votes(words, per("n_exclaim") > 0.20, never),
        "prose": _votes(words, never, prose),
    }


class VoteModel:
    """prior: P(good). table[rule][vote] = (P(vote | good), P(vote | bad))."""

    def __init__(self, names: list[str]) -> None:
        self.prior = 0.8
        self.table = {n: {GOOD: (0.85, 0.5), BAD: (0.01, 0.25), ABSTAIN: (0.14, 0.25)} for n in names}

    def probability(self, pattern: list[int]) -> float:
        """P(good) of a pattern of votes, in the rules' order."""
        odds = math.log(self.prior / (1 - self.prior)) + sum(math.log(self.table[name][v][0] / self.table[name][v][1]) for name, v in zip(self.table, pattern, strict=True))
        return 1 / (1 + math.exp(-odds))

    def posterior(self) -> Column:
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, by_vote in self.table.items():
            odds = odds + F.element_at(F.array(*[F.lit(math.log(by_vote[v][0] / by_vote[v][1])) for v in (BAD, GOOD, ABSTAIN)]), F.col(name) + 1)
        return 1 / (1 + F.exp(-odds))


def fit_votes(votes: DataFrame, names: list[str], *, rounds: int = 20, tolerance: float = 1e-4, pseudo: float = 0.02) -> VoteModel:
    """Expectation-maximisation. votes: the rules' columns and `n`, how many documents voted so.

    pseudo: the weight of the initial table, as a share of all documents, which keeps good and bad from changing places.
    The patterns of votes, 3 to the power of the rules at most, come to the driver once; a round is a loop over them.
    """
    model, first = VoteModel(names), VoteModel(names)
    patterns = [([r[c] for c in names], float(r["n"])) for r in votes.groupBy(*names).agg(F.sum("n").alias("n")).orderBy(*names).collect()]
    n = sum(times for _, times in patterns)
    for _ in range(rounds if n else 0):
        good, sums = 0.0, {name: {v: [0.0, 0.0] for v in (BAD, GOOD, ABSTAIN)} for name in names}
        for pattern, times in patterns:
            share = times * model.probability(pattern)
            good += share
            for name, v in zip(names, pattern, strict=True):
                sums[name][v][0] += share
                sums[name][v][1] += times - share
        weight, moved = pseudo * n, abs(good / n - model.prior)
        model.prior = min(max(good / n, 1e-3), 1 - 1e-3)
        for name in names:
            for v in (BAD, GOOD, ABSTAIN):
                old = model.table[name][v]
                new = tuple((x + weight * p) / (total + weight) for x, p, total in zip(sums[name][v], first.table[name][v], (good, n - good), strict=True))
                moved = max(moved, abs(new[0] - old[0]), abs(new[1] - old[1]))
                model.table[name][v] = new
        if moved < tolerance:
            break
    return model


def judge(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the features, each rule's vote, base_failed, p_good and kept for each row of docs; other columns don't matter."""
    features = ["n_words", "word_chars", "n_symbols", "n_upper", "n_exclaim", "n_lines", "n_dup_lines", "n_repeat_words"]
    rows = repeated_words(surface_features(docs.select(F.col(key), F.col(text).alias("_text")), "_text")).select(key, *features)
    votes = rules()
    seen = materialise(rows.withColumns(votes))
    model = fit_votes(seen.groupBy(*votes).agg(F.count("*").alias("n")), list(votes))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.withColumns({"base_failed": failed, "p_good": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
