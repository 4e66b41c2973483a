"""From raw documents to packed training sequences, each stage on all that its predecessor kept.

language_id drops texts without a letter; near_duplicates keeps the smallest id of each class of similar texts;
secret_scan replaces secrets; mixing repeats and drops documents by fitted rates, so that domains reach their target
shares; packing turns what remains into sequences. Stages but the last return the columns of documents. Extra columns
are carried along, whatever their names: helper columns get names that no column has. Null texts are dropped by the first stage. Rows that share an id, or have none, are documents of their
own: near duplicates are found by row, and packing numbers the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import jaccard, langid, mixing, packing, secrets
from rasterloom.llm.textops import crc_mod, unused_name
from rasterloom.session import discard, materialise, stored


#: So many ids are sent to all executors, so that the texts stay where they are.
FEW_IDS = 2_000_000


def without(docs: DataFrame, gone: DataFrame, few: int) -> DataFrame:
    """The rows whose id isn't among `gone`; few: how many these are. Up to FEW_IDS (a long each) they go to the texts, not the texts to them."""
    return docs.join(F.broadcast(gone) if few <= FEW_IDS else gone, gone.columns, "left_anti").select(docs.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter of any language go."""
    profiles = langid.fit_profiles(docs.where(crc_mod(F.col("doc_id"), langid.FOLDS) != 1))
    return langid.drop_undetermined(docs, profiles)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar documents one row stays: that with the smallest id, an id before none, and of rows with that id any one.

    Rows whose id is null or occurs again get numbers of their own below all ids, so that every row is compared for itself.
    """
    again = materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1 or doc_id is null").select("doc_id"))
    if again.isEmpty():
        similar = jaccard.similar_documents(docs)
        gone, _ = stored(similar.where(F.col("component_id") != F.col("doc_id")).select("doc_id"))
        return without(docs, gone, gone.count())
    known = again.where("doc_id is not null")
    least = min(0, docs.agg(F.min("doc_id").alias("m")).first()["m"] or 0)
    row = unused_name("row", docs)
    odd = docs.join(known, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
    odd = materialise(odd.withColumn(row, least - 1 - F.monotonically_increasing_id()))
    plain = docs.where("doc_id is not null").join(known, "doc_id", "left_anti").select(docs.columns)
    every = plain.select(F.col("doc_id").cast("long").alias("row"), "text").unionByName(odd.select(F.col(row).alias("row"), "text"))
    similar = materialise(jaccard.similar_documents(every, key="row"))
    named = similar.join(odd.select(F.col(row).alias("row"), "doc_id"), "row", "left").withColumn("doc_id", F.when(F.col("row") < least, F.col("doc_id")).otherwise(F.col("row")))
    stays = named.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", F.negative("row"))).alias("row"))
    gone = materialise(similar.join(stays, "row", "left_anti").select("row"))
    n = gone.count()
    kept = without(plain, gone.select(F.col("row").alias("doc_id")), n)
    return kept.unionByName(without(odd, gone.select(F.col("row").alias(row)), n).select(docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its secrets replaced."""
    return secrets.redact(docs, size="n_chars")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document's row as often as its fitted rate and draw say."""
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs)
    mixed, _ = mixing.mix(docs, labels, mixing.TARGETS, anchor=mixing.ANCHOR)
    # by id and text, so that rows sharing an id keep their own rates; equal rows have equal rates
    own, copies, key, hashed, times = (unused_name(n, docs) for n in ("own", "copies", "key", "hashed", "times"))
    other = mixed.groupBy("doc_id", "_h").agg(F.max("copies").alias("copies")).where("copies <> 1").select(F.col("doc_id").alias(key), F.col("_h").alias(hashed), F.col("copies").alias(copies))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(other, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(hashed)), "left")
    n = F.coalesce(copies, F.lit(1))
    return rows.where(n > 0).withColumn(times, F.explode(F.sequence(F.lit(1), n))).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces lie in the training sequences."""
    return packing.pack(docs)


STAGES = [("language_id", languages), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mixing_weights), ("packing", sequences)]

#: Not expressible: the rates and the packing are iterative.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's documents are kept as Parquet until the next stage's are complete, so that no more than two of them take room."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if held:
            discard(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
