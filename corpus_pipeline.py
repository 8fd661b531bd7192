"""The pipeline over documents: quality, near-duplicates, benchmark items, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and but for the last returns the
columns of documents. run() writes each stage's rows to the shared folder and reads them again for the next. Null and
empty texts go through all stages as they are, if the classifier keeps them; an empty table gives an empty result;
further columns are handed on, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, decontaminate, near_duplicates, quality, secrets
from loomwright.llm.common import held_out, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, gives a score of 0.5 or more."""
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out("doc_id", 3, 1))
    return quality.keep_good(docs, network)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id (rows without an id come last), and one row of repeated ones.

    Rows are told apart by a hash of id and text, so that ids may repeat or be null; rows are repeated if id and text are equal.
    """
    key = F.xxhash64("doc_id", "text")
    classes = near_duplicates.near_duplicate_classes(docs.select(key.alias("doc_id"), "text"))
    ids = docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    rows = stored(classes.join(ids, F.col("doc_id") == F.col("key")).select("key", "class_id", "id", "n"), "classes")
    stay = rows.groupBy("class_id").agg(F.min_by(F.struct("key", "n"), F.struct(F.col("id").isNull(), "id", "key")).alias("own")).select("own.*")
    gone = rows.select(F.col("key").alias("__gone")).join(stay.select(F.col("key").alias("__gone")), "__gone", "left_anti")
    kept = docs.select(F.struct("*").alias("__row"), key.alias("__key")).join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    # rows that are there several times: few keys, whose rows alone are compared
    again = stored(stay.where("n > 1").select(F.col("key").alias("__again")), "again")
    if again.isEmpty():
        return kept.select("__row.*")
    once = kept.join(again, F.col("__key") == F.col("__again"), "left_anti").select("__row.*")
    repeated = kept.join(again, F.col("__key") == F.col("__again"), "left_semi").withColumns({"__id": F.col("__row.doc_id"), "__text": F.col("__row.text")})
    return once.unionByName(repeated.dropDuplicates(["__key", "__id", "__text"]).select("__row.*"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; equal texts stay or go together, whatever their ids."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text, a null text stays null."""
    found = stored(secrets.find_secrets(docs, secrets.fit(secrets.labelled_findings(spark))), "findings")
    redacted = secrets.redact(docs, found)
    return redacted.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else redacted


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every document."""
    rows = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality", good_quality), ("near-duplicates", one_of_each), ("decontamination", decontaminated), ("secrets", without_secrets), ("tokens", encoded)]
#: No SQL: the classifier, the sampling and the forest are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
