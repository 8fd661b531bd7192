"""One query for each operator, with production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprints, language, language_model, near_duplicates, quality, secrets, token_counts
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item at least 0.8 of whose shingles it holds."""
    return decontaminate.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.compare_with_edited(_table(spark, sf_dir, "documents"))
    near, spelled = fingerprints.likeness, fingerprints.spelled
    return rows.select("doc_id", "n_chars", "edited_sha256", spelled("sketch").alias("fingerprint"), spelled("edited").alias("edited_fingerprint"), near("sketch", "edited").alias("near_edited"), near("sketch", "next_sketch").alias("near_next"), fingerprints.containment("sketch", "edited").alias("kept_in_edited"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    network = quality.fit(docs, _table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, network).select("doc_id", out.alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    return language.identify(docs, language.fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)))
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), "probability")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_fingerprints, op3_chat_format, op4_quality, op5_near_duplicates, op6_bpe, op7_language_model, op8_token_counts, op9_language_id, op10_secrets)}

_SHINGLES = """
    SELECT DISTINCT {id} AS id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {id}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table})
"""
_CONTROL = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in ("\\", *chat.CONTROL))

ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}), i AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
q AS (SELECT id, count(*) AS item_shingles FROM i GROUP BY id),
b AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM b JOIN q ON q.id = b.item_id WHERE shared / item_shingles >= 0.8
""",
    "op3_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({len(chat.HEAD) + len(chat.END) + 1} + length(role) + length(t) + {_CONTROL}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
}
