"""The queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, clusters, html_text, langid, neardup, packing, pieces, pii, quality, shards, topk, whitening, word_bpe
from .common import numbered, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat_format.digest(chat_format.read_back(chat_format.format_conversations(rows.unionByName(planted))))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, _ = numbered(topk.usable(table(spark, sf_dir, "embeddings")))
    return topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(table(spark, sf_dir, "documents"), 40)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.usable(table(spark, sf_dir, "embeddings"), 256), 4)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(clusters.usable(table(spark, sf_dir, "embeddings"), 64, 64), k=16, rounds=3, seed="1", dims=64)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_chat_format, op3_exact_topk, op4_pii, op5_shards, op6_html_text,
        op7_near_duplicates, op8_pieces, op9_packing, op10_quality, op11_whitening, op12_clusters, op13_word_bpe,
    )
}

CHAT_ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|/?SYS>>)|\[(/?INST\])', '', 'g') AS bare,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role
               AND row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) > 1 AS merged,
             length(text) + length(text) - length(replace(text, '\', ''))
               + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|<</?SYS>>')) AS chars FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN merged THEN 8 ELSE 8 + length(role) + 8 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLE: dict[str, str] = {"op2_chat_format": CHAT_ORACLE, "op3_exact_topk": topk.ORACLE, "op10_quality": quality.ORACLE, "op12_clusters": clusters.oracle()}
