"""A corpus pipeline: quality rules, language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, neardup, packing, pii, quality
from weftline.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose main language has less of their letters than this are rejected.
MIN_LANGUAGE_SHARE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines.

    Null and empty texts and those of less than ten words go. Each row is judged by its text alone: repeated
    rows, and rows without id or label, like any other. An empty table gives an empty one.
    """
    return quality.clean_documents(docs.select(*COLUMNS))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters (null and empty texts too) or without a main language go.

    The model learns from the labelled rows of ``docs``; where no row is labelled no language is known, and
    all go. Repeated rows and rows without id or label are judged like any other. An empty table gives an empty one.
    """
    model = langid.fit(langid.training_rows(docs))
    return langid.keep_identified(docs.select(*COLUMNS), model, MIN_LANGUAGE_SHARE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the first with its least doc_id.

    Repeated rows and rows without doc_id are copies like others. Null and empty texts have no words, are no
    copies, and stay. An empty table gives an empty one.
    """
    return neardup.one_of_each(docs.select(*COLUMNS), words=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and secrets replaced by placeholders; null texts stay null, and ``n_chars`` is counted anew."""
    return pii.redact(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences: of every row, repeated ones and null ids too; a null or empty text is the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express fitting a language model, MinHash components or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise AssertionError("STAGES is empty")
