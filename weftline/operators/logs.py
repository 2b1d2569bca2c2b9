"""Audits over ids, calls and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import MIN_ID_MS, error_code


def id_audit(ids: DataFrame) -> DataFrame:
    """Ids per worker and minute of a table of generated ids (id), with how many of them are repeated."""
    once = ids.groupBy("id").agg(F.count("*").alias("_c"))
    ms = F.shiftright("id", 22) + MIN_ID_MS
    worker = F.shiftright("id", 12).bitwiseAND(F.lit(1023))
    return once.groupBy(worker.cast("long").alias("worker"), F.floor(ms / 60_000).alias("minute")).agg(
        F.sum("_c").alias("n"), F.sum(F.col("_c") - 1).alias("duplicates")
    )


def error_class(logs: DataFrame) -> DataFrame:
    return logs.withColumn("code", error_code(F.col("exception"), F.col("message")))


def duplicate_calls(calls: DataFrame) -> DataFrame:
    """Tool calls (session_id, seq, tool, args) with a key of tool and canonical arguments, repeated ones flagged."""
    key = F.concat(F.coalesce("tool", F.lit("")), F.lit(":"), F.coalesce(F.to_json(F.try_parse_json("args")), F.col("args"), F.lit("")))
    rows = calls.withColumn("key", key)
    n = F.row_number().over(Window.partitionBy("session_id", "key").orderBy("seq"))
    return rows.withColumn("is_duplicate", n > 1)


def merge_evidence(results: DataFrame) -> DataFrame:
    """Passages of tool results (question_id, seq, tool, passages): each (tool, content) once per question, new ones flagged.

    A result that is a JSON array has a passage for each item, another JSON value is one passage, and what
    is not JSON is one as it stands. Texts are passages without their quotes, other values as compact JSON; blank ones are left out.
    """
    items = F.when(F.ltrim("passages").startswith("["), F.from_json("passages", "array<string>"))
    # Within an array of one, a text loses its quotes and another value is written anew.
    whole = F.from_json(F.concat(F.lit("["), F.col("passages"), F.lit("]")), "array<string>")
    valid = F.try_parse_json("passages").isNotNull()
    found = F.coalesce(items, F.when(valid, whole), F.array("passages"))
    each = results.where(F.col("passages").rlike(r"\S")).select("question_id", "seq", "tool", F.posexplode(found).alias("pos", "_item"))
    rows = each.withColumn("content", F.coalesce("_item", F.lit("null"))).where(F.col("content").rlike(r"\S"))
    n = F.row_number().over(Window.partitionBy("question_id", "tool", "content").orderBy("seq", "pos"))
    return rows.withColumn("is_new", n == 1).select("question_id", "seq", "tool", "content", "is_new")
