"""Memory candidates that wait for a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decided_candidates(cands: DataFrame, decisions: DataFrame, wait: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Streams of DECIDE candidates and of decisions as one of what happens: ``user_id, seq, memory_key, action, target_id, content``.

    ``cands`` has ts, user_id, seq (unique for a user), memory_key, content and target_id; ``decisions`` said_at, user_id, seq,
    action (others than UPDATE and INSERT are none) and merged. A decision counts if it was said at the candidate's time or within ``wait`` after it:
    UPDATE changes the target, INSERT makes a new row, with the merged text where there is one. A candidate that nobody has
    decided is inserted as it is when the watermarks, ``late`` behind the newest rows of both streams, have passed its time. Of several
    decisions of one candidate within ``late`` one counts. State holds what may still meet, whatever came before.
    """
    waiting = cands.withWatermark("ts", late).select("ts", "user_id", "seq", "memory_key", "content", "target_id")
    said = decisions.where("action in ('UPDATE', 'INSERT')").withWatermark("said_at", late).dropDuplicatesWithinWatermark(["user_id", "seq"])
    said = said.select(F.col("user_id").alias("_user"), F.col("seq").alias("_seq"), "said_at", F.col("action").alias("_action"), "merged")
    in_time = F.expr(f"said_at >= ts and said_at <= ts + interval {wait}")
    both = waiting.join(said, (F.col("user_id") == F.col("_user")) & (F.col("seq") == F.col("_seq")) & in_time, "left_outer")
    update = F.coalesce((F.col("_action") == "UPDATE") & F.col("target_id").isNotNull(), F.lit(False))
    return both.select(
        "user_id", "seq", "memory_key", F.when(update, "UPDATE").otherwise("INSERT").alias("action"),
        F.when(update, F.col("target_id")).alias("target_id"), F.coalesce("merged", "content").alias("content"),
    )
