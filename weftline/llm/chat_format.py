"""Chat formatting with Spark expressions only.

A conversation becomes one string. Turns are collected as structs, sorted by turn, adjacent turns of
one role are merged into a block, and every block is written as

    <|turn|>ROLE<|body|>TEXT(<|part|>TEXT)*<|end|>\\n

Inside roles and texts a backslash goes before the second character of every control string (``<|``,
``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``) and before each backslash, so that
no text can open a turn and the original comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>\n"
#: Where a backslash is added: at a backslash, or within a control string, after its first character.
CONTROL = r"(\\)|(?<=[<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, segments``.

    ``rows`` has conv_id, turn, role, text; other columns are ignored. ``segments`` is an array of
    (text, loss) whose texts make up ``formatted``; loss marks the texts of ``loss_role``, one segment each.
    A null role or text counts as empty; rows of one turn number are ordered by role, then text, and
    repeated rows all stay; rows without conv_id form one conversation with a null id; a null turn
    comes first. An empty table gives an empty result.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    )
    # The start of each block of adjacent turns with one role.
    starts = sorted_turns.withColumn(
        "starts",
        F.filter(
            F.sequence(F.lit(0), F.size("turns") - 1),
            lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"]),
        ),
    )
    blocks = starts.withColumn(
        "blocks",
        F.transform(
            "starts",
            lambda s, k: F.struct(
                F.get(F.col("turns"), s)["role"].alias("role"),
                F.transform(
                    F.slice(F.col("turns"), s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns")) - s),
                    lambda t: t["text"],
                ).alias("texts"),
            ),
        ),
    )

    def part(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(block: Column) -> Column:
        no, own = F.lit(False), block["role"] == loss_role
        # Each text is a segment of its own; the marks between texts of one block are not under the mask.
        texts = F.transform(block["texts"], lambda t, i: F.when(i == 0, F.array(part(t, own))).otherwise(F.array(part(F.lit(PART), no), part(t, own))))
        head, tail = part(F.concat(F.lit(TURN), block["role"], F.lit(BODY)), no), part(F.lit(END), no)
        return F.concat(F.array(head), F.flatten(texts), F.array(tail))

    with_segments = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return with_segments.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns of ``formatted`` again: ``conv_id, formatted, segments, turns`` with turns an array of (role, text)."""

    def block(raw: Column) -> Column:
        role = unescape(F.substring_index(raw, BODY, 1))
        body = F.substr(raw, F.length(F.substring_index(raw, BODY, 1)) + len(BODY) + 1)
        # The end marker is the only one left in the body.
        parts = F.split(F.replace(body, F.lit(END), F.lit("")), r"<\|part\|>", -1)
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = formatted.withColumn("raw", F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 1_000_000_000))
    return blocks.withColumn("turns", F.flatten(F.transform("raw", block))).drop("raw")


def digest(turns: DataFrame) -> DataFrame:
    """The columns of the query: counts and digests of what ``read_back`` found."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return (
        turns.withColumn("loss_text", masked)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(whole, 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
