"""Conversations and long-term memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How the row of an earlier summary begins, and what stands for no messages and for no summary.
SUMMARY_PREFIX = "以下是较早对话的摘要：\n"
NO_MESSAGES = "（无最近会话消息）"
NO_SUMMARY = "（无会话摘要）"
EXACT_KEYS = ("tech_stack", "skill_level")
HIGH, LOW = 0.88, 0.75


def chat_version(chat: DataFrame, posts: DataFrame) -> DataFrame:
    return chat.join(posts.select("post_id", "version"), "post_id").select(F.col("id").alias("chat_id"), "version")


def chat_owner(msgs: DataFrame, chat: DataFrame) -> DataFrame:
    return msgs.join(chat.select(F.col("id").alias("conversation_id"), "user_id"), "conversation_id")


def conversation_ids(chat: DataFrame) -> DataFrame:
    return chat.select("id")


def _lines(messages: DataFrame) -> DataFrame:
    line = F.struct("id", F.concat_ws(": ", "role", "content").alias("line"))
    rows = messages.groupBy("conversation_id").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return rows.select("conversation_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def transcript(messages: DataFrame) -> DataFrame:
    """Messages of each conversation by id, a line each."""
    return _lines(messages)


def recent_text(messages: DataFrame) -> DataFrame:
    """What was said before each conversation's last message: ``conversation_id, summary, recent``.

    A first row that holds an earlier summary stands apart; blank messages are left out; fixed texts stand for no summary and no messages.
    """
    ends = messages.groupBy("conversation_id").agg(F.min(F.struct("id", "role", "content")).alias("f"), F.max("id").alias("_last"))
    leads = (F.col("f.id") < F.col("_last")) & (F.lower("f.role") == "system") & F.startswith(F.col("f.content"), F.lit(SUMMARY_PREFIX))
    ends = ends.select("conversation_id", "_last", F.when(leads, F.col("f.id")).alias("_lead"), F.when(leads, F.col("f.content")).alias("summary"))
    said = messages.where(F.col("content").rlike(r"\S")).join(ends.drop("summary"), "conversation_id")
    between = said.where((F.col("id") < F.col("_last")) & (F.col("_lead").isNull() | (F.col("id") > F.col("_lead"))))
    return ends.join(_lines(between), "conversation_id", "left").select(
        "conversation_id", F.coalesce("summary", F.lit(NO_SUMMARY)).alias("summary"), F.coalesce("text", F.lit(NO_MESSAGES)).alias("recent")
    )


def _unsummarised(messages: DataFrame, chat: DataFrame) -> DataFrame:
    c = chat.select(F.col("id").alias("conversation_id"), "last_message_id")
    return messages.join(c, "conversation_id").where(F.col("last_message_id").isNull() | (F.col("id") > F.col("last_message_id"))).drop("last_message_id")


def _from_last() -> Column:
    return F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("id")))


def memory_window(messages: DataFrame, chat: DataFrame, n: int = 6) -> DataFrame:
    """The last n messages of each conversation that no summary covers."""
    return _unsummarised(messages, chat).withColumn("_n", _from_last()).where(F.col("_n") <= n).drop("_n").select(*messages.columns)


def evicted(messages: DataFrame, chat: DataFrame, n: int = 6) -> DataFrame:
    """Messages beyond the window, in order, and the pointer that a summary of them moves to."""
    rows = _unsummarised(messages, chat).withColumn("_n", _from_last()).where(F.col("_n") > n)
    return rows.groupBy("conversation_id").agg(F.max("id").alias("last_message_id"), F.sort_array(F.collect_list("id")).alias("evicted"))


def conversation_context(chat: DataFrame, messages: DataFrame) -> DataFrame:
    """The summary of a conversation as a system row, then the messages after it."""
    summary = chat.where("summary is not null and trim(summary) <> ''").select(
        F.col("id").alias("conversation_id"), F.lit(0).cast("long").alias("pos"), F.lit("system").alias("role"), F.concat(F.lit(SUMMARY_PREFIX), "summary").alias("content")
    )
    rest = _unsummarised(messages, chat).select("conversation_id", F.col("id").alias("pos"), "role", "content")
    return summary.unionByName(rest)


def clear_conversations(chat: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col("id"), F.lit(True).alias("_gone")).distinct()
    cleared = chat.join(gone, "id", "left")
    keep = F.col("_gone").isNull()
    new_chat = cleared.select(*[F.when(keep, F.col(c)).alias(c) if c in ("summary", "last_message_id") else F.col(c) for c in chat.columns])
    return new_chat, messages.join(gone.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti").select(*messages.columns)


def union_memories(topics: DataFrame, goals: DataFrame) -> DataFrame:
    return topics.unionByName(goals)


def exact_memory(memory: DataFrame, requests: DataFrame) -> DataFrame:
    wanted = requests.where(F.col("memory_key").isin(*EXACT_KEYS)).select("user_id", "memory_key").distinct()
    return memory.where("status = 'ACTIVE'").join(wanted, ["user_id", "memory_key"], "left_semi").select("user_id", "id", "memory_key", "content")


def valid_candidates(cands: DataFrame) -> DataFrame:
    return cands.where("memory_key is not null and trim(memory_key) <> '' and content is not null")


def strict_candidates(cands: DataFrame, keys: tuple[str, ...] = ("language", "answer_style", "tech_stack", "skill_level", "topics", "current_goal"), levels: tuple[str, ...] = ("beginner", "intermediate", "advanced", "unknown")) -> DataFrame:
    """Candidates with the strict rule that they break: a known key; a text, or for skill_level an object of one skill and its level."""
    skill = F.from_json("content", "map<string,string>")
    err = (
        F.when(~F.coalesce(F.col("memory_key").isin(*keys), F.lit(False)), "UNKNOWN_KEY")
        .when((F.col("memory_key") == "skill_level") & ~F.coalesce((F.size(skill) == 1) & F.get(F.map_values(skill), F.lit(0)).isin(*levels), F.lit(False)), "BAD_SKILL")
        .when(F.col("content").isNull() | (F.trim("content") == ""), "EMPTY_CONTENT")
    )
    return cands.withColumn("err", err)


def validate_memory_updates(msgs: DataFrame) -> DataFrame:
    err = (
        F.when(F.col("conversation_id").isNull(), "NO_CONVERSATION")
        .when(F.col("question").isNull() | (F.trim("question") == ""), "NO_QUESTION").when(F.col("answer").isNull(), "NO_ANSWER")
    )
    return msgs.withColumn("err", err)


def latest_singleton(memory: DataFrame, key: str = "language") -> DataFrame:
    rows = memory.where((F.col("memory_key") == key) & (F.col("status") == "ACTIVE"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))).where("_n = 1").drop("_n")


def route(nearest: DataFrame, hi: float = HIGH, lo: float = LOW) -> DataFrame:
    """What becomes of candidates with their nearest memory: SINGLETON, UPDATE, DECIDE or INSERT."""
    action = (
        F.when(F.col("memory_key") == "language", "SINGLETON").when(F.col("score") >= hi, "UPDATE").when(F.col("score") >= lo, "DECIDE").otherwise("INSERT")
    )
    return nearest.withColumn("action", action).withColumn("target_id", F.when(F.col("action").isin("UPDATE", "DECIDE"), F.col("doc_id")))


def actions_of(routed: DataFrame, memory: DataFrame) -> DataFrame:
    """Actions for ``apply_memory`` of routed candidates with their content.

    A SINGLETON replaces the user's newest active row of its key, or is inserted; of several of one user
    in a batch the last counts. A DECIDE that nobody has decided is inserted, so that nothing is lost.
    """
    single = routed.where("action = 'SINGLETON'").groupBy("user_id", "memory_key").agg(F.max(F.struct("seq", "content")).alias("s"))
    have = latest_singleton(memory).select("user_id", "memory_key", F.col("id").alias("target_id"), "version")
    columns = ("seq", "user_id", "memory_key", "content", "action", "target_id", "version")
    chosen = single.select("user_id", "memory_key", "s.seq", "s.content").join(have, ["user_id", "memory_key"], "left")
    chosen = chosen.withColumn("action", F.when(F.col("target_id").isNotNull(), "UPDATE").otherwise("INSERT"))
    rest = routed.where("action <> 'SINGLETON'").withColumn("action", F.when(F.col("action") == "DECIDE", "INSERT").otherwise(F.col("action")))
    return chosen.select(*columns).unionByName(rest.select(*columns))


def latest_rows(memory: DataFrame, changes: DataFrame) -> DataFrame:
    """Memory rows after changed ones (memory_id in place of id): the largest version of each id."""
    rows = memory.select("id", "user_id", "memory_key", "content", "status", "version").unionByName(changes.withColumnRenamed("memory_id", "id").select("id", "user_id", "memory_key", "content", "status", "version"))
    return rows.groupBy("id").agg(F.max_by(F.struct("user_id", "memory_key", "content", "status", "version"), "version").alias("r")).select("id", "r.*")


def apply_memory(memory: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Memory after actions (seq, user_id, memory_key, content, action, target_id, version); new search documents; conflicts.

    An update needs the target's version and that it is active, else it is a conflict; of several on
    one target the least seq wins. A new row's id is the largest one plus its seq, which is unique, plus 1.
    """
    ups = actions.where("action = 'UPDATE'").select("seq", F.col("target_id").alias("id"), F.col("content").alias("_new"), F.col("version").alias("_seen"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    matched = ups.withColumn("_n", first).join(memory.select("id", F.col("version").alias("_now"), "status"), "id", "left")
    ok = F.coalesce((F.col("_n") == 1) & (F.col("_seen") == F.col("_now")) & (F.col("status") == "ACTIVE"), F.lit(False))
    conflicts = matched.where(~ok).select("seq", F.col("id").alias("target_id"))
    won = matched.where(ok).select("id", "_new")
    kept = memory.join(won, "id", "left").select(
        "id", "user_id", "memory_key", F.coalesce("_new", "content").alias("content"), "status",
        (F.col("version") + F.col("_new").isNotNull().cast("int")).cast("int").alias("version"), F.col("_new").isNotNull().alias("_changed"),
    )
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = actions.where("action = 'INSERT'").dropDuplicates(["user_id", "memory_key", "content"])
    made = new.crossJoin(F.broadcast(top)).select(  # top is one row
        (F.col("_top") + F.col("seq") + 1).cast("long").alias("id"), "user_id", "memory_key", "content", F.lit("ACTIVE").alias("status"), F.lit(1).alias("version"), F.lit(True).alias("_changed")
    )
    everything = kept.unionByName(made)
    docs = everything.where("_changed").select(F.format_string("long-memory-%d-v%d", "id", "version").alias("doc_id"), F.col("id").alias("memory_id"), "user_id", "memory_key", "status", "version", "content")
    return everything.drop("_changed"), docs, conflicts


FOLDED = "seq long, user_id long, memory_key string, action string, memory_id long, version int, score double, content string, status string"


def _unit(vector) -> np.ndarray | None:
    """A vector of length 1; none where it is null or has no direction."""
    v = np.asarray([] if vector is None else vector, dtype=float)
    length = np.sqrt(v @ v)
    return v / length if length > 0 else None


def _fold_key(cands: pd.DataFrame, known: pd.DataFrame, hi: float, lo: float) -> pd.DataFrame:
    """One user's candidates of one key, one after another: each meets the memories as the ones before it left them."""
    known = known.sort_values("_id")
    ids, versions = known["_id"].tolist(), known["_version"].tolist()
    units = [_unit(v) for v in known["_known"]]
    dims = max((len(u) for u in [*units, *map(_unit, cands["embedding"])] if u is not None), default=0)
    rows = np.zeros((len(ids) + len(cands), dims))
    for i, u in enumerate(units):
        if u is not None:
            rows[i, : len(u)] = u
    out = []
    for c in cands.sort_values("seq").itertuples(index=False):
        own, n = _unit(c.embedding), len(ids)
        q = np.zeros(dims)
        if own is not None:
            q[: len(own)] = own
        content, score, at = c.content, 0.0, None
        if c.memory_key == "language":
            at = n - 1 if n else None  # the newest
        elif n and own is not None:
            scores = np.round(rows[:n] @ q, 6)
            best = int(scores.argmax())  # ids rise, so the first of equals has the least
            score = float(scores[best])
            if score >= hi:
                at = best
            elif score >= lo and isinstance(c.decision, str):
                content = c.content if c.merged is None else c.merged
                at = best if c.decision == "UPDATE" else None
        if at is None:
            at = n
            ids.append(c.new_id)
            versions.append(0)
        versions[at] += 1
        rows[at] = q
        out.append((c.seq, c.user_id, c.memory_key, "INSERT" if at == n else "UPDATE", ids[at], versions[at], score, content, "ACTIVE"))
    return pd.DataFrame(out, columns=[x.split()[0] for x in FOLDED.split(", ")])


def fold_candidates(memory: DataFrame, cands: DataFrame, decisions: DataFrame | None = None, hi: float = HIGH, lo: float = LOW) -> DataFrame:
    """What becomes of a batch of candidates processed one by one in order of seq: the columns of ``FOLDED``, a row for each.

    ``memory`` has id, user_id, memory_key, status, version and embedding; ``cands`` seq (unique), user_id,
    memory_key, content and embedding. A candidate meets the active memories of its user and key as those before it left
    them, new ones too: at a cosine of ``hi`` it updates the nearest, from ``lo`` on ``decisions`` (seq, action, merged)
    say UPDATE or INSERT, and with which content; one that nobody has decided is inserted. A language
    replaces the newest. New rows are numbered as in ``apply_memory``. Rows of ``memory`` after it: ``latest_rows``.
    Each turn depends on the one before, so one user's key is one task's; users and keys are dealt over all tasks.
    """
    top = memory.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    said = cands.select("seq").where("false").selectExpr("seq", "'' as action", "'' as merged") if decisions is None else decisions
    said = said.where("action in ('UPDATE', 'INSERT')").groupBy("seq").agg(F.max("action").alias("decision"), F.max_by("merged", "action").alias("merged"))
    rows = cands.join(said, "seq", "left").crossJoin(F.broadcast(top))  # top is one row
    rows = rows.select("seq", "user_id", "memory_key", "content", "embedding", "decision", "merged", (F.col("_top") + F.col("seq") + 1).cast("long").alias("new_id"))
    known = memory.where("status = 'ACTIVE'").join(cands.select("user_id", "memory_key").distinct(), ["user_id", "memory_key"], "left_semi")
    known = known.select(F.col("user_id").alias("_user"), F.col("memory_key").alias("_key"), F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("embedding").alias("_known"))

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return _fold_key(own, others, hi, lo)

    return rows.groupBy("user_id", "memory_key").cogroup(known.groupBy("_user", "_key")).applyInPandas(run, FOLDED)


def merge_docs(memory_docs: DataFrame, new_docs: DataFrame) -> DataFrame:
    """Search documents with those that ``apply_memory`` made; older ones of the same memory become DELETE."""
    newest = new_docs.groupBy("memory_id").agg(F.max("version").alias("_newest"))
    old = memory_docs.join(newest, "memory_id", "left")
    status = F.when(F.col("_newest") > F.col("version"), "DELETE").otherwise(F.col("status"))
    kept = old.select(*[status.alias(c) if c == "status" else F.col(c) for c in memory_docs.columns])
    return kept.unionByName(new_docs, allowMissingColumns=True)


def append_messages(messages: DataFrame, new: DataFrame, chat: DataFrame, posts: DataFrame) -> DataFrame:
    """Messages with new ones (conversation_id, seq, version, role, content) after them; ids go on within each conversation."""
    return messages.select("id", "conversation_id", "version", "role", "content").unionByName(numbered_messages(messages, new, chat, posts))


def numbered_messages(messages: DataFrame, new: DataFrame, chat: DataFrame, posts: DataFrame) -> DataFrame:
    """The new rows of ``append_messages``."""
    default = chat_version(chat, posts).select(F.col("chat_id").alias("conversation_id"), F.col("version").alias("_default"))
    last = messages.groupBy("conversation_id").agg(F.max("id").alias("_last"))
    number = F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq"))
    rows = new.withColumn("_n", number).join(default, "conversation_id", "left").join(last, "conversation_id", "left")
    return rows.select(
        (F.coalesce("_last", F.col("conversation_id") * 1000) + F.col("_n")).cast("long").alias("id"), "conversation_id",
        F.coalesce("version", "_default").alias("version"), "role", F.coalesce("content", F.lit("")).alias("content"),
    )


def apply_summaries(chat: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chats with new summaries (conversation_id, text, last_message_id); an empty text is an error and changes nothing."""
    s = summaries.select(F.col("conversation_id").alias("id"), F.trim("text").alias("_text"), F.col("last_message_id").alias("_last"), F.lit(True).alias("_has"))
    joined = chat.join(s, "id", "left")
    ok = F.col("_has") & (F.coalesce("_text", F.lit("")) != "")
    return joined.select(
        *[F.when(ok, F.col(new)).otherwise(F.col(c)).alias(c) if (new := {"summary": "_text", "last_message_id": "_last"}.get(c)) else F.col(c) for c in chat.columns],
        F.when(F.col("_has") & ~F.coalesce(ok, F.lit(False)), "EMPTY_SUMMARY").alias("err"),
    )
