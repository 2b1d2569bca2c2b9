"""Favourites: transitions, counts, counter events and reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.folders import stored as written

from weftline.functions.scalars import pack_counter, unpack_counter
from weftline.schemas import COUNTER_EVENT

INDEX = {"turn": 1, "fav": 2}
INT_MAX = 2**31 - 1


def fav_transitions(events: DataFrame) -> DataFrame:
    """+1 or -1 for each event that changes the state of (sku, user); before the first it is not a favourite."""
    w = Window.partitionBy("sku_id", "user_id").orderBy("ts", "event_id")
    rows = events.where("sku_id is not null and user_id is not null and status is not null")
    return (
        rows.withColumn("_before", F.lag("status", 1, 0).over(w)).where("status <> _before")
        .select("sku_id", "user_id", "event_id", (F.col("status") - F.col("_before")).cast("int").alias("delta"))
    )


def latest_fav(events: DataFrame) -> DataFrame:
    return events.groupBy("sku_id", "user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def active_fav(fav: DataFrame) -> DataFrame:
    """Favourites of each sku that has a row, 0 if none is active."""
    return fav.groupBy("sku_id").agg(F.count_if(F.col("status") == 1).alias("fav_count"))


def sku_fav_counts(sku: DataFrame, fav: DataFrame) -> DataFrame:
    """Active favourites of every sku, 0 without any."""
    active = fav.where("status = 1").groupBy("sku_id").agg(F.count("*").alias("fav_count"))
    return sku.select(F.col("id").alias("sku_id")).join(active, "sku_id", "left").select("sku_id", F.coalesce("fav_count", F.lit(0)).alias("fav_count"))


def validate_counter_events(outbox: DataFrame, *also: str) -> DataFrame:
    """Counter events of an outbox with the first rule that each breaks, and further columns; other event types are skipped."""
    e = F.from_json("payload", COUNTER_EVENT)
    rows = outbox.where("event_type = 'CounterEvent'").select("event_id", "payload", e.alias("e"), *also)
    index = F.when(F.col("e.metric") == "turn", 1).when(F.col("e.metric") == "fav", 2)
    err = (
        F.when(F.col("payload").isNull() | F.col("e").isNull() | (F.trim("payload") == ""), "NO_PAYLOAD")
        .when(~F.coalesce(F.col("e.sid") > 0, F.lit(False)), "BAD_SID")
        .when(~F.coalesce(F.col("e.idx").between(1, 2), F.lit(False)), "BAD_IDX")
        .when(~F.coalesce(index == F.col("e.idx"), F.lit(False)), "METRIC_MISMATCH")
        .when(~F.coalesce(F.col("e.eventId") > 0, F.lit(False)), "BAD_EVENT_ID")
        .when(F.col("e.eventId") != F.col("event_id"), "EVENT_ID_MISMATCH")
    )
    return rows.select("event_id", "e.sid", "e.metric", "e.idx", "e.delta", err.alias("err"), *also)


def fold_deltas(events: DataFrame) -> DataFrame:
    """Sum of the deltas of valid events, each event once, by (sid, idx); a sum beyond 32 bits is an error. ``apply_deltas`` checks each event."""
    once = events.where("err is null").dropDuplicates(["sid", "event_id"])
    total = once.groupBy("sid", "idx").agg(F.sum(F.col("delta").cast("long")).alias("delta"))
    return total.withColumn("err", F.when(~F.col("delta").between(-INT_MAX - 1, INT_MAX), "OVERFLOW"))


#: Events of a counter that one block holds, about so many.
BLOCK_EVENTS = 100_000
_FOLDED = "sid long, idx int, value long, rejected long"


def apply_deltas(events: DataFrame, start: DataFrame, block_events: int = BLOCK_EVENTS) -> DataFrame:
    """Counters after valid events, each event once and in order of event_id: ``sid, idx, value, n, rejected``.

    ``start`` (sid, idx, value) has the counters before; others start from 0. An event that would leave 32 bits is rejected
    alone, and those after it go on from where the counter stood. Where all of a counter's rises or falls together
    can't leave 32 bits, its sum is enough. The other counters' events are dealt into blocks by range, and
    a counter's blocks are added up one after another: a block whose running sum stays within 32 bits goes in at
    once, in another the first event beyond is dropped and the sum goes on behind it.
    """
    once = events.where("err is null").dropDuplicates(["sid", "event_id"]).select("sid", "idx", "event_id", F.coalesce(F.col("delta"), F.lit(0)).cast("long").alias("delta"))
    up, down = F.sum(F.greatest("delta", F.lit(0))), F.sum(F.least("delta", F.lit(0)))
    sums = once.groupBy("sid", "idx").agg(F.count("*").alias("n"), up.alias("_up"), down.alias("_down"))
    before = start.select("sid", F.col("idx").cast("int").alias("idx"), F.col("value").cast("long").alias("_start"))
    sums = written(sums.join(before, ["sid", "idx"], "left").withColumn("_start", F.coalesce("_start", F.lit(0))))
    safe = (F.col("_start") + F.col("_up") <= INT_MAX) & (F.col("_start") + F.col("_down") >= -INT_MAX - 1)
    plain = sums.where(safe).select("sid", "idx", (F.col("_start") + F.col("_up") + F.col("_down")).alias("value"), "n", F.lit(0).cast("long").alias("rejected"))
    at_risk = sums.where(~safe)
    many = at_risk.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not many:
        return plain
    own = once.join(at_risk.select("sid", "idx", "_start"), ["sid", "idx"])
    dealt = written(own.repartitionByRange(max(1, -(-many // block_events)), "sid", "idx", "event_id").withColumn("_block", F.spark_partition_id()))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "delta"))), lambda e: e["delta"])
    blocks = dealt.groupBy("sid", "idx", "_start", "_block").agg(ordered.alias("deltas"))
    folded = blocks.repartition("sid", "idx").sortWithinPartitions("sid", "idx", "_block").select("sid", "idx", "_start", "deltas").mapInArrow(_fold_blocks, _FOLDED)
    return plain.unionByName(folded.join(at_risk.select("sid", "idx", "n"), ["sid", "idx"]).select("sid", "idx", "value", "n", "rejected"))


def _fold_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's counters, whose blocks come one after another."""
    key, value, rejected = None, 0, 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([value], pa.int64()), pa.array([rejected], pa.int64())], names=["sid", "idx", "value", "rejected"])

    for batch in batches:
        for sid, idx, first, deltas in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            if key != (sid, idx):
                if key:
                    yield done()
                key, value, rejected = (sid, idx), first, 0
            value, more = fold_within(value, deltas.values.to_numpy(zero_copy_only=False))
            rejected += more
    if key:
        yield done()


def fold_within(value: int, deltas: np.ndarray, tries: int = 64) -> tuple[int, int]:
    """``value`` after ``deltas`` that keep it within 32 bits, and how many of them don't."""
    at = rejected = 0
    while at < len(deltas) and rejected < tries:
        sums = value + np.cumsum(deltas[at:])
        beyond = (sums > INT_MAX) | (sums < -INT_MAX - 1)
        first = int(beyond.argmax())
        if not beyond[first]:
            return int(sums[-1]), rejected
        value, at, rejected = int(sums[first - 1]) if first else value, at + first + 1, rejected + 1
    for d in deltas[at:].tolist():  # where many go, one by one is less work
        fits = -INT_MAX - 1 <= value + d <= INT_MAX
        value += d if fits else 0
        rejected += not fits
    return value, rejected


def check_count_range(counts: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("fav_count").between(0, INT_MAX), F.lit(False))
    return counts.withColumn("err", F.when(~ok, "COUNT_OUT_OF_RANGE"))


def check_sku_id(counts: DataFrame) -> DataFrame:
    return counts.withColumn("err", F.when(~F.coalesce(F.col("sku_id") > 0, F.lit(False)), "BAD_SKU_ID"))


def fav_vs_counter(counts: DataFrame, counters: DataFrame) -> DataFrame:
    """Counts beside the stored counters (sku_id, turn, fav)."""
    have = counters.select("sku_id", "turn", "fav", F.lit(True).alias("exists"))
    return counts.join(have, "sku_id", "left").select("sku_id", "fav_count", "turn", "fav", F.coalesce("exists", F.lit(False)).alias("exists"))


def reconcile(counts: DataFrame, counters: DataFrame) -> DataFrame:
    """Counters as they should be: fav is the count, turn stays, a missing counter is made. Result CORRECTED, UNCHANGED or FAILED."""
    err = check_sku_id(check_count_range(counts).withColumnRenamed("err", "_range"))
    both = fav_vs_counter(counts, counters).join(err.select("sku_id", F.coalesce("err", "_range").alias("err")), "sku_id")
    result = F.when(F.col("err").isNotNull(), "FAILED").when(F.col("exists") & F.col("fav").eqNullSafe(F.col("fav_count")), "UNCHANGED").otherwise("CORRECTED")
    return both.select(
        "sku_id", F.coalesce("turn", F.lit(0)).cast("int").alias("turn"),
        F.when(F.col("err").isNull(), F.col("fav_count")).otherwise(F.col("fav")).cast("long").alias("fav"), result.alias("result"), "err",
    )


def reconcile_summary(recon: DataFrame) -> DataFrame:
    def n(state: str):
        return F.count_if(F.col("result") == state).alias(state.lower())

    return recon.agg(F.count("*").alias("scanned"), n("CORRECTED"), F.lit(0).cast("long").alias("skipped"), n("FAILED"))


def rebuild_missing(events: DataFrame, counters: DataFrame, fav: DataFrame) -> DataFrame:
    """Counters with those that events need and that are missing, from facts; the events' own deltas are not added."""
    missing = events.where("err is null").select(F.col("sid").alias("sku_id")).distinct().join(counters, "sku_id", "left_anti")
    facts = missing.join(active_fav(fav), "sku_id", "left")
    made = facts.select("sku_id", F.lit(0).alias("turn"), F.coalesce("fav_count", F.lit(0)).cast("int").alias("fav"))
    return counters.select("sku_id", "turn", "fav").unionByName(made)


def stored(counters: DataFrame) -> DataFrame:
    """Counters as bytes."""
    return counters.select("sku_id", pack_counter(F.col("turn"), F.col("fav")).alias("value"))


def loaded(values: DataFrame) -> DataFrame:
    """Counters of bytes; null for a value of another length."""
    return values.select("sku_id", unpack_counter(F.col("value")).alias("c")).select("sku_id", "c.turn", "c.fav")
