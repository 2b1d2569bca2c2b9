"""Structured Streaming jobs over counter events, orders, publish events and memory updates.

Jobs that keep tables work batch by batch: what a batch decides goes to ``<path>/batch=<number>`` and
depends only on the batches before it, so that a replayed batch writes the same again. Now and then the
batches before are put together (``earlier``). Admission and counters keep their state by key instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from weftline.folders import stored
from weftline.operators import articles, chunking, counters, memory, orders
from weftline.sources import tables
from weftline.streaming.state import Buckets

#: How long a counter event is remembered: seven days, as milliseconds.
TTL_MS = 7 * 24 * 3600 * 1000
#: Parts into which order ids and counter events are dealt: as many tasks at most look them up. Fixed for the life of a stream.
SLOTS = 512
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
#: What stateful processors need: their state store, and no batches without data, which a time to live by the clock would ask for without end.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_store(spark: SparkSession, settings: dict[str, str] = STATE_STORE) -> Iterator[None]:
    """The session with ``settings``, for the time of a stream's run."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counter_stream(outbox: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Valid counter events of an outbox stream (with ts), each (sid, event_id) once within the time to live, summed by (sid, idx). Needs ``STATE_STORE``."""
    return counter_events(outbox, slots=slots).groupBy("sid", "idx").agg(F.sum(F.col("delta").cast("long")).alias("value"))


class SeenEvents(StatefulProcessor):
    """The counter events of one slot that came within the time to live, which runs from when one was first taken, by the clock."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = Buckets(handle, "seen", "sid long, event_id long", "taken long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.seen.open(now)
        for pdf in rows:
            once = pdf.drop_duplicates(["sid", "event_id"])
            ids = list(zip(once["sid"].tolist(), once["event_id"].tolist(), strict=True))
            fresh = [not self.seen.get(*i) for i in ids]
            for i, is_fresh in zip(ids, fresh, strict=True):
                if is_fresh:
                    self.seen.put(i, (now,))
            yield once[pd.Series(fresh, index=once.index, dtype=bool)].astype({"idx": "Int64", "delta": "Int64"})[["sid", "event_id", "idx", "delta"]]
        self.seen.close()

    def close(self) -> None:
        pass


def counter_events(outbox: DataFrame, ttl_ms: int = TTL_MS, slots: int = SLOTS) -> DataFrame:
    """Valid inserted counter events ``sid, event_id, idx, delta`` of an outbox stream, each (sid, event_id) once within the time to live.

    The time runs by the clock: an event counts however old its own time is, and however late it comes.
    State is keyed by ``slots`` of events, so a hot sid is dealt over many tasks; each slot of a batch costs a call, so small streams want few. Needs ``STATE_STORE``.
    """
    events = counters.validate_counter_events(outbox.where("op = 'INSERT'")).where("err is null").selectExpr("cast(sid as long) as sid", "cast(event_id as long) as event_id", "idx", "delta")
    slotted = events.withColumn("slot", F.pmod(F.xxhash64("sid", "event_id"), F.lit(slots)))
    return slotted.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=SeenEvents(ttl_ms), outputStructType="sid long, event_id long, idx int, delta int", outputMode="append", timeMode="processingTime"
    )


class CounterState(StatefulProcessor):
    """The counters of one sid. Rows of a batch are folded as they come, so a hot sid needs no more memory than another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counter", "turn long, fav long, n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((int(row["turn"]), int(row["fav"]), 0))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        values, n, rejected = ({1: known[0], 2: known[1]} if known else {1: 0, 2: None}), known[2] if known else 0, 0
        for pdf in rows:
            if known is None:  # facts hold what the batch's own events say
                if values[2] is None:
                    values[2] = int(pdf["fact"].iloc[0])
                n += len(pdf)
                continue
            for idx in values:
                deltas = pdf.loc[pdf["idx"] == idx, "delta"].fillna(0).to_numpy(dtype=np.int64)
                sums = values[idx] + np.cumsum(deltas)
                if not len(sums):
                    continue
                if sums.min() >= INT_MIN and sums.max() <= INT_MAX:
                    values[idx] = int(sums[-1])
                else:
                    for d in deltas.tolist():
                        fits = INT_MIN <= values[idx] + d <= INT_MAX
                        values[idx] += d if fits else 0
                        rejected += not fits
            n += len(pdf)
        self.state.update((values[1], values[2], n))
        yield pd.DataFrame({"sid": [key[0]], "turn": [values[1]], "fav": [values[2]], "n": [n], "rejected": [rejected]})

    def close(self) -> None:
        pass


def stateful_counters(events: DataFrame, stored: DataFrame, facts: DataFrame) -> DataFrame:
    """Counters after each batch: ``sid, turn, fav, n, rejected``.

    ``events`` are those of ``counter_events``, ``stored`` the counters (sku_id, turn, fav) at the start,
    ``facts`` the favourites (sku_id, fav_count). An event that would leave 32 bits is rejected alone. A
    missing counter starts from the facts, with turn 0; the events of the batch that finds it missing are
    not added. n counts a sid's events so far: its last row has the largest. Needs ``STATE_STORE``.
    """
    start = stored.select(F.col("sku_id").alias("sid"), F.col("turn").cast("long").alias("turn"), F.col("fav").cast("long").alias("fav"))
    known = facts.select(F.col("sku_id").alias("sid"), F.col("fav_count").alias("fact"))
    rows = events.join(known, "sid", "left").select("sid", "idx", "delta", F.coalesce("fact", F.lit(0)).cast("long").alias("fact"))
    return rows.groupBy("sid").transformWithStateInPandas(
        statefulProcessor=CounterState(), outputStructType="sid long, turn long, fav long, n long, rejected long", outputMode="append", timeMode="none", initialState=start.groupBy("sid")
    )


def run_to_last(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Run an aggregating stream over all that is there now; the last row that it wrote of each key.

    A batch writes the keys that it changed to ``<path>/batch=<number>``; a replayed batch overwrites them.
    """

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = stream.sparkSession.read.schema(f"{schema}, batch long").option("basePath", path).parquet(f"{path}/batch=*")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an appending stream over all that is there now; the rows that it wrote."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


#: Batches after which what the batches before wrote is put together.
COMPACT = 10


def earlier(spark: SparkSession, path: str, schema: str, number: int, fold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What the batches before ``number`` wrote to ``<path>/batch=<number>``, by ``fold`` reduced to what later batches need.

    At every ``COMPACT``-th batch the rows before it go, folded, to ``<path>.upto/<number>``: a batch reads the
    last of these tables and fewer than ``COMPACT`` batches. All of them follow from what was written before, so a replay writes the same.
    """
    base = number - number % COMPACT
    parts = [f"{path}/batch={k}" for k in range(base, number)]
    if base:
        snapshot = f"{path}.upto/{base}"
        if base == number:
            before = [f"{path}/batch={k}" for k in range(base - COMPACT, base)] + ([f"{path}.upto/{base - COMPACT}"] if base > COMPACT else [])
            fold(spark.read.schema(schema).parquet(*before)).write.mode("overwrite").parquet(snapshot)
        parts.append(snapshot)
    return fold(spark.read.schema(schema).parquet(*parts)) if parts else spark.createDataFrame([], schema)


EVENT = ("arrival", "kind", "order_id", "sku_id", "user_id", "status", "keep_buyer")
ADMITTED = "arrival long, kind string, order_id long, sku_id long, user_id long, result_order_id long, result string, err string"


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch, one after another."""
    batch = pd.concat(list(rows), ignore_index=True)
    return batch.sort_values([c for c in ("arrival", "order_id", "sku_id", "user_id") if c in batch], kind="stable", ignore_index=True)


class OrderRegistry(StatefulProcessor):
    """The order ids of one slot: each belongs to the item and buyer of the first request under it, or of its reservation from before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = Buckets(handle, "owners", "order_id long", "sku_id long, user_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows)
        self.owners.open()
        asked = (batch[batch["kind"] == "REQUEST"] if "kind" in batch else batch).drop_duplicates("order_id")
        first = {int(o): (int(s), int(u)) for o, s, u in zip(asked["order_id"], asked["sku_id"], asked["user_id"], strict=True)}
        once = batch.drop_duplicates("order_id")
        held = zip(once["held_sku"].tolist(), once["held_user"].tolist(), strict=True) if "held_sku" in batch else [(-1, -1)] * len(once)
        own: dict[int, tuple[int, int] | None] = {}
        for order, (sku, user) in zip(once["order_id"].tolist(), held, strict=True):
            found = self.owners.get(order)
            own[order] = found or ((sku, user) if sku >= 0 else first.get(order))
            if not found and own[order]:
                self.owners.put((order,), own[order])
        self.owners.close()
        owner = [own[o] is None or own[o] == (s, u) for o, s, u in zip(batch["order_id"].tolist(), batch["sku_id"].tolist(), batch["user_id"].tolist(), strict=True)]
        batch["owner"] = pd.Series(owner, dtype=bool)
        yield batch.drop(columns=["slot", "held_sku", "held_user"], errors="ignore")

    def close(self) -> None:
        pass


def registered(events: DataFrame, reservations: DataFrame | None = None) -> DataFrame:
    """A stream of orders' events (columns of ``EVENT``) with whether its id belongs to the event's item and buyer (owner), and the state of each order's stored reservation, if such are given.

    Events without kind are requests. The state is keyed by slots of order ids, in which the ids of a batch are looked up in buckets: one pair of numbers for each id.
    """
    rows = events
    if reservations is not None:
        held = reservations.select("order_id", F.col("sku_id").alias("held_sku"), F.col("user_id").alias("held_user"), F.col("state").alias("held_state"), F.coalesce("keep_buyer", F.lit(False)).alias("held_keep"))
        rows = events.join(held, "order_id", "left").select(*events.columns, *held.columns[1:])
    none = {"held_sku": -1, "held_user": -1, "held_state": "", "held_keep": False, "status": "", "keep_buyer": False}
    rows = rows.select(*[F.coalesce(c, F.lit(none[c])).alias(c) if c in none else c for c in rows.columns])
    schema = StructType([f for f in rows.schema.fields if f.name not in ("held_sku", "held_user")]).add("owner", "boolean")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("order_id"), F.lit(SLOTS)))
    return rows.groupBy("slot").transformWithStateInPandas(statefulProcessor=OrderRegistry(), outputStructType=schema, outputMode="append", timeMode="none")


def _by_item(rows: DataFrame) -> GroupedData:
    """Rows by slots of items, so that items with few rows share a call."""
    return rows.withColumn("slot", F.pmod(F.xxhash64("sku_id"), F.lit(SLOTS))).groupBy("slot")


class AdmissionState(StatefulProcessor):
    """The items of one slot: the units left, each buyer's open order and mark, and each order's state. What a batch names is looked up, no more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = Buckets(handle, "left", "sku_id long", "left long")
        self.buyers = Buckets(handle, "buyers", "sku_id long, user_id long", "open long, marked boolean")
        self.orders = Buckets(handle, "orders", "order_id long, sku_id long", "state string, keep boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, out = _sorted(rows), []
        for state in (self.left, self.buyers, self.orders):
            state.open()
        for row in batch.itertuples(index=False):
            sku, user, order = row.sku_id, row.user_id, row.order_id
            has, bad = row.has_units, row.units < 0
            if not self.left.get(sku):
                self.left.put((sku,), (max(row.units, 0),))
            (left,) = self.left.get(sku)
            open_, marked = self.buyers.get(sku, user) or (row.open, row.bought)
            now = self.orders.get(order, sku) or ((row.held_state, row.held_keep) if row.held_state else None)
            won = None
            if row.kind == "REQUEST":
                if not row.owner:
                    say = "COLLISION"
                elif open_ >= 0:
                    say, won = "RETRY", open_
                elif now:
                    say = "ID_REUSED"
                elif marked or not has:
                    say = "REJECTED"
                elif bad:
                    say = "BAD_STOCK"
                elif not left:
                    say = "REJECTED"
                else:
                    say, won = "ADMITTED", order
                    self.left.put((sku,), (left - 1,))
                    self.buyers.put((sku, user), (order, True))
                    self.orders.put((order, sku), ("PENDING", False))
            elif not row.owner:
                say = "OWNER_MISMATCH"
            elif not now:
                say = "NO_RESERVATION"
            elif now[0] != "PENDING":
                say = "UNCHANGED" if now[0] == row.status and (row.status != "CANCELLED" or now[1] == row.keep_buyer) else "STATE_CONFLICT"
            elif open_ != order:
                say = "BUYER_ORDER_LOST"
            elif row.status == "CANCELLED" and (bad or not has or left >= orders.LONG_MAX):
                say = "STOCK_ERROR"
            else:
                say = "APPLIED"
                self.orders.put((order, sku), (row.status, row.keep_buyer))
                if row.status == "CANCELLED":
                    self.left.put((sku,), (left + 1,))
                    self.buyers.put((sku, user), (-1, row.keep_buyer))
            fine = say in ("ADMITTED", "APPLIED", "RETRY", "REJECTED", "UNCHANGED")
            out.append((row.arrival, row.kind, order, sku, user, won, say if fine else "ERROR", None if fine else say))
        for state in (self.left, self.buyers, self.orders):
            state.close()
        found = pd.DataFrame(out, columns=[c.split()[0] for c in ADMITTED.split(", ")])
        found["result_order_id"] = found["result_order_id"].astype("Int64")
        yield found

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, stock: DataFrame, buyers: DataFrame, reservations: DataFrame | None = None) -> DataFrame:
    """Admit a stream of requests (order_id, sku_id, user_id), within a batch by order_id or, where there is one, by arrival: the columns of ``ADMITTED``.

    With a column kind, events are those of ``orders.stock_flow``: outcomes end reservations, and a cancellation gives its unit
    back. ``stock`` (sku_id, stock), ``buyers`` and ``reservations`` are those of the start. Two stages keep state: by order
    id, whose first request owns it whether it is admitted or not, so that any other item or buyer under it is a COLLISION;
    and by slots of items, where buyers and orders are looked up in buckets, so that a batch costs what it holds however many
    came before. Needs ``STATE_STORE``.
    """
    have = set(requests.columns)
    fill = {"arrival": F.col("order_id"), "kind": F.lit("REQUEST"), "status": F.lit(None).cast("string"), "keep_buyer": F.lit(None).cast("boolean")}
    events = requests.select(*[c if c in have else fill[c].alias(c) for c in EVENT])
    if reservations is None:
        reservations = stock.where("false").select(F.col("sku_id").alias("order_id"), "sku_id", F.col("sku_id").alias("user_id"), F.lit("").alias("state"), F.lit(False).alias("keep_buyer"))
    left = stock.select("sku_id", F.coalesce(F.col("stock").cast("long"), F.lit(-1)).alias("units"), F.lit(True).alias("has_units"))
    # One row of each buyer, written once: a batch joins what the start says of its buyers in one exchange.
    known = orders.buyer_orders(reservations).select("sku_id", "user_id", F.col("order_id").alias("open"), F.lit(None).cast("boolean").alias("bought"))
    known = known.unionByName(buyers.select("sku_id", "user_id", F.lit(None).cast("long").alias("open"), F.lit(True).alias("bought")))
    known = stored(known.groupBy("sku_id", "user_id").agg(F.max("open").alias("open"), F.bool_or("bought").alias("bought")))
    rows = registered(events, reservations).join(known, ["sku_id", "user_id"], "left").join(left, "sku_id", "left")
    none = {"units": 0, "has_units": False, "bought": False, "open": -1}
    rows = rows.select(*[F.coalesce(c, F.lit(none[c])).alias(c) if c in none else c for c in rows.columns])
    return _by_item(rows).transformWithStateInPandas(statefulProcessor=AdmissionState(), outputStructType=ADMITTED, outputMode="append", timeMode="none")


def redeliver(rows: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, number: int, attempts: int) -> None:
    """Process rows with those that batch ``number - 1`` left to try again; good, retry and dead ones go to folders of ``path``."""
    spark = rows.sparkSession
    fresh = rows.withColumn("attempt", F.lit(0))
    if number:
        fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(f"{path}/retry/batch={number - 1}"))
    process(fresh).write.mode("overwrite").parquet(f"{path}/processed/batch={number}")
    done = spark.read.parquet(f"{path}/processed/batch={number}")
    for name, part in zip(("good", "retry", "dead"), tables.with_quarantine(done, attempts), strict=True):
        part.select(*(fresh.columns if name == "retry" else part.columns)).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def redelivery_stream(messages: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Process messages batch by batch; rows that ``process`` gives an ``err`` come again with the next batch, up to ``attempts`` times, then they are dead.

    ``process`` keeps the columns of its rows (those of the messages and attempt) and adds err. ``redeliver_rest`` tries what is left when no more messages come; dead
    rows are sent again by writing them, with the same ids, to the source.
    """
    return messages.writeStream.foreachBatch(lambda batch, number: redeliver(batch, process, path, number, attempts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redeliver_rest(spark: SparkSession, schema: str, process: Callable[[DataFrame], DataFrame], path: str, last: int, attempts: int = 3) -> None:
    """Try the rows that batch ``last`` of a stopped ``redelivery_stream`` left, until none is, in folders of their own under ``<path>/rest``."""
    none, rest = spark.createDataFrame([], schema), f"{path}/rest"
    left = spark.read.schema(f"{schema}, attempt int").parquet(f"{path}/retry/batch={last}")
    left.write.mode("overwrite").parquet(f"{rest}/retry/batch=0")
    for number in range(1, attempts + 1):
        redeliver(none, process, rest, number, attempts)


DECIDED = "order_id long, sku_id long, user_id long, status string, keep_buyer boolean, err string, result string, redis_applied boolean, fresh boolean"


class DecisionState(StatefulProcessor):
    """The items of one slot: the units that orders may still take, who has one, and what was decided of each order and became of its reservation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = Buckets(handle, "left", "sku_id long", "left long, back long")
        self.buyers = Buckets(handle, "buyers", "sku_id long, user_id long", "order_id long")
        self.decided = Buckets(handle, "decided", "order_id long", "status string, keep boolean, result string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, out = _sorted(rows), []
        for state in (self.left, self.buyers, self.decided):
            state.open()
        for row in batch.itertuples(index=False):
            sku, user, order = row.sku_id, row.user_id, row.order_id
            if not self.left.get(sku):
                self.left.put((sku,), (row.market, 0))
            if not row.owner:
                out.append((order, sku, user, None, None, "PAYLOAD_CONFLICT", None, None, False))
                continue
            old = self.decided.get(order)
            if old:  # said again: the same, and nothing more follows
                status, keep, result = old[0], old[1], "UNCHANGED" if old[2] in ("APPLIED", "UNCHANGED") else old[2]
            else:
                left, back = self.left.get(sku)
                status, keep = ("CANCELLED", True) if self.buyers.get(sku, user) else ("CANCELLED", False) if left <= 0 else ("CONFIRMED", True)
                if status == "CONFIRMED":
                    left -= 1
                    self.buyers.put((sku, user), (order,))
                result = self._completed(row, status, keep, row.has_units and 0 <= row.units <= orders.LONG_MAX - back - 1)
                back += result == "APPLIED" and status == "CANCELLED"
                self.left.put((sku,), (left, back))
                self.decided.put((order,), (status, keep, result))
            out.append((order, sku, user, status, keep, None, result, result in ("APPLIED", "UNCHANGED"), not old))
        for state in (self.left, self.buyers, self.decided):
            state.close()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DECIDED.split(", ")])

    @staticmethod
    def _completed(row, status: str, keep: bool, has_room: bool) -> str:
        """What a first decision does to the order's reservation, as in ``orders.completions``."""
        if not row.held_state:
            return "NO_RESERVATION"
        if not row.held_own:
            return "OWNER_MISMATCH"
        if row.held_state != "PENDING":
            return "UNCHANGED" if row.held_state == status and (status == "CONFIRMED" or row.held_keep == keep) else "STATE_CONFLICT"
        if not row.held_open:
            return "BUYER_ORDER_LOST"
        return "STOCK_ERROR" if status == "CANCELLED" and not has_room else "APPLIED"

    def close(self) -> None:
        pass


def order_stream(messages: DataFrame, sku: DataFrame, reservations: DataFrame, stock: DataFrame, mapped: DataFrame) -> DataFrame:
    """Decide a stream of orders (order_id, sku_id, user_id) and complete their reservations: the columns of ``DECIDED``.

    The tables given are those of the start; ``orders.after_completions`` gives them after the rows whose result is APPLIED. A row holds a
    decision, what it did, and, by ``confirmed_rows``, its outbox row; so one sink's commit shows all of a batch or nothing of it.
    State is keyed by order id, whose first message owns it (another item or buyer under it is a PAYLOAD_CONFLICT), and by slots of items;
    no batch reads what came before. A message said again (fresh is false) repeats its decision. Needs ``STATE_STORE``.
    """
    # Whether a reservation is its buyer's open order is found once, not in each batch; of an id's several ones the first by item and buyer counts, as of its messages.
    first = reservations.groupBy("order_id").agg(F.min(F.struct("sku_id", "user_id", "state", F.coalesce("keep_buyer", F.lit(False)).alias("held_keep"))).alias("_r"))
    open_ = mapped.select("sku_id", "user_id", F.col("order_id").alias("_open"))
    held = first.select("order_id", "_r.*").join(open_, ["sku_id", "user_id"], "left")
    held = stored(held.select("order_id", F.col("sku_id").alias("_sku"), F.col("user_id").alias("_user"), F.col("state").alias("held_state"), "held_keep", F.coalesce(F.col("_open") == F.col("order_id"), F.lit(False)).alias("held_open")))
    # A reservation doesn't claim its id here: an order that differs from it is decided and is an OWNER_MISMATCH after.
    own = registered(messages.select("order_id", "sku_id", "user_id")).join(held, "order_id", "left")
    own = own.withColumn("held_own", (F.col("_sku") == F.col("sku_id")) & (F.col("_user") == F.col("user_id"))).drop("_sku", "_user")
    market = sku.select(F.col("id").alias("sku_id"), F.col("stock").cast("long").alias("market"))
    left = stock.select("sku_id", F.coalesce(F.col("stock").cast("long"), F.lit(-1)).alias("units"), F.lit(True).alias("has_units"))
    rows = own.join(market, "sku_id", "left").join(left, "sku_id", "left")
    none = {"held_state": "", "held_keep": False, "held_open": False, "held_own": False, "market": 0, "units": 0, "has_units": False}
    rows = rows.select(*[F.coalesce(c, F.lit(none[c])).alias(c) if c in none else c for c in rows.columns])
    return _by_item(rows).transformWithStateInPandas(statefulProcessor=DecisionState(), outputStructType=DECIDED, outputMode="append", timeMode="none")


def confirmed_rows(decided: DataFrame) -> DataFrame:
    """The outbox rows of newly confirmed orders."""
    new = decided.where(F.col("fresh") & (F.col("status") == "CONFIRMED"))
    return tables.to_outbox_rows(new.select(F.col("order_id").alias("event_id"), "sku_id", "user_id"), "Order")


PUBLISHED = "post_id long, version int, first boolean"


def posts_after(posts: DataFrame, published: DataFrame) -> DataFrame:
    """Posts after the publish events that were accepted (post_id, the new version)."""
    new = articles.latest_publish(published).withColumnRenamed("version", "_new")
    changed = {"version": F.coalesce("_new", "version"), "status": F.when(F.col("_new").isNotNull(), 2).otherwise(F.col("status"))}
    return posts.join(new, "post_id", "left").select(*[changed[c].cast("int").alias(c) if c in changed else F.col(c) for c in posts.columns])


def publish_stream(pubs: DataFrame, posts: DataFrame, contents: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Publish events (post_id, version) batch by batch: ``<path>/chunks`` gets the chunks of newly published versions that have none yet, then ``<path>/published`` the new versions.

    An event counts if its version is the post's at the start of the batch. ``first`` says that the post
    was not published before. Views follow from ``<path>/published`` by ``articles.publish_barrier``.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = lambda df: df.groupBy("post_id").agg(F.max("version").alias("version"), F.bool_or("first").alias("first"))
        now = posts_after(posts, earlier(spark, f"{path}/published", PUBLISHED, number, newest))
        hit = batch.select("post_id", "version").distinct().join(now.select("post_id", "version", "status"), ["post_id", "version"])
        accepted = hit.select("post_id", (F.col("version") + 1).cast("int").alias("version"), (F.col("status") == 1).alias("first"))
        have = earlier(spark, f"{path}/chunks", "post_id long, version int", number, lambda df: df.distinct())
        texts = articles.content_at(contents, chunking.new_chunks(accepted, have))
        chunking.chunk_rows(chunking.assemble_chunks(texts)).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        accepted.write.mode("overwrite").parquet(f"{path}/published/batch={number}")

    return pubs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGED = "doc_id string, memory_id long, user_id long, memory_key string, status string, version int, content string"
MESSAGES = "id long, conversation_id long, version int, role string, content string"
SUMMARIES = "conversation_id long, text string, last_message_id long"


def chat_after(chat: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chats with the last of their summaries."""
    last = summaries.groupBy("conversation_id").agg(F.max(F.struct("last_message_id", "text")).alias("s"))
    return memory.apply_summaries(chat, last.select("conversation_id", "s.text", "s.last_message_id")).drop("err")


def memory_stream(
    updates: DataFrame, chat: DataFrame, posts: DataFrame, messages: DataFrame, stored: DataFrame,
    nearest: Callable[[DataFrame, DataFrame], DataFrame], summarise: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, window: int = 6,
) -> StreamingQuery:
    """Memory updates (seq, conversation_id, version, question, answer, candidates as an array of memory_key and content), batch by batch.

    ``nearest`` gives candidates (user_id, seq, memory_key, content) and memory rows the candidates with
    doc_id, version and score; ``summarise`` gives evicted messages (conversation_id, last_message_id, id,
    role, content) one row (conversation_id, text, last_message_id) per conversation. Folders of ``path``,
    in the order in which they are written: dead (updates that break a rule), conflicts, memory (changed
    rows), messages (the turns, only after memory), summaries.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

        def before(name: str, schema: str, *last: str) -> DataFrame:
            """What earlier batches wrote; of each value of ``last[0]`` only the row with the largest ``last[1]``."""
            def newest(df: DataFrame) -> DataFrame:
                rest = [c for c in df.columns if c != last[0]]
                return df.groupBy(last[0]).agg(F.max_by(F.struct(*rest), last[1]).alias("_r")).select(*[last[0] if c == last[0] else F.col(f"_r.{c}").alias(c) for c in df.columns])

            return earlier(spark, f"{path}/{name}", schema, number, newest if last else lambda df: df)

        checked = memory.validate_memory_updates(batch)
        put(checked.where("err is not null"), "dead")
        good = checked.where("err is null").drop("err")
        known = memory.latest_rows(stored, before("memory", CHANGED, "memory_id", "version"))
        width = good.agg(F.coalesce(F.max(F.size("candidates")), F.lit(1)).alias("_w"))
        owned = memory.chat_owner(good.select("conversation_id", "seq", "candidates"), chat).crossJoin(F.broadcast(width))  # width is one row
        each = owned.select("user_id", "seq", "_w", F.posexplode("candidates").alias("_pos", "c"))
        cands = memory.valid_candidates(each.select("user_id", (F.col("seq") * F.col("_w") + F.col("_pos")).alias("seq"), "c.memory_key", "c.content"))
        _, changed, conflicts = memory.apply_memory(known, memory.actions_of(memory.route(nearest(cands, known)), known))
        put(conflicts, "conflicts")
        put(changed, "memory")
        own = messages.select("id", "conversation_id", "version", "role", "content").unionByName(before("messages", MESSAGES))
        turn = F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), F.lit(0).alias("at")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.lit(1).alias("at"))))
        said = good.select("conversation_id", "seq", "version", turn.alias("t")).select("conversation_id", (F.col("seq") * 2 + F.col("t.at")).alias("seq"), "version", "t.role", "t.content")
        put(memory.numbered_messages(own, said, chat, posts), "messages")
        everything = own.unionByName(spark.read.schema(MESSAGES).parquet(f"{path}/messages/batch={number}"))
        gone = memory.evicted(everything, chat_after(chat, before("summaries", SUMMARIES, "conversation_id", "last_message_id")), window)
        texts = gone.select("conversation_id", "last_message_id", F.explode("evicted").alias("id")).join(everything.select("id", "conversation_id", "role", "content"), ["conversation_id", "id"])
        put(summarise(texts), "summaries")

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
