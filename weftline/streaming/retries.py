"""Messages that are tried again when they are due, by the clock."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from weftline.sources import tables
from weftline.streaming.jobs import SLOTS, TTL_MS
from weftline.streaming.state import Buckets, Queue

QUEUED = "id long, attempt int, due long, payload string"
#: Buckets of ids that a task holds at most, but for those of one part of its rows.
MOST = 4096
#: What timers need: their state store, and batches without data, since it is in these that most timers go off.
TIMERS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "true",
}


class DueRows(StatefulProcessor):
    """The messages of one slot: each attempt of an id goes on once, when it is due."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = Buckets(handle, "taken", "id long", "at long, attempt int", self.ttl)
        self.waiting = Queue(handle, "waiting", QUEUED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self.taken.open(now)
        for pdf in rows:
            out, later = [], {}  # later ones by whole seconds, so that a slot has few timers
            for i, attempt, due, payload in zip(pdf["id"].tolist(), pdf["attempt"].tolist(), pdf["due"].tolist(), pdf["payload"], strict=True):
                last = self.taken.get(i)
                if last and last[1] >= attempt:
                    continue  # sent again by its source, or by a replayed batch
                self.taken.put((i,), (now, attempt))
                if due <= now:
                    out.append((i, attempt, due, payload))
                else:
                    later.setdefault(-(-due // 1000) * 1000, []).append((i, attempt, due, payload))
            for at, queued in later.items():
                self.waiting.put(at, queued)
                self.handle.registerTimer(at)
            if len(self.taken.read) > MOST:  # a slot of very many messages is taken in parts
                self.taken.close()
                self.taken.open(now)
            yield _queued(out)
        self.taken.close()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for part in self.waiting.take(expiredTimerInfo.getExpiryTimeInMs()):
            yield _queued(part)

    def close(self) -> None:
        pass


def _queued(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "attempt", "due", "payload"]).astype({"id": "int64", "attempt": "int32", "due": "int64"})


def when_due(queued: DataFrame, ttl_ms: int = TTL_MS, slots: int = SLOTS) -> DataFrame:
    """A stream of ``QUEUED`` rows (due in milliseconds of the clock), each (id, attempt) once and not before it is due.

    Later attempts of an id follow earlier ones; what an id had is remembered for ``ttl_ms``, which should be far more than all its
    attempts take. State is keyed by ``slots`` of ids: a hot source is dealt over many tasks, and a timer reads what waits for its second in its slot.
    """
    slotted = queued.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(slots)))
    return slotted.groupBy("slot").transformWithStateInPandas(statefulProcessor=DueRows(ttl_ms), outputStructType=QUEUED, outputMode="append", timeMode="processingTime")


def try_batch(rows: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, number: int, attempts: int, delay: int) -> None:
    """Process the rows of a batch; good, retry and dead ones go to folders of ``path``, retries with when they are due."""
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("attempt", "due")]
    process(rows).withColumn("tried_at", F.unix_millis(F.current_timestamp())).write.mode("overwrite").parquet(f"{path}/processed/batch={number}")
    good, again, dead = tables.with_quarantine(spark.read.parquet(f"{path}/processed/batch={number}"), attempts)
    nameless = again.where("id is null")
    later = again.where("id is not null").select("id", "attempt", (F.col("tried_at") + 1000 * delay).alias("due"), F.to_json(F.struct(*columns)).alias("payload"))
    for name, part in (("good", good), ("dead", dead.unionByName(nameless)), ("retry", later)):
        part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def timed_retries(
    messages: DataFrame, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    attempts: int = 3, delay: int = 30, tick: str = "1 second", slots: int = SLOTS, ttl_ms: int = TTL_MS,
) -> StreamingQuery:
    """Process messages as they come; rows that ``process`` gives an ``err`` come again ``delay`` seconds after they failed, up to ``attempts`` times.

    ``messages`` has a long id and no column attempt, due, tried_at or err; other columns are of types that JSON carries. ``process`` keeps
    its rows' columns and adds err; it sees the attempt (from 0) and when it was due. What fails goes to ``<path>/retry``, which the stream reads beside its
    source, and waits in state until its timer goes off, so a retry needs no other message. A message said again counts once; a
    replayed batch writes its folders again, and retries of an attempt that went on before are passed over. Rows without id can't wait: they are tried once.
    Needs ``TIMERS``; runs until it is stopped.
    """
    spark = messages.sparkSession
    schema = messages.schema
    again = f"{path}/retry"
    spark.createDataFrame([], QUEUED).write.mode("ignore").parquet(f"{again}/batch=-1")
    retries = spark.readStream.schema(f"{QUEUED}, batch long").parquet(again).drop("batch")
    payload = F.to_json(F.struct(*messages.columns)).alias("payload")
    fresh = messages.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("attempt"), F.lit(0).cast("long").alias("due"), payload)
    queued = when_due(fresh.where("id is not null").unionByName(retries), ttl_ms, slots).unionByName(fresh.where("id is null"))
    rows = queued.select(F.from_json("payload", schema).alias("_m"), "attempt", "due").select("_m.*", "attempt", "due")
    return (
        rows.writeStream.foreachBatch(lambda batch, number: try_batch(batch, process, path, number, attempts, delay))
        .option("checkpointLocation", checkpoint).trigger(processingTime=tick).start()
    )


def settled(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What ``timed_retries`` has written as ``good`` or ``dead`` so far, with its batch."""
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}/batch=*")


def wait_until_settled(spark: SparkSession, query: StreamingQuery, path: str, messages: int, seconds: float = 600) -> None:
    """Let the job run until so many messages are good or dead, then stop it; an error if it fails, or if for so long no batch takes or settles a message.

    A batch that is at work may take any time: how long all of it takes follows from the number of messages.
    """
    batch, done, since = -1, 0, time.monotonic()
    try:
        while True:
            if query.exception():
                raise query.exception()
            idle, last = not query.status["isTriggerActive"], query.lastProgress  # in this order: a batch shows its progress before it ends
            if last and last["batchId"] > batch:
                batch, idle = last["batchId"], True
                now = sum(settled(spark, path, name).count() for name in ("good", "dead"))
                if now >= messages:
                    return
                if now > done or last["numInputRows"]:
                    done, since = now, time.monotonic()
            if idle and time.monotonic() > since + seconds:
                raise TimeoutError(f"{done} of {messages} messages were settled, and none for {seconds} s")
            time.sleep(0.2)
    finally:
        query.stop()
