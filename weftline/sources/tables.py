"""Reading tables and events, and writing outbox rows and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weftline.folders import shared_folder  # noqa: F401  sources give their folders by it
from weftline.functions.scalars import encode_payload
from weftline.operators.orders import validate_orders
from weftline.schemas import TABLES

REQUIRED = ("event_id", "payload", "status", "retry_count", "event_type")


def read_table(spark: SparkSession, name: str, source: str | dict) -> DataFrame:
    """A table of the model: Parquet at a path, or JDBC options (with partitionColumn, lowerBound, upperBound, numPartitions for a parallel read)."""
    if isinstance(source, str):
        return spark.read.schema(TABLES[name]).parquet(source)
    return spark.read.format("jdbc").options(dbtable=f"`{name}`", **source).load()


def outbox_inserts(cdc: DataFrame) -> DataFrame:
    """After-images of rows inserted into the outbox: change rows have op, table, is_ddl, names, values, ts."""
    rows = cdc.where((F.lower("table") == "outbox") & ~F.coalesce("is_ddl", F.lit(False)) & (F.upper("op") == "INSERT"))
    return rows.select(F.map_from_arrays(F.transform("names", F.lower), F.col("values")).alias("image"), "ts")


def to_outbox(images: DataFrame) -> DataFrame:
    """Typed outbox rows of after-images; a missing or null required column is an error."""
    raw = {c: F.try_element_at("image", F.lit(c)) for c in REQUIRED}
    typed = {c: raw[c].try_cast("long") if c == "event_id" else raw[c].try_cast("int") if c in ("status", "retry_count") else raw[c] for c in REQUIRED}
    err = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        err = F.when(typed[c].isNull(), f"MISSING_{c.upper()}").otherwise(err)
    return images.select(*[typed[c].alias(c) for c in REQUIRED], err.alias("err"))


def parse_order_events(raw: DataFrame) -> DataFrame:
    """Order events of strings (orderId, skuId, userId); malformed rows stay, with an error, and so do other columns."""
    return validate_orders(raw.withColumnsRenamed({"orderId": "order_id", "skuId": "sku_id", "userId": "user_id"}))


def to_outbox_rows(changes: DataFrame, event_type: str) -> DataFrame:
    """An outbox row for each change, its columns as JSON."""
    return changes.select(
        F.col("event_id"), encode_payload(*changes.columns).alias("payload"), F.lit(0).alias("status"), F.lit(0).alias("retry_count"), F.lit(event_type).alias("event_type")
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").partitionBy("version").parquet(path)


def relay(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Send a stream of orders on, equal ones once within the batch, all payloads of an id; a replayed batch overwrites what it wrote before."""

    def send(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_quarantine(df: DataFrame, attempts: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good rows, rows to try again, and dead ones, by ``err`` and the number of attempts so far."""
    tries = F.coalesce("attempt", F.lit(0)) if "attempt" in df.columns else F.lit(0)
    rows = df.withColumn("attempt", F.when(F.col("err").isNull(), tries).otherwise(tries + 1))
    bad = rows.where("err is not null")
    return rows.where("err is null"), bad.where(F.col("attempt") <= attempts), bad.where(F.col("attempt") > attempts)
