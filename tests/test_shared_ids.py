"""Orders whose ids stand for several buyers."""

from weftline.operators import orders
from weftline.sources import tables
from weftline.streaming import jobs

SHARED = [(1, 10, 20), (1, 10, 21), (2, 10, 20)]


def test_order_history_keeps_each_message_once(spark):
    msgs = spark.createDataFrame(SHARED, "order_id long, sku_id long, user_id long")
    found = orders.order_history(msgs, msgs.withColumnRenamed("order_id", "id")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 10, 20, True, 2), (1, 10, 21, True, None), (2, 10, 20, True, 1)]


def test_parsed_events_keep_their_other_columns(spark):
    raw = spark.createDataFrame([("1", "10", "20", 3), ("1", "10", "x", 4)], "orderId string, skuId string, userId string, attempt int")
    found = tables.parse_order_events(raw).select("order_id", "user_id", "attempt", "err").collect()
    assert sorted(found, key=str) == [(1, 20, 3, None), (1, None, 4, "INVALID_ORDER")]


def test_a_relay_sends_all_payloads_of_an_id(spark, tmp_path):
    schema = "order_id long, sku_id long, user_id long"
    spark.createDataFrame([*SHARED, SHARED[0]], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    tables.relay(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").select("order_id", "sku_id", "user_id").collect()) == SHARED


def test_the_outcome_of_an_id_does_not_depend_on_the_order_of_rows(spark):
    """Before, any one of an id's outcomes counted, even one without status, which left its reservation as it was."""
    outcome = "order_id long, sku_id long, user_id long, status string, keep_buyer boolean"
    said = [(1, 10, 21, None, None), (1, 10, 20, "CONFIRMED", True), (2, 10, 30, "CONFIRMED", True), (2, 10, 30, "CANCELLED", False), (3, 11, 5, None, None)]
    held = spark.createDataFrame([(1, 10, 20, "PENDING", None), (2, 10, 30, "PENDING", None), (3, 11, 5, "PENDING", None)], "order_id long, sku_id long, user_id long, state string, keep_buyer boolean")
    stock = spark.createDataFrame([(10, 4), (11, 4)], "sku_id long, stock long")
    mapped = orders.buyer_orders(held)
    for rows in (said, said[::-1]):
        done = orders.completions(held, stock, mapped, spark.createDataFrame(rows, outcome).coalesce(1))
        assert sorted((r["order_id"], r["user_id"], r["status"], r["result"]) for r in done.collect()) == [(1, 20, "CONFIRMED", "APPLIED"), (2, 30, "CANCELLED", "APPLIED")]


def _joins(df):
    return df._jdf.queryExecution().analyzed().toString().count("Join ")


def test_an_order_of_an_id_with_two_reservations_is_decided_once(spark, tmp_path):
    """Before, each reservation of an id gave a row, and which of them counted followed from the order of rows; a batch also joined the buyers' open orders."""
    schema = "order_id long, sku_id long, user_id long"
    held = spark.createDataFrame([(i, s, u, "PENDING", None) for i, s, u in SHARED], f"{schema}, state string, keep_buyer boolean")
    spark.createDataFrame(SHARED, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    sku, stock = spark.createDataFrame([(10, 4)], "id long, stock int"), spark.createDataFrame([(10, 4)], "sku_id long, stock long")
    mapped, before = orders.buyer_orders(held), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        with jobs.state_store(spark):
            decided = jobs.order_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), sku, held, stock, mapped)
            out = jobs.run_to_files(decided, f"{tmp_path}/out", f"{tmp_path}/check").select("order_id", "user_id", "status", "err", "result", "fresh").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Order 2 is the open one of the buyer, whose order 1 was first and so has the item.
    assert sorted(map(tuple, out), key=str) == [(1, 20, "CONFIRMED", None, "BUYER_ORDER_LOST", True), (1, 21, None, "PAYLOAD_CONFLICT", None, False), (2, 20, "CANCELLED", None, "APPLIED", True)]
    assert _joins(decided) == 3


def test_a_batch_of_admission_joins_its_buyers_once(spark, tmp_path):
    """Before, a batch joined marks of buyers and their open orders one after the other."""
    schema = "order_id long, sku_id long, user_id long"
    spark.createDataFrame(SHARED, schema).write.parquet(f"{tmp_path}/in")
    held = spark.createDataFrame([(9, 10, 20, "PENDING", None)], f"{schema}, state string, keep_buyer boolean")
    stock = spark.createDataFrame([(10, 4)], "sku_id long, stock long")
    admitted = jobs.admission_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), stock, held.select("sku_id", "user_id"), held)
    assert _joins(admitted) == 3
