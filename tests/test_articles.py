"""Tests of what a lookup of contents moves."""

from pyspark.sql import functions as F

from weftline.operators import articles


def shuffled(spark):
    """Bytes that all stages so far have shuffled."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_are_not_asked_for_are_not_shuffled(spark):
    """However many the keys are: of 4,000 texts of 4 kB, a tenth is asked for, some twice, some that aren't there, and some places hold two rows."""
    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(32)])
    contents = spark.range(4000, numPartitions=4).select((F.col("id") + 1).alias("content_id"), (F.col("id") % 3900).alias("post_id"), F.lit(1).alias("version"), text.alias("content"))
    keys = spark.range(0, 4000, 10).selectExpr("id as post_id", "1L as version")
    keys = keys.union(keys.limit(50)).union(spark.sql("select 7L, 2L union all select cast(null as bigint), 1L union all select -5L, 1L"))
    want = {(i + 1, i) for i in range(0, 3900, 10)}
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the keys were too many for a broadcast
    try:
        got = articles.content_at(contents, keys)
        assert got.columns == contents.columns
        assert {(r["content_id"], r["post_id"]) for r in got.select("content_id", "post_id", F.length("content")).where("length(content) = 4096").collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert shuffled(spark) - before < 4_000_000
    assert articles.content_at(contents, keys.where("false")).count() == articles.content_at(contents.where("false"), keys).count() == 0
