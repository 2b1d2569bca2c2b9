"""Queries that run streaming jobs to their end; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.fixtures import SQL as FIXTURES
from weftline.folders import stored
from weftline.functions import hooks
from weftline.operators import memory, orders, retrieval
from weftline.plans.contested import FLOWN, flow_tables
from weftline.plans.queries import COUNTS, HAVE, VALID, VEC, Tables, _counts, _have, _stock, _vector_queries, query
from weftline.sources import change_log, tables
from weftline.streaming import decisions, jobs, retries

FILES = 4


def stream_of(t: Tables, slices: list[DataFrame], name: str) -> tuple[DataFrame, str]:
    """A stream of ``slices``, one batch each, over files in the shared folder; and a folder for its job."""
    folder = tables.shared_folder(t.spark, name)
    for part in slices:
        part.repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    return t.spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in"), folder


def _order_stream(t: Tables, name: str, wanted: DataFrame | None = None) -> tuple[DataFrame, str]:
    wanted = stored(t.order_req) if wanted is None else wanted  # read for each batch
    return stream_of(t, [wanted.where(f"order_id % 3 = {k}") for k in range(3)], name)


def _read(t: Tables, path: str, schema: str) -> DataFrame:
    return t.spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)


FIRST = """f as (select sku_id, user_id, arg_min(order_id, (order_id % 3, order_id)) as won from order_req group by sku_id, user_id),
k as (select f.*, row_number() over (partition by sku_id order by won % 3, won) as rank, stock from f join sku on sku.id = f.sku_id),
w as (select sku_id, user_id, won from k where rank <= stock)"""


@query("str2_admission_stream", f"with {FIRST} select order_id, won as result_order_id, case when won = order_id then 'ADMITTED' when won is not null then 'RETRY' else 'REJECTED' end as result from order_req o left join w on w.sku_id = o.sku_id and w.user_id = o.user_id")
def _admission(t: Tables) -> DataFrame:
    stream, folder = _order_stream(t, "admission")
    with jobs.state_store(t.spark):
        admitted = jobs.admission_stream(stream, _stock(t), t.order_req.where("false").select("sku_id", "user_id"))
        return jobs.run_to_files(admitted, f"{folder}/out", f"{folder}/check").select("order_id", "result_order_id", "result")


DECIDED = f"""{FIRST}, dc as (select order_id, o.sku_id, o.user_id, case when won = order_id then 'CONFIRMED' else 'CANCELLED' end as status, won is not null as keep_buyer from order_req o left join w on w.sku_id = o.sku_id and w.user_id = o.user_id)"""
#: A seventh of the orders has no reservation; of a buyer's others the last one is open.
COMPLETIONS = f"""{DECIDED}, rv as (select * from order_req where order_id % 7 <> 0), mp as (select sku_id, user_id, max(order_id) as last from rv group by sku_id, user_id),
cp as (select dc.*, case when rv.order_id is null then 'NO_RESERVATION' when mp.last <> dc.order_id then 'BUYER_ORDER_LOST' when status = 'CANCELLED' and sku.id is null then 'STOCK_ERROR' else 'APPLIED' end as result
  from dc left join rv using (order_id) left join mp on mp.sku_id = dc.sku_id and mp.user_id = dc.user_id left join sku on sku.id = dc.sku_id)"""


def _order_run(t: Tables) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """What an order stream decided, and the tables that it began with."""
    wanted = stored(t.order_req)  # each batch reads it
    stream, folder = _order_stream(t, "orders", wanted)
    held = wanted.where("order_id % 7 <> 0").selectExpr("order_id", "sku_id", "user_id", "'PENDING' as state", "cast(null as boolean) as keep_buyer")
    given = (held, wanted.where("user_id % 2 = 0").select("sku_id", "user_id").distinct(), _stock(t), orders.buyer_orders(held))
    with jobs.state_store(t.spark):
        return jobs.run_to_files(jobs.order_stream(stream, t.sku, held, _stock(t), given[3]), f"{folder}/out", f"{folder}/check"), given


@query("str3_order_stream", f"with {DECIDED} select * from dc")
def _orders(t: Tables) -> DataFrame:
    return _order_run(t)[0].select("order_id", "sku_id", "user_id", "status", "keep_buyer")


@query("str3_completions", f"with {COMPLETIONS} select *, result = 'APPLIED' as redis_applied from cp")
def _completions(t: Tables) -> DataFrame:
    return _order_run(t)[0].drop("err", "fresh")


@query("str3_stock", f"with {COMPLETIONS} select id as sku_id, cast(stock + coalesce(n, 0) as bigint) as stock from sku left join (select sku_id, count(*) as n from cp where result = 'APPLIED' and status = 'CANCELLED' group by sku_id) c on c.sku_id = id")
def _stock_after(t: Tables) -> DataFrame:
    decided, given = _order_run(t)
    return orders.after_completions(*given, decided)[2]


@query("str3_outbox", f"""with {DECIDED} select order_id as event_id, '{{"event_id":' || order_id || ',"sku_id":' || sku_id || ',"user_id":' || user_id || '}}' as payload, 0 as status, 0 as retry_count, 'Order' as event_type from dc where status = 'CONFIRMED'""")
def _order_outbox(t: Tables) -> DataFrame:
    return jobs.confirmed_rows(_order_run(t)[0])


@query("str2_stock_flow_stream", FLOWN)
def _flow_stream(t: Tables) -> DataFrame:
    """Requests and outcomes in three batches by arrival."""
    events, stock, held = flow_tables(t)
    cuts = events.approxQuantile("arrival", [1 / 3, 2 / 3], 0.01)
    parts = [f"arrival <= {cuts[0]}", f"arrival > {cuts[0]} and arrival <= {cuts[1]}", f"arrival > {cuts[1]}"]
    stream, folder = stream_of(t, [events.where(p) for p in parts], "flow")
    with jobs.state_store(t.spark):
        return jobs.run_to_files(jobs.admission_stream(stream, stock, held.select("sku_id", "user_id"), held), f"{folder}/out", f"{folder}/check")


@query("snk1_relay", "select order_id, sku_id, user_id from order_req")
def _relay(t: Tables) -> DataFrame:
    stream, folder = _order_stream(t, "relay")
    tables.relay(stream, f"{folder}/out", f"{folder}/check").awaitTermination()
    return _read(t, f"{folder}/out", "order_id long, sku_id long, user_id long").drop("batch")


@query("str8_timed_retries", """select order_id as id, cast(order_id % 5 as int) as attempt, case when order_id % 5 = 4 then 'DEAD' else 'GOOD' end as outcome, true as in_time from order_outcome""")
def _timed_retries(t: Tables) -> DataFrame:
    """Outcomes that fail up to four times and come again two seconds after each failure, the last one when no message comes any more."""
    outcomes = t.order_outcome.select(F.col("order_id").alias("id"), "status")
    n = outcomes.count()
    stream, folder = stream_of(t, [outcomes.where(f"id % 2 = {k}") for k in range(2)], "retries")
    process = lambda df: df.withColumn("err", F.when(F.col("attempt") < F.col("id") % 5, "NOT_YET"))
    with jobs.state_store(t.spark, retries.TIMERS):
        job = retries.timed_retries(stream, process, f"{folder}/out", f"{folder}/check", delay=2, slots=max(16, n // 20_000))
        retries.wait_until_settled(t.spark, job, f"{folder}/out", n)
    ends = [retries.settled(t.spark, f"{folder}/out", name).withColumn("outcome", F.lit(name.upper())) for name in ("good", "dead")]
    return ends[0].unionByName(ends[1]).select("id", "attempt", "outcome", (F.col("tried_at") >= F.col("due")).alias("in_time"))


@query("agg2s_stateful_counters", f"""with {COUNTS}, {HAVE}, {VALID}, s as (select sid, sum(delta) as total from val where err is null and event_id not in (select event_id from outbox_cdc where op <> 'INSERT') group by sid)
select sid, cast(coalesce(turn, 0) as bigint) as turn, cast(case when turn is not null then fav + total else coalesce(fav_count, 0) end as bigint) as fav
from s left join have on have.sku_id = sid left join cnt on cnt.sku_id = sid""")
def _stateful(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    events = t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path.replace("/events.", "/[e]vents."))
    with jobs.state_store(t.spark):
        unique = jobs.counter_events(t.spark.sql(FIXTURES["outbox_cdc"], events=events), slots=16)
        folder = tables.shared_folder(t.spark, "counters")
        out = jobs.run_to_files(jobs.stateful_counters(unique, _have(t), _counts(t)), f"{folder}/out", f"{folder}/check")
    last = out.groupBy("sid").agg(F.max_by(F.struct("turn", "fav"), "n").alias("l"))
    return last.select("sid", "l.turn", "l.fav")


@query("src2_change_log_stream", "select event_id, payload, 0 as status, 0 as retry_count, event_type, cast(null as varchar) as err from outbox_cdc where op = 'INSERT'")
def _change_log(t: Tables) -> DataFrame:
    """A log of a transaction for each change, in as many segments as a shuffle has partitions."""
    names = ["EVENT_ID", "payload", "status", "retry_count", "event_type"]
    values = F.array(F.col("event_id").cast("string"), "payload", F.lit("0"), F.lit("0"), "event_type")
    row = F.array(F.struct(F.array(*map(F.lit, names)).alias("names"), values.alias("values")))
    change = F.to_json(F.struct(F.lit("ROWDATA").alias("type"), F.lit("Outbox").alias("table"), "op", F.lit(False).alias("is_ddl"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), row.alias("rows")))
    lines = t.outbox_cdc.select(F.explode(F.array(F.lit('{"type":"TRANSACTIONBEGIN"}'), change, F.lit('{"type":"TRANSACTIONEND"}'))).alias("value"))
    folder = tables.shared_folder(t.spark, "log")
    lines.repartition(max(FILES, int(t.spark.conf.get("spark.sql.shuffle.partitions")))).write.text(f"{folder}/in")
    images = tables.outbox_inserts(change_log.change_log(t.spark, f"{folder}/in", piece=1 << 16))
    return jobs.run_to_files(tables.to_outbox(images), f"{folder}/out", f"{folder}/check")


#: Of three candidates one is decided with its own slice, one with the next, and one by nobody; the last slice, a day later, is decided at once.
@query("ups6_decision_stream", """select user_id, id as seq, memory_key, case when id % 6 in (1, 2, 5) then 'UPDATE' else 'INSERT' end as action, case when id % 6 in (1, 2, 5) then id + 1 end as target_id,
case when id % 6 in (1, 2, 4, 5) then 'merged ' || content else content end as content from long_memory""")
def _decisions(t: Tables) -> DataFrame:
    base = "timestamp '2024-01-01 00:00:00'"
    part = t.long_memory.selectExpr("id", "user_id", "memory_key", "content", "cast(case id % 6 when 3 then 1 when 5 then 2 else 0 end as int) as slice")
    timed = part.selectExpr("*", f"{base} + make_dt_interval(0, 0, 0, id % 60) + make_dt_interval(if(slice = 2, 1, 0), if(slice = 1, 1, 0), 0, 0) as ts")
    said = timed.where("id % 6 in (1, 2, 4, 5)").selectExpr("ts + make_dt_interval(0, 0, if(id % 6 = 2, 20, 1), 0) as said_at", "user_id", "id as seq", "if(id % 6 = 4, 'INSERT', 'UPDATE') as action", "'merged ' || content as merged", "if(id % 6 = 2, 1, slice) as slice")
    slices = lambda df: [df.where(f"slice = {k}").drop("slice") for k in range(3)]
    cands, folder = stream_of(t, slices(timed.selectExpr("ts", "user_id", "id as seq", "memory_key", "content", "id + 1 as target_id", "slice")), "candidates")
    answers, _ = stream_of(t, slices(said), "decisions")
    return jobs.run_to_files(decisions.decided_candidates(cands, answers, wait="30 minutes"), f"{folder}/out", f"{folder}/check")


@query("str4_publish_stream", """select post_id, cast(version + case when post_id % 6 = 0 then 2 when post_id % 3 < 2 then 1 else 0 end as int) as version, case when post_id % 3 < 2 then 2 else status end as status,
case when post_id % 3 < 2 and title is not null then 1 else 0 end as chunked, post_id % 3 < 2 and status = 1 as first from posts""")
def _publish(t: Tables) -> DataFrame:
    posts = t.posts
    later = posts.where("post_id % 6 = 0").selectExpr("post_id", "version + 1 as version").unionByName(posts.where("post_id % 6 <> 0").selectExpr("post_id", "version + 5 as version"))
    pubs = [posts.where("post_id % 3 = 0").select("post_id", "version"), later, posts.where("post_id % 3 < 2 and post_id % 6 <> 0").select("post_id", "version")]
    stream, folder = stream_of(t, pubs, "publish")
    jobs.publish_stream(stream, posts, t.contents, f"{folder}/out", f"{folder}/check").awaitTermination()
    published = _read(t, f"{folder}/out/published", jobs.PUBLISHED)
    chunked = _read(t, f"{folder}/out/chunks", "post_id long, version int").groupBy("post_id").agg(F.count_distinct("version").cast("int").alias("_n"))
    first = published.where("first").select("post_id", F.lit(True).alias("_first")).distinct()
    rows = jobs.posts_after(posts, published).join(chunked, "post_id", "left").join(first, "post_id", "left")
    return rows.select("post_id", "version", "status", F.coalesce("_n", F.lit(0)).alias("chunked"), F.coalesce("_first", F.lit(False)).alias("first"))


def _nearest_by_text(cands: DataFrame, known: DataFrame) -> DataFrame:
    """A stub for a vector search: an equal text is near, all else is far."""
    have = known.where("status = 'ACTIVE'").groupBy("user_id", "memory_key", "content").agg(F.min(F.struct(F.col("id").alias("doc_id"), "version")).alias("k"))
    return cands.join(have, ["user_id", "memory_key", "content"], "left").select(*cands.columns, "k.doc_id", "k.version", F.when(F.col("k").isNotNull(), 1.0).otherwise(0.0).alias("score"))


def _summarise(texts: DataFrame) -> DataFrame:
    """A stub for a model: how many messages are covered."""
    return texts.groupBy("conversation_id").agg(F.concat(F.lit("covers "), F.count("*").cast("string")).alias("text"), F.max("last_message_id").alias("last_message_id"))


def _memory_run(t: Tables) -> str:
    asked = t.message.where("role = 'user'").selectExpr(
        "id as seq", "conversation_id", "version", "if(id % 7 = 0, ' ', content) as question", "concat('re ', content) as answer",
        "array(named_struct('memory_key', if(id % 2 = 0, 'topics', 'language'), 'content', concat('c', id % 10)), named_struct('memory_key', ' ', 'content', 'x')) as candidates")
    stream, folder = stream_of(t, [asked.where(f"id % 2 = {k}") for k in range(2)], "memory")
    jobs.memory_stream(stream, t.chat, t.posts, t.message, t.long_memory, _nearest_by_text, _summarise, f"{folder}/out", f"{folder}/check").awaitTermination()
    return f"{folder}/out"


@query("str5_memory_stream", """with u as (select conversation_id, 2 * count(*) as n from message where role = 'user' and content is not null and trim(content) <> '' and id % 7 <> 0 group by conversation_id),
mx as (select conversation_id, max(id) as m from message group by conversation_id),
al as (select conversation_id, id from message union all select conversation_id, m + k from mx join u using (conversation_id), lateral (select unnest(range(1, n + 1)) as k)),
op as (select al.*, row_number() over (partition by conversation_id order by al.id desc) as r from al join chat c on c.id = conversation_id where last_message_id is null or al.id > last_message_id),
ev as (select conversation_id, max(id) as pointer from op where r > 6 group by conversation_id),
ct as (select conversation_id, count(*) as n_messages from al group by conversation_id)
select chat.id as conversation_id, n_messages, coalesce(pointer, last_message_id) as last_message_id from chat join ct on ct.conversation_id = chat.id left join ev on ev.conversation_id = chat.id""")
def _memory_stream(t: Tables) -> DataFrame:
    out = _memory_run(t)
    chat = jobs.chat_after(t.chat, _read(t, f"{out}/summaries", jobs.SUMMARIES).drop("batch"))
    n = t.message.select("id", "conversation_id").unionByName(_read(t, f"{out}/messages", jobs.MESSAGES).select("id", "conversation_id")).groupBy("conversation_id").agg(F.count("*").alias("n_messages"))
    return chat.select(F.col("id").alias("conversation_id"), "last_message_id").join(n, "conversation_id")


@query("str5_memory_rows", """with a as (select user_id, m.id as sq, case when m.id % 2 = 0 then 'topics' else 'language' end as memory_key, 'c' || m.id % 10 as content
  from message m join chat c on c.id = conversation_id where role = 'user' and m.content is not null and trim(m.content) <> '' and m.id % 7 <> 0),
tp as (select distinct user_id, memory_key, content from a where memory_key = 'topics'),
lg as (select user_id, memory_key, arg_max(content, sq) as content from a where memory_key = 'language' group by user_id, memory_key),
old as (select *, row_number() over (partition by user_id order by case when memory_key = 'language' and status = 'ACTIVE' then id end desc nulls last) = 1 and memory_key = 'language' and status = 'ACTIVE' as newest from long_memory)
select o.user_id, o.memory_key, coalesce(lg.content, o.content) as content, o.status, cast(o.version + case when lg.content is not null then 1 else 0 end as int) as version from old o left join lg on newest and lg.user_id = o.user_id
union all select user_id, memory_key, content, 'ACTIVE', 1 from tp
union all select user_id, memory_key, content, 'ACTIVE', 1 from lg where user_id not in (select user_id from old where newest)""")
def _memory_rows(t: Tables) -> DataFrame:
    changed = _read(t, f"{_memory_run(t)}/memory", jobs.CHANGED).drop("batch")
    return memory.latest_rows(t.long_memory, changed).drop("id")


@query("u1_model_scores", f"with {VEC} select query_id, chunk_id, score, rank, cast(-score as double) as model_score from vk")
def _scored(t: Tables) -> DataFrame:
    """The stub stands for a model: it turns the order round."""
    return hooks.score(retrieval.vector_topk(_vector_queries(t), t.chunk_vec), lambda pdf: -pdf["score"], name="model_score")


@query("u2_token_counts", "select doc_id, cast(len(list_filter(string_split(coalesce(content, ''), ' '), lambda w: w <> '')) as int) as n from chunk_text")
def _tokens(t: Tables) -> DataFrame:
    count = hooks.tokens(lambda x: x.str.count("[^ ]+"))
    return t.chunk_text.select("doc_id", count("content").alias("n"))
