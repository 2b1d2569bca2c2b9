"""The queries of the library's own operators over the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.fixtures import SQL as FIXTURES
from weftline.fixtures import fixture, with_fixtures
from weftline.functions import scalars
from weftline.operators import articles, chunking, counters, logs, memory, orders, retrieval, similar
from weftline.sources import tables
from weftline.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-06-01 00:00:00"


class Tables:
    """The derived tables of one folder, read when they are named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_fixtures(sql)
        return f

    return add


def simple(name: str, f: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    query(name, sql)(f)


# ---- articles

simple("fil1_visible_posts", lambda t: articles.visible_posts(t.posts), "select * from posts where status in (2, 3)")
simple("fil2_post_state", lambda t: articles.post_state(t.posts, t.posts.where("post_id % 2 = 0")), "select post_id, version, status from posts where post_id % 2 = 0")
simple("fil3_content_at", lambda t: articles.content_at(t.contents, t.posts), "select c.* from contents c join posts p on c.post_id = p.post_id and c.version = p.version")
simple("joi1_published_view", lambda t: articles.published_view(t.posts, t.contents),
       "select p.post_id, user_id, title, status, p.version, content from posts p left join contents c on c.post_id = p.post_id and c.version = p.version where status in (2, 3)")
simple("joi2_draft_view", lambda t: articles.draft_view(t.posts, t.contents),
       "select p.post_id, p.version + 1 as version, status, coalesce(content, '') as content from posts p left join contents c on c.post_id = p.post_id and c.version = p.version + 1")
simple("joi7_published_only", lambda t: articles.published_only(t.chat, articles.visible_posts(t.posts)), "select chat.* from chat where post_id in (select post_id from posts where status in (2, 3))")
simple("agg8_author_catalogue", lambda t: articles.author_catalogue(t.posts).withColumn("titles", F.array_join("titles", "|", "")),
       "select user_id, string_agg(coalesce(title, ''), '|' order by post_id) as titles, count(*) as n from posts group by user_id")
PUBS = "select post_id, version from posts where post_id % 3 = 0 union all select post_id, version + 1 from posts where post_id % 3 = 1"


def _pubs(t: Tables) -> DataFrame:
    return t.posts.where("post_id % 3 = 0").select("post_id", "version").unionByName(t.posts.where("post_id % 3 = 1").selectExpr("post_id", "version + 1 as version"))


simple("win7_latest_publish", lambda t: articles.latest_publish(_pubs(t).unionByName(t.contents.select("post_id", "version"))),
       f"select post_id, max(version) as version from ({PUBS} union all select post_id, version from contents) group by post_id")
simple("ups2_publish", lambda t: articles.apply_publish(t.posts, _pubs(t))[0],
       "select post_id, user_id, title, case when post_id % 3 = 0 then 2 else status end as status, case when post_id % 3 = 0 then version + 1 else version end as version from posts")


EDITED = "ed as (select post_id, k, title, version, case when k = 1 then 'STALE' when k = 2 then 'STALE' when version + 1 <= (post_id - 1) % 3 + 1 then 'ACCEPTED' else 'NO_CONTENT' end as result from posts, (values (0), (1), (2)) as v(k))"


def _edits(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    edits = t.posts.crossJoin(t.spark.range(3).withColumnRenamed("id", "k")).selectExpr(
        "post_id * 10 + k as edit_id", "post_id", "if(k = 2, status + 1, status) as status", "version", "concat('new ', title) as content")
    return articles.apply_edits(t.posts, t.contents, edits)


simple("ups1_edits", lambda t: _edits(t)[2], f"with {EDITED} select post_id * 10 + k as edit_id, result from ed")
simple("ups1_posts", lambda t: _edits(t)[0], f"with {EDITED} select posts.post_id, user_id, posts.title, cast(status + case when result = 'ACCEPTED' then 1 else 0 end as int) as status, posts.version from posts join ed on ed.post_id = posts.post_id and k = 0")
simple("ups1_contents", lambda t: _edits(t)[1],
       f"with {EDITED} select content_id, c.post_id, c.version, case when ed.post_id is not null then concat('new ', title) else content end as content from contents c left join ed on ed.post_id = c.post_id and k = 0 and result = 'ACCEPTED' and c.version = ed.version + 1")


def _views(t: Tables) -> DataFrame:
    return t.posts.where("post_id % 4 <> 3").selectExpr("post_id", "version", "if(post_id % 5 = 0, null, concat('p', post_id)) as payload")


VIEWS = "v as (select post_id, version, case when post_id % 5 = 0 then null else concat('p', cast(post_id as varchar)) end as payload from posts where post_id % 4 <> 3)"
simple("ups3_refill", lambda t: articles.refill(_views(t), _pubs(t).selectExpr("post_id", "version", "if(post_id % 2 = 0, 'fresh', null) as payload")),
       f"""with {VIEWS}, n as (select post_id, version as nv, case when post_id % 2 = 0 then 'fresh' end as np from ({PUBS}))
       select coalesce(v.post_id, n.post_id) as post_id, case when nv >= coalesce(version, nv) then nv else version end as version,
              case when nv >= coalesce(version, nv) and np is not null then np else payload end as payload from v full join n on v.post_id = n.post_id""")  # fmt: skip
simple("ups4_publish_barrier", lambda t: articles.publish_barrier(_views(t), _pubs(t)),
       f"""with {VIEWS}, n as (select post_id, version as nv from ({PUBS}))
       select coalesce(v.post_id, n.post_id) as post_id, case when nv is not null and (version is null or nv > version) then nv else version end as version,
              case when nv is not null and (version is null or nv > version) then null else payload end as payload from v full join n on v.post_id = n.post_id""")  # fmt: skip
simple("ups5_resolve_view", lambda t: articles.resolve_view(_views(t)),
       f"with {VIEWS} select post_id, case when version = 0 then 'MISSING' when payload is not null then 'HIT' else 'MISS' end as hit, case when version <> 0 then payload end as payload from v")

# ---- counters

TRANSITIONS = "tr as (select *, status - lag(status, 1, 0) over (partition by sku_id, user_id order by ts, event_id) as delta from fav_event)"
LATEST = "lf as (select sku_id, user_id, arg_max(status, (ts, event_id)) as status from fav_event group by sku_id, user_id)"
COUNTS = f"{LATEST}, cnt as (select sku_id, count(*) filter (where status = 1) as fav_count from lf group by sku_id)"
HAVE = "have as (select sku_id, 3 as turn, fav_count + case when sku_id % 3 = 0 then 1 else 0 end as fav from cnt where sku_id % 7 <> 0)"
VALID = """ev as (select event_id, cast(json_extract(payload, '$.sid') as bigint) as sid, json_extract_string(payload, '$.metric') as metric, cast(json_extract(payload, '$.idx') as int) as idx,
  cast(json_extract(payload, '$.delta') as int) as delta from outbox_cdc where event_type = 'CounterEvent'),
val as (select *, case when sid <= 0 then 'BAD_SID' when metric = 'turn' then 'METRIC_MISMATCH' end as err from ev)"""


def _counts(t: Tables) -> DataFrame:
    return counters.active_fav(counters.latest_fav(t.fav_event))


def _have(t: Tables) -> DataFrame:
    return _counts(t).where("sku_id % 7 <> 0").selectExpr("sku_id", "3 as turn", "fav_count + if(sku_id % 3 = 0, 1, 0) as fav")


simple("win1_fav_transitions", lambda t: counters.fav_transitions(t.fav_event), f"with {TRANSITIONS} select sku_id, user_id, event_id, delta from tr where delta <> 0")
simple("win2_latest_fav", lambda t: counters.latest_fav(t.fav_event), f"with {LATEST} select * from lf")
simple("agg1_active_fav", _counts, f"with {COUNTS} select * from cnt")
simple("joi5_sku_fav_counts", lambda t: counters.sku_fav_counts(t.sku, counters.latest_fav(t.fav_event)), f"with {COUNTS} select id as sku_id, coalesce(fav_count, 0) as fav_count from sku left join cnt on sku_id = id")
simple("fil5_counter_events", lambda t: counters.validate_counter_events(t.outbox_cdc), f"with {VALID} select * from val")
simple("agg2_fold_deltas", lambda t: counters.fold_deltas(counters.validate_counter_events(t.outbox_cdc.unionByName(t.outbox_cdc))),
       f"with {VALID} select sid, idx, cast(sum(delta) as bigint) as delta, cast(null as varchar) as err from val where err is null group by sid, idx")
# Deltas so large that counters leave 32 bits again and again; those of sid 1 to 5 are small.
WIDE = "select event_id + 1 as event_id, event_id % 20 + 1 as sid, cast(1 + event_id % 2 as int) as idx, cast(case when event_id % 20 < 5 then event_id % 7 - 3 else (event_id * 7919) % 2000000011 - 900000000 end as int) as delta, cast(null as varchar(9)) as err from {events}"
WIDE_START = "select distinct event_id % 20 + 1 as sid, 1 as idx, cast(1000 * (event_id % 20) as bigint) as value from {events} where event_id % 3 = 0"


def _wide(t: Tables) -> DataFrame:
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    return counters.apply_deltas(t.spark.sql(WIDE, events=events), t.spark.sql(WIDE_START, events=events), 1000)


query("agg2_per_event", f"""with w as ({WIDE.format(events='events')}), st as ({WIDE_START.format(events='events')}),
g as (select sid, idx, list({{'v': cast(delta as bigint), 'r': cast(0 as bigint)}} order by event_id) as d, count(*) as n from w group by sid, idx),
f as (select sid, idx, n, list_reduce(list_prepend({{'v': coalesce(value, 0), 'r': cast(0 as bigint)}}, d), lambda a, x: case when a.v + x.v between -2147483648 and 2147483647 then {{'v': a.v + x.v, 'r': a.r}} else {{'v': a.v, 'r': a.r + 1}} end) as e from g left join st using (sid, idx))
select sid, idx, e.v as value, n, e.r as rejected from f""")(_wide)
simple("fil10_count_range", lambda t: counters.check_count_range(_counts(t).selectExpr("sku_id", "fav_count - if(sku_id % 4 = 0, 100000, 0) as fav_count")),
       f"with {COUNTS}, x as (select sku_id, fav_count - case when sku_id % 4 = 0 then 100000 else 0 end as fav_count from cnt) select *, case when fav_count not between 0 and 2147483647 then 'COUNT_OUT_OF_RANGE' end as err from x")
simple("fil11_sku_id", lambda t: counters.check_sku_id(_counts(t).selectExpr("sku_id - 3 as sku_id", "fav_count")), f"with {COUNTS} select sku_id - 3 as sku_id, fav_count, case when sku_id - 3 <= 0 then 'BAD_SKU_ID' end as err from cnt")
simple("joi9_fav_vs_counter", lambda t: counters.fav_vs_counter(_counts(t), _have(t)), f"with {COUNTS}, {HAVE} select cnt.sku_id, fav_count, turn, fav, have.sku_id is not null as exists from cnt left join have on cnt.sku_id = have.sku_id")
RECON = f"{COUNTS}, {HAVE}, rec as (select cnt.sku_id, coalesce(turn, 0) as turn, fav_count as fav, case when fav = fav_count then 'UNCHANGED' else 'CORRECTED' end as result, cast(null as varchar) as err from cnt left join have on cnt.sku_id = have.sku_id)"
simple("ups10_reconcile", lambda t: counters.reconcile(_counts(t), _have(t)), f"with {RECON} select * from rec")
simple("agg10_reconcile_summary", lambda t: counters.reconcile_summary(counters.reconcile(_counts(t), _have(t))),
       f"with {RECON} select count(*) as scanned, count(*) filter (where result = 'CORRECTED') as corrected, cast(0 as bigint) as skipped, count(*) filter (where result = 'FAILED') as failed from rec")
simple("str7_reconcile", lambda t: counters.reconcile(counters.sku_fav_counts(t.sku, counters.latest_fav(t.fav_event)), _have(t)),
       f"with {COUNTS}, {HAVE} select id as sku_id, coalesce(turn, 0) as turn, coalesce(fav_count, 0) as fav, case when fav = coalesce(fav_count, 0) then 'UNCHANGED' else 'CORRECTED' end as result, cast(null as varchar) as err from sku left join cnt on cnt.sku_id = id left join have on have.sku_id = id")
simple("ups11_rebuild", lambda t: counters.rebuild_missing(counters.validate_counter_events(t.outbox_cdc), _have(t), counters.latest_fav(t.fav_event)).selectExpr("sku_id", "turn", "cast(fav as bigint) as fav"),
       f"with {COUNTS}, {HAVE}, {VALID} select sku_id, turn, cast(fav as bigint) as fav from have union all select s.sid, 0, coalesce(fav_count, 0) from (select distinct sid from val where err is null and sid not in (select sku_id from have)) s left join cnt on sku_id = sid")
simple("sca1_counter_codec", lambda t: counters.loaded(counters.stored(_counts(t).selectExpr("sku_id", "cast(sku_id - 10 as int) as turn", "cast(-fav_count as int) as fav"))),
       f"with {COUNTS} select sku_id, cast(sku_id - 10 as int) as turn, cast(-fav_count as int) as fav from cnt")
simple("snk2_outbox_rows", lambda t: tables.to_outbox_rows(counters.fav_transitions(t.fav_event), "FavChange").select("event_id", "status", "retry_count", "event_type"),
       f"with {TRANSITIONS} select event_id, 0 as status, 0 as retry_count, 'FavChange' as event_type from tr where delta <> 0")

# ---- orders

REQ = "req as (select row_number() over (order by order_id) as arrival, order_id, sku_id, user_id from order_req)"


def _requests(t: Tables) -> DataFrame:
    return t.order_req.withColumn("arrival", F.col("order_id"))


def _stock(t: Tables) -> DataFrame:
    return t.sku.selectExpr("id as sku_id", "cast(stock as bigint) as stock")


def _admitted(t: Tables) -> DataFrame:
    none = t.order_req.where("false")
    return orders.admit(_requests(t), _stock(t), none.select("sku_id", "user_id"), none.selectExpr("order_id", "sku_id", "user_id", "'PENDING' as state"))


def _decided(t: Tables) -> DataFrame:
    none = t.order_req.where("false")
    said = none.selectExpr("order_id", "sku_id", "user_id", "'CONFIRMED' as status", "true as keep_buyer")
    return orders.decide(t.order_req, none.selectExpr("order_id as id", "sku_id", "user_id"), said, t.sku)


FIRST = """f as (select sku_id, user_id, min(order_id) as won from order_req group by sku_id, user_id),
k as (select f.*, row_number() over (partition by sku_id order by won) as rank, stock from f join sku on sku.id = f.sku_id),
w as (select sku_id, user_id, won from k where rank <= stock)"""
DECIDED = f"""{FIRST}, dec as (select o.order_id, o.sku_id, o.user_id, case when won = o.order_id then 'CONFIRMED' else 'CANCELLED' end as status,
  won is not null as keep_buyer, cast(null as varchar) as err from order_req o left join w on w.sku_id = o.sku_id and w.user_id = o.user_id)"""
simple("win3_admission", _admitted,
       f"with {FIRST} select order_id, won as result_order_id, case when won = order_id then 'ADMITTED' when won is not null then 'RETRY' else 'REJECTED' end as result, cast(null as varchar) as err from order_req o left join w on w.sku_id = o.sku_id and w.user_id = o.user_id")
simple("win4_decision", _decided, f"with {DECIDED} select * from dec")
# The same over all items and buyers, whose number grows with the tables.
ALL_FIRST, ALL_DECIDED = (x.replace("order_req", "order_all").replace("join sku on sku.id", "join sku_all on sku_all.id") for x in (FIRST, DECIDED))


def _all_stock(t: Tables) -> DataFrame:
    return t.sku_all.selectExpr("id as sku_id", "cast(stock as bigint) as stock")


def _all_admitted(t: Tables) -> DataFrame:
    none = t.order_all.where("false")
    return orders.admit(t.order_all.withColumn("arrival", F.col("order_id")), _all_stock(t), none.select("sku_id", "user_id"), none.selectExpr("order_id", "sku_id", "user_id", "'PENDING' as state"))


def _all_decided(t: Tables) -> DataFrame:
    none = t.order_all.where("false")
    return orders.decide(t.order_all, none.selectExpr("order_id as id", "sku_id", "user_id"), none.selectExpr("order_id", "sku_id", "user_id", "'CONFIRMED' as status", "true as keep_buyer"), t.sku_all)


simple("win3_all_items", _all_admitted,
       f"with {ALL_FIRST} select order_id, won as result_order_id, case when won = order_id then 'ADMITTED' when won is not null then 'RETRY' else 'REJECTED' end as result, cast(null as varchar) as err from order_all o left join w on w.sku_id = o.sku_id and w.user_id = o.user_id")
simple("win4_all_items", _all_decided, f"with {ALL_DECIDED} select * from dec")
simple("agg4_consume_stock", lambda t: orders.consume_stock(t.sku, _decided(t)),
       f"with {DECIDED} select id as sku_id, cast(greatest(0, stock - coalesce(n, 0)) as bigint) as stock from sku left join (select sku_id, count(*) as n from dec where status = 'CONFIRMED' group by sku_id) on sku_id = id")
simple("agg5_release_stock", lambda t: orders.release_stock(_stock(t), _decided(t).withColumnRenamed("status", "state")),
       f"with {DECIDED} select id as sku_id, stock + coalesce(n, 0) as stock, cast(null as varchar) as err from sku left join (select sku_id, count(*) as n from dec where status = 'CANCELLED' group by sku_id) on sku_id = id")
simple("fil6_validate_orders", lambda t: orders.validate_orders(t.order_req.selectExpr("concat(if(order_id % 7 = 0, '0', ''), order_id) as order_id", "cast(sku_id - 1 as string) as sku_id", "cast(user_id as string) as user_id")),
       "select case when order_id % 7 <> 0 then order_id end as order_id, case when sku_id > 1 then sku_id - 1 end as sku_id, user_id, case when order_id % 7 = 0 or sku_id <= 1 then 'INVALID_ORDER' end as err from order_req")
simple("src4_order_events", lambda t: tables.parse_order_events(t.order_req.selectExpr("cast(order_id as string) as orderId", "cast(sku_id as string) as skuId", "if(user_id % 10 = 0, 'x', cast(user_id as string)) as userId")),
       "select order_id, sku_id, case when user_id % 10 <> 0 then user_id end as user_id, case when user_id % 10 = 0 then 'INVALID_ORDER' end as err from order_req")
simple("agg3_duplicate_purchases", lambda t: orders.duplicate_purchases(t.order_req), "select sku_id, user_id, count(*) as duplicate_count from order_req group by sku_id, user_id having count(*) > 1")
simple("agg11_conflicting_payloads", lambda t: orders.conflicting_payloads(t.order_req.unionByName(t.order_req.where("order_id % 5 = 0").withColumn("user_id", F.col("user_id") + 1))),
       "select order_id, cast(2 as bigint) as n_variants from order_req where order_id % 5 = 0")
simple("agg13_backlog", lambda t: orders.backlog(t.order_req, t.order_req.where("order_id % 3 = 0"), 1000), "select count(*) as backlog, count(*) >= 1000 as is_full from order_req where order_id % 3 <> 0")
simple("joi11_order_history", lambda t: orders.order_history(t.order_req, t.order_req.where("order_id % 3 = 0").withColumnRenamed("order_id", "id")),
       "select o.order_id, o.sku_id, o.user_id, o.order_id % 3 = 0 as same_id, min(p.order_id) as prior_order_id from order_req o left join order_req p on p.sku_id = o.sku_id and p.user_id = o.user_id and p.order_id % 3 = 0 and p.order_id <> o.order_id group by all")
OUTCOMES = f"{DECIDED}, res as (select order_id, sku_id, user_id, case when order_id % 4 = 0 then 'CONFIRMED' when order_id % 4 = 1 then 'CANCELLED' else 'PENDING' end as state, keep_buyer from dec where order_id % 11 <> 0)"


def _reservations(t: Tables) -> DataFrame:
    # An id belongs to one item and buyer: another payload under it holds nothing.
    return _decided(t).where("order_id % 11 <> 0 and err is null").selectExpr("order_id", "sku_id", "user_id", "case order_id % 4 when 0 then 'CONFIRMED' when 1 then 'CANCELLED' else 'PENDING' end as state", "keep_buyer")


simple("joi10_reservation_outcome", lambda t: orders.reservation_with_outcome(_reservations(t), _decided(t)).select("order_id", "state", "status", "err"),
       f"with {OUTCOMES} select dec.order_id, state, status, case when state is null then 'NO_RESERVATION' when state <> 'PENDING' and state <> status then 'STATE_CONFLICT' end as err from dec left join res using (order_id)")
# Buyers' open orders: the last pending one, but for some that were lost; marks of buyers with an even id; stock of item 5 is malformed, that of item 6 full but for two units.
HELD = f"""{OUTCOMES}, mp as (select sku_id, user_id, max(order_id) as order_id from res where state = 'PENDING' and user_id % 9 <> 0 group by sku_id, user_id),
by_ as (select distinct sku_id, user_id from order_req where user_id % 2 = 0),
sk as (select id as sku_id, case id when 5 then -1 when 6 then 9223372036854775805 else cast(stock as bigint) end as stock from sku),
j as (select dec.order_id, dec.sku_id, dec.user_id, status, dec.keep_buyer, state, case when state is null then 'NO_RESERVATION' when state <> 'PENDING' and state <> status then 'STATE_CONFLICT'
  when state = 'PENDING' and mp.order_id is distinct from dec.order_id then 'BUYER_ORDER_LOST' end as err, sk.stock
  from dec left join res using (order_id) left join mp on mp.sku_id = dec.sku_id and mp.user_id = dec.user_id left join sk on sk.sku_id = dec.sku_id),
bk as (select order_id, row_number() over (partition by sku_id order by order_id) as place from j where err is null and state = 'PENDING' and status = 'CANCELLED'),
dn as (select j.order_id, sku_id, user_id, status, keep_buyer, case when err is not null then err when place is not null and (stock is null or stock < 0 or place > 9223372036854775807 - stock) then 'STOCK_ERROR' when state = 'PENDING' then 'APPLIED' else 'UNCHANGED' end as result
  from j left join bk using (order_id)),
ap as (select * from dn where result = 'APPLIED'), ca as (select * from ap where status = 'CANCELLED')"""


def _held(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reservations, buyers, stock and buyers' open orders."""
    held = _reservations(t)
    mapped = orders.buyer_orders(held.where("state = 'PENDING' and user_id % 9 <> 0"))
    buyers = t.order_req.where("user_id % 2 = 0").select("sku_id", "user_id").distinct()
    stock = t.sku.selectExpr("id as sku_id", "case id when 5 then -1 when 6 then 9223372036854775805 else cast(stock as bigint) end as stock")
    return held, buyers, stock, mapped


simple("ups8_complete", lambda t: orders.complete(*_held(t), _decided(t))[4], f"with {HELD} select * from dn")
simple("ups8_reservations", lambda t: orders.complete(*_held(t), _decided(t))[0],
       f"with {HELD} select res.order_id, res.sku_id, res.user_id, coalesce(ap.status, state) as state, case when ap.status = 'CANCELLED' then ap.keep_buyer else res.keep_buyer end as keep_buyer from res left join ap using (order_id)")
simple("ups8_buyers", lambda t: orders.complete(*_held(t), _decided(t))[1],
       f"with {HELD} select sku_id, user_id from by_ where (sku_id, user_id) not in (select (sku_id, user_id) from ca where not keep_buyer) union select sku_id, user_id from ca where keep_buyer")
simple("ups8_stock", lambda t: orders.complete(*_held(t), _decided(t))[2],
       f"with {HELD} select sku_id, cast(stock + coalesce(n, 0) as bigint) as stock from sk left join (select sku_id, count(*) as n from ca group by sku_id) using (sku_id)")
simple("ups8_buyer_orders", lambda t: orders.complete(*_held(t), _decided(t))[3], f"with {HELD} select sku_id, user_id, order_id from mp where order_id not in (select order_id from ca)")
simple("top1_recovery_queue", lambda t: orders.recovery_queue(t.order_outcome, F.lit(NOW).cast("timestamp_ntz")),
       f"select * from order_outcome where not redis_applied and next_retry_at <= timestamp '{NOW}' and status in ('CONFIRMED', 'CANCELLED') order by next_retry_at, order_id limit 100")
simple("ups9_mark_applied", lambda t: orders.mark_applied(t.order_outcome, t.order_outcome.where("order_id % 3 = 0")),
       "select order_id, status, redis_applied or (order_id % 3 = 0 and status <> 'PROCESSING') as redis_applied, next_retry_at from order_outcome")
simple("sca10_postpone", lambda t: orders.postpone(t.order_outcome, t.order_outcome.where("order_id % 3 = 0"), F.lit(NOW).cast("timestamp_ntz")),
       f"select order_id, status, redis_applied, case when order_id % 3 = 0 then timestamp '{NOW}' + interval 30 second else next_retry_at end as next_retry_at from order_outcome")
simple("top4_overdue", lambda t: orders.overdue(t.order_outcome.selectExpr("order_id", "redis_applied as delivered", "next_retry_at as last_delivery"), F.lit(NOW).cast("timestamp_ntz")),
       f"select order_id, redis_applied as delivered, next_retry_at as last_delivery from order_outcome where not redis_applied and epoch_ms(timestamp '{NOW}') - epoch_ms(next_retry_at) >= 60000 order by last_delivery, order_id limit 100")

# ---- retrieval

DOT = "list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[])) * list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[])))"
VEC = f"""vs as (select a.vec_id as query_id, b.chunk_id, round({DOT}, 6) as score from chunk_vec a join chunk_vec b on a.post_id = b.post_id and a.version = b.version where a.vec_id % 50 = 0),
vk as (select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from vs qualify rank <= 40)"""


def _vector_queries(t: Tables) -> DataFrame:
    return t.chunk_vec.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "post_id", "version", "embedding")


def _word_queries(t: Tables) -> DataFrame:
    return t.chunk_text.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "post_id", "version", F.array(F.lit("the"), F.lit("en"), F.lit("der"), F.lit("las")).alias("keywords"))


BM = r"""q as (select doc_id as query_id, post_id, version, unnest(['the', 'en', 'der', 'las']) as term from chunk_text where doc_id % 50 = 0),
d as (select chunk_id, post_id, version, list_filter(regexp_split_to_array(lower(content), '[^\pL]+'), lambda w: w <> '') as ts from chunk_text),
st as (select count(*) as n, avg(len(ts)) as avgl from d),
tf as (select chunk_id, post_id, version, len, term, count(*) as tf from (select chunk_id, post_id, version, len(ts) as len, unnest(ts) as term from d) where term in ('the', 'en', 'der', 'las') group by all),
df as (select term, count(*) as df from tf group by term),
bs as (select query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgl))), 6) as score
       from q join tf using (post_id, version, term) join df using (term), st group by query_id, chunk_id)"""
simple("ret1_vector_topk", lambda t: retrieval.vector_topk(_vector_queries(t), t.chunk_vec), f"with {VEC} select * from vk")
simple("ret1_approximate_topk", lambda t: similar.approximate_topk(t.chunk_vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), t.chunk_vec, filters=()))
simple("ret2_bm25_topk", lambda t: retrieval.bm25_topk(_word_queries(t), t.chunk_text), f"with {BM} select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from bs qualify rank <= 40")
# Another list: the same hits the other way round, two of three under ids that the first list lacks, and some without id.
OTHER = "ot as (select query_id, case when rank % 7 = 0 then null when rank % 3 = 0 then chunk_id else concat(chunk_id, 'x') end as chunk_id, 41 - rank as rank from vk)"


def _two_lists(t: Tables) -> list[DataFrame]:
    one = retrieval.vector_topk(_vector_queries(t), t.chunk_vec)
    return [one, one.selectExpr("query_id", "case when rank % 7 = 0 then null when rank % 3 = 0 then chunk_id else concat(chunk_id, 'x') end as chunk_id", "41 - rank as rank")]


FUSED = f"{VEC}, {OTHER}, fu as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) as score from (select query_id, chunk_id, rank from vk union all select * from ot) where chunk_id is not null group by all)"
simple("set1_fuse_lists", lambda t: retrieval.fuse_lists(_two_lists(t)), f"with {FUSED} select * from fu")
simple("ret3_rrf", lambda t: retrieval.rrf(_two_lists(t)), f"with {FUSED} select *, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from fu qualify rank <= 30")
simple("top3_topk_per_group", lambda t: retrieval.topk_per_group(t.chunk_vec.drop("embedding"), ["post_id", "version"], [F.desc("vec_id")], 5),
       "select vec_id, post_id, version, chunk_id, cast(row_number() over (partition by post_id, version order by vec_id desc) as int) as rank from chunk_vec qualify rank <= 5")
simple("sca4_chunk_index", lambda t: t.chunk_vec.select("vec_id", scalars.chunk_index(F.col("chunk_id")).alias("idx")), "select vec_id, cast(vec_id as int) as idx from chunk_vec")
simple("ret4_rerank", lambda t: retrieval.rerank(retrieval.vector_topk(_vector_queries(t), t.chunk_vec), retrieval.vector_topk(_vector_queries(t), t.chunk_vec).selectExpr("query_id", "chunk_id", "-score as rerank_score")),
       f"with {VEC} select query_id, chunk_id, score, rerank_score, r as rank from (select query_id, chunk_id, score, -score as rerank_score, cast(row_number() over (partition by query_id order by score, chunk_id) as int) as r from vk) where r <= 5")
simple("joi8_with_previous", lambda t: retrieval.with_previous(t.chunk_text.selectExpr("post_id as query_id", "cast(doc_id div 20 as int) as chunk_idx", "content as text", "cast(length(content) as int) as source_end")),
       "with s as (select post_id as query_id, cast(doc_id // 20 as int) as chunk_idx, content as text, cast(length(content) as int) as source_end from chunk_text) select a.*, b.text as prev_text, b.source_end as prev_end from s a left join s b on a.query_id = b.query_id and a.chunk_idx = b.chunk_idx + 1")
MEMORY_DOCS = "md as (select m.*, e.embedding from long_memory m join embeddings e on e.vec_id + 1 = m.id)"


def _memory_docs(t: Tables) -> DataFrame:
    vectors = t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").selectExpr("vec_id + 1 as id", "embedding")
    return t.long_memory.join(vectors, "id").withColumnRenamed("id", "doc_id")


simple("ret6_memory_search", lambda t: retrieval.memory_search(_memory_docs(t).where("doc_id % 10 = 0").selectExpr("doc_id as query_id", "user_id", "memory_key", "embedding"), _memory_docs(t), 2, 0.2),
       f"""with {MEMORY_DOCS}, s as (select a.id as query_id, a.memory_key, b.id as doc_id, round({DOT}, 6) as score from md a join md b on a.user_id = b.user_id and a.memory_key = b.memory_key
       where a.id % 10 = 0 and a.memory_key in ('topics', 'current_goal') and b.status = 'ACTIVE')
       select query_id, memory_key, doc_id, score from (select *, row_number() over (partition by query_id, memory_key order by score desc, doc_id) as r from s) where r <= 2 and score >= 0.2""")  # fmt: skip
NEAREST = f"""nm as (select a.user_id, a.id as seq, a.memory_key, b.id as doc_id, b.version, coalesce(round({DOT}, 6), 0) as score from md a left join md b on a.user_id = b.user_id and a.memory_key = b.memory_key and b.status = 'ACTIVE'
  where a.id % 10 = 0 qualify row_number() over (partition by a.id order by score desc, b.id) = 1)"""


def _nearest(t: Tables) -> DataFrame:
    return retrieval.nearest_memory(_memory_docs(t).where("doc_id % 10 = 0").selectExpr("user_id", "doc_id as seq", "memory_key", "embedding"), _memory_docs(t))


simple("ret7_nearest_memory", _nearest, f"with {MEMORY_DOCS}, {NEAREST} select user_id, seq, memory_key, doc_id, version, score from nm")


def _folded(t: Tables) -> DataFrame:
    """Memories of odd ids as candidates, one by one, beside the others; decisions for two thirds of them."""
    docs = _memory_docs(t).withColumnRenamed("doc_id", "id")
    cands = docs.where("id % 2 = 1").selectExpr("id as seq", "user_id", "memory_key", "concat('new ', id) as content", "embedding")
    said = cands.where("seq % 3 <> 0").selectExpr("seq", "if(seq % 3 = 1, 'UPDATE', 'INSERT') as action", "concat('merged ', seq) as merged")
    return memory.fold_candidates(docs.where("id % 2 = 0"), cands, said, 0.5, 0.2)


simple("ups7_fold_candidates", _folded)
simple("ups6_route", lambda t: memory.route(_nearest(t)),
       f"with {MEMORY_DOCS}, {NEAREST}, r as (select *, case when memory_key = 'language' then 'SINGLETON' when score >= 0.88 then 'UPDATE' when score >= 0.75 then 'DECIDE' else 'INSERT' end as action from nm) select *, case when action in ('UPDATE', 'DECIDE') then doc_id end as target_id from r")

# ---- memory

OPEN = "un as (select m.*, row_number() over (partition by conversation_id order by m.id desc) as n from message m join chat c on c.id = m.conversation_id where last_message_id is null or m.id > last_message_id)"
simple("win5_memory_window", lambda t: memory.memory_window(t.message, t.chat), f"with {OPEN} select id, conversation_id, version, role, content from un where n <= 6")
simple("win6_evicted", lambda t: memory.evicted(t.message, t.chat, 3).withColumn("evicted", F.array_join("evicted", ",")),
       f"with {OPEN} select conversation_id, max(id) as last_message_id, string_agg(cast(id as varchar), ',' order by id) as evicted from un where n > 3 group by conversation_id")
simple("win8_latest_singleton", lambda t: memory.latest_singleton(t.long_memory), "select * from long_memory where memory_key = 'language' and status = 'ACTIVE' qualify row_number() over (partition by user_id order by id desc) = 1")
simple("agg6_transcript", lambda t: memory.transcript(t.message), "select conversation_id, string_agg(concat(role, ': ', content), chr(10) order by id) as text from message group by conversation_id")
simple("agg12_conversation_ids", lambda t: memory.conversation_ids(t.chat), "select id from chat")
simple("joi3_chat_version", lambda t: memory.chat_version(t.chat, t.posts), "select id as chat_id, version from chat join posts on chat.post_id = posts.post_id")
simple("joi4_chat_owner", lambda t: memory.chat_owner(t.message.select("id", "conversation_id"), t.chat), "select message.id, conversation_id, user_id from message join chat on chat.id = conversation_id")
simple("set2_context", lambda t: memory.conversation_context(t.chat, t.message),
       f"with {OPEN} select id as conversation_id, cast(0 as bigint) as pos, 'system' as role, '以下是较早对话的摘要：' || chr(10) || summary as content from chat where summary is not null union all select conversation_id, id, role, content from un")
simple("set3_clear", lambda t: memory.clear_conversations(t.chat, t.message, t.chat.where("id % 2 = 0"))[0],
       "select id, user_id, post_id, case when id % 2 <> 0 then summary end as summary, case when id % 2 <> 0 then last_message_id end as last_message_id from chat")
simple("set4_union_memories", lambda t: memory.union_memories(t.long_memory.where("memory_key = 'topics'"), t.long_memory.where("memory_key = 'current_goal'")), "select * from long_memory where memory_key in ('topics', 'current_goal')")
simple("fil4_exact_memory", lambda t: memory.exact_memory(t.long_memory, t.long_memory.where("user_id % 2 = 0")),
       "select user_id, id, memory_key, content from long_memory where status = 'ACTIVE' and user_id % 2 = 0 and memory_key in ('tech_stack', 'skill_level')")
simple("fil7_valid_candidates", lambda t: memory.valid_candidates(t.cands), "select * from cands where trim(memory_key) <> '' and content is not null")
simple("fil9_memory_updates", lambda t: memory.validate_memory_updates(t.message.selectExpr("if(id % 5 = 0, null, conversation_id) as conversation_id", "if(id % 7 = 0, ' ', content) as question", "if(id % 3 = 0, null, content) as answer")),
       "select case when id % 5 <> 0 then conversation_id end as conversation_id, case when id % 7 = 0 then ' ' else content end as question, case when id % 3 <> 0 then content end as answer, case when id % 5 = 0 then 'NO_CONVERSATION' when id % 7 = 0 then 'NO_QUESTION' when id % 3 = 0 then 'NO_ANSWER' end as err from message")
simple("ups12_append_messages", lambda t: memory.append_messages(t.message, t.message.where("id % 2 = 0").selectExpr("conversation_id", "id as seq", "version", "role", "if(role = 'user', null, content) as content"), t.chat, t.posts).select("id", "conversation_id", "role", "content"),
       "select id, conversation_id, role, content from message union all select mx + row_number() over (partition by m.conversation_id order by m.id), m.conversation_id, role, case when role = 'user' then '' else content end from message m join (select conversation_id, max(id) as mx from message group by 1) x on x.conversation_id = m.conversation_id where m.id % 2 = 0")
simple("ups13_summaries", lambda t: memory.apply_summaries(t.chat, t.chat.selectExpr("id as conversation_id", "if(id % 2 = 0, ' new ', ' ') as text", "id * 7 as last_message_id")),
       "select id, user_id, post_id, case when id % 2 = 0 then 'new' else summary end as summary, case when id % 2 = 0 then id * 7 else last_message_id end as last_message_id, case when id % 2 <> 0 then 'EMPTY_SUMMARY' end as err from chat")

# ---- chunks and logs; what SQL can't express has tests

MARKDOWN = r"select doc_id+1 post_id, 1 version, concat('# ', source, chr(10), chr(10), '## part ', cast(doc_id as varchar(9)), chr(10), chr(10), replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10), '- a', chr(10), '- b', chr(10), chr(10), repeat('`', 3), chr(10), 'x = 1', chr(10), repeat('`', 3), chr(10), case when doc_id % 3 = 0 then concat(chr(10), '---', chr(10)) else '' end) content from {documents}"


def _markdown(t: Tables) -> DataFrame:
    return t.spark.sql(MARKDOWN, documents=t.spark.read.parquet(f"{t.sf_dir}/documents.parquet"))


def _simple_markdown(t: Tables) -> DataFrame:
    """Documents whose k-th line is a paragraph, a list item, a quote or a heading, by k."""
    marks = F.array(F.lit(""), F.lit("- "), F.lit("> "), F.lit("## "))
    line = lambda x, i: F.concat(F.element_at(marks, i % 4 + 1), F.lit("w "), F.regexp_replace(x, "[^A-Za-z ]", ""))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line)
    documents = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return documents.select((F.col("doc_id") + 1).alias("post_id"), F.lit(1).alias("version"), F.array_join(lines, "\n\n").alias("content"))


simple("txt1_simple_blocks", lambda t: chunking.markdown_blocks(_simple_markdown(t)).select("post_id", "block_idx", "type", "level", F.array_join("path", "|").alias("path"), "strong", F.md5("text").alias("text_md5")),
       """with d as (select doc_id + 1 as post_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
       l as (select post_id, len(ls) as n, unnest(generate_series(1, len(ls))) as k, unnest(ls) as x from d),
       b as (select post_id, n, cast(k - 1 as integer) as block_idx, cast((k - 1) % 4 as integer) as m, 'w ' || regexp_replace(x, '[^A-Za-z ]', '', 'g') as x from l)
       select post_id, block_idx, ['paragraph', 'list', 'quote', 'heading'][m + 1] as type, case when m = 3 then 2 else 0 end as level,
       coalesce(last_value(case when m = 3 then trim(x) end ignore nulls) over (partition by post_id order by block_idx rows between unbounded preceding and current row), '') as path,
       false as strong, md5(['', '- ', '> ', '## '][m + 1] || x || case when block_idx < n - 1 then chr(10) || chr(10) else '' end) as text_md5 from b""")  # fmt: skip
simple("txt1_blocks", lambda t: chunking.markdown_blocks(_markdown(t)))
simple("txt2_chunks", lambda t: chunking.chunk_rows(chunking.assemble_chunks(_markdown(t))))
simple("txt3_split_oversize", lambda t: chunking.split_blocks(chunking.markdown_blocks(_markdown(t)), 60, 120))
# A stored table of chunks: each line of a text with its line end, under the path (source, lang).
LINES = "select doc_id + 1 as post_id, cast(doc_id % 3 as int) as version, string_split(coalesce(text, ''), chr(10)) as ls, source, lang, text from documents"
LINE_CHUNKS = f"""ln as ({LINES}), lc as (select post_id, version, cast(generate_subscripts(ls, 1) - 1 as int) as chunk_idx, unnest(ls) as line, len(ls) as n_lines, source, lang from ln),
ck as (select post_id, version, chunk_idx, concat(line, case when chunk_idx < n_lines - 1 then chr(10) else '' end) as text, source, lang from lc)"""


def _line_chunks(t: Tables) -> DataFrame:
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    each = docs.select((F.col("doc_id") + 1).alias("post_id"), (F.col("doc_id") % 3).cast("int").alias("version"), F.size(lines).alias("_n"), "source", "lang", F.posexplode(lines).alias("chunk_idx", "_line"))
    text = F.concat("_line", F.when(F.col("chunk_idx") < F.col("_n") - 1, "\n").otherwise(""))
    kinds = F.when(F.col("chunk_idx") == 0, F.array(F.lit("heading"), F.lit("paragraph"))).otherwise(F.array(F.lit("paragraph")))
    paths = F.array(F.array("source", F.coalesce("lang", F.lit("none"))), F.array("source"))
    return each.select("post_id", "version", "chunk_idx", text.alias("text"), chunking.token_count(text).alias("token_count"), paths.alias("paths"), kinds.alias("types"))


def _line_contents(t: Tables) -> DataFrame:
    """The texts of these chunks, but for some with one more line."""
    docs = t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")
    return docs.selectExpr("doc_id + 1 as post_id", "cast(doc_id % 3 as int) as version", "if(doc_id % 10 = 0, concat(text, chr(10)), text) as content")


simple("txt4_chunk_rows", lambda t: chunking.chunk_rows(_line_chunks(t)).selectExpr("post_id", "version", "chunk_id", "array_join(heading_paths, ' | ') as heading_paths", "array_join(block_types, ',') as block_types"),
       f"with {LINE_CHUNKS} select post_id, version, concat(post_id, '#', chunk_idx) as chunk_id, concat(source, ' > ', coalesce(lang, 'none'), ' | ', source) as heading_paths, case when chunk_idx = 0 then 'heading,paragraph' else 'paragraph' end as block_types from ck")
simple("txt6_chunk_stats", lambda t: chunking.chunk_stats(_line_chunks(t), _line_contents(t)),
       f"""with {LINE_CHUNKS}, tk as (select *, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]')) as k from ck)
       select d.doc_id + 1 as post_id, cast(d.doc_id % 3 as int) as version, count(*) as n, cast(sum(k) as bigint) as tokens, count(*) filter (where k < 100) as n_small, not (d.doc_id % 10 = 0 and any_value(d.text) is not null) as is_exact
       from documents d join tk on tk.post_id = d.doc_id + 1 group by d.doc_id""")  # fmt: skip
simple("txt6_markdown_stats", lambda t: chunking.chunk_stats(chunking.assemble_chunks(_markdown(t)), _markdown(t)))
simple("txt4_markdown_rows", lambda t: chunking.chunk_rows(chunking.assemble_chunks(_markdown(t))).select("post_id", "version", "chunk_id", "heading_paths", "block_types", "start", "end"))
simple("joi6_new_chunks", lambda t: chunking.new_chunks(t.chunk_text.drop("content"), t.chunk_text.where("doc_id % 3 = 0").where("post_id % 2 = 1")),
       "select doc_id, post_id, version, chunk_id from chunk_text where (post_id, version) not in (select post_id, version from chunk_text where doc_id % 3 = 0 and post_id % 2 = 1)")
simple("txt5_token_count", lambda t: t.chunk_text.select("doc_id", chunking.token_count(F.coalesce("content", F.lit(""))).cast("long").alias("n")),
       r"select doc_id, cast(len(regexp_extract_all(coalesce(content, ''), '[A-Za-z0-9]+|[^\sA-Za-z0-9]')) as bigint) as n from chunk_text")
IDS = "((unix_millis(cast(ts as timestamp)) + 31622400000 - 1735689600000 + 86400000) * 4194304) + (user_id % 8) * 4096 + event_id % 4096"
ORACLE["sca3_id_audit"] = f"""with ids as (select {IDS.replace('unix_millis(cast(ts as timestamp))', 'epoch_ms(ts)')} as id from events), o as (select id, count(*) as c from ids group by id)
select (id >> 12) & 1023 as worker, ((id >> 22) + 1735689600000) // 60000 as minute, cast(sum(c) as bigint) as n, cast(sum(c - 1) as bigint) as duplicates from o group by all"""
# Microseconds of a time without zone, whatever the session's zone and its summer time.
_MICROS = "(unix_date(cast(ts as date)) * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(second from ts) * 1000000 as bigint))"


def _event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = _MICROS if dict(events.dtypes)["ts"] == "timestamp_ntz" else "unix_micros(ts)"
    # DuckDB's epoch_ms gives the nearest millisecond, the one further from 1970 of two: the last half of a minute's last one belongs to the next minute.
    millis = f"(({micros} + if({micros} < 0, -500, 500)) div 1000)"
    return events.selectExpr(f"{IDS.replace('unix_millis(cast(ts as timestamp))', millis)} as id")


QUERIES["sca3_id_audit"] = lambda spark, sf_dir: logs.id_audit(_event_ids(spark, sf_dir))
simple("sca6_error_class", lambda t: logs.error_class(t.fav_event.selectExpr("event_id", "if(event_id % 5 = 0, 'IllegalArgumentException', 'IOException') as exception", "case event_id % 4 when 0 then 'read timed out' when 1 then 'HTTP 429' when 2 then 'HTTP 503' else 'other' end as message")),
       "select event_id, case when event_id % 5 = 0 then 'IllegalArgumentException' else 'IOException' end as exception, case event_id % 4 when 0 then 'read timed out' when 1 then 'HTTP 429' when 2 then 'HTTP 503' else 'other' end as message, case when event_id % 5 = 0 then 'INVALID_ARGUMENT' else case event_id % 4 when 0 then 'UPSTREAM_TIMEOUT' when 1 then 'RATE_LIMITED' when 2 then 'UPSTREAM_UNAVAILABLE' else 'TOOL_EXECUTION_ERROR' end end as code from fav_event")


@query("str1_counter_stream", f"with {VALID} select sid, idx, cast(sum(delta) as bigint) as value from val where err is null and event_id not in (select event_id from outbox_cdc where op <> 'INSERT') group by sid, idx")
def _counter_stream(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/events.parquet"
    schema = t.spark.read.parquet(path).schema
    # A pattern, since a stream can't have a single file as its base path.
    events = t.spark.readStream.schema(schema).parquet(path.replace("/events.", "/[e]vents."))
    folder = tables.shared_folder(t.spark, "counter_stream")
    with jobs.state_store(t.spark):
        return jobs.run_to_last(jobs.counter_stream(t.spark.sql(FIXTURES["outbox_cdc"], events=events), 16), ["sid", "idx"], f"{folder}/out", f"{folder}/check")


SUMMARISED = "if(turn = 0 and conversation_id % 2 = 0, 'system', role) as role, if(turn = 0 and conversation_id % 2 = 0, concat('以下是较早对话的摘要：', chr(10), content), if(turn % 5 = 3, ' ', content)) as content"
simple("agg7_recent_text", lambda t: memory.recent_text(t.spark.sql(f"select id, conversation_id, {SUMMARISED} from (select *, id % 1000 as turn from {{m}})", m=t.message)),
       f"""with ms as (select id, conversation_id, {SUMMARISED} from (select *, id % 1000 as turn from message)),
       fi as (select conversation_id, min(id) as fid, max(id) as lid from ms group by conversation_id),
       ld as (select m.conversation_id, m.id, m.content as summary from ms m join fi on fi.conversation_id = m.conversation_id and m.id = fid where lower(role) = 'system' and starts_with(content, '以下是较早对话的摘要：' || chr(10)) and fid < lid)
       select m.conversation_id, coalesce(max(ld.summary), '（无会话摘要）') as summary, coalesce(string_agg(concat(role, ': ', content), chr(10) order by m.id) filter (where trim(content) <> '' and ld.id is distinct from m.id and m.id < lid), '（无最近会话消息）') as recent
       from ms m join fi on fi.conversation_id = m.conversation_id left join ld on ld.conversation_id = m.conversation_id group by m.conversation_id""")  # fmt: skip
SKILLS = """select user_id, seq, case when seq % 3 = 0 then 'skill_level' else memory_key end as memory_key,
  case when seq % 3 <> 0 then content when seq % 4 = 0 then concat('{"go":"', case seq % 5 when 0 then 'beginner' when 1 then 'expert' when 2 then 'unknown' when 3 then 'advanced' else 'Advanced' end, '"}') when seq % 4 = 1 then '{}' when seq % 4 = 2 then '{"go":"unknown","c":"unknown"}' else content end as content from cands"""
simple("fil8_strict_candidates", lambda t: memory.strict_candidates(t.spark.sql(SKILLS.replace("{", "{{").replace("}", "}}").replace("from cands", "from {c}"), c=t.cands)),
       "with sk as (" + SKILLS + """) select *, case when memory_key is null or trim(memory_key) = '' then 'UNKNOWN_KEY' when memory_key = 'skill_level'
         and not coalesce(content in ('{"go":"beginner"}', '{"go":"unknown"}', '{"go":"advanced"}'), false) then 'BAD_SKILL' when content is null then 'EMPTY_CONTENT' end as err from sk""")  # fmt: skip
simple("sca8_trim_by_offset", lambda t: t.chunk_text.select("doc_id", scalars.trim_by_offset(F.col("content"), (F.col("doc_id") % 50).cast("int"), (F.col("doc_id") % 30).cast("int")).alias("text")),
       "select doc_id, substring(content, greatest(0, doc_id % 50 - doc_id % 30) + 1) as text from chunk_text")


OWN = "own as (select t.doc_id, t.chunk_id, t.post_id, t.version, e.embedding from chunk_text t join embeddings e on e.vec_id = t.doc_id)"


@query("ret5_hybrid_search", f"""with {OWN}, {BM.replace("from chunk_text where doc_id % 50 = 0", "from own where doc_id % 50 = 0")},
vs as (select a.doc_id as query_id, b.chunk_id, round({DOT}, 6) as score from own a join own b on a.post_id = b.post_id and a.version = b.version where a.doc_id % 50 = 0),
ls as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from vs qualify rank <= 40
       union all select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bs qualify rank <= 40),
fu as (select query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) as score from ls group by all),
fr as (select query_id, chunk_id, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from fu qualify rank <= 5)
select query_id, rank, chunk_id, content as text from fr join chunk_text using (chunk_id)""")
def _hybrid(t: Tables) -> DataFrame:
    vectors = t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").selectExpr("vec_id as doc_id", "embedding")
    own = t.chunk_text.join(vectors, "doc_id").select("doc_id", "chunk_id", "post_id", "version", "embedding")
    words = F.array(F.lit("the"), F.lit("en"), F.lit("der"), F.lit("las"))
    asked = own.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "post_id", "version", "embedding", words.alias("keywords"))
    return retrieval.hybrid_search(asked, t.chunk_text, own)


# ---- change events, payloads and calls

CDC = """cdc as (select event_id, ts, op, event_type, case when event_id % 19 <> 0 then payload end as payload from outbox_cdc where event_id % 13 <> 0 and event_id % 17 <> 0 and op = 'INSERT')"""


def _cdc(t: Tables) -> DataFrame:
    return t.outbox_cdc.selectExpr(
        "op", "if(event_id % 13 = 0, 'posts', 'OUTBOX') as table", "event_id % 17 = 0 as is_ddl", "array('EVENT_ID', 'payload', 'status', 'Retry_Count', 'event_type') as names",
        "array(string(event_id), if(event_id % 19 = 0, null, payload), '0', if(event_id % 23 = 0, 'x', '0'), event_type) as values", "ts")


simple("src2_outbox_inserts", lambda t: tables.outbox_inserts(_cdc(t)).select(F.col("image")["event_id"].alias("event_id"), F.col("image")["payload"].alias("payload"), F.size("image").alias("n"), "ts"),
       f"with {CDC} select cast(event_id as varchar) as event_id, payload, 5 as n, ts from cdc")
simple("src3_outbox_rows", lambda t: tables.to_outbox(tables.outbox_inserts(_cdc(t))),
       f"""with {CDC} select event_id, payload, 0 as status, case when event_id % 23 <> 0 then 0 end as retry_count, event_type,
       case when payload is null then 'MISSING_PAYLOAD' when event_id % 23 = 0 then 'MISSING_RETRY_COUNT' end as err from cdc""")  # fmt: skip
simple("sca11_payloads", lambda t: t.order_req.select("order_id", scalars.encode_payload("order_id", "sku_id", "user_id").alias("payload")).withColumn("user_id", scalars.decode_payload(F.col("payload"), "order_id long, sku_id long, user_id long")["user_id"]),
       """select order_id, '{"order_id":' || order_id || ',"sku_id":' || sku_id || ',"user_id":' || user_id || '}' as payload, user_id from order_req""")  # fmt: skip
simple("sca7_duplicate_calls", lambda t: logs.duplicate_calls(t.fav_event.selectExpr("user_id as session_id", "event_id as seq", "concat('t', event_id % 2) as tool", """if(event_id % 3 = 0, concat('{"b": ', sku_id % 2, ', "a":1}'), concat('{"a":1,"b":', sku_id % 2, '}')) as args""")),
       """with c as (select user_id as session_id, event_id as seq, 't' || event_id % 2 as tool, case when event_id % 3 = 0 then '{"b": ' || sku_id % 2 || ', "a":1}' else '{"a":1,"b":' || sku_id % 2 || '}' end as args,
       't' || event_id % 2 || ':{"a":1,"b":' || sku_id % 2 || '}' as key from fav_event) select *, row_number() over (partition by session_id, key order by seq) > 1 as is_duplicate from c""")  # fmt: skip
# Results of five kinds: arrays of texts, objects, single texts, no JSON, and arrays with other values.
RESULTS = """select conversation_id as question_id, id as seq, role as tool, case id % 5 when 1 then concat('{"b": ', cast(id % 2 as varchar(9)), ', "a": [1, 2]}') when 2 then concat('"said ', cast(id % 3 as varchar(9)), '"')
  when 3 then content when 4 then '[{"x": 1}, 7, null, "said 1"]' end as passages, content from message"""


def _results(t: Tables) -> DataFrame:
    made = t.spark.sql(RESULTS.replace("{", "{{").replace("}", "}}").replace("from message", "from {m}"), m=t.message)
    return made.withColumn("passages", F.when(F.col("seq") % 5 == 0, F.to_json(F.split("content", " "))).otherwise(F.col("passages")))


simple("agg9_merge_evidence", lambda t: logs.merge_evidence(_results(t)),
       "with rs as (" + RESULTS + r"""), p as (select question_id, seq, tool, case seq % 5 when 0 then string_split(content, ' ') when 1 then [concat('{"b":', seq % 2, ',"a":[1,2]}')] when 2 then [concat('said ', seq % 3)] when 3 then [content] else ['{"x":1}', '7', 'null', 'said 1'] end as ps from rs),
       u as (select question_id, seq, tool, unnest(ps) as content, generate_subscripts(ps, 1) as pos from p)
       select question_id, seq, tool, content, row_number() over (partition by question_id, tool, content order by seq, pos) = 1 as is_new from u where trim(content) <> ''""")  # fmt: skip
ASKED = "case doc_id % 3 when 0 then concat('What OTHER arti cles has the Author of ', source, '?') when 1 then concat('List the posts of ', source) else text end"
simple("sca5_author_questions", lambda t: t.spark.sql(f"select doc_id, {ASKED} as question from {{d}}", d=t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")).select("doc_id", scalars.asks_author_works(F.col("question"), "author|writer|作者", "article|post|文章", "other|all|list|其他|全部").alias("asks")),
       rf"with p as (select doc_id, regexp_replace(lower({ASKED}), '\s+', '', 'g') as q from documents) select doc_id, regexp_matches(q, 'author|writer|作者') and regexp_matches(q, 'article|post|文章') and regexp_matches(q, 'other|all|list|其他|全部') as asks from p")
WORKS = "case doc_id % 4 when 0 then concat('How Many wor ks has the AUTHOR of ', source, '?') when 1 then '这个作者一共写了几篇博文' when 2 then 'who is the writer of all posts' else text end"
simple("sca5_author_works", lambda t: t.spark.sql(f"select doc_id, {WORKS} as question from {{d}}", d=t.spark.read.parquet(f"{t.sf_dir}/documents.parquet")).select("doc_id", scalars.asks_author_works(F.col("question")).alias("asks")),
       rf"with p as (select doc_id, regexp_replace(lower({WORKS}), '\s+', '', 'g') as q from documents) select doc_id, regexp_matches(q, '作者|author') and regexp_matches(q, '文章|作品|帖子|博文|article|post|work') and regexp_matches(q, '多少|几篇|数量|总数|一共|全部|所有|其他|哪些|列表|howmany|count|list|other') as asks from p")
simple("sca9_trim_by_prefix", lambda t: t.chunk_text.select("doc_id", scalars.trim_by_prefix(F.expr("substring(content, 1, 60 + doc_id % 90)"), F.expr("substring(content, 41)")).alias("text")),
       """with p as (select doc_id, substring(content, 1, 60 + doc_id % 90) as a, substring(content, 41) as b from chunk_text)
       select doc_id, substring(b, coalesce(list_max(list_filter(range(1, 101), lambda n: n <= length(a) and n <= length(b) and right(a, n) = left(b, n))), 0) + 1) as text from p""")  # fmt: skip
simple("sca12_joined_paths", lambda t: t.spark.read.parquet(f"{t.sf_dir}/documents.parquet").select("doc_id", scalars.join_paths(F.array(F.array("source", "lang"), F.array("source"))).alias("paths"), scalars.join_types(F.array(F.lit("heading"), "source")).alias("types")),
       "select doc_id, concat_ws(' > ', source, lang) || ' | ' || concat_ws(' > ', source) as paths, concat_ws(',', 'heading', source) as types from documents")
simple("str8_quarantine", lambda t: _quarantined(t), "select order_id, user_id % 5 as attempt, 'good' as fate from order_req where user_id % 10 <> 0 union all select order_id, user_id % 5 + 1, case when user_id % 5 + 1 <= 3 then 'retry' else 'dead' end from order_req where user_id % 10 = 0")


def _quarantined(t: Tables) -> DataFrame:
    raw = t.order_req.selectExpr("cast(order_id as string) as orderId", "cast(sku_id as string) as skuId", "if(user_id % 10 = 0, 'x', cast(user_id as string)) as userId", "user_id % 5 as attempt")
    tried = tables.parse_order_events(raw)
    good, retry, dead = (x.select("order_id", "attempt", F.lit(fate).alias("fate")) for x, fate in zip(tables.with_quarantine(tried), ("good", "retry", "dead"), strict=True))
    return good.unionByName(retry).unionByName(dead)


# ---- applying memory actions, recovery, and tables written and read again

ACTIONS = """ac as (select id as seq, user_id, memory_key, 'new ' || content as content, case when id % 4 = 0 then 'UPDATE' else 'INSERT' end as action, case when id % 4 = 0 then id end as target_id,
  case when id % 4 = 0 then version + case when id % 8 = 0 then 1 else 0 end end as version from long_memory where id % 4 < 2),
top as (select max(id) as m from long_memory),
after as (select id, user_id, memory_key, case when hit then 'new ' || content else content end as content, status, case when hit then version + 1 else version end as version, hit
  from (select *, id % 8 = 4 and status = 'ACTIVE' as hit from long_memory)
  union all select m + seq + 1, user_id, memory_key, content, 'ACTIVE', 1, true from ac, top where action = 'INSERT')"""


def _actions(t: Tables) -> DataFrame:
    return t.long_memory.where("id % 4 < 2").selectExpr(
        "id as seq", "user_id", "memory_key", "concat('new ', content) as content", "if(id % 4 = 0, 'UPDATE', 'INSERT') as action", "if(id % 4 = 0, id, null) as target_id", "if(id % 4 = 0, version + if(id % 8 = 0, 1, 0), null) as version")


def _docs_of(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("format_string('long-memory-%d-v%d', id, version) as doc_id", "id as memory_id", "user_id", "memory_key", "status", "version", "content")


simple("ups7_apply_memory", lambda t: memory.apply_memory(t.long_memory, _actions(t))[0], f"with {ACTIONS} select id, user_id, memory_key, content, status, version from after")
simple("ups7_memory_docs", lambda t: memory.merge_docs(_docs_of(t.long_memory), memory.apply_memory(t.long_memory, _actions(t))[1]),
       f"""with {ACTIONS} select 'long-memory-' || id || '-v' || version as doc_id, id as memory_id, user_id, memory_key, case when id % 8 = 4 then 'DELETE' else status end as status, version, content from long_memory
       union all select 'long-memory-' || id || '-v' || version, id, user_id, memory_key, status, version, content from after where hit""")  # fmt: skip
simple("ups7_conflicts", lambda t: memory.apply_memory(t.long_memory, _actions(t))[2], "select id as seq, id as target_id from long_memory where id % 8 = 0 or (id % 4 = 0 and status <> 'ACTIVE')")
PENDING = "select order_id, order_id % 20 + 1 as sku_id, order_id % 50 + 1 as user_id, status, order_id % 2 = 0 as keep_buyer, redis_applied, next_retry_at from order_outcome"


RECOVERED = f"""o as ({PENDING}), q as (select * from o where not redis_applied and next_retry_at <= timestamp '{NOW}' and status in ('CONFIRMED', 'CANCELLED') order by next_retry_at, order_id limit 100),
rs as (select order_id, sku_id, user_id, case when order_id % 3 = 0 then 'CONFIRMED' else 'PENDING' end as state from o where order_id % 5 <> 0), mp as (select sku_id, user_id, max(order_id) as last from rs group by sku_id, user_id),
f as (select q.order_id, q.sku_id, q.status, state, state is null or (state = 'CONFIRMED' and status <> 'CONFIRMED') or (state = 'PENDING' and (last <> q.order_id or (status = 'CANCELLED' and stock is null))) as failed
  from q left join rs using (order_id) left join mp on mp.sku_id = q.sku_id and mp.user_id = q.user_id left join sku on sku.id = q.sku_id)"""


def _recovery(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    outcomes = t.spark.sql(PENDING.replace("order_outcome", "{o}"), o=t.order_outcome)
    held = outcomes.where("order_id % 5 <> 0").selectExpr("order_id", "sku_id", "user_id", "if(order_id % 3 = 0, 'CONFIRMED', 'PENDING') as state", "cast(null as boolean) as keep_buyer")
    return orders.run_recovery(outcomes, held, outcomes.select("sku_id", "user_id").distinct(), _stock(t), orders.buyer_orders(held), F.lit(NOW).cast("timestamp_ntz"))


simple("str6_recovery", lambda t: _recovery(t)[0].select("order_id", "status", "redis_applied", "next_retry_at"),
       f"with {RECOVERED} select o.order_id, o.status, o.redis_applied or (failed is not null and not failed) as redis_applied, case when failed then timestamp '{NOW}' + interval 30 second else next_retry_at end as next_retry_at from o left join f using (order_id)")
simple("str6_reservations", lambda t: _recovery(t)[1].select("order_id", "state"),
       f"with {RECOVERED} select rs.order_id, case when rs.state = 'PENDING' and not failed then f.status else rs.state end as state from rs left join f using (order_id)")
simple("str6_stock", lambda t: _recovery(t)[3],
       f"with {RECOVERED} select id as sku_id, cast(stock + coalesce(n, 0) as bigint) as stock from sku left join (select sku_id, count(*) as n from f where not failed and state = 'PENDING' and status = 'CANCELLED' group by sku_id) c on c.sku_id = id")


@query("src1_read_table", "select order_id as id, sku_id, user_id from order_req")
def _read_table(t: Tables) -> DataFrame:
    path = tables.shared_folder(t.spark, "order")
    t.order_req.withColumnRenamed("order_id", "id").write.parquet(path)
    return tables.read_table(t.spark, "order", path)


@query("snk3_write_chunks", "select post_id, version, chunk_id, content as text from chunk_text")
def _write_chunks(t: Tables) -> DataFrame:
    path = tables.shared_folder(t.spark, "chunks")
    tables.write_chunks(t.chunk_text.selectExpr("post_id", "version", "chunk_id", "content as text"), path)
    return tables.read_table(t.spark, "chunks", path).select("post_id", "version", "chunk_id", "text")
