"""Tables of the library's model, derived from the given ones. Each statement runs alike in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = ("documents", "conversations", "embeddings", "events", "orders", "lineitem", "part", "benchmark")
SQL = {
    "posts": "select doc_id+1 post_id, doc_id % 50 + 1 user_id, substring(text,1,40) title, cast(doc_id % 4 as int) status, cast(doc_id % 3 as int) version from {documents}",
    "contents": "select (doc_id*4+v)+1 content_id, doc_id+1 post_id, cast(v as int) version, concat('v', cast(v as varchar(9)), ' ', text) content from {documents} cross join (select 0 v union all select 1 union all select 2 union all select 3) n where v >= 1 and v <= doc_id % 3 + 1",
    "chat": "select conv_id+1 id, conv_id % 50 + 1 user_id, conv_id + 1 post_id, cast(case when conv_id % 5 = 0 then 'said before' end as varchar(20)) summary, case when conv_id % 5 = 0 then (conv_id+1)*1000+1 end last_message_id from (select distinct conv_id from {conversations}) c",
    "message": "select (conv_id+1)*1000+turn id, conv_id+1 conversation_id, cast(case when turn % 3 <> 0 then turn % 3 end as int) version, role, text content from {conversations}",
    "sku": "select p_partkey+1 id, max(p_size) stock from {part} where p_partkey < 200 and p_partkey % 20 <> 7 group by p_partkey",
    "order_req": "select distinct o_orderkey*100000 + l_partkey + 1 order_id, l_partkey % 200 + 1 sku_id, o_custkey % 100 + 1 user_id from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "sku_all": "select p_partkey+1 id, max(p_size) stock from {part} where p_partkey % 20 <> 7 group by p_partkey",
    "order_all": "select distinct o_orderkey*10000000 + l_partkey + 1 order_id, l_partkey+1 sku_id, o_custkey+1 user_id from {lineitem} join {orders} on l_orderkey = o_orderkey",
    "fav_event": "select event_id+1 event_id, ts, event_id % 20 + 1 sku_id, user_id+1 user_id, case when event_type = 'view' then 0 else 1 end status from {events} where event_type in ('click','purchase','view')",
    "outbox_cdc": """select event_id+1 event_id, ts, case when event_type = 'error' then 'UPDATE' else 'INSERT' end op, case when event_type = 'purchase' then 'Order' else 'CounterEvent' end event_type, concat('{{"sid":', cast(event_id % 20 as varchar(9)), ',"metric":"', case when event_id % 11 = 0 then 'turn' else 'fav' end, '","idx":2,"delta":', case when event_type = 'view' then '-1' else '1' end, ',"eventId":', cast(event_id+1 as varchar(20)), '}}') payload from {events}""",
    "long_memory": "select vec_id+1 id, cast(label as bigint)+1 user_id, case vec_id % 6 when 0 then 'language' when 1 then 'answer_style' when 2 then 'tech_stack' when 3 then 'skill_level' when 4 then 'topics' else 'current_goal' end memory_key, concat('m', cast(vec_id as varchar(9))) content, case when vec_id % 7 = 0 then 'DELETE' else 'ACTIVE' end status, cast(vec_id % 3 + 1 as int) version from {embeddings}",
    "chunk_vec": "select vec_id, cast(label as bigint)+1 post_id, cast(vec_id % 2 + 1 as int) version, concat(cast(label+1 as varchar(9)), '#', cast(vec_id as varchar(9))) chunk_id, embedding from {embeddings}",
    "chunk_text": "select doc_id, doc_id % 20 + 1 post_id, cast(doc_id % 2 + 1 as int) version, concat(cast(doc_id % 20 + 1 as varchar(9)), '#', cast(doc_id as varchar(9))) chunk_id, text content from {documents}",
    "order_outcome": "select o_orderkey+1 order_id, case when o_orderstatus='F' then 'CONFIRMED' when o_orderstatus='O' then 'CANCELLED' else 'PROCESSING' end status, o_orderkey % 4 = 0 redis_applied, o_orderdate next_retry_at from {orders}",
    "cands": "select cast(label as bigint)+1 user_id, vec_id seq, case when vec_id % 9 = 0 then null when vec_id % 9 = 1 then '  ' when vec_id % 2 = 0 then 'topics' else 'current_goal' end memory_key, case when vec_id % 5 = 0 then null else concat('c', cast(vec_id as varchar(9))) end content from {embeddings}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, from the given tables of ``sf_dir`` that its statement names."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in GIVEN if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def with_fixtures(sql: str) -> str:
    """``sql`` for DuckDB, the derived tables that it names as common table expressions before it."""
    names = {t: t for t in GIVEN}
    used = [n for n in SQL if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL[n].format(**names)})" for n in used)
    return f"WITH {ctes}\n{sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {ctes},\n{sql.lstrip()[5:]}"
