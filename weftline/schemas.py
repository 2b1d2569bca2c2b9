"""The fixed schemas of all tables, as DDL."""

TABLES = {
    "posts": "post_id long, user_id long, title string, status int, version int",
    "contents": "content_id long, post_id long, version int, content string",
    "chat": "id long, user_id long, post_id long, summary string, last_message_id long",
    "message": "id long, conversation_id long, version int, role string, content string, created_at timestamp",
    "long_memory": "id long, user_id long, memory_key string, content string, status string, version int, source_message_id long",
    "sku": "id long, stock int",
    "order": "id long, sku_id long, user_id long",
    "fav": "id long, sku_id long, user_id long, status int",
    "outbox": "event_id long, payload string, status int, retry_count int, event_type string",
    "order_outcome": "order_id long, sku_id long, user_id long, status string, keep_buyer boolean, redis_applied boolean, next_retry_at timestamp, created_at timestamp, updated_at timestamp",
    "counters": "sku_id long, turn int, fav int",
    "reservations": "order_id long, sku_id long, user_id long, state string, keep_buyer boolean",
    "chunks": "post_id long, version int, chunk_idx int, chunk_id string, text string, token_count int, heading_paths array<string>, block_types array<string>, source_start int, source_end int, embedding array<float>",
    "memory_docs": "doc_id string, memory_id long, user_id long, memory_key string, status string, version int, content string, embedding array<float>",
}
COUNTER_EVENT = "sid long, metric string, idx int, delta int, eventId long"
