"""Versioned articles: visibility, views, edits, publishing and cached views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VISIBLE = (2, 3)
#: Bits of the bitmaps by which ``likely`` picks rows.
SIEVE_BITS = 1 << 25


def visible_posts(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("status").isin(*VISIBLE))


def post_state(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Version and status of the posts of ``ids``, whatever their status."""
    return posts.join(ids.select("post_id"), "post_id", "left_semi").select("post_id", "version", "status")


def likely(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` without most of those whose columns ``on`` are in no row of ``keys``, for a join that shuffles the rest.

    A bit for each hash of a key, in bitmaps of up to 4 MB in all, goes to the rows, so that those which go aren't shuffled.
    All rows of a key stay, and of others one in 33 for a million keys.
    """
    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in on]), F.lit(SIEVE_BITS))
    bits = keys.select(place.alias("_place")).select(F.bitmap_bucket_number("_place").alias("_bucket"), F.bitmap_bit_position("_place").alias("_bit"))
    maps = bits.repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = F.bitmap_bit_position("_place")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    placed = rows.select("*", place.alias("_place"))
    found = placed.join(F.broadcast(maps), F.bitmap_bucket_number("_place") == F.col("_bucket"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def content_at(contents: DataFrame, keys: DataFrame) -> DataFrame:
    """The first content of each (post_id, version) of ``keys``. Hardly any other text is shuffled."""
    key = ["post_id", "version"]
    first = F.row_number().over(Window.partitionBy(*key).orderBy("content_id"))
    wanted = keys.select(*key).distinct()
    found = likely(contents, wanted, key).join(wanted, key)  # Spark would push a semi-join below that of ``likely``
    return found.withColumn("_n", first).where("_n = 1").drop("_n").select(*contents.columns)


def published_view(posts: DataFrame, contents: DataFrame) -> DataFrame:
    return visible_posts(posts).join(contents.select("post_id", "version", "content"), ["post_id", "version"], "left").select(
        "post_id", "user_id", "title", "status", "version", "content"
    )


def draft_view(posts: DataFrame, contents: DataFrame) -> DataFrame:
    """The content of the version after the current one; empty if there is none."""
    following = posts.select("post_id", (F.col("version") + 1).alias("version"), "status")
    joined = following.join(contents.select("post_id", "version", "content"), ["post_id", "version"], "left")
    return joined.select("post_id", "version", "status", F.coalesce("content", F.lit("")).alias("content"))


def published_only(requests: DataFrame, published: DataFrame) -> DataFrame:
    """Requests for published posts only."""
    return requests.join(published.select("post_id"), "post_id", "left_semi")


def author_catalogue(posts: DataFrame) -> DataFrame:
    """Titles of each author by post, of every status."""
    rows = posts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("post_id", "title"))).alias("own"))
    return rows.select("user_id", F.transform("own", lambda x: x["title"]).alias("titles"), F.size("own").cast("long").alias("n"))


def latest_publish(pubs: DataFrame) -> DataFrame:
    """The newest version of each post among publish events."""
    return pubs.groupBy("post_id").agg(F.max("version").alias("version"))


def apply_edits(posts: DataFrame, contents: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edits (edit_id, post_id, status, version, content): posts and contents after them, and each edit's result.

    An edit is accepted if status and version are the post's current ones and the next version has a
    content row. Of several on one state the least edit_id wins. Results: ACCEPTED, STALE, NO_CONTENT.
    """
    now = posts.select("post_id", F.col("status").alias("_status"), F.col("version").alias("_version"))
    # Only the place is needed, not the text.
    slots = contents.select("post_id", F.col("version").alias("_slot")).distinct()
    matched = edits.join(now, "post_id", "left").join(
        slots.withColumnRenamed("post_id", "_post"), (F.col("post_id") == F.col("_post")) & (F.col("version") + 1 == F.col("_slot")), "left"
    )
    fits = F.coalesce((F.col("status") == F.col("_status")) & (F.col("version") == F.col("_version")), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("post_id", fits).orderBy("edit_id"))
    result = matched.withColumn(
        "result", F.when(~fits | (turn > 1), "STALE").when(F.col("_slot").isNull(), "NO_CONTENT").otherwise("ACCEPTED")
    ).select("edit_id", "post_id", "version", "content", "result")
    won = result.where("result = 'ACCEPTED'")
    new_posts = posts.join(won.select("post_id", F.lit(1).alias("_won")), "post_id", "left").select(
        *[(F.col("status") + F.coalesce("_won", F.lit(0))).cast("int").alias("status") if c == "status" else F.col(c) for c in posts.columns]
    )
    texts = won.select("post_id", (F.col("version") + 1).alias("version"), F.col("content").alias("_new"), F.lit(True).alias("_won"))
    new_contents = contents.join(texts, ["post_id", "version"], "left").select(
        *[F.when(F.col("_won"), F.col("_new")).otherwise(F.col("content")).alias("content") if c == "content" else F.col(c) for c in contents.columns]
    )
    return new_posts, new_contents, result.select("edit_id", "result")


def apply_publish(posts: DataFrame, pubs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts after publish events (post_id, version), and the ids that are published for the first time.

    An event counts if its version is the post's; then the version goes up and the status becomes 2.
    """
    hit = pubs.select("post_id", "version", F.lit(True).alias("_hit")).distinct()
    joined = posts.join(hit, ["post_id", "version"], "left")
    first = joined.where(F.col("_hit") & (F.col("status") == 1)).select("post_id")
    changed = {"version": F.col("version") + 1, "status": F.lit(2)}

    def column(c: str) -> Column:
        return F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).cast("int").alias(c) if c in changed else F.col(c)

    return joined.select(*map(column, posts.columns)), first


def refill(views: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cached views (post_id, version, payload) after reads: a row of the same or a newer version replaces the old; without a payload only the version goes up."""
    new = incoming.groupBy("post_id").agg(F.max(F.struct("version", F.col("payload").isNotNull().alias("has"), "payload")).alias("n"))
    both = views.join(new, "post_id", "full")
    newer = F.col("n.version") >= F.coalesce("version", F.col("n.version"))
    return both.select(
        "post_id",
        F.when(newer, F.col("n.version")).otherwise(F.col("version")).alias("version"),
        F.when(newer & F.col("n.has"), F.col("n.payload")).otherwise(F.col("payload")).alias("payload"),
    )


def publish_barrier(views: DataFrame, pubs: DataFrame) -> DataFrame:
    """Cached views after publishing: only a newer version counts, and drops the payload."""
    new = latest_publish(pubs).withColumnRenamed("version", "_new")
    both = views.join(new, "post_id", "full")
    newer = F.col("_new").isNotNull() & (F.col("version").isNull() | (F.col("_new") > F.col("version")))
    return both.select(
        "post_id",
        F.when(newer, F.col("_new")).otherwise(F.col("version")).alias("version"),
        F.when(~newer, F.col("payload")).alias("payload"),
    )


def resolve_view(views: DataFrame) -> DataFrame:
    """Whether a view answers a read: version 0 says that there is no such post, a payload is the answer."""
    hit = F.when(F.col("version") == 0, "MISSING").when(F.col("payload").isNotNull(), "HIT").otherwise("MISS")
    return views.select("post_id", hit.alias("hit"), F.when(F.col("version") != 0, F.col("payload")).alias("payload"))
