"""Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_ID_MS = 1_735_689_600_000
# The words by which a question asks for an author's works, lower case, without white space.
AUTHOR_WORDS = ("作者", "author")
ARTICLE_WORDS = ("文章", "作品", "帖子", "博文", "article", "post", "work")
COLLECTION_WORDS = ("多少", "几篇", "数量", "总数", "一共", "全部", "所有", "其他", "哪些", "列表", "howmany", "count", "list", "other")


def positive_id(text: Column) -> Column:
    """A canonical positive 64-bit integer of a string, else null."""
    return F.when(text.rlike(r"^[1-9][0-9]*$"), text.try_cast("long"))


def unpack_counter(value: Column) -> Column:
    """(turn, fav) of 8 bytes, two big-endian signed integers; null for another length."""

    def number(at: int) -> Column:
        raw = F.conv(F.hex(F.substring(value, at, 4)), 16, 10).cast("long")
        return F.when(raw >= 2**31, raw - 2**32).otherwise(raw).cast("int")

    return F.when(F.octet_length(value) == 8, F.struct(number(1).alias("turn"), number(5).alias("fav")))


def pack_counter(turn: Column, fav: Column) -> Column:
    def part(x: Column) -> Column:
        return F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(4294967295))), 8, "0")

    return F.unhex(F.concat(part(turn), part(fav)))


def chunk_index(chunk_id: Column) -> Column:
    """The number after the last ``#``, or null."""
    return F.when(F.contains(chunk_id, F.lit("#")), F.substring_index(chunk_id, "#", -1).try_cast("int"))


def asks_author_works(text: Column, author: str = "|".join(AUTHOR_WORDS), article: str = "|".join(ARTICLE_WORDS), collection: str = "|".join(COLLECTION_WORDS)) -> Column:
    """Whether a question names an author, an article and a collection of them (patterns); a null text does not."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", "")
    return plain.rlike(author) & plain.rlike(article) & plain.rlike(collection)


def error_code(exception: Column, message: Column) -> Column:
    """The class of a failed call by the name of its exception and its message; the first rule that fits wins."""
    name, text = F.lower(exception), F.coalesce(F.lower(message), F.lit(""))
    return (
        F.when(name.isNull(), "TOOL_EXECUTION_ERROR")
        .when(name.contains("illegalargument") | name.contains("numberformat"), "INVALID_ARGUMENT")
        .when(text.contains("timeout") | text.contains("timed out") | name.contains("timeout"), "UPSTREAM_TIMEOUT")
        .when(text.contains("429") | text.contains("rate limit"), "RATE_LIMITED")
        .when(text.rlike("50[234]|unavailable"), "UPSTREAM_UNAVAILABLE")
        .otherwise("TOOL_EXECUTION_ERROR")
    )


def trim_by_offset(current: Column, previous_end: Column, current_start: Column) -> Column:
    """``current`` without the characters that the previous chunk already has, by source offsets."""
    overlap = F.greatest(F.lit(0), F.coalesce(previous_end - current_start, F.lit(0)))
    return F.substr(current, (overlap + 1).cast("int"))


def trim_by_prefix(previous: Column, current: Column, most: int = 100) -> Column:
    """``current`` without its longest prefix that ends ``previous``, of up to ``most`` characters."""
    sizes = F.sequence(F.lit(1), F.lit(most))
    # In an array of one, so that the ends are cut once and not for each size.
    ends = F.array(F.struct(F.right(previous, F.lit(most)).alias("tail"), F.left(current, F.lit(most)).alias("head")))

    def longest(e: Column) -> Column:
        tail, head = e["tail"], e["head"]
        fits = F.filter(sizes, lambda n: (n <= F.length(tail)) & (n <= F.length(head)) & (F.right(tail, n) == F.left(head, n)))
        return F.array_max(fits)

    return F.substr(current, F.coalesce(F.get(F.transform(ends, longest), F.lit(0)), F.lit(0)) + 1)



def join_paths(paths: Column) -> Column:
    """Heading paths (arrays of headings) in one string."""
    return F.array_join(F.transform(paths, lambda p: F.array_join(p, " > ")), " | ")


def join_types(types: Column) -> Column:
    """Block types in one string."""
    return F.array_join(types, ",")


def encode_payload(*columns: str | Column) -> Column:
    """Columns as the JSON text of an event."""
    return F.to_json(F.struct(*columns))


def decode_payload(payload: Column, schema: str) -> Column:
    """The struct of an event's JSON text; null for a null text."""
    return F.from_json(payload, schema)
