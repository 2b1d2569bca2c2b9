"""Retrieval: cosine and BM25 top-k, reciprocal rank fusion, reranking and overlap trimming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import chunk_index, trim_by_offset, trim_by_prefix
from weftline.operators.nearest import nearest_pairs


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def with_square(df: DataFrame, vector: str, name: str) -> DataFrame:
    """``df`` with a vector's product with itself: taken once a row, not once a pair."""
    return df.withColumn(name, dot(F.col(vector), F.col(vector)))


def cosine(a: str, b: str, a_square: str, b_square: str) -> Column:
    """The cosine of two vectors whose squares are known."""
    return dot(F.col(a), F.col(b)) / F.sqrt(F.col(a_square) * F.col(b_square))


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = 40, filters: tuple[str, ...] = ("post_id", "version")) -> DataFrame:
    """``query_id, chunk_id, score, rank`` of the chunks nearest by cosine among those with the query's values of ``filters``."""
    q = queries.select("query_id", *filters, F.col("embedding").alias("_q"))
    d = chunks.select("chunk_id", F.col("embedding").alias("_d"), *filters)
    hits = nearest_pairs(q, d, list(filters), k, [("chunk_id", "asc")]).select("query_id", "chunk_id", "score")
    return topk_per_group(hits, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def terms(text: Column) -> Column:
    """Lower-case words of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def term_counts(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """``term, df, _n, _avg``: of each of ``words`` (term) how many chunks have it, beside the number of chunks and their mean words.

    One pass over the texts: a chunk gives each of its words once, and an empty word that stands for the chunk itself.
    """
    docs = chunks.select(terms(F.coalesce("content", F.lit(""))).alias("_terms"))
    each = docs.select(F.size("_terms").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_terms"))).alias("term"))
    known = words.select("term").union(words.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    counts = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("_len")).join(known, "term", "left_semi")
    whole = Window.partitionBy()  # over a row for each word of the queries
    of_all = lambda c: F.max(F.when(F.col("term") == "", F.col(c))).over(whole)
    return counts.select("term", "df", of_all("df").alias("_n"), (of_all("_len") / of_all("df")).alias("_avg")).where("term <> ''")


def bm25_topk(queries: DataFrame, chunks: DataFrame, k: int = 40, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, chunk_id, score, rank`` by BM25 over chunks of the query's (post_id, version); statistics are those of all chunks.

    Queries have query_id, post_id, version, keywords (an array). All chunks are cut into words once, for the
    statistics; those of a version that some query asks for once more. Queries of equal words and versions share one ranking.
    """
    words = queries.select("query_id", "post_id", "version", F.explode(F.array_distinct("keywords")).alias("term")).where("term <> ''")
    # Queries that ask the same of the same version are scored once, by the first of them: pairs grow with what is asked, not with who asks.
    each = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("post_id", "version", "term"))).alias("_asked"))
    once = each.groupBy("_asked").agg(F.min("query_id").alias("_first"))
    words = once.select("_first", F.inline("_asked"))
    wanted = words.groupBy("post_id", "version").agg(F.collect_set("term").alias("_wanted"))
    own = chunks.join(wanted, ["post_id", "version"]).select("chunk_id", "post_id", "version", "_wanted", terms(F.coalesce("content", F.lit(""))).alias("_terms"))
    # Counted where the text is: no word of a text is shuffled but those that its version's queries ask for, with their counts.
    found = F.transform(F.array_intersect("_terms", "_wanted"), lambda w: F.struct(w.alias("term"), F.size(F.filter("_terms", lambda x: x == w)).alias("tf")))
    tf = own.select("chunk_id", "post_id", "version", F.size("_terms").alias("len"), F.inline(found))
    tf = tf.groupBy("chunk_id", "post_id", "version", "len", "term").agg(F.sum("tf").alias("tf"))
    idf = F.log1p((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("_avg"))
    hits = words.join(tf, ["post_id", "version", "term"]).join(term_counts(chunks, words), "term")
    scored = hits.groupBy("_first", "chunk_id").agg(F.round(F.sum(idf * F.col("tf") * (k1 + 1) / norm), 6).alias("score"))
    top = topk_per_group(scored, ["_first"], [F.desc("score"), F.asc("chunk_id")], k)
    asking = each.join(once, "_asked").select("query_id", "_first")
    return asking.join(top, "_first").select("query_id", "chunk_id", "score", "rank")


def fuse_lists(lists: list[DataFrame], k0: int = 60) -> DataFrame:
    """Ranked lists (query_id, chunk_id, rank) as one, 1 / (k0 + rank) summed; a hit without id takes up its rank only."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "chunk_id", "rank") for x in lists])
    return rows.where("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k0 + F.col("rank"))), 6).alias("score"))


def rrf(lists: list[DataFrame], k0: int = 60, k: int = 30) -> DataFrame:
    return topk_per_group(fuse_lists(lists, k0), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def rerank(hits: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """Hits in the order of an outer score (query_id, chunk_id, rerank_score); without one they come last."""
    rows = hits.drop("rank").join(scores, ["query_id", "chunk_id"], "left")
    return topk_per_group(rows, ["query_id"], [F.desc_nulls_last("rerank_score"), F.asc("chunk_id")], k)


def with_previous(selected: DataFrame) -> DataFrame:
    """Selected chunks (query_id, chunk_idx, text, source_end) with text and end of the selected chunk before."""
    before = selected.groupBy("query_id", (F.col("chunk_idx") + 1).alias("chunk_idx")).agg(F.max_by(F.struct("text", "source_end"), "text").alias("_p"))
    return selected.join(before, ["query_id", "chunk_idx"], "left").select(*selected.columns, F.col("_p.text").alias("prev_text"), F.col("_p.source_end").alias("prev_end"))


def trimmed(rows: DataFrame) -> DataFrame:
    """Rows of ``with_previous`` whose text lacks what the chunk before already has."""
    by_prefix = trim_by_prefix(F.col("prev_text"), F.col("text"))
    text = F.when(F.col("prev_text").isNull(), F.col("text")).when(
        F.col("prev_end").isNotNull() & F.col("source_start").isNotNull(), trim_by_offset(F.col("text"), F.col("prev_end"), F.col("source_start"))
    )
    return rows.withColumn("text", F.coalesce(text, by_prefix))


def memory_search(queries: DataFrame, docs: DataFrame, k: int = 2, min_score: float = 0.70) -> DataFrame:
    """``query_id, memory_key, doc_id, score``: per key the k nearest active memories of the user, then those above the threshold."""
    q = queries.where(F.col("memory_key").isin("topics", "current_goal")).select("query_id", "user_id", "memory_key", F.col("embedding").alias("_q"))
    d = docs.where("status = 'ACTIVE'").select("doc_id", "user_id", "memory_key", F.col("embedding").alias("_d"))
    k = k if k > 0 else 2
    scored = nearest_pairs(q, d, ["user_id", "memory_key"], k, [("doc_id", "asc")]).select("query_id", "memory_key", "doc_id", "score")
    top = topk_per_group(scored, ["query_id", "memory_key"], [F.desc("score"), F.asc("doc_id")], k)
    return top.where(F.col("score") >= min_score).drop("rank")


def nearest_memory(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates (user_id, seq, memory_key, embedding) with their nearest active memory; score 0 without one."""
    names = ["user_id", "seq", "memory_key"]
    d = docs.where("status = 'ACTIVE'").select("user_id", "memory_key", "doc_id", "version", F.col("embedding").alias("_d"))
    hits = nearest_pairs(cands.select(*names, F.col("embedding").alias("_q")), d, ["user_id", "memory_key"], 1, [("doc_id", "asc"), ("version", "desc")], "at_end", 0.0)
    score = F.coalesce("score", F.lit(0.0))
    best = hits.groupBy(*names).agg(F.max(F.struct(score.alias("score"), (-F.col("doc_id")).alias("neg"), "version")).alias("b"))
    rows = cands.select(*names).distinct().join(best, names, "left")
    return rows.select(*names, (-F.col("b.neg")).alias("doc_id"), "b.version", F.coalesce("b.score", F.lit(0.0)).alias("score"))


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 40, fused: int = 30, final: int = 5, scores: DataFrame | None = None) -> DataFrame:
    """``query_id, rank, chunk_id, text``: vector and word search fused, reranked, and overlaps trimmed.

    ``scores`` (query_id, chunk_id, rerank_score) are a model's; without them the fused score orders. A
    chunk whose predecessor is selected too loses what that one already has: by source offsets where
    ``chunks`` has source_start and source_end, else by its longest prefix that ends the other.
    """
    both = rrf([vector_topk(queries, vectors, k), bm25_topk(queries, chunks, k)], k=fused)
    order = [F.desc("score"), F.asc("chunk_id")]
    top = topk_per_group(both.drop("rank"), ["query_id"], order, final) if scores is None else rerank(both, scores, final)
    offsets = [F.col(c).cast("int").alias(c) if c in chunks.columns else F.lit(None).cast("int").alias(c) for c in ("source_start", "source_end")]
    rows = top.join(chunks.select("chunk_id", F.col("content").alias("text"), *offsets), "chunk_id").withColumn("chunk_idx", chunk_index(F.col("chunk_id")))
    before = Window.partitionBy("query_id").orderBy("chunk_idx").rangeBetween(-1, -1)  # of at most ``final`` rows
    previous = F.when(F.col("chunk_idx").isNotNull(), F.max_by(F.struct("text", "source_end"), F.col("text")).over(before))
    rows = rows.withColumn("_p", previous).withColumn("prev_text", F.col("_p.text")).withColumn("prev_end", F.col("_p.source_end"))
    return trimmed(rows).select("query_id", "rank", "chunk_id", "text")
