"""Approximate vector search: hash tables of directions, several buckets asked for each query, exact scores of what they hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.nearest import Met, nearest_pairs
from weftline.operators.retrieval import topk_per_group


def sketch(vector: Column, tables: int = 8, bits: int = 8, seed: int = 7) -> Column:
    """A long of ``tables`` times ``bits`` bits: on which side of random planes a vector lies. The length doesn't matter.

    Null for vectors that have no direction: null, empty, all 0, or with a null or non-finite component.
    """
    if tables * bits > 64:
        raise ValueError("a sketch has up to 64 bits")

    def of(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.uint64)
        known = np.zeros(len(vectors), bool)
        sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for size in set(sizes[sizes > 0].tolist()):
            at = np.flatnonzero(sizes == size)
            rows = np.array([np.asarray(v, float) for v in vectors.iloc[at]])
            planes = np.random.default_rng((seed, size)).standard_normal((tables * bits, size))
            good = np.isfinite(rows).all(1) & rows.any(1)
            sides = np.where(good[:, None], rows, 0.0) @ planes.T >= 0
            out[at] = (sides.astype(np.uint64) << np.arange(tables * bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
            known[at] = good
        return pd.Series(out.view(np.int64)).astype("Int64").where(known)

    return F.pandas_udf(of, "long")(vector)


def approximate_topk(
    queries: DataFrame, chunks: DataFrame, k: int = 40, filters: tuple[str, ...] = ("post_id", "version"), tables: int = 8, bits: int = 8, flips: int = 2, seed: int = 7,
) -> DataFrame:
    """``query_id, chunk_id, score, rank`` as ``retrieval.vector_topk`` gives them, of the chunks that share a bucket with the query.

    Every chunk lies in a bucket of each of ``tables`` hash tables (``sketch``); a query asks the buckets that differ from its own in
    up to ``flips`` bits. A pair is scored once, however many tables it meets in, and by the exact cosine, so only membership is approximate: the nearer a chunk,
    the likelier it is found. Vectors without direction, or of another size than the query's, are left out; ``filters`` may be empty.

    Sketches meet in tiles (``nearest_pairs``), not by a join on buckets: a tile's nearest pairs are found by a product of matrices, their sketches say which of them have met,
    and only each query's best are shuffled. Where vectors have no near neighbours a query must meet most of them, so no row is made of a pair but of the best.
    """
    q = queries.select("query_id", *filters, F.col("embedding").alias("_q")).withColumn("_asked", sketch(F.col("_q"), tables, bits, seed))
    d = chunks.select("chunk_id", F.col("embedding").alias("_d"), *filters).withColumn("_sketch", sketch(F.col("_d"), tables, bits, seed))
    hits = nearest_pairs(q.where("_asked is not null"), d.where("_sketch is not null"), list(filters), k, [("chunk_id", "asc")], met=_sharing(tables, bits, flips))
    return topk_per_group(hits.where("score is not null").select("query_id", "chunk_id", "score"), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def _sharing(tables: int, bits: int, flips: int):
    """Which pairs of a tile share a bucket: sketches (_asked and _sketch) that differ in up to ``flips`` bits in some table."""

    def of(left: pa.Table, right: pa.Table) -> Met:
        asked, held = (t[c].to_numpy().view(np.uint64) for t, c in ((left, "_asked"), (right, "_sketch")))

        def met(q: np.ndarray, d: np.ndarray) -> np.ndarray:
            apart, found = asked[q] ^ held[d], np.zeros(len(q), bool)
            for t in range(tables):
                found |= np.bitwise_count((apart >> np.uint64(t * bits)) & np.uint64(2**bits - 1)) <= flips
            return found

        return met

    return of
