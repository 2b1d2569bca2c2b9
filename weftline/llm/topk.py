"""Exact top-k search by integer inner product, block at a time.

Vectors are stored as blocks of neighbouring ids: a block has a forward index (its integer rows) and the
largest and smallest component of each dimension. A query bounds a block by the sum of its best terms,
visits blocks by falling bound, and stops when the next bound falls below its k-th score. A bounded sample of
the vectors gives each query a score that its k-th can't fall below before any block is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

#: Vectors of a block, and of a shard and queries of a group at most: a task holds one of each.
BLOCK, SHARD, GROUP = 128, 32768, 4096
#: Vectors of a shard at least, where there are fewer than tasks could take.
SMALL = 4096
#: Vectors that every query is scored against first, about so many.
SAMPLE = 2048
SCALE = 1024
#: The column of ``common.numbered``.
ROW = "_row"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component as double; rows with a null id, vector or component, or one that isn't finite, go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")).alias("v"),
    )


def _blocks(batches: Iterator[pa.RecordBatch], block: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted by id, as blocks; a block's shard follows from its first id."""
    names = ["shard", "ids", "own", "rows", "dims"]

    def out(ids: list[int], own: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        dims = max(map(len, rows))
        flat = _matrix(rows, dims)
        shard = (ids[0] * 2654435761 >> 8) % shards
        packed = [pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (ids, own)]
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *packed, pa.array([flat.tobytes()], pa.binary()), pa.array([dims], pa.int64())], names=names)

    ids: list[int] = []
    own: list[int] = []
    rows: list[np.ndarray] = []
    for batch in batches:
        values = batch.column(1)
        flat, offsets = values.flatten().to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        offsets = offsets - offsets[0]
        for i, (x, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            ids.append(x)
            own.append(number)
            rows.append(flat[offsets[i] : offsets[i + 1]])
            if len(ids) == block:
                yield out(ids, own, rows)
                ids, own, rows = [], [], []
    if ids:
        yield out(ids, own, rows)


def _merge(best: np.ndarray, best_ids: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, by falling score, then rising id."""
    all_score = np.concatenate([best, score], 1)
    all_ids = np.concatenate([best_ids, np.broadcast_to(ids, score.shape)], 1)
    order = np.lexsort((all_ids, -all_score), axis=1)[:, :k]
    return np.take_along_axis(all_score, order, 1), np.take_along_axis(all_ids, order, 1)


def search_tile(own: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, ...]], k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best in some blocks (ids, rows, and numbers that tell rows apart if ids don't), other than ``own``, of those that score ``least`` or more; places without a candidate score -inf."""
    least = np.full(len(queries), -np.inf) if least is None else least
    high, low = np.array([b[1].max(0) for b in blocks]), np.array([b[1].min(0) for b in blocks])
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    best, best_ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    going = np.arange(len(queries))
    for r in range(len(blocks)):
        at = order[going, r]
        going = going[bound[going, at] >= np.maximum(best[going, k - 1], least[going])]  # a tie may still win by its id
        if not len(going):
            break
        at = order[going, r]
        for b in np.unique(at):
            here = going[at == b]
            ids, rows, *numbers = blocks[b]
            score = queries[here] @ rows.T
            score[(own[here][:, None] == (numbers[0] if numbers else ids)[None, :]) | (score < least[here, None])] = -np.inf
            beats = (score >= best[here, k - 1 : k]).any(1)
            if beats.any():
                best[here[beats]], best_ids[here[beats]] = _merge(best[here[beats]], best_ids[here[beats]], score[beats], ids, k)
    return best, best_ids


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """One tile: some queries against the blocks of one shard."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "own": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
    if left.empty or right.empty:
        return empty
    dims = max(int(right["dims"].max()), max(map(len, left["v"])))
    queries = _matrix(list(left["v"]), dims)
    blocks = []
    for ids, numbers, rows, width in zip(right["ids"], right["own"], right["rows"], right["dims"], strict=True):
        ids = np.frombuffer(ids, np.int64)
        flat = np.zeros((len(ids), dims))
        flat[:, :width] = np.frombuffer(rows).reshape(len(ids), width)
        blocks.append((ids, flat, np.frombuffer(numbers, np.int64)))
    query_ids, own = left["vec_id"].to_numpy(np.int64), left["own"].to_numpy(np.int64)
    best, best_ids = search_tile(own, queries, blocks, k, left["least"].to_numpy(float))
    found = np.isfinite(best)
    return pd.DataFrame({"query_id": np.repeat(query_ids, found.sum(1)), "own": np.repeat(own, found.sum(1)), "vec_id": best_ids[found], "score": best[found].astype(np.int64)})


def _matrix(rows: list, dims: int) -> np.ndarray:
    """Vectors as rows; a missing component is 0."""
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _least(batch: pa.RecordBatch, numbers: np.ndarray, sample: np.ndarray, k: int) -> pa.RecordBatch:
    """Queries with their k-th best score among the sample's other vectors; their own k-th best can't be lower."""
    rows = batch.column(1).to_pylist()
    least = np.full(len(rows), -np.inf)
    if rows and len(numbers) > k:
        dims = max(sample.shape[1], *map(len, rows))
        score = _matrix(rows, dims) @ np.pad(sample, ((0, 0), (0, dims - sample.shape[1]))).T
        score[np.array(batch.column(2).to_pylist())[:, None] == numbers[None, :]] = -np.inf
        least = np.partition(score, -k, axis=1)[:, -k]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=["vec_id", "v", "own", "least"])


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products over all candidates but its own row.

    Both have vec_id and v (``usable``). Rows that ``common.numbered`` has written are told apart by their number: then
    rows of one id rank each other, and each query row has a ranking. Without numbers a query's own rows are those of its id:
    repeated query rows count once, and query rows of one id with different vectors share one ranking of all their scores. Ties go to the smaller id; fewer candidates give fewer rows;
    repeated candidate rows count each; vectors of fewer dimensions are filled with 0; scores are exact below 2 to the 53. Queries in groups meet candidates in shards, so
    that a task holds ``GROUP`` queries and about ``SHARD`` vectors whatever the tables' size; a query goes to
    every shard and a vector to every group. The driver holds about ``SAMPLE`` vectors.
    """
    if ROW in candidates.columns and ROW in queries.columns:
        rows = [F.col("vec_id"), F.col("v"), F.col(ROW).alias("own")]
        candidates, queries = candidates.select(rows), materialize(queries.select(rows))
    else:
        rows = [F.col("vec_id"), F.col("v"), F.col("vec_id").alias("own")]
        candidates, queries = materialize(candidates.select(rows)), materialize(queries.dropDuplicates(["vec_id", "v"]).select(rows))
    n, n_queries = candidates.count(), queries.count()
    shards, groups = max(-(-n // SHARD), min(-(-n // SMALL), candidates.sparkSession.sparkContext.defaultParallelism), 1), max(1, -(-n_queries // GROUP))
    drawn = candidates.where(F.pmod(F.xxhash64("own"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).collect()
    sample = _matrix([r["v"] for r in drawn], max([len(r["v"]) for r in drawn], default=0))
    first = partial(_least, numbers=np.array([r["own"] for r in drawn], np.int64), sample=sample, k=k)
    blocks = (
        candidates.repartitionByRange(shards, "vec_id").sortWithinPartitions("vec_id")
        .mapInArrow(partial(_blocks, block=BLOCK, shards=shards), "shard long, ids binary, own binary, rows binary, dims long")
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    )
    asked = map_arrow(queries, first, "vec_id long, v array<double>, own long, least double", 1024)
    asked = asked.withColumn("group", F.pmod(F.xxhash64("own"), F.lit(groups)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))
    )
    found = (
        asked.groupBy("shard", "group").cogroup(blocks.groupBy("shard", "group"))
        .applyInPandas(partial(_search, k=k), "query_id long, own long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


#: DuckDB's form of the query.
ORACLE = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
