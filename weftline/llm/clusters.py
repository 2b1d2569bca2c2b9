"""Centroid clustering of integer vectors over subvector dictionaries.

Vectors lie in chunks. A chunk holds, for each block of neighbouring dimensions, the distinct subvectors that occur
there and each vector's code among them, which loses nothing. A round computes the exact distance of every distinct
subvector to each centroid's part once, and a vector's distance is the sum of those of its codes. Spark adds up what
the chunks say of each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Dimensions of a block, and vectors of a chunk at most.
BLOCK, CHUNK = 2, 32_768
#: Components are smaller than this in size, so that all sums of a chunk are exact in 64 bits.
LIMIT = 1 << 26

_CHUNK = "ids array<long>, codes binary, sizes array<int>, words binary"


def usable(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component as double, as long.

    Rows whose vector is null, has another number of components than ``dims``, or holds a null or non-finite component go,
    and those with a component of ``LIMIT`` or more after scaling. Null ids stay.
    """
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    fit = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < LIMIT - 1), F.lit(False)))
    return vectors.where((F.size("embedding") == dims) & fit).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(scaled(x)).cast("long")).alias("v"))


def _chunks(batches: Iterator[pa.RecordBatch], dims: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """A partition's vectors as chunks: codes by block of dimensions, and the blocks' distinct subvectors."""

    def close(ids: list[int | None], rows: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(rows).reshape(-1, dims)
        codes, words, sizes = [], [], []
        for at in range(0, dims, BLOCK):
            distinct, code = np.unique(flat[:, at : at + BLOCK], axis=0, return_inverse=True)
            codes.append(code.reshape(-1).astype("<u2" if chunk <= 1 << 16 else "<u4"))
            words.append(distinct.astype("<i4").tobytes())
            sizes.append(len(distinct))
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(c.tobytes() for c in codes)], pa.binary()), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(words)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "codes", "sizes", "words"])

    ids: list[int | None] = []
    rows: list[np.ndarray] = []
    for batch in batches:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        own = batch.column(0).to_pylist()
        for at in range(0, len(own), chunk):
            room = chunk - len(ids)
            ids += own[at : at + room]
            rows.append(values[at : at + room])
            if len(ids) == chunk:
                yield close(ids, rows)
                ids, rows = own[at + room : at + chunk], [values[at + room : at + chunk]]
    if ids:
        yield close(ids, rows)


def _nearest(row: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each vector's nearest centroid (ties: the smaller number), its squared distance, and the chunk's (codes, subvectors) by block."""
    n, dims, sizes = len(row["ids"]), centroids.shape[1], row["sizes"]
    codes = np.frombuffer(row["codes"], f"<u{len(row['codes']) // (n * len(sizes))}").reshape(len(sizes), n)
    flat, used, total, blocks = np.frombuffer(row["words"], "<i4").astype(np.int64), 0, np.zeros((n, len(centroids)), np.int64), []
    for k, size in enumerate(sizes):
        width = min(BLOCK, dims - k * BLOCK)
        distinct = flat[used : used + size * width].reshape(size, width)
        used += size * width
        gap = distinct[:, None, :] - centroids[None, :, k * BLOCK : k * BLOCK + width]
        total += (gap * gap).sum(2)[codes[k]]
        blocks.append((codes[k], distinct))
    cluster = total.argmin(1)
    return cluster, total[np.arange(n), cluster], blocks


def _totals(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each chunk and centroid: how many vectors are nearest, the sum of their distances, and their sum by dimension."""
    for batch in batches:
        for row in batch.to_pylist():
            cluster, distance, blocks = _nearest(row, centroids)
            k = len(centroids)
            count = np.bincount(cluster, minlength=k)
            far = np.zeros(k, np.int64)
            np.add.at(far, cluster, distance)
            sums = []
            for code, distinct in blocks:  # how often each centroid has each subvector
                times = np.bincount(cluster * len(distinct) + code, minlength=k * len(distinct)).reshape(k, len(distinct))
                sums.append(times @ distinct)
            per_dim = np.concatenate(sums, 1)
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count, pa.int64()), pa.array(far, pa.int64()), pa.array(list(per_dim), pa.list_(pa.int64()))], names=["cluster", "n", "distance", "sums"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            cluster, distance, _ = _nearest(row, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: str = "1", dims: int = 64, chunk: int = CHUNK) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``: vectors (``usable``) by their nearest centroid after some rounds.

    Centroids start as the ``k`` vectors whose digests of seed and id are smallest (repeated ids: then the smaller
    vector), fewer if there are fewer; rows without an id are clustered but start none, unless there are no others. An
    empty centroid stays; of equally near ones the smaller number wins. Repeated rows count each. An empty table gives an
    empty result. The driver holds the centroids and their totals alone.
    """
    vectors = vectors.select("vec_id", "v")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64)
    chunks = materialize(vectors.mapInArrow(partial(_chunks, dims=dims, chunk=chunk), _CHUNK))

    def totals(now: np.ndarray) -> list:
        each = chunks.mapInArrow(partial(_totals, centroids=now), "cluster int, n long, distance long, sums array<long>")
        per_dim = each.select("cluster", "n", "distance", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("distance").alias("distance"), F.sum("s").alias("s"))
        return per_dim.groupBy("cluster").agg(F.max("n").alias("n"), F.max("distance").alias("distance"), F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("sums")).collect()

    for _ in range(rounds):
        for r in totals(centroids):
            if r["n"]:
                centroids[r["cluster"]] = [s["s"] // r["n"] for s in r["sums"]]
    inertia = {r["cluster"]: r["distance"] for r in totals(centroids)}
    rows = [(c, d, sum(inertia.values()), _digest(centroids[c])) for c, d in inertia.items()]
    said = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = chunks.mapInArrow(partial(_assigned, centroids=centroids), "vec_id long, cluster int, distance long")
    return found.join(F.broadcast(said), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a centroid


def oracle(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> str:
    """DuckDB's form of the query, a step for each round."""
    gap = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    assign = "SELECT row, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT x.row, c.cluster, {gap} AS d FROM x CROSS JOIN c{r} c) GROUP BY row"
    parts = [f"""x AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS INTEGER) AS cluster, v FROM x
       QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) <= {k})"""]
    for r in range(rounds):
        parts.append(f"a{r} AS ({assign.format(gap=gap, r=r)})")
        parts.append(f"""s{r} AS (SELECT cluster, i, sum(x.v[i]) AS s, count(*) AS n FROM a{r} JOIN x USING (row) CROSS JOIN range(1, {dims + 1}) d(i) GROUP BY cluster, i),
m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY cluster),
c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    parts.append(f"f AS ({assign.format(gap=gap, r=rounds)})")
    return f"""WITH {", ".join(parts)}
SELECT x.vec_id, f.cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(f.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN x USING (row) JOIN c{rounds} c ON c.cluster = f.cluster"""
