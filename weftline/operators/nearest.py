"""Nearest vectors by exact cosine within groups of equal keys: queries in groups meet vectors in shards, and a tile keeps each query's best."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Queries and vectors of a tile at most, about: what a task holds doesn't grow with the tables.
GROUP, SHARD = 2048, 8192
#: Queries of a tile that are scored at once.
SLICE = 128
#: Below the k-th score by this much no pair can come to it when scores are rounded to six places.
MARGIN = 2e-6
#: Whether pairs, as numbers of queries and of rows, take part.
Met = Callable[[np.ndarray, np.ndarray], np.ndarray]


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in millionths, half up by their shortest decimal form, as Spark's ``round`` has them."""
    scaled = scores * 1e6
    out = np.rint(scaled)
    near = np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-3)
    for i in near:
        out[i] = int((Decimal(repr(float(scores[i]))) * 1000000).to_integral_value(ROUND_HALF_UP))
    return out


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled with 0, and their sizes; -1 for one that is null or has a null component."""
    values = column.combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(values)
    row, at = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0)), np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    out[row, at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(float)
    if flat.null_count:
        sizes[np.unique(row[pc.is_null(flat).to_numpy(zero_copy_only=False)])] = -1
    return out, sizes


def _squares(rows: np.ndarray) -> np.ndarray:
    """Each row's product with itself, added up in the order of its components, as Spark's ``aggregate`` does."""
    total = np.zeros(len(rows))
    for x in rows.T:
        total += x * x
    return total


def _exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, d: np.ndarray, qq: np.ndarray, dd: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (q, d), products added up in the order of components."""
    total = np.zeros(len(q))
    for a, b in zip(queries.T, rows.T, strict=True):
        total += a[q] * b[d]
    return total / np.sqrt(qq[q] * dd[d])


def best_of_tile(queries: np.ndarray, sizes: np.ndarray, rows: np.ndarray, row_sizes: np.ndarray, place: np.ndarray, k: int, missing: float = -np.inf, met: Met | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) of each query's ``k`` best by falling rounded cosine, then ``place``, with cosine and whether there is one.

    A product of matrices finds the pairs that may be among them; those are scored once more, one component after another.
    Vectors of other sizes, with nulls or without length have no cosine, and rank as ``missing``. One that isn't a number ranks first, as in Spark.
    With ``met`` only such pairs take part: it is asked of each query's nearest ``2 * k``, and of all its rows where fewer than ``k`` of these have met.
    """
    dims = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (queries, rows))
    with np.errstate(all="ignore"):
        qq, dd = _squares(queries), _squares(rows)
        usual = lambda square: np.isfinite(square).all() and (np.abs(np.log(square)) < 500).all()
        alike = usual(qq) and usual(dd) and (sizes == dims).all() and (row_sizes == dims).all()
        units, row_units = queries / np.sqrt(qq)[:, None], (rows / np.sqrt(dd)[:, None]).T.copy()
        most_of = k if met is None else 2 * k
        starts = np.linspace(0, len(rows), min(8 * k, len(rows)), endpoint=False).astype(int)
        found = []
        for start in range(0, len(queries), SLICE):
            own = np.arange(start, min(start + SLICE, len(queries)))
            about = units[own] @ row_units
            known = None
            if not alike:
                known = (sizes[own, None] >= 0) & (sizes[own, None] == row_sizes[None, :]) & (qq[own, None] * dd[None, :] != 0)
                about = np.where(known, np.where(np.isfinite(about), about, np.inf), missing)
            # The k-th largest of the largest of k and more parts is no more than the k-th of all.
            most = np.maximum.reduceat(about, starts, axis=1)
            least = np.partition(most, -most_of, axis=1)[:, -most_of] if most_of <= len(starts) else np.full(len(own), -np.inf)
            near = about >= np.where(np.isfinite(least), least - MARGIN, least)[:, None]
            q, d = np.nonzero(near)
            if met is not None:
                ok = met(own[q], d)
                q, d = q[ok], d[ok]
                enough = np.bincount(q[about[q, d] >= least[q]], minlength=len(own)) >= k
                rest, others = np.nonzero(~near & ~enough[:, None])
                ok = met(own[rest], others)
                q, d = np.concatenate([q, rest[ok]]), np.concatenate([d, others[ok]])
                by = np.lexsort((-about[q, d], q))
                q, d = q[by], d[by]
                first = np.searchsorted(q, np.arange(len(own)))
                last = np.minimum(first + k, np.searchsorted(q, np.arange(len(own)), "right")) - 1
                kth = np.append(about[q, d], -np.inf)[last]
                near = about[q, d] >= np.where(np.isfinite(kth), kth - MARGIN, kth)[q]
                q, d = q[near], d[near]
            has = np.ones(len(q), bool) if known is None else known[q, d]
            score = np.where(has, _exact(queries, rows, own[q], d, qq, dd), np.nan)
            order = np.where(has, np.where(np.isfinite(score), rounded(np.nan_to_num(score)), np.inf), missing * 1e6)
            by = np.lexsort((place[d], -order, q))
            q, d, score, has = q[by], d[by], score[by], has[by]
            first = np.searchsorted(q, np.arange(len(own)))
            keep = np.arange(len(q)) - first[q] < k
            found.append((own[q[keep]], d[keep], score[keep], has[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_pairs(queries: DataFrame, rows: DataFrame, keys: list[str], k: int, order: list[tuple[str, str]], nulls: str = "at_start", missing: float = -np.inf, met: Callable[[pa.Table, pa.Table], Met] | None = None) -> DataFrame:
    """Columns of ``queries`` and ``rows`` with ``score``, the cosine of ``_q`` and ``_d`` rounded to six places: for each query row its ``k`` best of each shard with its ``keys``.

    So each query has its ``k`` best among a few more, which the caller ranks. Ties go by ``order`` (columns of ``rows``, ascending or
    descending). A cosine that doesn't exist is null and ranks as ``missing``. Keys are split by their numbers of queries and rows, so a
    task holds ``GROUP`` queries and ``SHARD`` rows whatever the tables' size, and no pairs are shuffled but the best. ``met`` says of a
    tile's queries and rows which pairs take part, by any of their columns.
    """
    parts = lambda df, size, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = parts(queries, GROUP, "_groups").join(parts(rows, SHARD, "_shards"), keys) if keys else parts(queries, GROUP, "_groups").crossJoin(parts(rows, SHARD, "_shards"))
    with_sizes = lambda df: df.join(sizes, keys) if keys else df.crossJoin(sizes)
    part = lambda df, n: F.pmod(F.xxhash64(*df.columns), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile = [*keys, "_group", "_shard"]
    asked = with_sizes(queries).where("_groups > 0 and _shards > 0").withColumn("_group", part(queries, "_groups")).withColumn("_shard", every("_shards")).drop("_groups", "_shards")
    held = with_sizes(rows).where("_groups > 0 and _shards > 0").withColumn("_shard", part(rows, "_shards")).withColumn("_group", every("_groups")).drop("_groups", "_shards")
    mine = [f for f in queries.schema.fields if f.name != "_q"]
    theirs = [f for f in rows.schema.fields if f.name not in (*keys, "_d")]
    named, others = [f.name for f in mine], [f.name for f in theirs]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            empty = [left.schema.field(n).type for n in named] + [right.schema.field(n).type for n in others]
            return pa.table([pa.array([], t) for t in [*empty, pa.float64()]], names=[*named, *others, "score"])
        sort = pc.sort_indices(right, sort_keys=[(c, f"{way}ending") for c, way in order], null_placement=nulls).to_numpy()
        place = np.empty(len(right), np.int64)
        place[sort] = np.arange(len(right))
        q, d, score, has = best_of_tile(*_vectors(left["_q"]), *_vectors(right["_d"]), place, k, missing, met and met(left, right))
        columns = [left[n].take(pa.array(q)) for n in named] + [right[n].take(pa.array(d)) for n in others]
        return pa.table([*columns, pa.array(score, mask=~has)], names=[*named, *others, "score"])

    schema = StructType([*mine, *theirs, *StructType.fromDDL("score double").fields])
    held = held.withColumnsRenamed({c: f"_of{c}" for c in tile})  # both sides may be of one table
    found = asked.groupBy(*tile).cogroup(held.groupBy(*[f"_of{c}" for c in tile])).applyInArrow(run, schema)
    return found.withColumn("score", F.round("score", 6))
