"""Sharding by sampled splitters: size-weighted key samples give quantile boundaries, records are
range-partitioned, overfull ranges are subdivided, and ranges fill shards of near equal bytes.

The key is the hash of the text with the hash of the row's number in its low bits: equal texts lie side by
side, and a text with very many copies is still cut at any row, rows that are equal in all columns too.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, numbered

RANGES_PER_SHARD, SAMPLES_PER_RANGE, OVERFULL, ROUNDS = 64, 16, 1.25, 3
#: Ranges of one text go together up to a shard's mean over the first of these numbers that keeps shards within ``EVEN`` of the mean.
TOGETHER, EVEN = (1, 2, 4, 16, 64), 0.02
#: What is more than a shard's mean over so many is placed by itself, the largest first.
LUMP = 16
_BITS = 20
_LOW = (1 << _BITS) - 1
_ROW = "_row"


def _ranged(rows: DataFrame, splits: np.ndarray) -> DataFrame:
    """``rows`` with the range that each key falls into."""

    def run(batch: pa.RecordBatch, splits: np.ndarray) -> pa.RecordBatch:
        found = np.searchsorted(splits, batch.column("key").to_numpy(), side="right").astype(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "range"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_arrow(rows, partial(run, splits=splits), f"{schema}, range long", rows=65536)


def _sample(rows: DataFrame, step: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of rows drawn with a chance in proportion to their size, about one for each ``step`` bytes."""
    chance = F.pmod(F.xxhash64("key", "size", F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(chance < F.col("size") / F.lit(step)).select("key", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("weight"))
    got = drawn.toPandas()  # about total / step rows: RANGES_PER_SHARD * SAMPLES_PER_RANGE for each shard
    order = np.argsort(got["key"].to_numpy(np.int64), kind="stable")
    return got["key"].to_numpy(np.int64)[order], got["weight"].to_numpy(float)[order]


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    if not len(keys) or parts < 2:
        return np.array([], np.int64)
    cumulative = np.cumsum(weights)
    at = np.searchsorted(cumulative, cumulative[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def place_ranges(totals: dict[int, tuple[int, int, int, int]], n_shards: int) -> dict[int, int]:
    """The shard of each range, so that bytes are near equal and ranges within one text lie together as far as that allows."""
    best, most = {}, np.inf
    for share in TOGETHER:
        placed, load = _placed(totals, n_shards, share)
        if load.max() < most:
            best, most = placed, load.max()
        if load.max() <= (1 + EVEN) * load.mean():
            break
    return best


def _placed(totals: dict[int, tuple[int, int, int, int]], n_shards: int, share: int) -> tuple[dict[int, int], np.ndarray]:
    """Large units go first, each to the shard with the least so far; the others fill in key order what room is left."""
    mean = sum(x[0] for x in totals.values()) / n_shards
    units: list[list] = []  # size, ranges, the one text that they hold
    for r in sorted(totals):
        size, _, low, high = totals[r]
        text = low >> _BITS if low >> _BITS == high >> _BITS else None
        if text is not None and units and units[-1][2] == text and units[-1][0] + size <= mean / share:
            units[-1][0] += size
            units[-1][1].append(r)
        else:
            units.append([size, [r], text])
    placed, load = {}, np.zeros(n_shards)
    for size, own, _ in sorted((u for u in units if u[0] > mean / LUMP), key=lambda u: (-u[0], u[1])):
        shard = int(load.argmin())
        placed |= dict.fromkeys(own, shard)
        load[shard] += size
    small = [u for u in units if u[0] <= mean / LUMP]
    room = np.cumsum(np.maximum(0, mean - load))
    scale, at = room[-1] / max(1, sum(u[0] for u in small)), 0
    for size, own, _ in small:
        # A unit goes where its middle byte falls.
        shard = min(n_shards - 1, int(np.searchsorted(room, (at + size / 2) * scale)))
        placed |= dict.fromkeys(own, shard)
        load[shard] += size
        at += size
    return placed, load


def assign_shards(docs: DataFrame, n_shards: int = 40, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, under the law ``bytes``.

    A row's size is the UTF-8 length of its text (null: none) plus 16. Copies of a text share a shard
    unless they straddle a boundary or are too many. Repeated rows each get a slot, and any number of them is
    cut like other rows; null ids and texts are rows like others (a null text has the checksum of an empty
    one); other columns are ignored; an empty table gives an empty result. The driver sees only sampled keys
    and range totals: as many as shards times ``ranges_per_shard`` times a constant, whatever the size of the table.
    """
    return _assigned(docs.select("doc_id", "text", F.monotonically_increasing_id().alias(_ROW)), n_shards, ranges_per_shard).drop(_ROW)


def _assigned(docs: DataFrame, n_shards: int, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``assign_shards`` of numbered rows, with their numbers."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            _ROW,
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64(_ROW).bitwiseAND(F.lit(_LOW))).alias("key"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = n_shards * ranges_per_shard
    target = max(1.0, total / parts)
    step = target / SAMPLES_PER_RANGE
    splits = np.unique(_quantiles(*_sample(rows, step, 0), parts) & ~_LOW)  # no text is cut but where its range is overfull
    for round_ in range(ROUNDS):
        totals = _totals(rows, splits)
        over = [r for r, (size, n, _, _) in totals.items() if size > OVERFULL * target and n > 1]
        if not over:
            break
        inside = _ranged(rows, splits).where(F.col("range").isin(over)).drop("range")
        keys, weights = _sample(inside, step / 4, round_ + 1)
        place = np.searchsorted(splits, keys, side="right")
        more = [_quantiles(keys[place == r], weights[place == r], int(np.ceil(totals[r][0] / target))) for r in over]
        splits = np.unique(np.concatenate([splits, *more]))
    totals = _totals(rows, splits)
    shard_of = place_ranges(totals, n_shards) if totals else {}
    placed, before = [], dict.fromkeys(range(n_shards), 0)
    for r in sorted(totals):
        placed.append((r, shard_of[r], before[shard_of[r]]))
        before[shard_of[r]] += totals[r][1]
    ranges = docs.sparkSession.createDataFrame(placed, "range long, shard int, first_slot long")
    number = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id", "text_crc32", _ROW))
    return (
        _ranged(rows, splits)
        .withColumn("number", number)
        .join(F.broadcast(ranges), "range")  # at most a few times n_shards * ranges_per_shard rows
        .select(
            _ROW, "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first_slot") + F.col("number") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def _totals(rows: DataFrame, splits: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """Of each range its bytes, rows, least and largest key."""
    got = _ranged(rows.select("key", "size"), splits).groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
    return {r["range"]: (r["size"], r["n"], r["low"], r["high"]) for r in got.toLocalIterator()}


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Write every row of ``docs``, with its columns and ``slot``, as Parquet under ``shard=``, in the order of slots.

    Columns of ``docs`` that have these two names give way to them.
    """
    table, name = numbered(docs.drop("shard", "slot"))
    places = _assigned(table.select(F.col(name).alias(_ROW), "doc_id", "text"), n_shards).select(F.col(_ROW).alias(name), "shard", "slot")
    out = table.join(places, name).drop(name)
    out.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
