"""Hierarchical best-fit packing: partitions pack their own pieces best fit and are done with full and nearly full
sequences; the underfull ones go up a tree, in whose steps they are the items of another best fit. What the tree
leaves underfull is taken apart, where its pieces make fewer sequences.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts
from .tokens import ByteTokens, added_tokens

SEQUENCE, END_ID = 1024, 2
#: A sequence with no more free places than this is done.
SLACK = 8
#: Underfull sequences, or pieces of such, that a task of a later round takes, about so many.
OPEN = 16_384
#: Rounds end when one makes its sequences fewer by less than a part in so many; what is left then can hardly be joined.
FEW = 1000

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_SCHEMA = "bin long, size long, open boolean, members array<struct<doc_id long, piece int, start long, length long, ids_crc32 long>>"
_BINS = pa.schema([("bin", pa.int64()), ("size", pa.int64()), ("open", pa.bool_()), ("members", pa.list_(_PIECE))])


@cache
def _tokens(path: str) -> ByteTokens:
    """Ids of the vocabulary of a rank file, with the added tokens of the tokenizers file beside it."""
    return ByteTokens(path, added_tokens(path.removesuffix(".tiktoken") + ".json"))


def cut(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences, but for the first piece."""
    first = n % sequence or sequence
    return [(0, min(first, n)), *((s, sequence) for s in range(first, n, sequence))]


def best_fit(sizes: list[int], sequence: int = SEQUENCE) -> list[list[int]]:
    """Best fit in decreasing order: each item goes where it leaves the least room. Returns the item numbers of each bin."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(sequence + 1)]  # bins by free places
    open_rooms: list[int] = []  # the amounts of free places for which there is a bin, sorted
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect_left(open_rooms, sizes[i])
        if k == len(open_rooms):
            free, at = sequence, len(bins)
            bins.append([])
        else:
            free = open_rooms[k]
            at = room[free].pop()
            if not room[free]:
                del open_rooms[k]
        bins[at].append(i)
        left = free - sizes[i]
        if left > 0:
            if not room[left]:
                insort(open_rooms, left)
            room[left].append(at)
    return bins


def _rows(bins: list[list[tuple]], sizes: list[int], going: list[bool], level: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    base = (level << 56) | (part << 32)
    for at in range(0, len(bins), 4096):
        some = range(at, min(at + 4096, len(bins)))
        members = [[dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), m, strict=True)) for m in bins[i]] for i in some]
        yield pa.RecordBatch.from_arrays([pa.array([base + i for i in some], pa.int64()), pa.array([sizes[i] for i in some], pa.int64()), pa.array([going[i] for i in some]), pa.array(members, pa.list_(_PIECE))], schema=_BINS)


def _pack_pieces(batches: Iterator[pa.RecordBatch], path: str, sequence: int, full: int) -> Iterator[pa.RecordBatch]:
    """Tokenize a partition's documents and pack their pieces; only numbers are kept."""
    pieces: list[tuple] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            flat, counts = _tokens(path).encode_batch(texts(some.column(1)))
            ends = np.cumsum(counts)
            for doc, end, n in zip(some.column(0).to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                ids = np.append(flat[end - n : end], END_ID).astype("<u4").tobytes()
                for k, (start, length) in enumerate(cut(n + 1, sequence)):
                    pieces.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
    yield from _emit([[p] for p in pieces], [p[3] for p in pieces], 0, sequence, full)


def _emit(items: list[list[tuple]], sizes: list[int], level: int, sequence: int, full: int) -> Iterator[pa.RecordBatch]:
    packed = best_fit(sizes, sequence)
    bins = [[m for i in b for m in items[i]] for b in packed]
    totals = [sum(sizes[i] for i in b) for b in packed]
    yield from _rows(bins, totals, [n < full for n in totals], level)


def _pack_bins(batches: Iterator[pa.RecordBatch], level: int, sequence: int, full: int, apart: bool) -> Iterator[pa.RecordBatch]:
    """Pack underfull sequences as items, those that share a new one being joined; or, taken ``apart``, their pieces."""
    items = [[tuple(m.values()) for m in ms] for batch in batches for ms in batch.column("members").to_pylist()]
    if apart:
        items = [[m] for ms in items for m in ms]
    yield from _emit(items, [sum(m[3] for m in ms) for ms in items], level, sequence, full)


def pack(docs: DataFrame, ranks_path: str, sequence: int = SEQUENCE, slack: int = SLACK, most: int = OPEN) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    A document is its ids and the end id; only longer ones than ``sequence`` are cut. A null or empty
    text is the end id alone. Every row is packed, repeated rows and null ids too; other columns are
    ignored; an empty table gives an empty result. All underfull sequences go up to the next round, where
    each task takes about ``most`` of them, dealt from all partitions, so that its memory is bounded and it meets
    sizes of every partition; they are its items, and stay whole. Only these travel, as numbers.
    Rounds go on until one task takes all, or one saves few sequences (``FEW``). The pieces of what is still
    underfull are then packed anew in the same way, in tasks of about ``most`` pieces, where that saves any.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    bounds = {"sequence": sequence, "full": sequence - slack}
    bins = materialize(rows.mapInArrow(partial(_pack_pieces, path=ranks_path, **bounds), _SCHEMA))
    done, rest = bins.where("not open"), bins.where("open")
    level = 1

    def again(bins: DataFrame, items: int, apart: bool) -> tuple[DataFrame, int]:
        parts = max(1, -(-items // max(2, most)))
        return materialize(bins.repartition(parts).mapInArrow(partial(_pack_bins, level=level, apart=apart, **bounds), _SCHEMA)), parts

    for apart in (False, True):
        while True:
            left, pieces = rest.agg(F.count("*"), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
            merged, parts = again(rest, pieces if apart else left, apart)
            now = merged.count()
            if now < left:
                done, rest = done.unionByName(merged.where("not open")), merged.where("open")
            level += 1
            if parts == 1 or FEW * (left - now) < left:
                break
    done = done.unionByName(rest)
    offset = F.aggregate(F.slice("members", 1, F.col("at")), F.lit(0).cast("long"), lambda total, m: total + m["length"])
    return (
        done.select(F.col("bin").alias("sequence_id"), "members", F.posexplode("members").alias("at", "m"))
        .select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", offset.alias("offset"))
    )
