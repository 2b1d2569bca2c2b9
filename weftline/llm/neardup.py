"""Near-duplicate documents: MinHash with banding, verification, and components by large-star and small-star.

1. Each document's set of word shingles gives many universal hash minima; documents with one set form a class.
2. Each class is held against the first class of its buckets: pairs whose signatures disagree too much
   go, the others are confirmed on full sets. Components of the links follow.
3. Buckets that still hold several components are near misses, mostly. A class whose shingles are too often
   its own can be like no other and goes; the rest is held against the class of each bucket with the fewest
   shingles of its own, the most central one.
4. What is left meets in tiles of bounded size, the classes outside of a bucket's largest component against
   all of it, and an inverted index within a tile counts what classes of different components have in common.
   No pairs are written but confirmed links, and no bucket is capped.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, numbered, texts

BANDS = 32
#: Chance that a pair right at the threshold shares no band.
MISS = 1e-5
#: Standard deviations by which a signature may fall short of the threshold before the sets are read.
MARGIN = 5.0
#: Documents and bytes of shingle sets of each of the two blocks that meet in a tile, at most.
TILE_DOCS, TILE_BYTES = 2048, 32 << 20
_ROW = "_row"
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def band_rows(threshold: float, bands: int = BANDS, miss: float = MISS) -> int:
    """The most minima per band with which a pair at the threshold is missed with a chance of at most ``miss``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** bands <= miss:
        rows += 1
    return rows


def _hash(shingle: bytes) -> int:
    return xxhash.xxh3_64_intdigest(shingle)


def shingle_sets(batch: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, one text after the other, and how many each has.

    Words are runs of other characters than ASCII white space, A-Z in lower case; with fewer words
    than a shingle has, the whole sequence is one; without words the set is empty.
    """
    own = [t.encode().translate(_UPPER).split() for t in batch]
    lengths = np.array([len(w) for w in own], np.int64)
    flat = np.fromiter((_hash(w) for ws in own for w in ws), np.uint64, int(lengths.sum()))
    count = np.where(lengths >= words, lengths - words + 1, np.minimum(lengths, 1))
    doc = np.repeat(np.arange(len(own)), count)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    width = np.minimum(lengths, words)[doc]
    mixed = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64) * (width.astype(np.uint64) + np.uint64(1))
    for k in range(words):
        use = k < width
        h = flat[np.where(use, at + k, 0)] if len(flat) else flat
        step = (mixed ^ h) * np.uint64(0xBF58476D1CE4E5B9)
        step ^= step >> np.uint64(31)
        step *= np.uint64(0x94D049BB133111EB)
        mixed = np.where(use, step ^ (step >> np.uint64(29)), mixed)
    order = np.lexsort((mixed, doc))
    mixed, doc = mixed[order], doc[order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (doc[1:] != doc[:-1])
    return mixed[new], np.bincount(doc[new], minlength=len(own))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def _sketch(batch: pa.RecordBatch, words: int, bands: int, rows: int) -> pa.RecordBatch:
    hashes, counts = shingle_sets(texts(batch.column(2)), words)
    full = np.flatnonzero(counts)
    starts = np.concatenate([[0], np.cumsum(counts[full])])[:-1].astype(np.int64)
    n = bands * rows
    minima = np.zeros((n, len(full)), np.uint32)
    if len(full):
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        for k, (a, b) in enumerate(zip(*_coefficients(n), strict=True)):
            minima[k] = np.minimum.reduceat(low * a + b, starts)
        one, two = np.add.reduceat(hashes, starts), np.add.reduceat(hashes * (hashes | np.uint64(1)), starts)
    signature = np.ascontiguousarray(minima.T)
    short = signature.astype(np.uint8)  # for comparing, the low bytes of the minima do
    mixed = np.zeros((len(full), bands), np.uint64)
    for k in range(rows):
        mixed = (mixed ^ signature[:, k::rows]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed * np.uint64(bands) + np.arange(bands, dtype=np.uint64)  # bands keep to themselves
    keys, sigs, buckets = ([None] * len(counts) for _ in range(3))
    for i, d in enumerate(full.tolist()):
        keys[d] = one[i].tobytes() + two[i].tobytes()
        sigs[d] = short[i].tobytes()
        buckets[d] = mixed[i].view(np.int64)
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
        names=[_ROW, "doc_id", "n_shingles", "set_key", "signature", "buckets"],
    )


def _sets(batch: pa.RecordBatch, words: int) -> pa.RecordBatch:
    hashes, counts = shingle_sets(texts(batch.column(1)), words)
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["node", "n", "members"])


def _spread(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each shingle of each set."""
    sizes = [len(x) // 8 for x in batch.column(1).to_pylist()]
    flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), sizes), pa.int64()), pa.array(flat, pa.int64())], names=["node", "shingle"])


def _agree(batch: pa.RecordBatch, least: float) -> pa.RecordBatch:
    """Pairs whose signatures agree in at least that share of places."""
    if batch.num_rows:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
        ok = (left == right).mean(1) >= least
    else:
        ok = np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _confirm(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Pairs whose full sets are similar enough."""
    ok = []
    for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
            ok.append(False)
            continue
        at = np.searchsorted(p, q)
        common = int((p[np.minimum(at, len(p) - 1)] == q).sum())
        ok.append(100 * common >= percent * (len(p) + len(q) - common))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _with_both(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``a, b`` with ``value`` of each."""
    left = values.select(F.col("node").alias("a"), F.col(value).alias("x"))
    right = values.select(F.col("node").alias("b"), F.col(value).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: for each end of ``links`` (a, b) the least id that it reaches, by alternating stars.

    Large-star links every larger neighbour of a node to its least neighbour, small-star every smaller
    one; both keep components and end in stars. A node's least neighbour is an aggregate, and joins put
    it beside the links, so that no node's neighbours are ever gathered.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        star = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        edges = materialize(star.where("a <> b").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return got["n"], got["h"]


def _bitmaps(some: DataFrame, number: str) -> DataFrame:
    """The numbers in ``some`` (``number``), which may repeat, as bitmaps with a bit for each row of the documents."""
    bits = some.select(F.bitmap_bucket_number(number).alias("_bucket"), F.bitmap_bit_position(number).alias("_bit")).repartition("_bucket")
    return materialize(bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def _among(rows: DataFrame, some: DataFrame, name: str, number: str) -> DataFrame:
    """The rows whose number (``name``) is one of the numbers in ``some`` (``number``), which may repeat."""
    return _picked(rows, name, _bitmaps(some, number))


def _picked(rows: DataFrame, name: str, maps: DataFrame) -> DataFrame:
    """The rows whose number (``name``) is set in ``maps`` (``_bitmaps``).

    Texts, sets and signatures aren't shuffled for that: Spark sends the bitmaps to the rows
    while their table is small enough for a broadcast (2 MB for 16 million rows).
    """
    at = F.bitmap_bit_position("_number")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = rows.select(F.struct(*rows.columns).alias("_all"), F.col(name).alias("_number"))  # whatever its columns are called
    found = own.join(maps, F.bitmap_bucket_number("_number") == F.col("_bucket"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select("_all.*")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Two rows are linked when ``100 * common >= percent * union`` of their shingle sets; a component's
    id is the least doc_id in it, and a row is kept where that is its doc_id. Null and empty texts and those
    without words have an empty set, are linked with nothing and kept. Rows of one doc_id are one each, with
    their own texts; those without doc_id link as others do, and of a component without any doc_id one row is
    kept, with a null component_id. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _labelled(numbered(docs.select("doc_id", "text"))[0], words, percent, bands)
    nameless = F.col("component_id").isNull() & (F.col("component").isNull() | (F.col("component") == F.col(_ROW)))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), nameless).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS) -> DataFrame:
    """``docs`` with one row of each component of near copies: the first of those with its least doc_id.

    Repeated rows and rows without doc_id are copies like others; rows without words stay, all of them. All
    columns stay as they are, whatever their names; an empty table gives an empty result.
    """
    table, name = numbered(docs)
    rows = _labelled(table.select(F.col(name).alias(_ROW), "doc_id", "text"), words, percent, bands)
    first = rows.where("component is not null and doc_id <=> component_id").groupBy("component").agg(F.min(_ROW).alias(_ROW))
    kept = first.select(_ROW).union(rows.where("component is null").select(_ROW))
    return _among(table, kept, name, _ROW).select(*docs.columns)


def _labelled(table: DataFrame, words: int, percent: int, bands: int) -> DataFrame:
    """Of each row its number, ``doc_id, n_shingles, component, component_id``; without words there is no component and the id is its own."""
    threshold = percent / 100
    rows = band_rows(threshold, bands)
    least = threshold - MARGIN * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    texts_ = table.select(_ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"{_ROW} long, doc_id long, n_shingles long, set_key binary, signature binary, buckets array<long>"
    sketch = materialize(map_arrow(texts_, partial(_sketch, words=words, bands=bands, rows=rows), schema))
    # All rows of a class have the same signature: that of its first row, whose number is the class's node, stays where it is.
    classes = materialize(sketch.where("set_key is not null").groupBy("set_key").agg(F.min(_ROW).alias("node"), F.min("doc_id").alias("doc_id")))
    firsts = _among(sketch.select(F.col(_ROW).alias("node"), "signature", "buckets"), classes, "node", "node")
    joined = _linked(texts_, firsts, words, percent, least)
    placed = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(names, "component").select("set_key", "component", F.col("component_id").alias("least_id"))
    return sketch.join(found, "set_key", "left").select(
        _ROW, "doc_id", "n_shingles", "component", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id")
    )


def _alike(n: str, other: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _linked(texts_: DataFrame, firsts: DataFrame, words: int, percent: int, least: float) -> DataFrame:
    """``node, component`` for every class (node, signature, buckets) that is linked."""
    # Hardly any bucket holds several classes: its rows move once, and a window finds their first and last.
    members, bucket = firsts.select("node", F.explode("buckets").alias("bucket")), Window.partitionBy("bucket")
    ends = members.select("*", F.min("node").over(bucket).alias("pivot"), F.max("node").over(bucket).alias("last"))
    shared = materialize(ends.where("pivot < last").drop("last"))
    # Every later pair has both its ends among these.
    several = _bitmaps(shared, "node")
    read = _picked(texts_.select(F.col(_ROW).alias("node"), "text"), "node", several)
    sets = materialize(map_arrow(read, partial(_sets, words=words), "node long, n long, members binary"))
    signed = materialize(_picked(firsts.select("node", "signature"), "node", several))
    # First each class meets the first of all the pivots of its buckets.
    first = shared.groupBy("node").agg(F.min("pivot").alias("pivot")).where("node <> pivot")
    links = _verify(first.select(*_ordered(F.col("node"), F.col("pivot"))), signed, sets, least, percent)
    joined = components(links)
    rest = _unresolved(shared.join(sets.select("node", "n"), "node"), joined)
    if rest.isEmpty():
        return joined
    rest = _possible(rest, sets, percent)
    best = F.max_by(F.struct(F.col("node").alias("pivot"), F.col("component").alias("main"), F.col("n").alias("pivot_n")), F.col("shared") / F.col("n"))
    central = rest.groupBy("bucket").agg(best.alias("best")).select("bucket", "best.*")
    pairs = rest.join(central, "bucket").where((F.col("component") != F.col("main")) & _alike("n", "pivot_n", percent))
    joined = _with_links(joined, _verify(pairs.select(*_ordered(F.col("node"), F.col("pivot"))).distinct(), signed, sets, least, percent))
    rest = _unresolved(rest, joined)
    return joined if rest.isEmpty() else _with_links(joined, materialize(_tiles(rest, sets, percent)))


def _with_links(joined: DataFrame, more: DataFrame) -> DataFrame:
    """The components with some more links."""
    return joined if more.isEmpty() else components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _unresolved(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``bucket, node, n, component`` of the buckets that hold several components."""
    placed = rows.select("bucket", "node", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return materialize(_several(placed))


def _several(placed: DataFrame) -> DataFrame:
    """The rows of buckets with several components."""
    left = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return placed.join(left, "bucket", "left_semi")


def _possible(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rest`` with ``shared``, how many of a class's shingles others have too, without the classes that are linked with no more.

    What two classes have in common lies in the shared part of each: beside the smallest set of a bucket
    that bounds the similarity with any other. A shingle counts as shared when two classes of ``rest`` have it.
    """
    own = _among(sets.select("node", "members"), rest, "node", "node")
    single = map_arrow(own, _spread, "node long, shingle long").groupBy("shingle").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    rows = rest.join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    low = rows.groupBy("bucket").agg(F.min("n").alias("low"))
    union = F.col("n") + F.greatest("low", "shared") - F.col("shared")
    can = rows.join(low, "bucket").where(100 * F.col("shared") >= percent * union).drop("low")
    return materialize(_several(can))


def _tiles(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within buckets that are left (bucket, node, n, component).

    A bucket's classes outside of its largest component are cut into blocks, and so is that component;
    blocks of the former meet each other and those of the latter.
    """
    sizes = rest.groupBy("bucket", "component").agg(F.count("*").alias("docs"), (8 * F.sum("n")).alias("bytes"))
    largest = F.max_by("component", "docs")
    def blocks(docs: Column, bytes_: Column) -> Column:
        return F.greatest(F.ceil(docs / TILE_DOCS), F.ceil(bytes_ / TILE_BYTES), F.lit(1)).cast("int")

    cut = (
        sizes.groupBy("bucket").agg(largest.alias("largest"), F.max("docs").alias("main_docs"), F.max_by("bytes", "docs").alias("main_bytes"), F.sum("docs").alias("docs"), F.sum("bytes").alias("bytes"))
        .select("bucket", "largest", blocks(F.col("docs") - F.col("main_docs"), F.col("bytes") - F.col("main_bytes")).alias("others"), blocks(F.col("main_docs"), F.col("main_bytes")).alias("mains"))
    )
    rows = rest.join(cut, "bucket").withColumn("is_main", F.col("component") == F.col("largest"))
    own = F.when(F.col("is_main"), F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    last = F.when(F.col("is_main"), F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last - 1))).where("own <> other")
    tiles = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")
    return tiles.join(_among(sets.select("node", "members"), rest, "node", "node"), "node").groupBy("bucket", "i", "j").applyInPandas(partial(_tile_links, percent=percent), "a long, b long")


def _tile_links(tile: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join components of a tile, as few as it takes."""
    ids, component = tile["node"].tolist(), tile["component"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in tile["members"]]
    size = np.array([len(x) for x in sets])
    values, term = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    posting = owner[np.argsort(term, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(values)))])
    at = np.concatenate([[0], np.cumsum(size)])
    names, label, counts = np.unique(component, return_inverse=True, return_counts=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x in np.flatnonzero(label != counts.argmax()).tolist():
        own = term[at[x] : at[x + 1]]
        n = first[own + 1] - first[own]
        index = np.arange(int(n.sum())) + np.repeat(first[own] - (np.cumsum(n) - n), n)
        common = np.bincount(posting[index], minlength=len(sets))
        for y in np.flatnonzero((100 * common >= percent * (size[x] + size - common)) & (label != label[x])).tolist():
            a, b = find(label[x]), find(label[y])
            if a != b:
                root[a] = b
                links.append((max(ids[x], ids[y]), min(ids[x], ids[y])))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _verify(pairs: DataFrame, signed: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    close = materialize(map_arrow(_with_both(pairs, signed, "signature"), partial(_agree, least=least), "a long, b long", rows=4096))
    met = _among(sets, close.select("a").union(close.select("b")), "node", "a")
    return materialize(map_arrow(_with_both(close, met, "members"), partial(_confirm, percent=percent), "a long, b long"))
