"""Word-level BPE by a table of distinct words.

Texts are split into words in blocks: a block holds its documents' words as codes into its own list of distinct
words. Those lists meet by a hash of the word, where each distinct word is encoded once, and its ids go back to the
blocks, which put them in the words' places. Ids become text through a join with the vocabulary's pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, partial
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, numbered

#: Characters after which a block of documents is closed: a task holds one block.
BLOCK_CHARS = 32_000_000
#: Words after which a row of a block's documents ends.
PART_WORDS = 250_000
#: Entries of the blocks' word lists that a bucket of words takes, about so many.
BUCKET_WORDS = 50_000
#: What lies between white space, as tokenizers see it; Python's own split() cuts at these separators too.
_BETWEEN = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATOR = re.compile(r"[\x1c-\x1f]")
#: Symbols from which on a word's pairs are kept in a heap.
LONG = 24
_NO_RANK = 1 << 60


class _Places(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


class WordVocabulary:
    """A tokenizers file with BPE of lower-case words and a mark at the word's end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model, added = found["model"], found["added_tokens"]
        steps = [s["type"] for s in found["normalizer"]["normalizers"]]
        split, level = found["pre_tokenizer"]["pretokenizers"]
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if steps != ["NFC", "Replace", "Lowercase"] or level["add_prefix_space"] or level["use_regex"] or found["decoder"] or not plain:
            raise ValueError(f"{path} isn't a file of lower-case words without a decoder")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.id, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merge = {(self.id[a], self.id[b]): (rank, self.id[a + b]) for rank, (a, b) in enumerate(merges)}
        # Each byte has a visible character: printable ones their own, the others follow from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in own)}
        self.byte = {name: b for b, name in names.items()}
        self.first = [self.id[names[b]] for b in range(256)]
        self.last = [self.id[names[b] + self.suffix] for b in range(256)]
        # Characters younger than this Python, whose kinds only the library knows.
        unknown = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn"]
        cuts = [k for k in range(1, len(unknown)) if unknown[k] != unknown[k - 1] + 1]
        self.unknown = re.compile("[" + "".join(f"{chr(unknown[a])}-{chr(unknown[b - 1])}" for a, b in zip([0, *cuts], [*cuts, len(unknown)], strict=True)) + "]")
        self.library = Tokenizer.from_file(path)

    def pieces(self) -> list[tuple[int, str]]:
        """(id, piece) of the whole vocabulary."""
        found = sorted((i, p) for p, i in (self.id | self.added).items())
        if [i for i, _ in found] != list(range(len(found))):
            raise ValueError("the vocabulary's ids aren't 0, 1, ...")
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text; an added token stands for itself, and no word equals one."""
        parts = self.cut.split(text)
        out = self._plain_words(parts[0])
        for at in range(1, len(parts), 2):
            out.append(parts[at])
            out += self._plain_words(parts[at + 1])
        return out

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii() and self.unknown.search(text):
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte.__getitem__, word)).decode() for word, _ in found]
        # Letter by letter: the form of a sigma at a word's end doesn't matter to the tokenizer.
        return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, word: str) -> list[int]:
        if word in self.added:
            return [self.added[word]]
        raw = word.encode()
        ids = [*map(self.first.__getitem__, raw[:-1]), self.last[raw[-1]]]
        if len(ids) >= LONG:
            return self._encode_long(ids)
        none = (_NO_RANK, -1)
        found = [self.merge.get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = self.merge.get((ids[at], ids[at + 1]), none)
            if at:
                found[at - 1] = self.merge.get((ids[at - 1], ids[at]), none)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        """The same merges by a heap of (rank, place), so that work follows the length."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*self.merge[pair], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in self.merge]
        heap = [(rank, k, to) for rank, to, k in heap]
        heapify(heap)
        while heap:
            rank, k, to = heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0 or self.merge.get((ids[k], ids[right])) != (rank, to):
                continue
            ids[k], ids[right] = to, -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] >= 0:
                    pair = self.merge.get((ids[left], ids[after[left]]))
                    if pair:
                        heappush(heap, (pair[0], left, pair[1]))
        return [i for i in ids if i >= 0]


@cache
def load(path: str) -> WordVocabulary:
    return WordVocabulary(path)


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2 to the 32 as compressed bytes, the low ones of all first."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n).astype(np.int64)


def _strung(words: list[str]) -> bytes:
    return pa.compress(" ".join(words).encode(), codec="zstd", asbytes=True)


def _unstrung(packed: bytes, size: int) -> list[str]:
    return pa.decompress(packed, size, codec="zstd", asbytes=True).decode().split(" ")


def _expand(codes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of each code's list, lists lying in ``flat`` one after another, and how many each code has."""
    first, many = np.cumsum(counts) - counts, counts[codes]
    return flat[np.arange(int(many.sum())) + np.repeat(first[codes] - (np.cumsum(many) - many), many)], many


#: Rows of a block: 0 its words, sorted by hash, and for each code its place among them; 1 bundles of their ids; 2 documents as codes.
_WORDS, _IDS, _DOCS = 0, 1, 2
_ROW = "block long, kind int, at long, doc_ids array<long>, counts binary, n long, codes binary, size long, words binary"
_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("n", pa.int64()), ("codes", pa.binary()), ("size", pa.int64()), ("words", pa.binary())])


def _row(*values: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, chars: int) -> Iterator[pa.RecordBatch]:
    """A partition's documents as blocks. A word has a code by its frequency in the block.

    No word reaches across white space, so only the distinct strings between it are split into words.
    """
    vocabulary, base, made = load(path), TaskContext.get().partitionId() << 32, 0

    def close() -> Iterator[pa.RecordBatch]:
        places = _Places()
        lists = [[places[w] for w in vocabulary.words(x)] for x in strings]
        n_words, counts = len(places), np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((c for own in lists for c in own), np.int64, int(counts.sum()))
        if n_words:
            times = np.bincount(flat, np.repeat(np.bincount(np.concatenate(held), minlength=len(counts)), counts), n_words)
            code = np.empty(n_words, np.int64)
            code[np.argsort(-times, kind="stable")] = np.arange(n_words)
            words = list(places)
            by_hash = np.argsort(np.fromiter(map(_hash, words), np.int64, n_words), kind="stable")
            place = np.empty(n_words, np.int64)
            place[code[by_hash]] = np.arange(n_words)
            sorted_words = [words[i] for i in by_hash.tolist()]
            size = sum(len(w.encode()) for w in sorted_words) + n_words - 1
            yield _row(base + made, _WORDS, 0, None, None, n_words, _pack(place), size, _strung(sorted_words))
            flat = code[flat]
        at, part, n = 0, [], 0
        for k, own in enumerate(held):
            codes, _ = _expand(own, flat, counts)
            part.append(codes)
            n += len(codes)
            if n >= PART_WORDS or k == len(held) - 1:
                yield _row(base + made, _DOCS, at, doc_ids[at : k + 1], _pack(np.array([len(c) for c in part])), n, _pack(np.concatenate(part)), len(part), None)
                at, part, n = k + 1, [], 0

    strings, doc_ids, held, size = _Places(), [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            own = _BETWEEN.findall(text) if _SEPARATOR.search(text) else text.split()
            doc_ids.append(doc_id)
            held.append(np.fromiter(map(strings.__getitem__, own), np.int32, len(own)))
            size += len(text)
            if size >= chars:
                yield from close()
                made += 1
                strings, doc_ids, held, size = _Places(), [], [], 0
    if doc_ids:
        yield from close()


def _bundles(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each block's words by bucket: a range of hashes, so a bucket's words follow one another in the block's list."""
    for batch in batches:
        for row in batch.to_pylist():
            words = _unstrung(row["words"], row["size"])
            bucket = np.fromiter(map(_hash, words), np.int64, len(words)) * buckets >> 32
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            parts = [words[a:b] for a, b in zip(starts, [*starts[1:], len(words)], strict=True)]
            sizes = [sum(len(w.encode()) for w in own) + len(own) - 1 for own in parts]
            columns = [pa.array([row["block"]] * len(parts), pa.int64()), pa.array(bucket[starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(map(_strung, parts), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "size", "words"])


def _encode_bundles(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Ids of each bundle's words. Bundles come sorted by bucket, and a word has one bucket, so each word is encoded once."""
    vocabulary, bucket, known = load(path), None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                bucket, known = row["bucket"], {}
            found = []
            for word in _unstrung(row["words"], row["size"]):
                if word not in known:
                    known[word] = vocabulary.encode(word)
                found.append(known[word])
            ids, counts = np.array([i for x in found for i in x]), np.array(list(map(len, found)))
            yield _row(row["block"], _IDS, bucket, None, _pack(counts), len(ids), _pack(ids), len(found), None)


_OUT = "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, text string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("text", pa.string())])


def _in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks one after another, first a block's ids, then its documents: each document's ids by position, and their pieces."""
    block, place, pieces, bundles, table = None, None, [], [], None
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: column[at] for name, column in zip(batch.schema.names, batch.columns, strict=True)}
            kind, n, size = row["kind"].as_py(), row["n"].as_py(), row["size"].as_py()
            if row["block"].as_py() != block:
                block, place, pieces, bundles, table = row["block"].as_py(), np.zeros(0, np.int64), [], [], None
            if kind == _WORDS:
                place, pieces = _unpack(row["codes"].as_py(), n), row["pieces"].as_py()
            elif kind == _IDS:
                bundles.append((_unpack(row["codes"].as_py(), n), _unpack(row["counts"].as_py(), size)))
            else:
                if table is None:
                    ids, counts = (np.concatenate(x) for x in zip(*bundles, strict=True)) if bundles else (np.zeros(0, np.int64),) * 2
                    table, bundles = (ids.astype(np.int32), counts), []
                ids, many = _expand(place[_unpack(row["codes"].as_py(), n)], *table)
                ends = np.concatenate([[0], np.cumsum(many)])[np.concatenate([[0], np.cumsum(_unpack(row["counts"].as_py(), size))])]
                out = []
                for doc_id, a, b in zip(row["doc_ids"].as_py(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = ids[a:b]
                    out.append((doc_id, b - a, own, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), " ".join(map(pieces.__getitem__, own.tolist()))))
                for k in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[k : k + 256], strict=True), _OUT_ARROW, strict=True)], schema=_OUT_ARROW)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece`` of a tokenizers file, as large as its vocabulary."""
    return spark.createDataFrame(load(path).pieces(), "id int, piece string")


def encode(docs: DataFrame, path: str, chars: int = BLOCK_CHARS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, text``: each whole text's ids, and what they decode to.

    Null and empty texts have no ids and an empty text; every row gives one row, repeated rows and null ids of
    documents too; other columns are ignored; an empty table gives an empty result. The digest is of the ids as
    little-endian unsigned 32-bit integers. The text is decoded from the ids, through the pieces that each
    block is joined with, where the ids come back, so that ids aren't shuffled again; ``decode`` is for any ids.
    """
    spark = docs.sparkSession
    blocks = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_blocks, path=path, chars=chars), _ROW))
    words = blocks.where(F.col("kind") == _WORDS)
    listed = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = min(1 << 30, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed // bucket_words)))
    bundles = words.select("block", "size", "words").mapInArrow(partial(_bundles, buckets=buckets), "block long, bucket long, size long, words binary")
    encoded = bundles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_encode_bundles, path=path), _ROW)
    vocabulary = piece_table(spark, path).agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("_p"))
    pieces = vocabulary.select(F.lit(_WORDS).alias("kind"), F.transform("_p", lambda p: p["piece"]).alias("pieces"))
    whole = blocks.unionByName(encoded).drop("words").join(F.broadcast(pieces), "kind", "left")  # one row, as large as the vocabulary
    return whole.repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(_in_place, _OUT)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """The rows with ``text``: the pieces of their ids (``ids``), joined by spaces, as the file's tokenizer decodes them.

    Ids that the vocabulary doesn't have, and null ones, are left out, as the library does; null and empty lists give an empty text. A column
    named text is replaced.
    """
    own, number = numbered(rows.drop("text"))
    each = own.select(number, F.posexplode("ids").alias("_at", "id")).join(F.broadcast(piece_table(rows.sparkSession, path)), "id")  # as large as the vocabulary
    said = each.groupBy(number).agg(F.array_sort(F.collect_list(F.struct("_at", "piece"))).alias("_p"))
    text = F.array_join(F.transform("_p", lambda p: p["piece"]), " ")
    return own.join(said.select(number, text.alias("text")), number, "left").withColumn("text", F.coalesce("text", F.lit(""))).drop(number)
