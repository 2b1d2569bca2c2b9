"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct segments of a batch lie in one flat numpy array of symbols. In each round every segment
finds its pair of least rank, all of that pair's occurrences merge from the left, and the array is
compacted, until no segment has a pair left. Merges never cross from another character to a space
mark, nor a character that no longer piece holds, so texts are cut there and each segment is encoded once.
In long segments the places of each rank are queued, so that a round touches only what it merges.
"""

from __future__ import annotations

import hashlib
from functools import cache, partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts
from .tokens import SegmentIds

MARK = "▁"
#: Symbols from which on a segment's places are queued by rank.
LONG = 256
_NONE = np.int32(1 << 30)


class PieceModel:
    """A byte-fallback BPE model with the identity normalizer and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.id = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.byte_id = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.raw.append(bytes([int(p[1:-1], 16)]))
            else:
                self.raw.append(b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else p.replace(MARK, " ").encode())
        self.decimal = [str(i) for i in range(n)]
        # Rank of each piece by falling score; pieces of one score share it.
        scores = {i: sp.get_score(i) for i in self.id.values()}
        levels = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(n, _NONE, np.int32)
        for i, s in scores.items():
            self.rank[i] = levels[s]
        pairs = {}
        for p, i in self.id.items():
            for k in range(1, len(p)):
                left, right = self.id.get(p[:k]), self.id.get(p[k:])
                if left is not None and right is not None:
                    pairs[left, right] = i
        self._index(pairs)
        # After these merges a better pair can arise, or another piece has their score: one at a time, from the left.
        self.single = np.zeros(n, bool)
        for (left, right), i in pairs.items():
            for part in (left, right):
                if self.rank[i] <= self.rank[part]:
                    self.single[part] = True
        by_rank = np.bincount(self.rank[list(scores)], minlength=len(levels))
        self.single |= (self.rank < _NONE) & (by_rank[np.minimum(self.rank, len(levels) - 1)] > 1)
        longest = max(map(ord, "".join(self.id))) + 1
        self.char = np.full(longest + 1, -1, np.int32)  # the last place stands for all above
        for p, i in self.id.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        inner = set("".join(p for p in self.id if len(p) > 1))
        self.cuts_newline = "\n" not in inner
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a space mark after another character")
        self.ids = SegmentIds(self._placed)

    def _index(self, pairs: dict[tuple[int, int], int]) -> None:
        """A table by hash of the pair; each place is tried in turn."""
        size = 1 << max(16, (4 * len(pairs)).bit_length())
        self.mask = np.int64(size - 1)
        self.key = np.full(size, -1, np.int64)
        self.to = np.full(size, -1, np.int32)
        self.probes = 1
        for (left, right), i in pairs.items():
            key = (left << 32) | right
            at = self._place(np.int64(left), np.int64(right))
            step = 1
            while self.key[at] >= 0:
                at = (at + 1) & self.mask
                step += 1
            self.key[at], self.to[at] = key, i
            self.probes = max(self.probes, step)

    def _place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 40503 + right * 2654435761) >> 7) & self.mask

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        key, at = (left << 32) | right, self._place(left, right)
        out = np.full(len(left), -1, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            found = self.key[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
        return out

    def _placed(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, counts = self._encode(segments)
        return ids, counts, np.cumsum(counts) - counts

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(s) for s in segments], np.int64)
        word = np.repeat(np.arange(len(segments)), lengths)
        symbol = self.char[np.minimum(code, len(self.char) - 1)]
        done_symbol, done_word, done_at = [], [], []
        at = np.arange(len(symbol))
        long = np.repeat(lengths > LONG, lengths)
        if long.any():
            kept, merged = self._by_rank(symbol[long], word[long])
            done_symbol.append(merged), done_word.append(word[long][kept]), done_at.append(at[long][kept])
            symbol, word, at = symbol[~long], word[~long], at[~long]
        pair = self._pairs(symbol, word)
        while len(symbol):
            rank = np.where(pair >= 0, self.rank[pair], _NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbol)])
            going = np.repeat(least < _NONE, counts)
            if not going.all():  # words without a pair are done
                stop = ~going
                done_symbol.append(symbol[stop]), done_word.append(word[stop]), done_at.append(at[stop])
                symbol, word, at, pair, rank = symbol[going], word[going], at[going], pair[going], rank[going]
                if not len(symbol):
                    break
                counts, least = counts[least < _NONE], least[least < _NONE]
            hit = np.flatnonzero(rank == np.repeat(least, counts))
            hit = self._from_left(hit, word, pair)
            symbol[hit] = pair[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[hit] = True
            changed[np.maximum(hit - 1, 0)] = True
            prior = hit[(hit >= 2)] - 2  # the left neighbour may have gone into its own merge
            changed[prior] = True
            symbol, word, at, pair, changed = symbol[stay], word[stay], at[stay], pair[stay], changed[stay]
            redo = np.flatnonzero(changed)
            after = np.minimum(redo + 1, len(symbol) - 1)
            fresh = self._merged(symbol[redo], symbol[after])
            fresh[(word[redo] != word[after]) | (redo == len(symbol) - 1)] = -1
            pair[redo] = fresh
        symbol, word, at = np.concatenate(done_symbol), np.concatenate(done_word), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        symbol, word, at = symbol[order], word[order], at[order]
        return self._with_bytes(symbol, word, code[at], len(segments))

    def _by_rank(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge long words: the places that stay, and their symbols.

        Rounds go by rank over all words, which are independent. Places lie in a linked list whose last one
        stands for the end; a rank's queue may hold places that have changed since.
        """
        n = len(symbol)
        sym, word = np.append(symbol, -1), np.append(word, -1)
        after, before, alive = np.append(np.arange(1, n + 1), n), np.arange(-1, n), np.ones(n + 1, bool)
        before[0] = n
        pair = np.append(self._pairs(symbol, word[:-1]), -1)
        ranks: list[int] = []
        queues: dict[int, list[np.ndarray]] = {}
        single: dict[int, list[int]] = {}  # of ranks that go one at a time: places as a heap

        def push(places: np.ndarray) -> None:
            places = places[pair[places] >= 0]
            rank = self.rank[pair[places]]
            order = np.argsort(rank, kind="stable")
            cuts = np.flatnonzero(np.diff(rank[order])) + 1
            for own in np.split(places[order], cuts) if len(places) else ():
                r = int(self.rank[pair[own[0]]])
                if r not in queues and r not in single:
                    heappush(ranks, r)
                if self.single[pair[own]].any() or r in single:
                    heap = single.setdefault(r, [])
                    for x in (*own.tolist(), *(y for q in queues.pop(r, ()) for y in q.tolist())):
                        heappush(heap, x)
                else:
                    queues.setdefault(r, []).append(own)

        push(np.arange(n))
        while ranks:
            r = heappop(ranks)
            if r in single:
                heap = single[r]
                x = heappop(heap)
                if heap:
                    heappush(ranks, r)
                else:
                    del single[r]
                hit = np.array([x])
            else:
                hit = np.unique(np.concatenate(queues.pop(r)))
            hit = hit[alive[hit] & (pair[hit] >= 0)]
            hit = hit[self.rank[pair[hit]] == r]
            if not len(hit):
                continue
            run = np.r_[True, after[hit[:-1]] != hit[1:]]
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            gone = after[hit]
            sym[hit], alive[gone] = pair[hit], False
            after[hit] = after[gone]
            before[after[hit]] = hit
            changed = np.unique(np.concatenate([hit, before[hit]]))
            changed = changed[changed < n]
            follower = after[changed]
            fresh = self._merged(sym[changed], sym[follower])
            fresh[word[changed] != word[follower]] = -1
            pair[changed] = fresh
            push(changed)
        kept = np.flatnonzero(alive[:n])
        return kept, sym[kept]

    def _pairs(self, symbol: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(symbol), -1, np.int32)
        if len(symbol) > 1:
            out[:-1] = np.where(word[1:] == word[:-1], self._merged(symbol[:-1], symbol[1:]), -1)
        return out

    def _from_left(self, hit: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Of overlapping hits every second from the left; of the pieces that go one at a time, a word's first."""
        run = np.r_[True, hit[1:] != hit[:-1] + 1]
        first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        single = self.single[pair[hit]]
        if single.any():
            lead = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            alone = np.maximum.reduceat(single, np.flatnonzero(lead))  # words with any such piece
            hit = hit[lead | ~np.repeat(alone, np.diff(np.r_[np.flatnonzero(lead), len(hit)]))]
        return hit

    def _with_bytes(self, symbol: np.ndarray, word: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        missing = np.flatnonzero(symbol < 0)
        if not len(missing):
            return symbol.astype(np.int32), np.bincount(word, minlength=n)
        chars = [chr(c).encode() for c in code[missing].tolist()]
        width = np.ones(len(symbol), np.int64)
        width[missing] = [len(c) for c in chars]
        out = np.repeat(symbol, width)
        out[np.repeat(symbol < 0, width)] = self.byte_id[np.frombuffer(b"".join(chars), np.uint8)]
        return out.astype(np.int32), np.bincount(np.repeat(word, width), minlength=n)

    def segments(self, text: str) -> list[str]:
        """What merges never cross: a run of space marks with the characters up to the next space, and newlines alone."""
        if not text:
            return []
        out: list[str] = []
        marks = MARK
        for chunk in text.replace(MARK, " ").split(" "):
            if not chunk:
                marks += MARK
                continue
            if self.cuts_newline and "\n" in chunk:
                parts = chunk.split("\n")
                out.append(marks + parts[0])
                for p in parts[1:]:
                    out.append("\n")
                    if p:
                        out.append(p)
            else:
                out.append(marks + chunk)
            marks = MARK
        if len(marks) > 1:
            out.append(marks[1:])
        return out

    def encode_batch(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text."""
        own = [self.segments(t) for t in batch]
        flat, counts = self.ids([s for x in own for s in x])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library gives it: without the dummy prefix; bytes that make no character become U+FFFD each."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def load(path: str) -> PieceModel:
    return PieceModel(path)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, without begin and end ids.

    Null and empty texts have no ids; every row gives one row; null ids of documents stay null; other
    columns are ignored. Only distinct segments are merged, whatever the length of a text.
    """

    def run(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
        flat, counts = load(path).encode_batch(texts(batch.column(1)))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(run, path=model_path), "doc_id long, ids array<int>")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, text``: the text of each row's ids, with their count and digest."""

    def run(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
        model = load(path)
        lists = [x or [] for x in batch.column(1).to_pylist()]
        digests = [hashlib.sha256(",".join(map(model.decimal.__getitem__, x)).encode()).hexdigest() for x in lists]
        columns = [batch.column(0), pa.array([len(x) for x in lists], pa.int64()), pa.array(digests), pa.array(map(model.decode, lists), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "text"])

    return map_arrow(rows.select("doc_id", "ids"), partial(run, path=model_path), "doc_id long, n_tokens long, ids_sha256 string, text string")
