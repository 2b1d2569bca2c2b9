"""Segment-wise tokenizing: what a tokenizer never merges across is cut first, and each distinct segment is encoded once."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from itertools import compress

import numpy as np

#: The split pattern of byte-level vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's White_Space characters.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Coarser than BYTE_PATTERN: its matches never reach across these.
_SEGMENT = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")


class SegmentIds:
    """Ids of segments, kept for those seen before: of at most ``chars`` characters together, and none longer than ``longest``.

    ``encode`` gives (flat ids, number of ids per segment, place of the first).
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], chars: int = 4_000_000, longest: int = 64):
        self.encode, self.limit, self.longest = encode, chars, longest
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.used = self.chars = 0

    def _add(self, new: list[str]) -> None:
        ids, counts, first = self.encode(new)
        n, m = len(self.place), self.used
        while m + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(new) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[m : m + len(ids)] = ids
        self.count[n : n + len(new)] = counts
        self.first[n : n + len(new)] = m + first
        self.used = m + len(ids)
        self.place.update(zip(new, range(n, n + len(new)), strict=True))

    def __call__(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of ``segments`` in order, and the number of ids of each."""
        if self.chars > self.limit:
            self.clear()
        new = [s for s in dict.fromkeys(segments) if s not in self.place]
        short, long = [s for s in new if len(s) <= self.longest], [s for s in new if len(s) > self.longest]
        if short:
            self._add(short)
            self.chars += sum(map(len, short))
        used = self.used
        if long:
            self._add(long)
        at = np.fromiter(map(self.place.__getitem__, segments), np.int64, len(segments))
        counts = self.count[at]
        starts = np.cumsum(counts) - counts
        index = np.arange(int(counts.sum())) + np.repeat(self.first[at] - starts, counts)
        found = self.flat[index]
        for s in long:
            del self.place[s]
        self.used = used
        if len(self.flat) > 1 << 24:  # a batch of very long segments
            self.flat = self.flat[: max(1 << 16, used)].copy()
        return found, counts


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizers file, which the library finds in any text, with their ids."""
    with open(json_path, encoding="utf-8") as f:
        found = json.load(f)["added_tokens"]
    if any(t[k] for t in found for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{json_path} has added tokens that are matched by other rules than their text")
    return {t["content"]: t["id"] for t in found}


class ByteTokens:
    """Byte-level BPE ids of whole texts, equal to those of the tokenizers library.

    Strings of ``added`` have the ids given; without it special strings are ordinary text.
    """

    def __init__(self, ranks_path: str, added: dict[str, int] | None = None):
        import tiktoken

        self.added = added or {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        self.ids = SegmentIds(self._encode)

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Segments that begin with a space can follow one another in a text: they are encoded in one call.
        follow = [s[0] == " " and len(s) > 1 and s[1] not in " \t\n\r" and s not in self.added for s in segments]
        spaced, others = np.flatnonzero(follow), np.flatnonzero(~np.array(follow, bool))
        counts, first = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        text = "".join(compress(segments, follow))
        joined = np.array(self.core.encode_ordinary(text), np.int32)
        if len(spaced):
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
            ends = width[np.cumsum(np.fromiter(map(len, compress(segments, follow)), np.int64, len(spaced))) - 1]
            stop = np.searchsorted(np.cumsum(self.width[joined]), ends) + 1
            first[spaced] = np.concatenate([[0], stop[:-1]])
            counts[spaced] = stop - first[spaced]
        parts = [[self.added[s]] if s in self.added else self.core.encode_ordinary(s) for s in (segments[i] for i in others.tolist())]
        counts[others] = [len(x) for x in parts]
        first[others] = len(joined) + np.cumsum(counts[others]) - counts[others]
        return np.concatenate([joined, np.array([i for x in parts for i in x], np.int32)]), counts, first

    def _segments(self, text: str) -> list[str]:
        parts = self.cut.split(text) if self.cut else [text]
        if len(parts) == 1:
            return _SEGMENT.findall(text)
        # Every second part is an added token.
        return [s for k, part in enumerate(parts) for s in ([part] if k % 2 else _SEGMENT.findall(part))]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and the number of ids of each text."""
        segments = [self._segments(t) for t in texts]
        flat, counts = self.ids([s for own in segments for s in own])
        ends = np.concatenate([[0], np.cumsum(counts)])
        lengths = np.array([len(s) for s in segments])
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)])]
        return flat, np.diff(bounds)
