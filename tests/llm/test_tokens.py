"""The cache of segment ids."""

import numpy as np

from weftline.llm.tokens import SegmentIds


def letters(segments):
    counts = np.array([len(s) for s in segments], np.int64)
    return np.array([ord(c) for s in segments for c in s], np.int32), counts, np.cumsum(counts) - counts


def test_kept_segments_are_bounded_by_characters():
    ids = SegmentIds(letters, chars=100, longest=10)
    for k in range(200):
        own = [f"w{k}", "same", "x" * (11 + k % 3) * (1 + 1000 * (k % 7 == 0)), f"w{k}", "é" * 11]
        flat, counts = ids(own)
        assert "".join(map(chr, flat)) == "".join(own) and counts.tolist() == list(map(len, own))
        assert ids.chars <= 100 + 20 and max(map(len, ids.place)) <= 10
    assert ids.used <= 150
