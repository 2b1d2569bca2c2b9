"""Python tasks hold a small part of a batch at a time, whatever Spark's batches are."""

import pyarrow as pa
import pytest

from weftline.functions import batches, hooks
from weftline.operators import chunking

TEXTS = ["", None, "a" * 10, "b" * 300, "c", "é" * 60, *["d e"] * 700]


def test_parts_keep_order_rows_and_bounds(monkeypatch):
    monkeypatch.setattr(batches, "BYTES", 128)
    column = pa.array(["x", *TEXTS])[1:]  # a slice
    found = list(batches.small_parts(column, column))
    assert [t for part in found for t in part.to_pylist()] == TEXTS
    sizes = [sum(len((t or "").encode()) for t in part.to_pylist()) for part in found]
    assert all(n <= 128 or len(part) == 1 for n, part in zip(sizes, found, strict=True))
    assert max(map(len, found)) <= batches.ROWS
    assert list(batches.small_parts(column[:0], column[:0])) == []


def test_a_token_function_sees_few_texts_at_a_time(spark, tmp_path):
    """Before, it saw all 2000 texts of a batch at once."""
    def count(texts):
        return texts.str.len() * 0 + len(texts)

    df = spark.range(2000, numPartitions=1).selectExpr("if(id % 50 = 0, null, 'a b') as text")
    seen = {r[0] for r in df.select(hooks.tokens(count)("text")).collect()}
    assert 0 in seen and max(seen) <= batches.ROWS


@pytest.mark.parametrize("texts", [TEXTS[:5], ["# a\n\nx y. z\n\n- b\n"] * 3])
def test_blocks_and_chunks_of_parts_are_those_of_each_text(spark, texts):
    df = spark.createDataFrame([(i, None if i == 1 else i, t) for i, t in enumerate(texts)], "post_id int, version int, content string").coalesce(1)
    got = [(r["post_id"], r["version"], r["block_idx"], r["text"], r["path"]) for r in chunking.markdown_blocks(df).collect()]
    assert got == [(i, None if i == 1 else i, b["block_idx"], b["text"], b["path"]) for i, t in enumerate(texts) for b in chunking.scan(t or "")]
    chunks = [(r["post_id"], r["chunk_idx"], r["text"], r["token_count"]) for r in chunking.assemble_chunks(df).collect()]
    assert chunks == [(i, n, c["text"], c["tokens"]) for i, t in enumerate(texts) for n, c in enumerate(chunking.assemble(chunking.scan(t or "")))]
