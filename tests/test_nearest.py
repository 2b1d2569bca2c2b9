"""Nearest vectors in tiles, against all pairs scored one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import nearest, retrieval

ROWS = "chunk_id string, post_id long, version int, embedding array<float>"


def _pairs(rows, filters, k):
    """Each query's k best by plain sums, as Spark's expressions had them."""
    found = {}
    for qid, *q, x in [(r[0], r[1], r[2], r[3]) for r in rows if int(r[0]) % 3 == 0]:
        hits = []
        for cid, p, v, y in rows:
            if filters and [p, v] != q:
                continue
            usable = x is not None and y is not None and len(x) == len(y) and None not in x and None not in y and any(x) and any(y)
            dot = lambda a, b: sum(float(np.float32(i)) * float(np.float32(j)) for i, j in zip(a, b, strict=True))
            hits.append((round(dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5, 6) if usable else None, cid))
        hits.sort(key=lambda h: (h[0] is None, -(h[0] or 0), h[1]))
        found[qid] = [(c, s) for s, c in hits[:k]]
    return found


@pytest.mark.parametrize("filters", [("post_id", "version"), ()])
def test_tiles_give_the_same_as_all_pairs(spark, monkeypatch, filters):
    monkeypatch.setattr(nearest, "GROUP", 7)
    monkeypatch.setattr(nearest, "SHARD", 11)
    rng = np.random.default_rng(3)
    rows = [(f"{i:03}", i % 2, i % 3, [float(x) for x in rng.integers(-3, 4, 5)]) for i in range(150)]
    for i in range(20, 60):  # copies, so that ties go by id
        rows[i] = (*rows[i][:3], [1.0, 2.0, 0.0, 0.0, 1.0])
    rows[3], rows[6], rows[9], rows[12] = (*rows[3][:3], None), (*rows[6][:3], [1.0, None, 2.0, 0.0, 0.0]), (*rows[9][:3], [1.0, 2.0]), (*rows[12][:3], [0.0] * 5)
    df = spark.createDataFrame(rows, ROWS)
    asked = df.where("cast(chunk_id as int) % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    got = {}
    for r in sorted(retrieval.vector_topk(asked, df, 4, filters).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    assert got == _pairs(rows, filters, 4)


def test_scores_round_as_in_spark(spark):
    scores = np.array([0.1234565, -0.1234565, 0.0000005, 0.1234564999, 1.0, -0.9999995])
    df = spark.createDataFrame([(float(x),) for x in scores], "x double")
    assert [round(r[0] * 1e6) for r in df.select(F.round("x", 6)).collect()] == nearest.rounded(scores).tolist()


def test_a_memory_without_cosine_counts_as_nothing_alike(spark):
    cands = spark.createDataFrame([(1, 1, "a", [1.0, 0.0]), (1, 2, "b", [1.0, 0.0]), (1, 3, "c", [1.0, 0.0])], "user_id long, seq long, memory_key string, embedding array<float>")
    docs = spark.createDataFrame(
        [(7, 1, "a", "ACTIVE", 1, [-1.0, 0.0]), (8, 1, "a", "ACTIVE", 1, None), (5, 1, "b", "ACTIVE", 2, [2.0, 0.0]), (4, 1, "b", "ACTIVE", 3, [3.0, 0.0])],
        "doc_id long, user_id long, memory_key string, status string, version int, embedding array<float>",
    )
    found = {r["seq"]: (r["doc_id"], r["version"], r["score"]) for r in retrieval.nearest_memory(cands, docs).collect()}
    assert found == {1: (8, 1, 0.0), 2: (4, 3, 1.0), 3: (None, None, 0.0)}


def test_no_pairs_but_the_best_are_shuffled(spark, monkeypatch):
    """Before, every pair of a query and a chunk of its version came to the ranking."""
    ranked = []
    real = retrieval.topk_per_group
    monkeypatch.setattr(retrieval, "topk_per_group", lambda df, *a: ranked.append(df) or real(df, *a))
    df = spark.range(600).selectExpr("id as query_id", "concat('c', id) as chunk_id", "1L as post_id", "1 as version", "array(cast(id % 7 as float), 1f) as embedding")
    retrieval.vector_topk(df.where("query_id < 20"), df, 3)
    assert ranked[0].count() == 20 * 3
