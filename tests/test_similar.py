"""Tests of approximate search against exact search."""

import numpy as np

from __spark_entry__ import queries
from weftline.operators import retrieval, similar


def recall(found, exact):
    """The share of exact hits that were found, and whether what was found is scored as there."""
    scores = {(r["query_id"], r["chunk_id"]): r["score"] for r in found.collect()}
    want = {(r["query_id"], r["chunk_id"]): r["score"] for r in exact.collect()}
    return len(scores.keys() & want.keys()) / len(want), all(scores[p] == want[p] for p in scores.keys() & want.keys())


def test_near_vectors_are_found_and_few_others_read(spark):
    """Groups of near vectors, a hot group of equal ones, vectors without direction, of another size, and filters."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 32))
    rows = [(f"c{i}", (centres[i % 60] + 0.15 * rng.standard_normal(32)).tolist(), i % 2, 1) for i in range(3000)]
    rows += [(f"h{i:04}", centres[0].tolist(), 0, 1) for i in range(900)]
    odd = [("n0", None, 0, 1), ("n1", [], 0, 1), ("n2", [0.0] * 32, 0, 1), ("n3", [float("nan")] * 32, 0, 1), ("n4", [None] * 32, 0, 1), ("n5", [1.0] * 5, 0, 1)]
    chunks = spark.createDataFrame(rows + odd, "chunk_id string, embedding array<double>, post_id int, version int").repartition(8)
    asked = spark.createDataFrame([(i, rows[i][1], rows[i][2], 1) for i in range(0, 3000, 50)] + [(-1, None, 0, 1)], "query_id int, embedding array<double>, post_id int, version int")
    found = similar.approximate_topk(asked, chunks, k=20, flips=1)
    whole = chunks.where("chunk_id not like 'n%'")
    share, same = recall(found, retrieval.vector_topk(asked.where("query_id >= 0"), whole, k=20))
    assert share >= 0.97 and same
    assert found.count() == found.select("query_id", "chunk_id").distinct().count() == 60 * 20
    everything = similar.approximate_topk(asked, whole, k=10**6, filters=(), flips=1)
    assert 60 * 50 <= everything.count() <= 0.35 * 60 * whole.count()
    assert everything.count() == everything.select("query_id", "chunk_id").distinct().count()
    assert everything.where("query_id = 0 and score > 0.9").count() >= 900
    assert similar.approximate_topk(asked.where("false"), chunks).count() == similar.approximate_topk(asked, chunks.where("false")).count() == 0


def test_all_bits_flipped_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(f"c{i}", rng.standard_normal(6).tolist(), 0, 0) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, post_id int, version int")
    asked = chunks.limit(9).selectExpr("cast(substr(chunk_id, 2) as int) as query_id", "embedding", "post_id", "version")
    got = similar.approximate_topk(asked, chunks, k=30, tables=2, bits=3, flips=3)
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect())
    assert key(got) == key(retrieval.vector_topk(asked, chunks, k=30))


def test_recall_of_the_query(spark, sf):
    """The given vectors have hardly any near neighbours, which is the hardest case for hash tables."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "concat(cast(label + 1 as string), '#', cast(vec_id as string)) as chunk_id", "embedding", "1 as post_id", "1 as version")
    exact = retrieval.vector_topk(vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), vectors)
    share, same = recall(queries()["ret1_approximate_topk"](spark, sf), exact)
    assert same and share >= 0.9


def test_no_pairs_but_the_best_are_shuffled(spark, monkeypatch):
    """Before, every pair of a query and a chunk that shared a bucket came to the ranking. The best are those of all pairs that meet, pair by pair."""
    rng, ranked = np.random.default_rng(5), []
    real = similar.topk_per_group
    monkeypatch.setattr(similar, "topk_per_group", lambda df, *a: ranked.append(df) or real(df, *a))
    rows = [(f"c{i:03}", rng.standard_normal(8).tolist(), 0, 0) for i in range(700)]
    chunks = spark.createDataFrame(rows, "chunk_id string, embedding array<double>, post_id int, version int")
    asked = chunks.limit(30).selectExpr("cast(substr(chunk_id, 2) as int) as query_id", "embedding", "post_id", "version")
    for flips in (1, 3):  # few and most of the nearest pairs meet
        got = similar.approximate_topk(asked, chunks, k=20, tables=2, bits=8, flips=flips)
        assert ranked[-1].count() <= 30 * 20
        sketches = {r["chunk_id"]: r["s"] for r in chunks.select("chunk_id", similar.sketch(chunks["embedding"], 2, 8).alias("s")).collect()}
        near = lambda a, b: any(((sketches[a] ^ sketches[b]) >> 8 * t & 255).bit_count() <= flips for t in range(2))
        unit = {c: np.array(v) / np.linalg.norm(v) for c, v, _, _ in rows}
        want = {i: sorted(((-round(float(unit[f"c{i:03}"] @ unit[c]), 6), c) for c in unit if near(f"c{i:03}", c)))[:20] for i in range(30)}
        found = got.collect()
        assert sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in found) == sorted((i, n + 1, c, round(-x, 5)) for i, hits in want.items() for n, (x, c) in enumerate(hits))
