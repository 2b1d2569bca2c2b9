"""Search by words: equal questions are ranked once."""

from weftline.operators import retrieval


def test_equal_questions_are_scored_once(spark, monkeypatch):
    """Before, every query was scored against every chunk of its version, whatever others had asked."""
    ranked = []
    real = retrieval.topk_per_group
    monkeypatch.setattr(retrieval, "topk_per_group", lambda df, *a: ranked.append(df) or real(df, *a))
    chunks = spark.range(40).selectExpr("concat('c', id) as chunk_id", "id % 2 as post_id", "1 as version", "if(id % 4 < 2, 'one two two', 'Two three') as content")
    asked = spark.range(50).selectExpr("id as query_id", "id % 2 as post_id", "1 as version", "if(id % 10 < 5, array('two', 'one'), array('one', 'two', 'two')) as keywords")
    other = spark.createDataFrame([(90, 0, 1, ["three"]), (91, 0, 1, ["none"])], "query_id long, post_id long, version int, keywords array<string>")
    found = retrieval.bm25_topk(asked.unionByName(other), chunks, 5).collect()
    assert ranked[0].count() == 2 * 20 + 10
    assert len(found) == 50 * 5 + 5
    assert len({(r["query_id"] % 2, r["chunk_id"], r["score"], r["rank"]) for r in found if r["query_id"] < 50}) == 10
