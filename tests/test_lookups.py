"""Lookups of vectors and query texts by text ids."""

import pytest

from conceptsearch.operators import embed, text


@pytest.mark.parametrize("limit", [0, 128 << 20])
def test_query_texts(spark, limit):
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("9", "c"), ("x", "d")], "query_id string, doc_id string")
    queries = spark.createDataFrame([(1, "one"), (2, "two"), (9, None)], "qid long, query string")
    out = text.join_query_text(pairs, queries, limit)
    assert sorted((r["query_id"], r["doc_id"], r["query"]) for r in out.collect()) == \
        [("1", "a", "one"), ("1", "b", "one"), ("9", "c", None), ("x", "d", None)]


def test_pair_scores_join_on_the_vectors_own_key(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    d = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0, 0.0])], "id string, v array<double>")
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("01", "a"), ("x", "a"), ("1", "zz"), (None, "a")],
                                  "query_id string, doc_id string")
    out = embed.pair_score(pairs, q, d)
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in out.collect()) == [("1", "a", 3.0), ("1", "b", 2.0), ("2", "b", 0.0)]
