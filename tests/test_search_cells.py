"""Concept search and full ranking in cells: same rows as the joined forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptsearch.operators import search
from conceptsearch.operators.index import build_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((repr(r["qid"]), repr(r["docid"]), r["rank"], None if r["score"] is None else round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def concept(spark):
    rng = np.random.default_rng(5)
    docs = [(f"d{i % 70}" if i != 3 else None, sorted(int(x) for x in rng.choice(12, 4, replace=False)),
             [float(w) for w in rng.uniform(0.1, 1, 4)]) for i in range(90)] + [("empty", [], [])]
    # dl / avgdl gives the last document a zero denominator: a null score
    codes = spark.createDataFrame(docs, "docid string, ids array<long>, weight array<double>")
    latents = [(q % 25 if q != 7 else None, int(t), float(w)) for q in range(30)
               for t, w in zip(rng.choice(14, 3, replace=False), rng.uniform(0.1, 1, 3))]
    return build_index(codes, 24), spark.createDataFrame(latents + [(2, None, 0.5)], "qid int, latent long, weight double")


@pytest.mark.parametrize("k", [5, None])
@pytest.mark.parametrize("postings", [1000, 100])    # one chunk, several
def test_cells_give_the_joined_rows(concept, monkeypatch, k, postings):
    index, q = concept
    want = rows(search.sparse_search(index, q, k))
    monkeypatch.setattr(search, "MAX_JOINED_QUERIES", 3)
    monkeypatch.setattr(search, "CELL_POSTINGS", postings)
    monkeypatch.setattr(search, "CELL_OUTPUT_ROWS", 7)
    found = search.sparse_search(index, q, k)
    assert "partial_sum" not in plan(found).split("MapInArrow")[0]
    assert rows(found) == want and len(want) > 100


def test_no_pair_is_shuffled(concept, monkeypatch):
    index, q = concept
    monkeypatch.setattr(search, "MAX_JOINED_QUERIES", 3)
    before = plan(search.sparse_search(index, q, 5)).split("MapInArrow")[0]
    assert "Exchange" not in before and "Window" not in before


def test_null_scores_come_last_in_cells(spark, monkeypatch):
    docs = [(1, [1], [0.3]), (2, [2, 3, 4, 5, 6, 7, 8], [0.5] * 7)]     # document 1: a zero denominator
    codes = spark.createDataFrame(docs, "docid long, ids array<long>, weight array<double>")
    q = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0)], "qid long, latent long, weight double")
    monkeypatch.setattr(search, "MAX_JOINED_QUERIES", 0)
    got = search.sparse_search(build_index(codes, 24), q, 10).orderBy("rank").collect()
    assert [(r["docid"], r["rank"]) for r in got] == [(2, 1), (1, 2)] and got[1]["score"] is None


@pytest.mark.parametrize("at_once", [1, 3, 1000])
def test_every_rank_without_a_shuffle_of_pairs(spark, monkeypatch, at_once):
    rng = np.random.default_rng(8)
    vec = lambda ids: [(int(i), [float(x) for x in rng.integers(-2, 3, 4)]) for i in ids]
    q = spark.createDataFrame(vec([5, 1, 2, 5, 9, 5, 7]), "qid long, v array<double>")
    p = spark.createDataFrame(vec([*range(40), 3, 3, 8]), "pid long, v array<double>").repartition(3)
    monkeypatch.setattr(search, "DENSE_SCORE_CHUNK_BYTES", 32 * 43 * at_once)
    got = search.dense_search(q, p, None)
    assert "Window" not in plan(got) and "Exchange" not in plan(got).split("MapInArrow")[0]
    monkeypatch.setattr(search, "RANK_PASSAGE_BYTES", 0)
    want = search.dense_search(q, p, None)
    row = lambda r: tuple(r[c] for c in ("qid", "pid", "rank", "score"))
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
    assert got.filter(F.col("qid") == 5).agg(F.max("rank")).first()[0] == 3 * 43


def test_a_grid_cell_holds_a_bounded_chunk_of_passages(spark, monkeypatch):
    monkeypatch.setattr(search, "DENSE_QUERY_BLOCK_BYTES", 4 * 8192)
    monkeypatch.setattr(search, "DENSE_PASSAGE_CHUNK_BYTES", 8 * 2 * 10)
    rng = np.random.default_rng(2)
    vec = lambda n, name: spark.createDataFrame([(i, [float(x) for x in rng.normal(size=2)]) for i in range(n)], f"{name} long, v array<double>")
    q, p, grids, grid = vec(20, "qid"), vec(35, "pid"), [], search.dense_grid
    monkeypatch.setattr(search, "dense_grid", lambda *a: grids.append(a[3:]) or grid(*a))
    assert search.dense_search(q, p, 3).count() == 60 and grids == [(1, 4)]
