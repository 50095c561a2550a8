"""Physical-plan properties the operators rely on at scale."""

import uuid

import numpy as np
from pyspark.sql import functions as F

from conceptsearch.operators import sae, text
from conceptsearch.operators.index import truncate_latents
from conceptsearch.operators.search import rank_unbounded, sparse_search
from conceptsearch.plans.fixtures import Fixture
from conceptsearch.session import scratch_path
from conceptsearch.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_concept_search_prunes_postings_and_limits_before_shuffle(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    path = scratch_path(spark, f"tests/plan-index-{uuid.uuid4().hex}")
    sinks.save_index(fx.index(), path)
    p = plan(sparse_search(sinks.load_index(spark, path), fx.query_latents(), 1000))
    postings_scan = [line for line in p.split("\n") if "FileScan parquet [latent" in line and "docid" in line]
    assert postings_scan and "INSET" in postings_scan[0]
    assert "WindowGroupLimit" in p and "Partial" in p
    assert "partial_sum" in p


def test_encode_and_truncate_do_not_shuffle(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in plan(sae.encode_threshold(fx.passages(), fx.model, 0.2, "docid"))
    codes = spark.createDataFrame([(1, [1, 2], [0.5, 0.7])], "docid long, ids array<long>, weight array<double>")
    assert "Exchange" not in plan(truncate_latents(codes, 1))


def test_masking_large_input_does_not_shuffle(spark):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(0, 1000, 1, numPartitions=cores).select(
        F.col("id").alias("doc_id"), F.lit("a b ##c d").alias("text"))
    out = text.mask_tokens(text.whole_word_mask(text.token_arrays(docs), 0.15), 42)
    assert "Exchange" not in plan(out)


def test_unbounded_rank_has_no_window(spark):
    rng = np.random.default_rng(0)
    rows = [(int(q), int(p), float(rng.normal())) for q in range(3) for p in range(30)]
    df = spark.createDataFrame(rows, "qid long, pid long, score double")
    out = rank_unbounded(df)
    assert "Window" not in plan(out)
    got = {(r["qid"], r["pid"]): r["rank"] for r in out.collect()}
    for q in range(3):
        order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        assert [got[(q, r[1])] for r in order] == list(range(1, 31))


def test_corpus_is_filtered_by_broadcast_semi_join(spark):
    fx = Fixture(spark, "/root/testdata/sf0.001")
    pairs = spark.createDataFrame([("q", "1"), ("q", "5")], "query_id string, doc_id string")
    p = plan(text.join_corpus(pairs, fx.corpus(), "left"))
    assert "LeftSemi" in p and "BroadcastHashJoin" in p
