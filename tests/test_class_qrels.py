"""Judgements by class give what their pairs give, to the last duplicate."""

import pytest
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import dot
from conceptsearch.operators import metrics, search
from conceptsearch.operators.judgements import ClassQrels
from conceptsearch.plans.catalog import QUERIES
from conceptsearch.plans.fixtures import Fixture


@pytest.fixture(scope="module")
def parts(spark):
    topics = [(1, 0), (2, 1), (2, 2), (3, 0), (3, 0), (4, 9), (5, None), (6, 1)]      # 4: a label of no document
    members = [(p, p % 3, 1 + p % 4) for p in range(24)] + [(7, 1, 2), (7, 2, 1), (30, None, 3), (None, 0, 2)]
    run = [(q, p, r, 1.0 / r) for q in (1, 2, 3, 4, 5, 8) for r, p in enumerate((7, 30, 1, 6, 11, 4, 40, 15), 1)]
    return (spark.createDataFrame(run, "qid long, pid long, rank long, score double"),
            ClassQrels(spark.createDataFrame(topics, "qid long, label int"),
                       spark.createDataFrame(members, "pid long, label int, rel int")))


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("measure", [
    lambda run, q: metrics.per_query_metrics(run, q, (2, 5)), lambda run, q: metrics.per_query_metrics(run, q, (5,), "left"),
    lambda run, q: metrics.mrr_trec(run, q, 5), lambda run, q: metrics.mrr_msmarco(run, q, 5),
    lambda run, q: metrics.rel_threshold(q), lambda run, q: metrics.run_counts(run, q),
    lambda run, q: metrics.evaluated_queries(run, q), lambda run, q: metrics.evaluated_queries(run, q, "left")])
def test_measures(parts, measure):
    run, qrels = parts
    assert rows(measure(run, qrels)) == rows(measure(run, qrels.pairs())) != []


def test_every_passage_of_a_label_is_judged(spark, tmp_path):
    """Beyond the size at which judgements were dealt into pools."""
    spark.range(4000).selectExpr("id AS vec_id", "array(double(id % 7), 1.0) AS embedding", "int(id % 10) AS label") \
         .write.parquet(str(tmp_path / "embeddings.parquet"))
    fx = Fixture(spark, str(tmp_path))
    n = dict(rows(metrics.run_counts(fx.queries().selectExpr("qid", "qid AS pid"), fx.qrels_by_label())))
    queries, passages = [i % 10 for i in range(0, 4000, 25)], [i % 10 for i in range(4000) if i % 25]
    assert n["judgements"] == sum(passages.count(x) for x in [*queries, 0]) == fx.qrels_by_label().pairs().count()
    assert fx.qrels_graded().count() < n["judgements"]


def test_inner_products_by_blocks(spark, monkeypatch):
    """What ``dot`` gives for the joined pairs, also for odd vectors, without a row a pair before the score."""
    vec = [[1.0, 2.0], [0.5, -3.0], [float("nan"), 1.0], [1.0, None], None, [], [4.0], [-0.25, 1e6]]
    topics = [(q, q % 3, vec[q % 8]) for q in range(17)] + [(3, 0, vec[0]), (3, 0, vec[1]), (None, 1, vec[0]), (50, None, vec[0]), (51, 9, vec[0])]
    members = [(f"d{p}", p % 3, vec[p % 8]) for p in range(40)] + [("d7", 1, vec[1]), (None, 2, vec[7]), ("x", None, vec[0])]
    monkeypatch.setattr(search, "DENSE_PASSAGE_CHUNK_BYTES", 100)
    monkeypatch.setattr(search, "CELL_OUTPUT_ROWS", 7)
    t = spark.createDataFrame(topics, "qid int, label int, v array<float>")
    m = spark.createDataFrame(members, "pid string, label int, w array<float>").withColumn("rel", F.lit(1)).repartition(3)
    got = ClassQrels(t, m).dots("v", "w", parts=3)
    double = lambda c: F.col(c).cast("array<double>")
    want = ClassQrels(t, m).pairs("v", "w").select("qid", "pid", dot(double("v"), double("w")).alias("score"))
    assert got.schema["qid"].dataType == want.schema["qid"].dataType and len(rows(want)) > 250
    same = lambda df: sorted((str(r) for r in rows(df)))
    assert same(got) == same(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_dot_product_pairs_no_rows(spark, tmp_path):
    spark.range(400).selectExpr("id AS vec_id", "array(float(id % 7), float(1.5)) AS embedding", "int(id % 10) AS label") \
         .write.parquet(str(tmp_path / "embeddings.parquet"))
    df = QUERIES["dot_product"](spark, str(tmp_path))
    got = {(r["qid"], r["pid"]): r["score"] for r in df.collect()}
    assert got == {(q, p): (q % 7) * (p % 7) + 2.25 for q in range(0, 400, 25) for p in range(400) if p % 25 and (p - q) % 10 == 0}
    assert "_part" not in df._jdf.queryExecution().analyzed().toString()
