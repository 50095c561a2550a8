"""Text readers on hand-written files, and the driver contract."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conceptsearch.session import scratch_path
from conceptsearch.plans.catalog import QUERIES
from conceptsearch.sources import sinks, text_formats as tf

ROWS_ONLY = {"sae_fit"}


def write_text(spark, name, lines):
    path = scratch_path(spark, f"tests/{name}-{os.getpid()}")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "line_no long, value string")
    sinks.write_lines(df, path, ["line_no"])
    return path


def test_queries_last_duplicate_wins(spark):
    path = write_text(spark, "queries", ["1\tfirst", "2\tother", "1\tsecond  "])
    got = {r["qid"]: r["query"] for r in tf.scan_queries(spark, path).collect()}
    assert got == {"1": "second", "2": "other"}


def test_qrels_tab_and_blank_forms(spark):
    p1 = write_text(spark, "qrels-tab", ["q1\t0\td1\t1", "q1\t0\td2\t3", "q1\t0\td1\t2"])
    p2 = write_text(spark, "qrels-ws", ["q1 0  d1 1", "  q2\t0 d9   2 "])
    got1 = {(r["qid"], r["pid"]): r["rel"] for r in tf.scan_qrels(spark, p1).collect()}
    got2 = {(r["qid"], r["pid"]): r["rel"] for r in tf.scan_qrels(spark, p2, whitespace=True).collect()}
    assert got1 == {("q1", "d1"): 2, ("q1", "d2"): 3}
    assert got2 == {("q1", "d1"): 1, ("q2", "d9"): 2}


def test_run_readers(spark):
    path = write_text(spark, "run", ["q\td1\t1\t2.5", "q\td2\t2", "q\td3\t3\t0.5\textra"])
    lenient = {r["pid"]: r["score"] for r in tf.scan_run_lenient(spark, path).collect()}
    strict = {r["pid"]: r["score"] for r in tf.scan_run_strict(spark, path).collect()}
    assert lenient == {"d1": 2.5, "d2": 0.5, "d3": 0.5}
    assert strict == {"d1": 2.5}


def test_qa_first_question_wins(spark):
    path = write_text(spark, "qa", ['"what ""is"" x"\t["a", "b"]', "what \"is\" x\t['later']",
                                    "other\t['c']"])
    got = {r["qid"]: list(r["answers"]) for r in tf.scan_qa_queries(spark, path).collect()}
    assert got == {'what "is" x': ["a", "b"], "other": ["c"]}


def test_run_sink_three_decimals(spark):
    run = spark.createDataFrame([("q", "d", 1, 1.23456), ("q", "e", 2, 0.0625)],
                                "qid string, pid string, rank int, score double")
    path = scratch_path(spark, f"tests/sink-run-{os.getpid()}")
    sinks.write_run(run, path, "trec3")
    lines = sorted(r[0] for r in spark.read.text(path).collect())
    # exact binary half 0.0625 goes to even, as Python's "%.3f" does
    assert lines == ["q\td\t1\t1.235", "q\te\t2\t0.062"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "docid", "rank", "score"]
    assert df.count() > 0


def test_every_query_has_an_oracle_or_is_rows_only():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(q) and set(QUERIES) - set(o) == ROWS_ONLY


@pytest.mark.parametrize("name", ["sparse_topk", "ndcg_at_k", "index_stats"])
def test_sf0001_oracle_agreement(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    exp = sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r)
                 for r in con.sql(entry.oracle_sql()[name]).fetchall())
    df = entry.queries()[name](spark, sf)
    cols = con.sql(entry.oracle_sql()[name]).columns
    got = sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols)
                 for r in df.collect())
    assert got == exp


def test_vector_shards_numeric_order_beyond_ten(spark):
    from conceptsearch.sources import vectors as vec
    rows = [(i, [float(i), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    path = scratch_path(spark, f"tests/shards-{os.getpid()}")
    vec.write_vector_shards(df, path, worker=3, shard_rows=5)          # 12 shards
    names = sorted(os.listdir(path))
    assert "shard_3_10.parquet" in names and "shard_3_11.parquet" in names
    got = {r["vec_id"]: r["v"][0] for r in vec.scan_vector_shards(spark, path).collect()}
    assert got == {i: float(i) for i in range(60)}
    # a second write to the same folder is skipped (resume)
    vec.write_vector_shards(df.limit(1), path, worker=3, shard_rows=5)
    assert vec.scan_vector_shards(spark, path).count() == 60


def test_run_sink_variants(spark):
    run = spark.createDataFrame([("q", "d", 5, 0.123456), ("q", "e", 9, 0.9), ("q", "f", 7, 0.5)],
                                "qid string, pid string, rank int, score double")
    out = {}
    for variant in ("round4", "full", "rank3"):
        path = scratch_path(spark, f"tests/sink-{variant}-{os.getpid()}")
        sinks.write_run(run, path, variant)
        out[variant] = sorted(r[0] for r in spark.read.text(path).collect())
    assert "q\td\t5\t0.1235" in out["round4"]
    # full: ranks renumbered 1..n by score, full precision kept
    assert out["full"] == ["q\td\t3\t0.123456", "q\te\t1\t0.9", "q\tf\t2\t0.5"]
    assert out["rank3"] == ["q\td\t5", "q\te\t9", "q\tf\t7"]
    got = {r["pid"]: r["score"] for r in tf.scan_run_lenient(spark, scratch_path(
        spark, f"tests/sink-rank3-{os.getpid()}")).collect()}
    assert got == {"d": 1 / 5, "e": 1 / 9, "f": 1 / 7}


def test_package_shipped_to_python_workers(spark):
    from conceptsearch.session import PACKAGE_ROOT, ship_package
    ship_package(spark)
    assert PACKAGE_ROOT in spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
