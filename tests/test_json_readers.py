"""JSON readers fail on malformed lines, the object reader splits one file, and shards resume."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from conceptsearch.session import scratch_path
from conceptsearch.sources import text_formats as tf
from conceptsearch.sources import vectors as vec

GOOD = {"corpus.jsonl": '{"id": "1", "title": "t", "contents": "c"}',
        "train.jsonl": '{"query_id": "1", "positives": {"doc_id": ["2"], "score": [1.0]}}',
        "latents.jsonl": '{"docid": 1, "ids": [2], "weight": [0.5]}'}


@pytest.mark.parametrize("reader, name", [(tf.scan_corpus, "corpus.jsonl"), (tf.scan_train_records, "train.jsonl"),
                                          (tf.scan_passage_latents, "latents.jsonl")])
@pytest.mark.parametrize("bad", ["{broken", "[1, 2", "plain text"])
def test_malformed_json_lines_fail_the_read(spark, tmp_path, reader, name, bad):
    path = tmp_path / name
    path.write_text(GOOD[name] + "\n")
    assert len(reader(spark, str(path)).collect()) == 1
    path.write_text(GOOD[name] + "\n" + bad + "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        reader(spark, str(path)).collect()


def object_file(tmp_path, text, name="queries.json"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def entries(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], []).append((r["latent"], r["weight"]))
    return out


def test_one_object_is_read_by_many_tasks(spark, tmp_path):
    data = {str(q): {"ids": [q, q + 1], "weight": [q / 7, 0.25]} for q in range(5000)}
    path = object_file(tmp_path, json.dumps(data, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        parts = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        got = entries(tf.scan_query_latents(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 5 and got == {q: [(q, q / 7), (q + 1, 0.25)] for q in range(5000)}


def test_object_forms(spark, tmp_path):
    one = '{"ids": [1], "weight": [0.5]}'
    for text, want in [("{}", {}), ("{ }\n", {}), ('{"3":' + one + "}\n\n", {3: [(1, 0.5)]}),
                       ('{"3" : ' + one + ',\n "3": {"weight": [1.5], "ids": [9]}, "-4":{"ids":[],"weight":[]} }', {3: [(9, 1.5)]})]:
        assert entries(tf.scan_query_latents(spark, object_file(tmp_path, text))) == want


@pytest.mark.parametrize("text", [
    '{"1": {"ids": [1], "weight": [0.5]}, "2": {"ids": [1], "wei', '{"1": {"ids": [1], "weight": [0.5]}',
    '{"1": {"ids": [1], "weight": [0.5]}\n', '{"1": {"ids": [1, "weight": [0.5]}}', '{"x": {"ids": [1], "weight": [0.5]}}',
    '{"1": {"ids": [1, 2], "weight": [0.5]}}', '{"1": {"ids": [1]}}', '{"1": {"ids": [1], "weight": [0.5], "more": {}}}', "[1]"])
def test_broken_objects_fail_with_their_place(spark, tmp_path, text):
    with pytest.raises(Exception, match="malformed (entry in|object).*queries.json"):
        tf.scan_query_latents(spark, object_file(tmp_path, text)).collect()


def shards(spark, path):
    return {r["vec_id"]: r["v"] for r in vec.scan_vector_shards(spark, path).collect()}


def test_shards_resume_by_manifest(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") * 3).alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v"))
    path = scratch_path(spark, f"tests/{tmp_path.name}-resume")
    vec.write_vector_shards(rows.repartition(7), path, worker=2, shard_rows=23)
    want = {k: [float(k), 0.5] for k in range(100)}
    assert shards(spark, path) == want
    done = sorted((r["shard"], r["n_rows"]) for r in vec.finished_shards(spark, path).collect())
    assert done == [(0, 23), (1, 23), (2, 23), (3, 23), (4, 8)]
    # one shard was never finished, one is half written and not in the manifest
    spark.createDataFrame([(2, s, n) for s, n in done if s not in (1, 3)], vec.FINISHED).write.mode("overwrite").parquet(path + "/_finished")
    spark.createDataFrame([([9.0, 9.0],)] * 4, "embedding array<float>").write.mode("overwrite").parquet(path + "/shard_2_1.parquet")
    spark.createDataFrame([], "embedding array<float>").write.mode("overwrite").parquet(path + "/shard_2_3.parquet")
    vec.write_vector_shards(rows, path, worker=2, shard_rows=23, at_once=1)
    assert shards(spark, path) == want
    assert vec.finished_shards(spark, path).count() == 5


def test_shard_files_without_folders_are_read(spark, tmp_path):
    path = scratch_path(spark, f"tests/{tmp_path.name}-flat")
    vec.write_vector_shards(spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("v")).filter("false"), path)
    assert vec.finished_shards(spark, path).count() == 0


def test_a_shard_is_written_from_its_own_file(spark, monkeypatch):
    """Work grows with the rows, not with shards times rows; each shard stays in id order."""
    rows = spark.range(300).select(((F.col("id") * 7) % 300).alias("vec_id"), F.array(((F.col("id") * 7) % 300).cast("double")).alias("v"))
    path = scratch_path(spark, f"tests/own-{uuid.uuid4().hex}")      # the folder outlives a run
    dealt = path + "-dealt"
    monkeypatch.setattr(vec, "scratch_path", lambda spark, name: dealt)
    vec.write_vector_shards(rows.repartition(5), path, worker=1, shard_rows=10)
    assert shards(spark, path) == {k: [float(k)] for k in range(300)}
    assert vec.finished_shards(spark, path).agg(F.sum("n_rows"), F.count("*")).first()[:] == (300, 30)
    files = spark.read.parquet(dealt).withColumn("file", F.col("_metadata.file_path")).groupBy("shard").agg(
        F.count("*").alias("n"), F.min("row").alias("first"), F.countDistinct("file").alias("files")).collect()
    assert sorted((r["shard"], r["n"], r["first"], r["files"]) for r in files) == [(i, 10, 10 * i, 1) for i in range(30)]
