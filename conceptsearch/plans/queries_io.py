"""Registered queries: sources and sinks as write -> read round trips.

Each query writes data derived from the given tables into a fresh folder
under the shared checkpoint directory, reads it back with the reader under
test and returns the rows; the oracle computes the expected rows directly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptsearch.operators import describe, metrics, sae
from conceptsearch.operators import training_data as td
from conceptsearch.plans.fixtures import THETA, Fixture
from conceptsearch.plans.queries_text import _prompts
from conceptsearch.plans.registry import _r, _sparse_run3, register
from conceptsearch.session import scratch_path
from conceptsearch.sources import sinks, text_formats as tf, vectors as vec


def _fresh(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex}")


@register("scan_corpus")
def q_scan_corpus(spark, sf):
    path = _fresh(spark, "corpus") + "/corpus.jsonl.gz"
    sinks.write_corpus(Fixture(spark, sf).corpus(), path, gzip=True)
    return tf.scan_corpus(spark, path)


@register("scan_queries")
def q_scan_queries(spark, sf):
    b = Fixture(spark, sf).table("benchmark")
    clean = F.regexp_replace("text", "[\\t\\n\\r]", " ")
    first = b.select(F.col("item_id").alias("qid"), clean.alias("text"),
                     F.struct(F.lit(0).alias("again"), "item_id").alias("line_no"))
    again = b.filter(F.col("item_id") % 2 == 0).select(
        F.col("item_id").alias("qid"), F.concat(clean, F.lit(" (v2)")).alias("text"),
        F.struct(F.lit(1).alias("again"), "item_id").alias("line_no"))
    path = _fresh(spark, "queries") + "/queries.tsv"
    sinks.write_queries(first.unionByName(again), path)
    return tf.scan_queries(spark, path)


@register("scan_qa_queries")
def q_scan_qa_queries(spark, sf):
    lines = Fixture(spark, sf).qa_lines().select(
        F.concat_ws("\t", "raw_question", "raw_answers").alias("value"), "line_no")
    path = _fresh(spark, "qa") + "/qa.tsv"
    sinks.write_lines(lines, path, ["line_no"])
    out = tf.scan_qa_queries(spark, path)
    return out.select("query", F.array_join("answers", "|").alias("answers"),
                      F.size("answers").cast("long").alias("n_answers"))


@register("scan_qrels")
def q_scan_qrels(spark, sf):
    q = Fixture(spark, sf).qrels_graded()
    late = q.filter(F.col("pid") % 5 == 0).withColumn("rel", F.lit(0))
    out = None
    for form, sep in (("tab", "\t"), ("blank", "  ")):
        lines = q.withColumn("part", F.lit(0)).unionByName(late.withColumn("part", F.lit(1))) \
                 .select(F.concat_ws(sep, F.col("qid").cast("string"), F.lit("0"),
                                     F.col("pid").cast("string"), F.col("rel").cast("string"))
                         .alias("value"), "part", "qid", "pid")
        path = _fresh(spark, f"qrels-{form}")
        sinks.write_lines(lines, path, ["part", "qid", "pid"])
        got = tf.scan_qrels(spark, path, whitespace=(form == "blank")).withColumn("form", F.lit(form))
        out = got if out is None else out.unionByName(got)
    return out.select("form", "qid", "pid", "rel")


@register("scan_run_lenient")
def q_scan_run_lenient(spark, sf):
    run = Fixture(spark, sf).dense_run().select("qid", F.col("pid"), "rank", "score")
    path = _fresh(spark, "run3")
    sinks.write_run(run, path, "rank3")
    got = tf.scan_run_lenient(spark, path)
    return got.select("qid", "pid", "rank", _r("score").alias("score"))


@register("scan_run_strict")
def q_scan_run_strict(spark, sf):
    run = _sparse_run3(Fixture(spark, sf))
    path = _fresh(spark, "run4")
    sinks.write_run(run, path, "trec3")
    junk = run.filter(F.col("rank") == 1).select(
        F.concat_ws("\t", F.col("qid").cast("string"), F.lit("junk"), F.lit("1")).alias("value"))
    junk.write.mode("append").text(path)
    return tf.scan_run_strict(spark, path).select("qid", "pid", "score")


@register("sink_run")
def q_sink_run(spark, sf):
    run = _sparse_run3(Fixture(spark, sf))
    path = _fresh(spark, "sink-run")
    sinks.write_run(run, path, "trec3")
    return tf.scan_run_lenient(spark, path)


def _shards(spark, sf) -> str:
    v = Fixture(spark, sf).vectors()
    path = _fresh(spark, "shards")
    vec.write_vector_shards(v.filter(F.col("vec_id") < 250), path + "/w0", worker=0, shard_rows=97)
    vec.write_vector_shards(v.filter(F.col("vec_id") >= 250), path + "/w1", worker=1, shard_rows=97)
    return path


@register("scan_vector_shards")
def q_scan_vector_shards(spark, sf):
    path = _shards(spark, sf)
    got = vec.scan_vector_shards(spark, path + "/w*")
    return got.select("vec_id", F.size("v").cast("long").alias("dim"),
                      _r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("checksum"))


@register("sink_vector_shards")
def q_sink_vector_shards(spark, sf):
    path = _shards(spark, sf)
    # as after a run that stopped: a shard leaves the manifest and is written again
    gone = vec.finished_shards(spark, path + "/w1").filter("shard > 0").collect()
    spark.createDataFrame(gone, vec.FINISHED).write.mode("overwrite").parquet(path + "/w1/_finished")
    vec.write_vector_shards(Fixture(spark, sf).vectors().filter(F.col("vec_id") >= 250), path + "/w1", worker=1, shard_rows=97)
    plan = vec.finished_shards(spark, path + "/w0").unionByName(vec.finished_shards(spark, path + "/w1"))
    got = vec.scan_vector_shards(spark, path + "/w*").withColumn("worker", (F.col("vec_id") >= 250).cast("long"))
    shard = F.floor((F.col("vec_id") - 250 * F.col("worker")) / 97)
    sums = got.groupBy("worker", shard.alias("shard")).agg(
        _r(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)), 4).alias("checksum"))
    return plan.join(sums, ["worker", "shard"], "full")


def _recon(spark, sf) -> DataFrame:
    fx = Fixture(spark, sf)
    codes = sae.encode_threshold(fx.vectors(), fx.model, THETA, "vec_id")
    recon = sae.reconstruct(codes, fx.model).withColumnRenamed("id", "vec_id")
    path = _fresh(spark, "recon")
    vec.write_recon_vectors(recon, path, max_rows_per_file=100)
    got = vec.scan_recon_vectors(spark, path)
    return got.select("vec_id", F.posexplode("v").alias("dim", "value")) \
              .select("vec_id", F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


register("scan_recon_vectors")(_recon)
register("sink_recon_vectors")(_recon)


@register("scan_train_records")
def q_scan_train_records(spark, sf):
    rec = Fixture(spark, sf).train_records()
    base = _fresh(spark, "train")
    valid = F.col("query_id").cast("long") % 50 == 0
    rec.filter(~valid).write.mode("overwrite").json(base + "/train.jsonl")
    rec.filter(valid).write.mode("overwrite").json(base + "/valid.jsonl")
    got = tf.scan_train_records(spark, f"{base}/train.jsonl,{base}/valid.jsonl")
    return td.flatten_records(got).select("query_id", F.col("kind").cast("int").alias("kind"),
                                          "pos", "doc_id", _r("score").alias("score"))


def _latents_round_trip(spark, sf) -> DataFrame:
    fx = Fixture(spark, sf)
    path = _fresh(spark, "latents")
    sinks.write_latents(fx.passage_codes(), path, "docid")
    got = tf.scan_passage_latents(spark, path)
    return sae.explode_codes(got, "docid").select("docid", "latent", _r("w").alias("w"))


register("scan_passage_latents")(_latents_round_trip)
register("sink_latents")(_latents_round_trip)


@register("scan_query_latents")
def q_scan_query_latents(spark, sf):
    fx = Fixture(spark, sf)
    path = _fresh(spark, "qlatents")
    sinks.write_query_latents(fx.query_codes(), path, "qid")
    return tf.scan_query_latents(spark, path).select("qid", "latent", _r("weight").alias("weight"))


@register("sink_metrics")
def q_sink_metrics(spark, sf):
    fx = Fixture(spark, sf)
    run = fx.dense_run().select("qid", "pid", "rank", "score")
    path = _fresh(spark, "metrics")
    sinks.write_metrics(metrics.trec_eval(run, fx.qrels_graded(), metrics.DENSE_KS), path)
    return sinks.read_metrics(spark, path)


@register("index_save_load")
def q_index_save_load(spark, sf):
    path = _fresh(spark, "index")
    sinks.save_index(Fixture(spark, sf).index(), path)
    idx = sinks.load_index(spark, path)
    return idx.postings.select("latent", "docid", _r("tf").alias("tf"), "dl")


@register("index_load_counts")
def q_index_load_counts(spark, sf):
    """Statistics of a saved index as it is loaded, beside those it was saved with."""
    path = _fresh(spark, "index")
    sinks.save_index(Fixture(spark, sf).index(), path)
    idx = sinks.load_index(spark, path)
    saved = idx.stats.select(F.lit("saved_documents").alias("metric"), F.col("n").cast("double").alias("value")).unionByName(
        idx.stats.select(F.lit("saved_avgdl").alias("metric"), F.col("avgdl").alias("value")))
    return metrics.index_counts(idx).unionByName(saved).select("metric", _r("value", 9).alias("value"))


@register("index_load_tables")
def q_index_load_tables(spark, sf):
    """Terms and document lengths of a saved index as they are loaded."""
    path = _fresh(spark, "index")
    sinks.save_index(Fixture(spark, sf).index(), path)
    idx = sinks.load_index(spark, path)
    terms = idx.terms.select(F.lit("term").alias("kind"), F.col("latent").alias("id"), F.col("df").alias("n"), _r("idf", 9).alias("idf"))
    docs = idx.doc_stats.select(F.lit("document").alias("kind"), F.col("docid").alias("id"), F.col("dl").alias("n"),
                                F.lit(None).cast("double").alias("idf"))
    return terms.unionByName(docs)


@register("sink_descriptions")
def q_sink_descriptions(spark, sf):
    path = _fresh(spark, "desc")
    sinks.write_descriptions(describe.describe_latents(_prompts(Fixture(spark, sf))), path)
    return spark.read.schema("id long, interp string").json(path) \
                .select(F.col("id").alias("latent"), "interp")
