"""Registered queries: token masking, text encoders, QA text, descriptions
and training losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import (log_softmax, normalize_qa_text, parse_answer_list,
                                            parse_interpretation)
from conceptsearch.operators import describe, losses, metrics, sae, text
from conceptsearch.operators import training_data as td
from conceptsearch.operators.embed import cosine_scorer, embed_batch, hashing_encoder, pair_score
from conceptsearch.plans.fixtures import Fixture
from conceptsearch.plans.queries_training import _records, _vecs
from conceptsearch.plans.registry import _r, register

MLM_PROB = 0.15
ENC_PROB, DEC_PROB = 0.3, 0.5
EMBED_DIM = 16
TOP_DOCS, PROMPT_DOCS = 5, 3
TEMPERATURE = 0.1
WARMUP_STEPS, WORKERS = 5, 4
KD_CE_WEIGHT = 0.2


def _tokens(fx: Fixture) -> DataFrame:
    return text.token_table(fx.table("documents"), "text", "doc_id")


def _wwm(fx: Fixture) -> DataFrame:
    return text.whole_word_mask(text.token_arrays(fx.table("documents")), MLM_PROB, 42)


@register("whole_word_mask")
def q_whole_word_mask(spark, sf):
    return text.explode_mask(_wwm(Fixture(spark, sf))).filter("masked = 1") \
               .select("doc_id", "pos", "token")


@register("mask_tokens")
def q_mask_tokens(spark, sf):
    out = text.explode_masked_tokens(text.mask_tokens(_wwm(Fixture(spark, sf)), 42))
    return out.filter(F.col("label").isNotNull()).select("doc_id", "pos", "input_token", "label")


@register("vocabulary")
def q_vocabulary(spark, sf):
    return text.vocabulary(text.token_arrays(Fixture(spark, sf).table("documents")))


@register("mask_tokens_vocabulary")
def q_mask_tokens_vocabulary(spark, sf):
    """Random tokens come from the whole corpus."""
    tokens = text.token_arrays(Fixture(spark, sf).table("documents"))
    wwm = text.whole_word_mask(tokens, MLM_PROB, 42)
    out = text.explode_masked_tokens(text.mask_tokens(wwm, 42, vocab=text.vocabulary(tokens)))
    return out.filter(F.col("label").isNotNull()).select("doc_id", "pos", "input_token", "label")


@register("dual_mask_inputs")
def q_dual_mask_inputs(spark, sf):
    """Both tracks' inputs where the decoder's mask is set, and where a label is missing."""
    tokens = text.token_arrays(Fixture(spark, sf).table("documents"))
    dual = text.dual_mask(tokens, ENC_PROB, DEC_PROB, 42)
    out = text.dual_mask_inputs(dual, 42, text.vocabulary(tokens))
    z = F.arrays_zip(*(F.col(c) for c in ("enc_inputs", "enc_labels", "dec_inputs", "dec_labels", "labels")))
    rows = out.select("doc_id", F.posexplode(z).alias("pos", "p"))
    return rows.filter("p.dec_labels IS NOT NULL OR p.labels IS NULL").select(
        "doc_id", F.col("pos").cast("long").alias("pos"), *(f"p.{c}" for c in (
            "enc_inputs", "enc_labels", "dec_inputs", "dec_labels", "labels")))


@register("dual_mask")
def q_dual_mask(spark, sf):
    out = text.dual_mask(text.token_arrays(Fixture(spark, sf).table("documents")),
                         ENC_PROB, DEC_PROB, 42)
    z = F.arrays_zip(F.col("enc").alias("e"), F.col("dec").alias("d"))
    rows = out.select("doc_id", F.posexplode(z).alias("pos", "p"))
    return rows.filter("p.d = 1").select("doc_id", F.col("pos").cast("long").alias("pos"),
                                         F.col("p.e").alias("enc_masked"),
                                         F.col("p.d").alias("dec_masked"))


@register("replace_ratio")
def q_replace_ratio(spark, sf):
    out = text.replace_ratio(text.mask_tokens(_wwm(Fixture(spark, sf)), 42))
    return out.select("replaced", "attended", _r("ratio", 9).alias("ratio"))


@register("embed_batch")
def q_embed_batch(spark, sf):
    docs = Fixture(spark, sf).table("documents")
    v = embed_batch(docs, hashing_encoder(EMBED_DIM), "doc_id", "text")
    return v.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("dim", "value")) \
            .select("doc_id", F.col("dim").cast("long").alias("dim"), _r("value", 9).alias("value"))


@register("pool_mean")
def q_pool_mean(spark, sf):
    out = text.pool_mean(_tokens(Fixture(spark, sf)), EMBED_DIM)
    return out.select("doc_id", "dim", _r("value", 9).alias("value"))


@register("pool_first")
def q_pool_first(spark, sf):
    return text.pool_first(_tokens(Fixture(spark, sf)), EMBED_DIM)


@register("normalize_qa_text")
def q_normalize_qa_text(spark, sf):
    lines = Fixture(spark, sf).qa_lines().filter(F.col("line_no.again") == 0)
    return lines.select("conv_id", "turn", normalize_qa_text(F.col("raw_question")).alias("question"))


@register("parse_answer_list")
def q_parse_answer_list(spark, sf):
    lines = Fixture(spark, sf).qa_lines().filter(F.col("line_no.again") == 0)
    answers = parse_answer_list(normalize_qa_text(F.col("raw_answers")))
    return lines.select("conv_id", "turn", F.array_join(answers, "|").alias("answers"),
                        F.size(answers).cast("long").alias("n_answers"))


@register("parse_interpretation")
def q_parse_interpretation(spark, sf):
    c = Fixture(spark, sf).table("conversations")
    reply = F.when(F.col("turn") % 2 == 0,
                   F.concat(F.col("text"), F.lit("\n[interpretation]:  "), F.col("role"), F.lit(" "))) \
             .otherwise(F.col("text"))
    return c.select("conv_id", "turn", parse_interpretation(reply).alias("interp"))


# ---------------------------------------------------------------- descriptions
def _postings(fx: Fixture) -> DataFrame:
    return describe.latent_postings(sae.explode_codes(fx.passage_codes(), "docid"))


@register("latent_postings")
def q_latent_postings(spark, sf):
    return _postings(Fixture(spark, sf)).select("latent", "docid", _r("act").alias("act"))


@register("top_docs_per_latent")
def q_top_docs_per_latent(spark, sf):
    top = describe.top_docs_per_latent(_postings(Fixture(spark, sf)), TOP_DOCS)
    return top.select("latent", "docid", "rank", _r("act").alias("act"))


def _prompts(fx: Fixture) -> DataFrame:
    top = describe.top_docs_per_latent(_postings(fx), PROMPT_DOCS)
    return describe.prompt_text(top, fx.corpus())


@register("prompt_text")
def q_prompt_text(spark, sf):
    return _prompts(Fixture(spark, sf))


@register("describe_latents")
def q_describe_latents(spark, sf):
    return describe.describe_latents(_prompts(Fixture(spark, sf)))


# ---------------------------------------------------------------- losses
@register("running_mean")
def q_running_mean(spark, sf):
    # values carry cents: decimal sums are exact, so the mean does not depend
    # on the order in which partial sums meet
    ev = Fixture(spark, sf).table("events").select(
        F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("epoch"), "event_id",
        F.col("value").cast("decimal(18,2)").alias("value"),
        (F.lit(1) + F.col("user_id") % 3).cast("int").alias("n"))
    out = losses.running_mean(ev, "epoch", "event_id", "value", "n", chunk_rows=1000)
    return out.select("epoch", "step", F.round("running_mean", 6).cast("double").alias("running_mean"))


def _row_of(query: str):
    """Batch and row of a query id: four queries a batch, row numbers anew in each."""
    n = (F.col(query).cast("long") / 25).cast("long")
    return (n / 4).cast("long").alias("batch_id"), (n % 4).alias("row_id")


def _score_table(fx: Fixture, all_pairs: bool) -> DataFrame:
    groups = td.group_doc_ids(_records(fx), 3, 2)
    q, p = _vecs(fx)
    qrows = groups.select(F.col("query_id").cast("long").alias("qid")).distinct() \
        .join(q.withColumnRenamed("id", "qid"), "qid").select(*_row_of("qid"), "v")
    keys = groups.join(p.select(F.col("id").cast("string").alias("doc_id"), "v"), "doc_id") \
        .select(*_row_of("query_id"), "slot", "v").withColumn("key_id", F.col("row_id") * 4 + F.col("slot"))
    return losses.in_batch_scores(qrows, keys, all_pairs)


@register("accuracy_at_k")
def q_accuracy_at_k(spark, sf):
    out = metrics.accuracy_at_k(_score_table(Fixture(spark, sf), False), (1, 3))
    return out.select("metric", _r("value").alias("value"))


@register("batch_mrr")
def q_batch_mrr(spark, sf):
    out = metrics.batch_mrr(_score_table(Fixture(spark, sf), False))
    return out.select("metric", _r("value").alias("value"))


@register("contrastive_loss")
def q_contrastive_loss(spark, sf):
    out = losses.contrastive_loss(_score_table(Fixture(spark, sf), False), TEMPERATURE)
    return out.select(_r("loss", 9).alias("loss"))


@register("contrastive_loss_all_pairs")
def q_contrastive_loss_all_pairs(spark, sf):
    out = losses.contrastive_loss(_score_table(Fixture(spark, sf), True), TEMPERATURE)
    return out.select(_r("loss", 9).alias("loss"))


@register("contrastive_loss_steps")
def q_contrastive_loss_steps(spark, sf):
    """Every batch is a step, in the order of batches; the loss is scaled by the number of workers."""
    scores = _score_table(Fixture(spark, sf), True)
    steps = scores.select("batch_id").distinct().select("batch_id", F.col("batch_id").alias("step"))
    out = losses.contrastive_loss_steps(scores, steps, TEMPERATURE, WARMUP_STEPS, loss_scale=0, workers=WORKERS)
    return out.select("batch_id", "step", _r("scale", 9).alias("scale"), _r("loss", 9).alias("loss"))


def _kd_table(fx: Fixture) -> DataFrame:
    rec = _records(fx)
    groups = td.kd_label_join(td.group_doc_ids(rec, 3, 2), rec)
    q, p = _vecs(fx)
    student = pair_score(groups.select("query_id", "doc_id").distinct(), q, p, cosine_scorer, 5)
    return groups.join(student, ["query_id", "doc_id"]).withColumnRenamed("kd_label", "teacher")


@register("kd_kl_loss")
def q_kd_kl_loss(spark, sf):
    # teacher: the dense scores carried by the training records; student: the
    # in-batch scores of each query's own group; hard negatives masked in CE
    fx = Fixture(spark, sf)
    rec = _records(fx)
    kd = td.kd_label_join(td.group_doc_ids(rec, 3, 2), rec)
    teacher = kd.select(*_row_of("query_id"), F.col("slot").cast("int").alias("slot"),
                        F.col("kd_label").alias("teacher"))
    out = losses.kd_biencoder_loss(_score_table(fx, False), teacher, TEMPERATURE, KD_CE_WEIGHT,
                                   mask_hard_negatives=True)
    return out.select(_r("kl", 9).alias("kl"), _r("ce", 9).alias("ce"), _r("loss", 9).alias("loss"))


@register("rdrop_loss")
def q_rdrop_loss(spark, sf):
    kd = _kd_table(Fixture(spark, sf)).select("query_id", "slot", F.col("teacher").alias("score1"),
                                               F.col("score").alias("score2"))
    out = losses.rdrop_loss(kd, "score1", "score2", ("query_id",))
    return out.select(_r("kl", 9).alias("kl"), _r("ce", 9).alias("ce"), _r("loss", 9).alias("loss"))


@register("log_softmax")
def q_log_softmax(spark, sf):
    kd = _kd_table(Fixture(spark, sf))
    return kd.select("query_id", "slot", _r(log_softmax(F.col("teacher"), ["query_id"]), 9).alias("lp"))


@register("eval_means")
def q_eval_means(spark, sf):
    kd = _kd_table(Fixture(spark, sf)).select(F.col("teacher").alias("kd_label"),
                                               F.col("score").alias("student"))
    return losses.eval_means(kd, ["kd_label", "student"], 4)
