"""IR evaluation operators.

Runs are ``(qid, pid, score[, rank])``; qrels are rows ``(qid, pid, rel)``, or
``judgements.ClassQrels`` where all topics of a class have the same judgements.

Ranking for nDCG / Recall / MAP / reciprocal rank follows trec_eval: score
(as a C float) descending, then document id as a string descending; the rank
field of the run is ignored (SURVEY L7).  Relevant means rel >= 1 for
Recall, MAP and RR; nDCG's gain is the grade, discount log2(rank + 1), and
the ideal list comes from all judged documents of the query (L8).

Scale: every per-query window runs after a ``rank <= k`` cut, so a group
holds at most k rows.  The ideal DCG is computed from per-grade counts, not
from a per-query sort of all judgements: a query with millions of judged
documents still has only a handful of distinct grades, and positions are
generated only up to k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptsearch.operators.judgements import Qrels, as_qrels
from conceptsearch.operators.search import rank_within

TREC_KS = (10, 100, 1000)          # Fixed values: cut-offs of the concept evaluation
DENSE_KS = (10, 50, 100, 200, 1000)  # Fixed values: cut-offs of the dense evaluation


def trec_rank(run: DataFrame, k: int | None) -> DataFrame:
    """Rank a run in trec_eval order and cut at k: ``(qid, pid, score, rank)``."""
    order = [F.col("score").cast("float").desc(), F.col("pid").cast("string").desc()]
    return rank_within(run.select("qid", "pid", "score"), ["qid"], order, k)


def evaluated_queries(run: DataFrame, qrels: Qrels, scope: str = "inner") -> DataFrame:
    """C9 (``inner``): queries present in both run and qrels.
    C10 (``left``): every query of the qrels."""
    q_qrels = as_qrels(qrels).queries()
    if scope == "left":
        return q_qrels
    return q_qrels.join(run.select("qid").distinct(), "qid")


def _qrels_stats(qrels: Qrels, ks) -> DataFrame:
    """Per query: number of relevant judgements and ideal DCG at each k, from
    one aggregate of the qrels by (qid, grade); positions are generated only
    up to max(ks), so a query with millions of judgements stays cheap."""
    k_max = max(ks)
    counts = as_qrels(qrels).counts().filter(F.col("rel") > 0)
    by_q = Window.partitionBy("qid")
    w = by_q.orderBy(F.desc("rel")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = (counts.withColumn("end", F.sum("n").over(w))
                   .withColumn("start", F.col("end") - F.col("n"))
                   .withColumn("num_rel", F.sum("n").over(by_q)))
    pos = (spans.filter(F.col("start") < k_max)
                .select("qid", "rel", "num_rel",
                        F.explode(F.sequence(F.col("start") + 1,
                                             F.least(F.col("end"), F.lit(k_max)))).alias("pos")))
    gain = F.col("rel") / F.log2(F.col("pos") + 1)
    return pos.groupBy("qid").agg(F.first("num_rel").alias("num_rel"),
                                  *[F.sum(F.when(F.col("pos") <= k, gain).otherwise(0.0))
                                    .alias(f"idcg_{k}") for k in ks])


def per_query_metrics(run: DataFrame, qrels: Qrels, ks=TREC_KS, scope: str = "inner",
                      measures=("ndcg", "map", "recall")) -> DataFrame:
    """Per-query NDCG@k, MAP@k, Recall@k in long form ``(qid, metric, value)``.

    The run is ranked once (trec order, cut at max k) and joined to its
    judgements; per-query sums, qrels statistics and the query set all meet
    on ``qid``."""
    k_max = max(ks)
    ranked = trec_rank(run, k_max)
    judged = as_qrels(qrels).judged(ranked).withColumn("rel", F.coalesce(F.col("rel"), F.lit(0)))
    hit = (F.col("rel") >= 1).cast("int")
    w_run = Window.partitionBy("qid").orderBy("rank") \
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = judged.withColumn("hits", F.sum(hit).over(w_run))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    prec_at_hit = F.when(hit == 1, F.col("hits") / F.col("rank")).otherwise(0.0)
    aggs = []
    for k in ks:
        in_k = F.col("rank") <= k
        aggs += [F.sum(F.when(in_k & (F.col("rel") > 0), gain).otherwise(0.0)).alias(f"dcg_{k}"),
                 F.sum(F.when(in_k, hit).otherwise(0)).alias(f"relret_{k}"),
                 F.sum(F.when(in_k, prec_at_hit).otherwise(0.0)).alias(f"ap_{k}")]
    per_q = judged.groupBy("qid").agg(*aggs)
    qrels_q = as_qrels(qrels).queries()
    queries = per_q.join(qrels_q, "qid") if scope != "left" else qrels_q.join(per_q, "qid", "left")
    base = queries.join(_qrels_stats(qrels, ks), "qid", "left")
    cols = []
    for k in ks:
        if "ndcg" in measures:
            cols.append((f"NDCG@{k}", F.coalesce(F.try_divide(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")),
                                                 F.lit(0.0))))
        if "map" in measures:
            cols.append((f"MAP@{k}", F.coalesce(F.try_divide(F.col(f"ap_{k}"), F.col("num_rel")),
                                                F.lit(0.0))))
        if "recall" in measures:
            cols.append((f"Recall@{k}", F.coalesce(
                F.try_divide(F.col(f"relret_{k}").cast("double"), F.col("num_rel")), F.lit(0.0))))
    wide = base.select("qid", *[c.cast("double").alias(name) for name, c in cols])
    return wide.unpivot("qid", [name for name, _ in cols], "metric", "value")


def macro_average(per_query: DataFrame, digits: int = 5) -> DataFrame:
    """Mean of each metric over queries, rounded: ``(metric, value)``."""
    return per_query.groupBy("metric").agg(F.round(F.avg("value"), digits).alias("value"))


def trec_eval(run: DataFrame, qrels: Qrels, ks=TREC_KS, scope: str = "inner",
              measures=("ndcg", "map", "recall")) -> DataFrame:
    """D7 + D8 + D9 + D13: the flat metric record, long form."""
    return macro_average(per_query_metrics(run, qrels, ks, scope, measures))


def truncate_run(run: DataFrame, k: int, order_col: str = "rank") -> DataFrame:
    """per query the top k by score, stable on file order (``order_col``)."""
    return rank_within(run, ["qid"], [F.desc("score"), F.asc(order_col)], k, rank_col="_cut") \
        .drop("_cut")


def mrr_trec(run: DataFrame, qrels: Qrels, k: int = 10, order_col: str = "rank") -> DataFrame:
    """Truncate to k, reciprocal rank of the first relevant (rel >= 1)
    document in trec order, mean over queries in both run and qrels."""
    qrels = as_qrels(qrels)
    cut = truncate_run(run, k, order_col)
    # one pass: a query of the run has rows, and first is null where none is relevant
    first = (qrels.judged(trec_rank(cut, None)).groupBy("qid")
                  .agg(F.min(F.when(F.col("rel") >= 1, F.col("rank"))).alias("first")))
    rr = first.join(qrels.queries(), "qid") \
              .select("qid", F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"))
    return rr.agg(F.coalesce(F.sum("rr") / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0))
                  .alias("value")).select(F.lit(f"MRR@{k}").alias("metric"), "value")


def rel_threshold(qrels: Qrels) -> DataFrame:
    """2 if the largest grade is at least 3, else 1 (one row)."""
    return as_qrels(qrels).top_grade().agg(F.when(F.max("rel") >= 3, 2).otherwise(1).cast("int").alias("threshold"))


def mrr_msmarco(run: DataFrame, qrels: Qrels, k: int = 10, order_col: str = "rank") -> DataFrame:
    """Run order as given, threshold from D12, divided by every qrels
    query (missing run counts 0), x100, rounded to 4 decimals."""
    threshold = rel_threshold(qrels).scalar()
    in_order = rank_within(run, ["qid"], [F.asc(order_col)], k, rank_col="pos")
    first = (as_qrels(qrels).judged(in_order).filter(F.col("rel") >= threshold)
                     .groupBy("qid").agg(F.min("pos").alias("first")))
    n_qrels_queries = as_qrels(qrels).queries().select(F.greatest(F.countDistinct("qid"), F.lit(1))).scalar()
    total = first.agg(F.coalesce(F.sum(F.lit(1.0) / F.col("first")), F.lit(0.0)).alias("s"))
    return total.select(F.lit("mrr").alias("metric"),
                        F.round(F.col("s") / n_qrels_queries * 100, 4).alias("value"))


def score_table_ranks(scores: DataFrame) -> DataFrame:
    """Rank of every column inside its row of a score table ``(batch_id,
    row_id, col, score, target)``: score desc, column asc.  Row numbers may
    start anew in each batch; a table of one batch may leave ``batch_id`` out."""
    row = [c for c in ("batch_id", "row_id") if c in scores.columns]
    return rank_within(scores, row, [F.desc("score"), F.asc("col")], None)


def accuracy_at_k(scores: DataFrame, ks=(1, 3)) -> DataFrame:
    """Share of rows whose target column is among the top k, x100."""
    ranked = score_table_ranks(scores).filter(F.col("col") == F.col("target"))
    return ranked.agg(*[(F.avg((F.col("rank") <= k).cast("double")) * 100).alias(f"acc{k}")
                        for k in ks]) \
                 .unpivot([], [f"acc{k}" for k in ks], "metric", "value")


def batch_mrr(scores: DataFrame) -> DataFrame:
    """Mean of 100 / rank of the target column in its row."""
    ranked = score_table_ranks(scores).filter(F.col("col") == F.col("target"))
    return ranked.agg(F.avg(F.lit(100.0) / F.col("rank")).alias("value")) \
                 .select(F.lit("mrr").alias("metric"), "value")


def run_counts(run: DataFrame, qrels: Qrels) -> DataFrame:
    """Load statistics of a run and its qrels, long form."""
    r = run.agg(F.countDistinct("qid").alias("run_queries"), F.count("*").alias("run_rows"),
                F.countDistinct("pid").alias("run_docs"))
    q = as_qrels(qrels).counts().agg(F.countDistinct("qid").alias("qrels_queries"),
                                     F.coalesce(F.sum("n"), F.lit(0)).alias("judgements"))
    names = ["run_queries", "run_rows", "run_docs", "qrels_queries", "judgements"]
    both = r.unionByName(q, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])
    return both.unpivot([], names, "metric", "value").select(
        "metric", F.col("value").cast("long").alias("value"))


def index_counts(index) -> DataFrame:
    """Load statistics of an index, long form: size of the vocabulary,
    postings, documents, documents without a posting, and avgdl.  ``index`` is
    a ``ConceptIndex``; each of its tables is read once."""
    terms = index.terms.agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings"))
    docs = index.doc_stats.agg(F.count("*").alias("documents"), F.count_if(F.col("dl") == 0).alias("empty_documents"),
                               F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"))
    names = ["vocabulary", "postings", "documents", "empty_documents", "avgdl"]
    both = terms.unionByName(docs, allowMissingColumns=True).agg(
        *[F.coalesce(F.max(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    return both.unpivot([], names, "metric", "value")
