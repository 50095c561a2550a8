"""Training-set assembly.

Training records are ``(query_id, query, positives, negatives)`` with
``positives``/``negatives`` = ``struct<doc_id array<string>, score array<double>>``.
A record's lists are bounded by the search depth that produced them, so
per-record array functions (``slice``, ``transform``, ``filter``) replace
joins wherever the work stays inside one record.  Cross-record work (score
lookups, corpus text) is an equi-join on ``(query_id, doc_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptsearch.operators.search import rank_within

DOC_SCORES_TYPE = "struct<doc_id:array<string>,score:array<double>>"


def build_train_records(run: DataFrame, query_labels: DataFrame, passage_labels: DataFrame,
                        n_pos: int = 3, n_neg: int = 12, query_text: DataFrame | None = None
                        ) -> DataFrame:
    """Training records from a ranked run: the first ``n_pos`` passages that
    share the query's label are positives, the first ``n_neg`` others are
    negatives, both in rank order.  ``run``: ``(qid, pid, rank, score)``."""
    lab = (run.join(query_labels.select("qid", F.col("label").alias("qlabel")), "qid")
              .join(passage_labels.select("pid", "label"), "pid"))
    items = F.array_sort(F.collect_list(F.struct("rank", F.col("pid").cast("string").alias("doc_id"),
                                                  "score", (F.col("label") == F.col("qlabel"))
                                                  .alias("same"))))
    grouped = lab.groupBy("qid").agg(items.alias("items"))

    def part(same: bool, n: int) -> Column:
        chosen = F.slice(F.filter("items", lambda x: x["same"] == F.lit(same)), 1, n)
        return F.struct(F.transform(chosen, lambda x: x["doc_id"]).alias("doc_id"),
                        F.transform(chosen, lambda x: x["score"]).alias("score"))

    out = grouped.select(F.col("qid").cast("string").alias("query_id"), "qid",
                         part(True, n_pos).alias("positives"), part(False, n_neg).alias("negatives"))
    if query_text is not None:
        out = out.join(query_text.select("qid", F.col("text").alias("query")), "qid", "left")
    else:
        out = out.withColumn("query", F.lit(None).cast("string"))
    return out.select("query_id", "query", "positives", "negatives")


def flatten_records(records: DataFrame) -> DataFrame:
    """Records to rows ``(query_id, kind, pos, doc_id, score)``; kind 0 =
    positive, 1 = negative (H9/H10)."""
    def one(kind: int, col: str) -> DataFrame:
        z = F.arrays_zip(F.col(f"{col}.doc_id").alias("doc_id"), F.col(f"{col}.score").alias("score"))
        return records.select("query_id", F.lit(kind).alias("kind"), F.posexplode(z).alias("pos", "p")) \
                      .select("query_id", "kind", F.col("pos").cast("long").alias("pos"),
                              F.col("p.doc_id").alias("doc_id"), F.col("p.score").alias("score"))
    return one(0, "positives").unionByName(one(1, "negatives"))


def rank_cut(run: DataFrame, depth: int) -> DataFrame:
    """Keep ``rank <= depth`` (the filter reaches the scan / precedes any
    Python scorer)."""
    return run.filter(F.col("rank") <= depth)


def neg_cap(records: DataFrame, n_neg: int) -> DataFrame:
    """All positives, the first ``n_neg`` negatives, as records."""
    cap = F.struct(F.slice("negatives.doc_id", 1, n_neg).alias("doc_id"),
                   F.slice("negatives.score", 1, n_neg).alias("score"))
    return records.withColumn("negatives", cap)


def pairs_union(records: DataFrame, n_neg: int) -> DataFrame:
    """(query_id, doc_id) pairs to score: positives then capped negatives
    (bag semantics, as the reference lists them)."""
    pos = records.select("query_id", F.posexplode("positives.doc_id").alias("pos", "doc_id")) \
                 .withColumn("kind", F.lit(0))
    neg = records.select("query_id", F.posexplode(F.slice("negatives.doc_id", 1, n_neg))
                         .alias("pos", "doc_id")).withColumn("kind", F.lit(1))
    return pos.unionByName(neg).select("query_id", "kind", F.col("pos").cast("long").alias("pos"),
                                       "doc_id")


def first_positive_filter(records: DataFrame) -> DataFrame:
    """Keep positive p when p = 0, or score[p] >= score[0], or
    score[p] > max(negative scores)."""
    z = F.arrays_zip(F.col("positives.doc_id").alias("doc_id"),
                     F.col("positives.score").alias("score"))
    first = F.element_at("positives.score", 1)
    neg_max = F.array_max("negatives.score")
    kept = F.filter(z, lambda x, i: (i == 0) | (x["score"] >= first) |
                    F.coalesce(x["score"] > neg_max, F.lit(False)))
    return records.withColumn("positives", F.struct(
        F.transform(kept, lambda x: x["doc_id"]).alias("doc_id"),
        F.transform(kept, lambda x: x["score"]).alias("score")))


def row_presence_guard(records: DataFrame, merged_run: DataFrame | None = None,
                       expected_queries: DataFrame | None = None) -> DataFrame:
    """Data assertions as a violations table ``(check, violations)``.

    * positives / negatives lists of unequal length;
    * records whose negative list is empty (the rotation needs one);
    * duplicate pid within a query of ``merged_run``;
    * expected query ids missing from the records."""
    checks = [records.select(F.lit("positives_length").alias("check"),
                             (F.size("positives.doc_id") != F.size("positives.score"))
                             .cast("long").alias("bad")),
              records.select(F.lit("negatives_length").alias("check"),
                             (F.size("negatives.doc_id") != F.size("negatives.score"))
                             .cast("long").alias("bad")),
              records.select(F.lit("empty_negatives").alias("check"),
                             (F.size("negatives.doc_id") == 0).cast("long").alias("bad"))]
    if merged_run is not None:
        dup = merged_run.groupBy("qid", "pid").count().select(
            F.lit("duplicate_pid").alias("check"), (F.col("count") - 1).alias("bad"))
        checks.append(dup)
    if expected_queries is not None:
        missing = expected_queries.select(F.col("qid").cast("string").alias("query_id")) \
            .join(records.select("query_id"), "query_id", "left_anti") \
            .select(F.lit("missing_query").alias("check"), F.lit(1).cast("long").alias("bad"))
        checks.append(missing)
    names = ["positives_length", "negatives_length", "empty_negatives"] + \
        (["duplicate_pid"] if merged_run is not None else []) + \
        (["missing_query"] if expected_queries is not None else [])
    # one zero row per check, so a check without violations still reports 0
    allc = records.sparkSession.createDataFrame([(n, 0) for n in names], "check string, bad long")
    for c in checks:
        allc = allc.unionByName(c)
    return allc.groupBy("check").agg(F.sum("bad").cast("long").alias("violations"))


def latest_scores(scores: DataFrame, order_col: str) -> DataFrame:
    """Key ``(query_id, doc_id)`` -> score, the latest row by ``order_col``
    winning (a dict overwrite).  ``max_by`` aggregates partially before the
    shuffle, so a hot key costs one row per partition."""
    return scores.groupBy("query_id", "doc_id").agg(
        F.max_by("score", order_col).alias("score"))


def merge_teacher_scores(records: DataFrame, teacher: DataFrame) -> DataFrame:
    """Positives take their teacher score; negatives without a teacher
    score are dropped; list order kept.  ``teacher``: ``(query_id, doc_id,
    score)`` with one score per key (see ``latest_scores``)."""
    flat = records.select("query_id", F.posexplode("positives.doc_id").alias("pos", "doc_id")) \
        .withColumn("kind", F.lit(0)) \
        .unionByName(records.select("query_id", F.posexplode("negatives.doc_id")
                                    .alias("pos", "doc_id")).withColumn("kind", F.lit(1)))
    scored = flat.join(teacher, ["query_id", "doc_id"], "left") \
                 .filter((F.col("kind") == 0) | F.col("score").isNotNull())
    packed = scored.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("kind", "pos", "doc_id", "score"))).alias("items"))

    def part(kind: int) -> Column:
        chosen = F.filter("items", lambda x: x["kind"] == kind)
        return F.struct(F.transform(chosen, lambda x: x["doc_id"]).alias("doc_id"),
                        F.transform(chosen, lambda x: x["score"]).alias("score"))

    merged = packed.select("query_id", part(0).alias("positives"), part(1).alias("negatives"))
    return records.select("query_id", "query").join(merged, "query_id", "left")


def group_doc_ids(records: DataFrame, negative_size: int, offset: int,
                  use_first_positive: bool = False) -> DataFrame:
    """H1: epoch-rotated sampling.  Positive ``pos[offset % n]``, negatives
    ``neg[(offset * m + i) % n]`` for i < m.  Output ``(query_id, slot,
    doc_id)``: slot 0 the positive, 1..m the negatives.  Records with an
    empty positive or negative list are dropped (counted by B9)."""
    if use_first_positive:
        records = first_positive_filter(records)
    pos_ids, neg_ids = F.col("positives.doc_id"), F.col("negatives.doc_id")
    pos = F.element_at(pos_ids, F.pmod(F.lit(offset), F.size(pos_ids)) + 1)
    negs = F.transform(F.sequence(F.lit(0), F.lit(negative_size - 1)),
                       lambda i: F.element_at(neg_ids, F.pmod(F.lit(offset * negative_size) + i,
                                                              F.size(neg_ids)) + 1))
    ok = records.filter((F.size(pos_ids) > 0) & (F.size(neg_ids) > 0))
    return ok.select("query_id", F.posexplode(F.concat(F.array(pos), negs)).alias("slot", "doc_id")) \
             .select("query_id", F.col("slot").cast("long").alias("slot"), "doc_id")


def kd_label_join(groups: DataFrame, records: DataFrame) -> DataFrame:
    """Teacher score of every sampled passage.  Scores come from the
    record's positives then negatives, a later duplicate overwriting an
    earlier one.  Output ``(query_id, slot, doc_id, kd_label)``."""
    flat = flatten_records(records).withColumn("order", F.struct("kind", "pos"))
    lookup = flat.groupBy("query_id", "doc_id").agg(F.max_by("score", "order").alias("kd_label"))
    return groups.join(lookup, ["query_id", "doc_id"], "left") \
                 .select("query_id", "slot", "doc_id", "kd_label")


def rerank_tail_merge(head: DataFrame, original: DataFrame, depth: int) -> DataFrame:
    """C8 + F6: reranked head (``qid, pid, score``) followed by the original
    run's documents beyond ``depth`` (``qid, pid, rank``); the i-th tail
    document (from 0) scores ``min(head score) - i - 1``.  Ranks renumbered
    1..n.  Only queries present in the head are written."""
    heads = head.groupBy("qid").agg(F.min("score").alias("last"))
    ordered = rank_within(original.join(heads.select("qid"), "qid", "left_semi"),
                          ["qid"], [F.asc("rank"), F.asc("pid")], None, rank_col="position")
    tail = (ordered.filter(F.col("position") > depth).join(heads, "qid")
                   .select("qid", "pid", (F.col("last") - (F.col("position") - depth - 1) - 1)
                           .alias("score"), F.lit(1).alias("part"), F.col("position").alias("o")))
    top = head.select("qid", "pid", "score", F.lit(0).alias("part"),
                      F.lit(0).cast("long").alias("o"))
    both = top.unionByName(tail)
    return rank_within(both, ["qid"], [F.asc("part"), F.desc("score"), F.asc("o"), F.asc("pid")],
                       None).select("qid", "pid", "rank", "score")


def readable_export(records: DataFrame, corpus: DataFrame, max_keep: int = 5) -> DataFrame:
    """C11: the first ``max_keep`` positives and negatives with title and
    contents.  Output rows ``(query_id, kind, pos, doc_id, title, contents,
    score)``; ids missing from the corpus keep null text."""
    from conceptsearch.operators.text import restrict_to_ids
    flat = flatten_records(records).filter(F.col("pos") < max_keep)
    text = corpus.select(F.col("doc_id").cast("string").alias("doc_id"),
                         F.coalesce("title", F.lit("")).alias("title"), "contents")
    text = restrict_to_ids(text, flat.select("doc_id"), "doc_id")
    return flat.join(text, "doc_id", "left") \
               .select("query_id", "kind", "pos", "doc_id", "title", "contents", "score")


def hard_subset(scores: DataFrame, n_passages: int, factor: int) -> DataFrame:
    """F8: per query keep ``n_passages // factor`` passages with the highest
    score, the target (position 0) always kept.  ``scores``: ``(qid, pos,
    score)``; output adds ``rank``."""
    k = n_passages // factor
    pinned = F.when(F.col("pos") == 0, F.lit(float("inf"))).otherwise(F.col("score"))
    return rank_within(scores.withColumn("_key", pinned), ["qid"],
                       [F.desc("_key"), F.asc("pos")], k).drop("_key")


def union_train_vectors(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """G1: passage vectors and training-query vectors as one autoencoder
    input (bag union) with a ``kind`` column."""
    return passages.select(F.lit("passage").alias("kind"), F.col("docid").alias("id"), "v") \
                   .unionByName(queries.select(F.lit("query").alias("kind"),
                                               F.col("qid").alias("id"), "v"))


def merge_worker_runs(runs: DataFrame) -> DataFrame:
    """Per-worker runs ``(worker, qid, pid, rank, score)`` merged by
    query; a later worker's list replaces an earlier one."""
    last = runs.groupBy("qid").agg(F.max("worker").alias("last_worker"))
    return runs.join(last, "qid").filter(F.col("worker") == F.col("last_worker")) \
               .drop("last_worker")


def dedupe_first(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The first row per key by ``order_col`` (a ``min_by`` aggregate,
    unlike ``dropDuplicates`` it promises which row survives)."""
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("r"))
    return agg.select(key, *[F.col(f"r.{c}").alias(c) for c in others])


def holdout_split(df: DataFrame, id_col: str, n_eval: int, seed: int = 42) -> DataFrame:
    """Seeded shuffle by ``md5(seed || id)``; the first ``n_eval`` rows
    are evaluation, the rest training.  Adds ``split``.

    The n-th smallest hash is found with a bounded top-n (``n_eval`` is a
    parameter, 4096 in the reference), then every row is labelled by
    comparison: no global sort of the data."""
    h = df.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string"))))
    cut = h.select("_h", id_col).orderBy("_h", id_col).limit(n_eval) \
           .agg(F.max(F.struct("_h", id_col)).alias("c"))
    if n_eval <= 0:
        return h.withColumn("split", F.lit("train")).drop("_h")
    bound = cut.select("c").scalar()
    is_eval = F.struct("_h", id_col) <= bound
    return h.withColumn("split", F.when(is_eval, "eval").otherwise("train")).drop("_h")


def unpack_groups(records: DataFrame, group_size: int) -> DataFrame:
    """One row per passage of each query's group, with the flat index
    ``batch_row * group_size + slot`` a collator would give it.  ``records``:
    ``(query_id, batch_row, doc_ids array)``."""
    return records.select("query_id", "batch_row", F.posexplode("doc_ids").alias("slot", "doc_id")) \
                  .withColumn("flat_index", F.col("batch_row") * group_size + F.col("slot"))


_ = Window
