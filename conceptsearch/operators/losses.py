"""Training losses and meters as aggregates.

A score table is ``(batch_id, row_id, col, score, target)``, and where it
comes from ``in_batch_scores`` also ``block``, ``key_row`` and ``key_slot``:
one row per (query, candidate) of an in-batch score matrix.  Row numbers may
start anew in each batch.  Groups are batches (a training parameter, not the
data size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import dot, log_softmax

BLOCK_STRIDE = 1_000_000_000


def running_mean(df: DataFrame, epoch_col: str, step_col: str, value_col: str,
                 weight_col: str | None = None, chunk_rows: int = 1 << 16) -> DataFrame:
    """Weighted running average that restarts when the epoch changes.

    A two-level prefix sum, so an epoch holding a third of all rows is still
    spread over many tasks: steps are cut into chunks of ``chunk_rows``
    consecutive step ids, each chunk gets its running sums, and the chunk
    totals (a small table) give every chunk its offset.
    Sums keep the input types, so decimal values give exact sums (and an
    exact quotient) whatever the order of addition.
    Output ``(epoch, step, running_mean)``.
    """
    w = F.col(weight_col) if weight_col else F.lit(1)
    base = df.select(F.col(epoch_col).alias("epoch"), F.col(step_col).alias("step"),
                     (F.col(value_col) * w).alias("vw"), w.alias("w"),
                     F.floor(F.col(step_col) / chunk_rows).alias("chunk"))
    in_chunk = Window.partitionBy("epoch", "chunk").orderBy("step") \
                     .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumn("s_vw", F.sum("vw").over(in_chunk)).withColumn("s_w", F.sum("w").over(in_chunk))
    totals = base.groupBy("epoch", "chunk").agg(F.sum("vw").alias("t_vw"), F.sum("w").alias("t_w"))
    before = Window.partitionBy("epoch").orderBy("chunk") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("epoch", "chunk",
                            F.coalesce(F.sum("t_vw").over(before), F.lit(0)).alias("o_vw"),
                            F.coalesce(F.sum("t_w").over(before), F.lit(0)).alias("o_w"))
    return local.join(offsets, ["epoch", "chunk"]).select(
        "epoch", "step", ((F.col("s_vw") + F.col("o_vw")) / (F.col("s_w") + F.col("o_w")))
        .alias("running_mean"))


def in_batch_scores(queries: DataFrame, keys: DataFrame, use_all_pairs: bool = False
                    ) -> DataFrame:
    """D17 score matrix: inside each batch, every query against every key
    (qk); with ``use_all_pairs`` also each query's positive key against the
    queries (kq), queries against queries (qq) and positive keys against
    positive keys (kk), their diagonals masked (dropped).

    ``queries``: ``(batch_id, row_id, v)``; ``keys``: ``(batch_id, key_id,
    row_id, slot, v)`` where slot 0 is the row's positive.  The target column
    of row r is its positive key.  Output ``(batch_id, row_id, block, col,
    score, target, key_row, key_slot)``; ``col`` is the column index of the
    concatenated matrix, ``key_row``/``key_slot`` the owner of a qk key.
    """
    q = queries.select("batch_id", "row_id", F.col("v").alias("qv"))
    k = keys.select("batch_id", "key_id", F.col("row_id").alias("k_row"), "slot", F.col("v").alias("kv"))
    n_keys = keys.groupBy("batch_id").agg(F.count("*").alias("nk"))
    n_rows = queries.groupBy("batch_id").agg(F.count("*").alias("nq"))
    qk = q.join(k, "batch_id").select("batch_id", "row_id", F.lit("qk").alias("block"),
                                      F.col("key_id").alias("j"), dot("qv", "kv").alias("score"),
                                      F.col("k_row").alias("key_row"), F.col("slot").alias("key_slot"))
    target = k.filter(F.col("slot") == 0).select("batch_id", F.col("k_row").alias("row_id"),
                                                   F.col("key_id").alias("target"))
    out = qk.withColumn("col", F.col("j"))
    if use_all_pairs:
        pos = k.filter(F.col("slot") == 0).select("batch_id", F.col("k_row").alias("p_row"), "kv")
        q2 = q.select("batch_id", F.col("row_id").alias("o_row"), F.col("qv").alias("ov"))
        kq = pos.join(q2, "batch_id").filter(F.col("p_row") != F.col("o_row")).select(
            "batch_id", F.col("p_row").alias("row_id"), F.lit("kq").alias("block"),
            F.col("o_row").alias("j"), dot("kv", "ov").alias("score"))
        qq = q.join(q2, "batch_id").filter(F.col("row_id") != F.col("o_row")).select(
            "batch_id", "row_id", F.lit("qq").alias("block"), F.col("o_row").alias("j"),
            dot("qv", "ov").alias("score"))
        pos2 = pos.select("batch_id", F.col("p_row").alias("o_row"), F.col("kv").alias("ov"))
        kk = pos.join(pos2, "batch_id").filter(F.col("p_row") != F.col("o_row")).select(
            "batch_id", F.col("p_row").alias("row_id"), F.lit("kk").alias("block"),
            F.col("o_row").alias("j"), dot("kv", "ov").alias("score"))
        extra = kq.unionByName(qq).unionByName(kk).join(n_keys, "batch_id").join(n_rows, "batch_id")
        # extra blocks get their own column id ranges, never equal to a key id
        offset = (F.when(F.col("block") == "kq", F.lit(BLOCK_STRIDE))
                   .when(F.col("block") == "qq", F.lit(2 * BLOCK_STRIDE))
                   .otherwise(F.lit(3 * BLOCK_STRIDE)))
        extra = extra.withColumn("col", offset + F.col("j")).drop("nk", "nq") \
                     .withColumn("key_row", F.lit(None).cast("long")) \
                     .withColumn("key_slot", F.lit(None).cast("int"))
        out = out.unionByName(extra)
    return out.join(target, ["batch_id", "row_id"]).select(
        "batch_id", "row_id", "block", F.col("col").cast("long").alias("col"), "score",
        F.col("target").cast("long").alias("target"), "key_row", "key_slot")


def _row_keys(scores: DataFrame) -> list[str]:
    """A row is known by its batch and number; tables of one batch may leave the batch out."""
    return [c for c in ("batch_id", "row_id") if c in scores.columns]


def _whole_table(scores: DataFrame) -> DataFrame:
    """A score table with all its columns: without ``block`` every column is a
    key (qk), without ``key_row``/``key_slot`` its owner is unknown."""
    missing = {"block": F.lit("qk"), "key_row": F.lit(None).cast("long"), "key_slot": F.lit(None).cast("int")}
    return scores.withColumns({k: v for k, v in missing.items() if k not in scores.columns})


def temperature_scale(step, temperature: float, warmup_steps: int | None = None):
    """Factor of the scores: 1 / t; with a warm-up it grows with the step up to
    that, ``max(1, 1 / t * min(1, step / warmup_steps))``."""
    full = F.lit(1.0 / temperature)
    if not warmup_steps:
        return full
    return F.greatest(F.lit(1.0), full * F.least(F.lit(1.0), step / F.lit(float(warmup_steps))))


def _target_log_softmax(scores: DataFrame, scale, mask_hard_negatives: bool) -> DataFrame:
    """The table's rows at their target column, with ``lp``."""
    s = _whole_table(scores)
    if mask_hard_negatives:
        own_negative = (F.col("block") == "qk") & (F.col("key_row") == F.col("row_id")) & \
            (F.col("key_slot") > 0)
        s = s.filter(~F.coalesce(own_negative, F.lit(False)))
    lp = s.withColumn("lp", log_softmax(F.col("score") * scale, _row_keys(scores)))
    return lp.filter((F.col("block") == "qk") & (F.col("col") == F.col("target")))   # column ids are unique within a block


def contrastive_loss(scores: DataFrame, temperature: float = 1.0,
                     mask_hard_negatives: bool = False) -> DataFrame:
    """Mean over rows of -log softmax(score / t)[target].  With
    ``mask_hard_negatives`` a row's own hard negatives (its keys other than
    the positive) leave the softmax; a table without ``key_row`` has none.
    ``block`` may be missing (all columns are keys).  One row ``(loss)``."""
    hit = _target_log_softmax(scores, F.lit(1.0 / temperature), mask_hard_negatives)
    return hit.agg((-F.avg("lp")).alias("loss"))


def contrastive_loss_steps(scores: DataFrame, steps: DataFrame, temperature: float = 1.0,
                           warmup_steps: int | None = None, loss_scale: float = 1.0, workers: int = 1,
                           mask_hard_negatives: bool = False) -> DataFrame:
    """D17 over training: the loss of every batch at its step, with a
    temperature that warms up (``temperature_scale``) and a scaled loss
    (``loss_scale``; 0 or less means the number of ``workers`` that share a
    batch).  ``steps``: ``(batch_id, step)``, a row a batch; a batch without a
    step has no loss.  Output ``(batch_id, step, scale, loss)``."""
    factor = float(workers) if loss_scale <= 0 else float(loss_scale)
    scaled = steps.select("batch_id", "step", temperature_scale(F.col("step"), temperature, warmup_steps).alias("scale"))
    hit = _target_log_softmax(scores.join(scaled, "batch_id"), F.col("scale"), mask_hard_negatives)
    return hit.groupBy("batch_id", "step", "scale").agg((-F.avg("lp") * F.lit(factor)).alias("loss"))


def kd_kl_loss(scores: DataFrame, teacher_col: str = "teacher", student_col: str = "score",
               group_cols=("query_id",), ce_weight: float = 0.0, target_slot: int = 0,
               slot_col: str = "slot") -> DataFrame:
    """KL(teacher || student) of per-query log-softmaxes, summed over
    each query's candidates and averaged over queries; plus ``ce_weight`` x
    cross-entropy of the student at the target slot.  One row ``(kl, ce, loss)``."""
    g = list(group_cols)
    t = log_softmax(F.col(teacher_col), g)
    s = log_softmax(F.col(student_col), g)
    lp = scores.withColumn("t", t).withColumn("s", s)
    per_q = lp.groupBy(*g).agg(F.sum(F.exp("t") * (F.col("t") - F.col("s"))).alias("kl"),
                               F.sum(F.when(F.col(slot_col) == target_slot, -F.col("s"))).alias("ce"))
    return per_q.agg(F.avg("kl").alias("kl"), F.avg("ce").alias("ce")) \
                .withColumn("loss", F.col("kl") + F.lit(ce_weight) * F.col("ce"))


def kd_biencoder_loss(scores: DataFrame, teacher: DataFrame, temperature: float = 1.0,
                      ce_weight: float = 1.0, mask_hard_negatives: bool = False) -> DataFrame:
    """Distillation loss of a bi-encoder batch.

    KL(teacher || student) over each row's own group (its positive and hard
    negatives, student = in-batch score / t), averaged over rows, plus
    ``ce_weight`` x the in-batch cross-entropy (optionally without the row's
    own hard negatives).  ``teacher``: ``(batch_id, row_id, slot, teacher)``;
    without ``batch_id`` its row numbers are those of one batch, or unique.
    One row ``(kl, ce, loss)``."""
    rows = _row_keys(scores)
    own = scores.filter((F.col("block") == "qk") & (F.col("key_row") == F.col("row_id"))) \
                .select(*rows, F.col("key_slot").alias("slot"),
                        (F.col("score") / F.lit(temperature)).alias("student"))
    kd = own.join(teacher, [c for c in (*rows, "slot") if c in teacher.columns])
    kl = kd_kl_loss(kd, "teacher", "student", rows).select("kl")
    ce = contrastive_loss(scores, temperature, mask_hard_negatives).select("loss").scalar()
    return kl.withColumn("ce", ce).withColumn("loss", F.lit(ce_weight) * F.col("ce") + F.col("kl"))


def rdrop_loss(scores: DataFrame, first_col: str = "score1", second_col: str = "score2",
               group_cols=("query_id",), target_slot: int = 0, slot_col: str = "slot") -> DataFrame:
    """Symmetric KL between two scoring passes plus the mean
    cross-entropy of both passes.  One row ``(kl, ce, loss)``."""
    g = list(group_cols)
    a = log_softmax(F.col(first_col), g)
    b = log_softmax(F.col(second_col), g)
    lp = scores.withColumn("a", a).withColumn("b", b)
    per_q = lp.groupBy(*g).agg(
        F.sum(F.exp("a") * (F.col("a") - F.col("b")) + F.exp("b") * (F.col("b") - F.col("a")))
        .alias("kl"),
        F.sum(F.when(F.col(slot_col) == target_slot, -(F.col("a") + F.col("b")) / 2)).alias("ce"))
    return per_q.agg((F.avg("kl") / 2).alias("kl"), F.avg("ce").alias("ce")) \
                .withColumn("loss", F.col("kl") + F.col("ce"))


def eval_means(df: DataFrame, cols, digits: int = 4) -> DataFrame:
    """Mean of several per-row columns, rounded, as one record."""
    return df.agg(*[F.round(F.avg(c), digits).alias(f"avg_{c}") for c in cols])
