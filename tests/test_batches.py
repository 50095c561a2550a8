"""Losses and ranks of score tables whose row numbers start anew in each batch."""

import math

import numpy as np
import pytest

from conceptsearch.operators import losses, metrics

SCHEMA = "batch_id long, row_id long, col long, score double, target long"


def table(spark, batches):
    rows = [(b, r, c, float(s[r, c]), 0) for b, s in enumerate(batches) for r in range(len(s)) for c in range(s.shape[1])]
    return spark.createDataFrame(rows, SCHEMA)


def lsm(x):
    return x - x.max() - math.log(np.exp(x - x.max()).sum())


BATCHES = [np.array([[2.0, 0.5, -1.0], [0.9, 0.3, 0.2]]), np.array([[0.8, 0.1, 0.0], [0.1, 0.3, 0.7]]),
           np.array([[0.4, 0.6, 0.5]])]


def test_ranks_are_of_one_batch(spark):
    scores = table(spark, BATCHES[:2])
    # the target is first in three rows, third in the last
    assert metrics.batch_mrr(scores).first()["value"] == pytest.approx(100 * (3 + 1 / 3) / 4)
    acc = {r["metric"]: r["value"] for r in metrics.accuracy_at_k(scores).collect()}
    assert acc == {"acc1": 75.0, "acc3": 100.0}
    one = scores.filter("batch_id = 0").drop("batch_id")
    assert metrics.batch_mrr(one).first()["value"] == 100.0


def test_contrastive_loss_without_block_or_batch(spark):
    scores = table(spark, BATCHES)
    want = -np.mean([lsm(r / 0.5)[0] for s in BATCHES for r in s])
    assert losses.contrastive_loss(scores, 0.5).first()["loss"] == pytest.approx(want)
    assert losses.contrastive_loss(scores, 0.5, mask_hard_negatives=True).first()["loss"] == pytest.approx(want)
    one = scores.filter("batch_id = 1").drop("batch_id")
    assert losses.contrastive_loss(one).first()["loss"] == pytest.approx(-np.mean([lsm(r)[0] for r in BATCHES[1]]))


@pytest.mark.parametrize("scale, workers, factor", [(1.0, 8, 1.0), (0, 8, 8.0), (2.5, 8, 2.5)])
def test_warm_up_and_scaled_loss(spark, scale, workers, factor):
    scores = table(spark, BATCHES)
    steps = spark.createDataFrame([(0, 0), (1, 60), (2, 500)], "batch_id long, step long")
    out = {r["batch_id"]: r for r in losses.contrastive_loss_steps(scores, steps, 0.02, 100, scale, workers).collect()}
    for b, (step, want) in enumerate([(0, 1.0), (60, 30.0), (500, 50.0)]):
        assert out[b]["step"] == step and out[b]["scale"] == pytest.approx(want)
        assert out[b]["loss"] == pytest.approx(-np.mean([lsm(r * want)[0] for r in BATCHES[b]]) * factor)
    flat = losses.contrastive_loss_steps(scores, steps.filter("batch_id < 2"), 0.02).collect()
    assert sorted((r["batch_id"], round(r["scale"], 6)) for r in flat) == [(0, 50.0), (1, 50.0)]


def test_teacher_is_of_the_same_batch(spark):
    rows = [(b, r, "qk", c, float(s[r, c]), 2 * r, c // 2, c % 2)
            for b, s in enumerate([np.array([[2.0, 1.0, 0.5, -1.0], [0.2, 0.1, 1.5, 0.3]]),
                                   np.array([[0.1, 0.4, 0.2, 0.3], [1.0, 0.5, -0.5, 2.0]])])
            for r in range(2) for c in range(4)]
    scores = spark.createDataFrame(rows, "batch_id long, row_id long, block string, col long, score double, "
                                         "target long, key_row long, key_slot int")
    wanted = {(0, 0): [3.0, 1.0], (0, 1): [2.0, 2.5], (1, 0): [0.0, 1.0], (1, 1): [-1.0, 1.0]}
    teacher = spark.createDataFrame([(b, r, k, v) for (b, r), t in wanted.items() for k, v in enumerate(t)],
                                    "batch_id long, row_id long, slot int, teacher double")
    out = losses.kd_biencoder_loss(scores, teacher, 0.5).first()
    student = {(b, r): np.array([v for bb, rr, _, c, v, _, owner, _ in rows if (bb, rr, owner) == (b, r, r)]) / 0.5 for b, r in wanted}
    kl = np.mean([np.sum(np.exp(lsm(np.array(t))) * (lsm(np.array(t)) - lsm(student[k]))) for k, t in wanted.items()])
    assert out["kl"] == pytest.approx(kl)
