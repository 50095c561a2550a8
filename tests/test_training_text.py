"""Training-set assembly, text helpers and losses on hand-made tables."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import (normalize_qa_text, parse_answer_list,
                                            parse_interpretation)
from conceptsearch.operators import losses, text
from conceptsearch.operators import training_data as td

REC_SCHEMA = ("query_id string, query string, positives struct<doc_id:array<string>,score:array<double>>, "
              "negatives struct<doc_id:array<string>,score:array<double>>")


def records(spark, rows):
    return spark.createDataFrame(rows, REC_SCHEMA)


def test_group_doc_ids_rotation(spark):
    rec = records(spark, [("q1", "t", (["p0", "p1"], [3.0, 2.0]), (["n0", "n1", "n2"], [1.0, 0.5, 0.2])),
                          ("q2", "t", (["p0"], [1.0]), (["n0"], [0.1])),     # shorter than the step
                          ("q3", "t", (["p0"], [1.0]), ([], []))])           # no negatives: dropped
    got = {}
    for r in td.group_doc_ids(rec, 2, 3).collect():
        got.setdefault(r["query_id"], {})[r["slot"]] = r["doc_id"]
    # positive pos[3 % 2] = p1; negatives neg[(3*2 + i) % 3] = n0, n1
    assert got["q1"] == {0: "p1", 1: "n0", 2: "n1"}
    assert got["q2"] == {0: "p0", 1: "n0", 2: "n0"}
    assert "q3" not in got


def test_first_positive_filter(spark):
    rec = records(spark, [("q", "t", (["a", "b", "c", "d"], [2.0, 2.0, 1.5, 0.1]), (["n"], [1.0]))])
    kept = td.first_positive_filter(rec).first()["positives"]["doc_id"]
    # a: first; b: ties the first; c: above max negative; d: neither
    assert list(kept) == ["a", "b", "c"]


def test_rerank_tail_merge(spark):
    head = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.95)], "qid long, pid long, score double")
    orig = spark.createDataFrame([(1, p, r) for r, p in enumerate([11, 10, 12, 13], 1)] +
                                 [(2, 5, 1)], "qid long, pid long, rank long")
    got = [(r["pid"], r["rank"], r["score"]) for r in
           td.rerank_tail_merge(head, orig, 2).orderBy("qid", "rank").collect()]
    assert got == [(11, 1, 0.95), (10, 2, 0.9), (12, 3, pytest.approx(-0.1)), (13, 4, pytest.approx(-1.1))]


def test_rerank_tail_of_length_zero(spark):
    head = spark.createDataFrame([(1, 10, 0.5)], "qid long, pid long, score double")
    orig = spark.createDataFrame([(1, 10, 1)], "qid long, pid long, rank long")
    assert td.rerank_tail_merge(head, orig, 5).count() == 1


def test_merge_teacher_scores_drops_unscored_negatives(spark):
    rec = records(spark, [("q", "t", (["a"], [0.0]), (["x", "y", "z"], [0.0, 0.0, 0.0]))])
    teacher = spark.createDataFrame([("q", "a", 5.0), ("q", "z", 1.0), ("q", "x", 2.0)],
                                    "query_id string, doc_id string, score double")
    out = td.merge_teacher_scores(rec, teacher).first()
    assert list(out["positives"]["score"]) == [5.0]
    assert list(out["negatives"]["doc_id"]) == ["x", "z"]


def test_latest_score_wins(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "a", 2.0, 3), ("q", "a", 9.0, 2)],
                               "query_id string, doc_id string, score double, line long")
    assert td.latest_scores(df, "line").first()["score"] == 2.0


def test_holdout_split_size(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    split = td.holdout_split(df, "doc_id", 17, seed=3)
    assert split.filter("split = 'eval'").count() == 17


def test_contiguous_shard_sizes(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    sizes = [r["count"] for r in text.contiguous_shard(df, "pos", 3).groupBy("shard").count()
             .orderBy("shard").collect()]
    assert sizes == [4, 3, 3]


def test_whole_word_mask_greedy_skip(spark):
    toks = ["[CLS]", "a", "##b", "##c", "d", "e", "[SEP]"]
    df = spark.createDataFrame([(1, toks)], "doc_id long, toks array<string>")
    out = text.explode_mask(text.whole_word_mask(df, 0.3, seed=0)).orderBy("pos").collect()
    masked = [r["token"] for r in out if r["masked"] == 1]
    # target = round(7 * 0.3) = 2 pieces: the three-piece word never fits
    assert len(masked) <= 2 and masked
    assert not {"a", "##b", "##c"} & set(masked)
    assert out[0]["masked"] == 0 and out[-1]["masked"] == 0


def test_whole_word_mask_takes_words_in_hash_order(spark):
    """A word is masked exactly if it fits behind the masked words before it."""
    rng = np.random.default_rng(5)
    docs = []
    for d in range(30):
        n = int(rng.integers(0, 60))
        toks = ["[CLS]"] + [("##" if rng.random() < 0.3 else "") + f"t{int(rng.integers(0, 9))}"
                            for _ in range(n)] + ["[SEP]"]
        if d % 7 == 0:
            toks.insert(len(toks) // 2, "[SEP]")
        docs.append((d, toks))
    df = spark.createDataFrame(docs, "doc_id long, toks array<string>")
    got = {r["doc_id"]: list(r["mask"]) for r in text.whole_word_mask(df, 0.2, seed=9).collect()}
    for d, toks in docs:
        special = [t in ("[CLS]", "[SEP]") for t in toks]
        plain = [i for i, x in enumerate(special) if not x]
        starts = [i for i in plain if not toks[i].startswith("##") or i == plain[0]]
        members = {s: [i for i in plain if s <= i and not any(s < t <= i for t in starts)] for s in starts}
        rank = {s: hashlib.md5(f"9:{d}:{s}".encode()).hexdigest() for s in starts}
        masked = {i for i, m in enumerate(got[d]) if m}
        chosen = [s for s in starts if s in masked]
        target = max(1, round(len(toks) * 0.2))
        assert masked == {i for s in chosen for i in members[s]} and len(masked) <= target
        for s in starts:
            before = sum(len(members[c]) for c in chosen if rank[c] < rank[s])
            assert (s in masked) == (before + len(members[s]) <= target), (d, s)


def test_dual_mask_contains_encoder_mask(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(40))) for i in range(5)],
                                 "doc_id long, text string")
    out = text.dual_mask(text.token_arrays(docs), 0.2, 0.5).collect()
    assert all(d >= e for r in out for e, d in zip(r["enc"], r["dec"]))
    assert sum(sum(r["dec"]) for r in out) > sum(sum(r["enc"]) for r in out)


def test_qa_text_helpers(spark):
    df = spark.createDataFrame([('"a ""b"" c"', "\"['x', 'y z']\""), ("plain", "['only']")],
                               "q string, a string")
    out = df.select(normalize_qa_text("q").alias("q"),
                    parse_answer_list(normalize_qa_text("a")).alias("a")).collect()
    assert out[0]["q"] == 'a "b" c' and list(out[0]["a"]) == ["x", "y z"]
    assert out[1]["q"] == "plain" and list(out[1]["a"]) == ["only"]


def test_parse_interpretation(spark):
    df = spark.createDataFrame([("x [interpretation]: a [interpretation]:  final one \n",),
                                ("  no marker here ",)], "t string")
    got = [r[0] for r in df.select(parse_interpretation("t")).collect()]
    assert got == ["final one", "no marker here"]


def test_running_mean_resets_per_epoch_and_chunks(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"epoch": np.repeat([0, 1], 50), "step": np.arange(100),
                        "value": rng.normal(size=100), "n": rng.integers(1, 4, size=100)})
    df = spark.createDataFrame(pdf)
    got = losses.running_mean(df, "epoch", "step", "value", "n", chunk_rows=7).toPandas() \
        .sort_values("step")
    exp = (pdf.assign(vw=pdf.value * pdf.n).groupby("epoch")[["vw", "n"]].cumsum())
    assert got["running_mean"].to_numpy() == pytest.approx((exp.vw / exp.n).to_numpy())


def test_contrastive_loss_matches_numpy(spark):
    s = np.array([[2.0, 0.5, -1.0], [0.1, 0.3, 0.2]])
    target = [0, 2]
    rows = [(0, r, c, float(s[r, c]), target[r]) for r in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "batch_id long, row_id long, col long, score double, target long")
    got = losses.contrastive_loss(df, 0.5).first()["loss"]
    z = s / 0.5
    lp = z - z.max(axis=1, keepdims=True)
    lp = lp - np.log(np.exp(lp).sum(axis=1, keepdims=True))
    assert got == pytest.approx(-np.mean([lp[0, 0], lp[1, 2]]))


def test_kd_kl_loss_matches_numpy(spark):
    t = np.array([1.0, 0.2, -0.5])
    s = np.array([0.3, 0.9, 0.1])
    rows = [("q", i, float(t[i]), float(s[i])) for i in range(3)]
    df = spark.createDataFrame(rows, "query_id string, slot long, teacher double, score double")
    out = losses.kd_kl_loss(df, ce_weight=0.5).first()

    def lsm(x):
        return x - x.max() - math.log(np.exp(x - x.max()).sum())
    kl = float(np.sum(np.exp(lsm(t)) * (lsm(t) - lsm(s))))
    assert out["kl"] == pytest.approx(kl)
    assert out["loss"] == pytest.approx(kl + 0.5 * -lsm(s)[0])


def test_kd_biencoder_loss_with_hard_negative_mask(spark):
    # two rows, two keys each (slot 0 positive, slot 1 hard negative)
    s = np.array([[2.0, 1.0, 0.5, -1.0], [0.2, 0.1, 1.5, 0.3]])
    rows = [(0, r, "qk", c, float(s[r, c]), 2 * r, c // 2, c % 2) for r in range(2) for c in range(4)]
    scores = spark.createDataFrame(rows, "batch_id long, row_id long, block string, col long, score double, "
                                         "target long, key_row long, key_slot int")
    teacher = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0), (1, 0, 2.0), (1, 1, 2.5)],
                                    "row_id long, slot int, teacher double")
    out = losses.kd_biencoder_loss(scores, teacher, 0.5, 0.3, mask_hard_negatives=True).first()

    def lsm(x):
        return x - x.max() - math.log(np.exp(x - x.max()).sum())
    t = {0: np.array([3.0, 1.0]), 1: np.array([2.0, 2.5])}
    kl = np.mean([np.sum(np.exp(lsm(t[r])) * (lsm(t[r]) - lsm(s[r, 2 * r: 2 * r + 2] / 0.5)))
                  for r in range(2)])
    ce = []
    for r in range(2):
        keep = [c for c in range(4) if not (c // 2 == r and c % 2 == 1)]
        z = s[r, keep] / 0.5
        ce.append(-lsm(z)[keep.index(2 * r)])
    assert out["kl"] == pytest.approx(kl)
    assert out["ce"] == pytest.approx(np.mean(ce))
    assert out["loss"] == pytest.approx(0.3 * np.mean(ce) + kl)
