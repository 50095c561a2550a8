"""IR metrics against an independent pure-Python implementation of the
trec_eval conventions (score desc, then doc id as text desc)."""

import math

import pytest

from conceptsearch.operators import metrics

RUN = [  # qid, pid, rank, score
    ("1", "9", 1, 3.0), ("1", "10", 2, 3.0), ("1", "4", 3, 2.5), ("1", "7", 4, 1.0),
    ("1", "8", 5, 0.5),
    ("2", "1", 1, 1.0), ("2", "2", 2, 0.9), ("2", "3", 3, 0.8),
    ("5", "1", 1, 1.0),                       # query only in the run
]
QRELS = [  # qid, pid, rel
    ("1", "10", 3), ("1", "7", 1), ("1", "99", 2), ("1", "4", 0),
    ("2", "3", 1), ("2", "50", 1),
    ("3", "1", 2),                            # query only in the qrels
]


def trec_order(rows):
    return sorted(rows, key=lambda r: (-float(r[3]), tuple(-ord(c) for c in r[1])))


def ref_metrics(run, qrels, ks, scope="inner"):
    q_run = {r[0] for r in run}
    rel = {}
    for q, p, g in qrels:
        rel.setdefault(q, {})[p] = g
    qs = sorted(rel) if scope == "left" else sorted(q for q in rel if q in q_run)
    out = {}
    for k in ks:
        nd, rc, mp = [], [], []
        for q in qs:
            docs = trec_order([r for r in run if r[0] == q])[:k]
            gains = [rel[q].get(r[1], 0) for r in docs]
            dcg = sum(g / math.log2(i + 2) for i, g in enumerate(gains) if g > 0)
            ideal = sorted((g for g in rel[q].values() if g > 0), reverse=True)[:k]
            idcg = sum(g / math.log2(i + 2) for i, g in enumerate(ideal))
            nd.append(dcg / idcg if idcg else 0.0)
            n_rel = sum(1 for g in rel[q].values() if g >= 1)
            hits, ap = 0, 0.0
            for i, g in enumerate(gains):
                if g >= 1:
                    hits += 1
                    ap += hits / (i + 1)
            rc.append(hits / n_rel if n_rel else 0.0)
            mp.append(ap / n_rel if n_rel else 0.0)
        out[f"NDCG@{k}"] = round(sum(nd) / len(qs), 5)
        out[f"Recall@{k}"] = round(sum(rc) / len(qs), 5)
        out[f"MAP@{k}"] = round(sum(mp) / len(qs), 5)
    return out


@pytest.fixture
def tables(spark):
    run = spark.createDataFrame(RUN, "qid string, pid string, rank int, score double")
    qrels = spark.createDataFrame(QRELS, "qid string, pid string, rel int")
    return run, qrels


@pytest.mark.parametrize("scope", ["inner", "left"])
def test_trec_eval_matches_reference_python(tables, scope):
    run, qrels = tables
    got = {r["metric"]: r["value"] for r in metrics.trec_eval(run, qrels, (1, 2, 3, 10), scope)
           .collect()}
    exp = ref_metrics(RUN, QRELS, (1, 2, 3, 10), scope)
    assert got == pytest.approx(exp)


def test_string_id_tie_order(tables):
    # tied scores: pid "9" sorts after "10" as text descending -> "9" first
    run, _ = tables
    ranked = metrics.trec_rank(run.filter("qid = '1'"), None).orderBy("rank").collect()
    assert [r["pid"] for r in ranked[:2]] == ["9", "10"]


def test_mrr_trec(tables):
    run, qrels = tables
    v = metrics.mrr_trec(run, qrels, 10).first()["value"]
    # query 1: trec order 9, 10 (rel 3) -> 1/2 ; query 2: 1, 2, 3 (rel 1) -> 1/3
    assert v == pytest.approx((1 / 2 + 1 / 3) / 2)


def test_rel_threshold_and_msmarco_mrr(spark, tables):
    run, qrels = tables
    assert metrics.rel_threshold(qrels).first()["threshold"] == 2
    no3 = qrels.filter("rel < 3")
    assert metrics.rel_threshold(no3).first()["threshold"] == 1
    # threshold 2: only (1, 10, 3) and (1, 99, 2) count; run order: 9, 10 -> 1/2;
    # divided by all three qrels queries, x100
    v = metrics.mrr_msmarco(run, qrels, 10).first()["value"]
    assert v == pytest.approx(round((1 / 2) / 3 * 100, 4))


def test_accuracy_and_batch_mrr(spark):
    rows = [(0, 0, 0.9, 0), (0, 1, 0.5, 0), (0, 2, 0.1, 0),
            (1, 0, 0.9, 1), (1, 1, 0.5, 1), (1, 2, 0.7, 1)]
    df = spark.createDataFrame(rows, "row_id long, col long, score double, target long")
    acc = {r["metric"]: r["value"] for r in metrics.accuracy_at_k(df, (1, 2)).collect()}
    assert acc == pytest.approx({"acc1": 50.0, "acc2": 50.0})
    assert metrics.batch_mrr(df).first()["value"] == pytest.approx((100 / 1 + 100 / 3) / 2)
