"""Row numbers, the vocabulary, and masks that draw from it."""

import hashlib

from pyspark.sql import functions as F

from conceptsearch.operators import numbering, text
from conceptsearch.operators.search import rank_unbounded

SCHEMA = "doc_id long, text string"


def test_numbers_are_dense_and_in_order(spark):
    rows = [(k * 7919 % 1000, "x" if k % 3 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, _place string").repartition(6)
    out = numbering.number_rows(df, [F.col("k").desc()])
    assert out.columns == ["k", "_place", "position"]
    assert sorted((r["position"], r["k"]) for r in out.collect()) == [(p, 999 - p) for p in range(1000)]
    assert numbering.number_rows(df.filter("false"), [F.col("k").asc()]).count() == 0


def test_numbers_survive_equal_rows(spark):
    df = spark.createDataFrame([(1,)] * 300 + [(0,)] * 2 + [(None,)], "k int").repartition(5)
    got = sorted((r["position"], r["k"]) for r in numbering.number_rows(df, [F.col("k").asc_nulls_first()]).collect())
    assert [p for p, _ in got] == list(range(303)) and [k for _, k in got[:4]] == [None, 0, 0, 1]


def test_unbounded_ranks(spark):
    pairs = [(q, p, float((q * 31 + p * 17) % 13)) for q in range(4) for p in range(50)]
    got = {(r["qid"], r["pid"]): r["rank"] for r in
           rank_unbounded(spark.createDataFrame(pairs, "qid long, pid long, score double")).collect()}
    for q in range(4):
        order = sorted((-s, p) for qq, p, s in pairs if qq == q)
        assert [got[q, p] for _, p in order] == list(range(1, 51))


def docs(spark):
    rows = [(k, " ".join(f"w{(k * j) % 37}" for j in range(1, 60))) for k in range(30)]
    rows += [(40, ""), (41, None), (42, "only"), (5, "another text of the same id " * 8), (None, "no id at all " * 9)]
    return text.token_arrays(spark.createDataFrame(rows, SCHEMA))


def test_vocabulary_counts_every_token(spark):
    tokens = docs(spark)
    want: dict[str, int] = {}
    for r in tokens.collect():
        for t in r["toks"] or ():
            want[t] = want.get(t, 0) + 1
    got = text.vocabulary(tokens).collect()
    assert sorted((r["token_id"], r["token"], r["n"]) for r in got) == [(k, t, want[t]) for k, t in enumerate(sorted(want))]


def number(seed, tag, doc, i, digits):
    key = ":".join([str(seed), tag, *([str(doc)] if doc is not None else []), str(i)])
    return int(hashlib.md5(key.encode()).hexdigest()[:digits], 16)


def brute_inputs(toks, mask, doc, seed, vocab):
    out = []
    for i, (t, m) in enumerate(zip(toks, mask)):
        if m and number(seed, "r", doc, i, 8) / 2**32 < 0.8:
            t = "[MASK]"
        elif m and number(seed, "x", doc, i, 8) / 2**32 < 0.5:
            t = vocab[number(seed, "p", doc, i, 15) % len(vocab)]
        out.append(t)
    return out


def test_replacements_come_from_the_whole_corpus(spark):
    tokens = docs(spark)
    vocab = text.vocabulary(tokens)
    words = [r["token"] for r in vocab.orderBy("token_id").collect()]
    dual = text.dual_mask(tokens.filter("toks is not null"), 0.4, 0.7, 3)
    out = text.dual_mask_inputs(dual, 9, vocab).collect()
    assert len(out) == dual.count()
    foreign = 0
    for r in out:
        assert r["enc_inputs"] == brute_inputs(r["toks"], r["enc"], r["doc_id"], 9, words)
        assert r["dec_inputs"] == brute_inputs(r["toks"], r["dec"], r["doc_id"], 10, words)
        assert r["enc_labels"] == [t if m else None for t, m in zip(r["toks"], r["enc"])]
        assert r["dec_labels"] == [t if m else None for t, m in zip(r["toks"], r["dec"])]
        assert r["labels"] == [None if t in (text.CLS, text.SEP) else t for t in r["toks"]]
        foreign += sum(t not in r["toks"] and t != "[MASK]" for t in r["dec_inputs"])
    assert foreign > 10


def test_all_mask_tokens(spark):
    dual = text.dual_mask(docs(spark).filter("doc_id = 3"), 0.5, 0.5)
    r = text.dual_mask_inputs(dual, all_use_mask_token=True).first()
    assert r["enc_inputs"] == r["dec_inputs"] == ["[MASK]" if m else t for t, m in zip(r["toks"], r["enc"])]


def test_documents_of_both_tracks_are_written_once_and_not_shuffled(spark, monkeypatch):
    rows = [(k, ["[CLS]", *(f"t{k}_{i}" for i in range(60)), "[SEP]"]) for k in range(20)]
    rows += [(3, ["[CLS]", *(f"again{i}" for i in range(90)), "[SEP]"]), rows[4], (None, ["[CLS]", *(f"n{i}" for i in range(70)), "[SEP]"])]
    tokens = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    vocab = text.vocabulary(tokens)
    words = [r["token"] for r in vocab.orderBy("token_id").collect()]
    dual = text.dual_mask(tokens, 0.4, 0.7, 3)
    paths, real, before = [], text.scratch_path, spark.catalog.listTables()
    monkeypatch.setattr(text, "scratch_path", lambda *a: paths.append(a) or real(*a))
    out = text.dual_mask_inputs(dual, 9, vocab)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == [*dual.columns, "enc_inputs", "enc_labels", "dec_inputs", "dec_labels", "labels"]
    for r in got:
        assert r["enc_inputs"] == brute_inputs(r["toks"], r["enc"], r["doc_id"], 9, words)
        assert r["dec_inputs"] == brute_inputs(r["toks"], r["dec"], r["doc_id"], 10, words)
    assert len(paths) == 1 and spark.catalog.listTables() == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert not [x for x in plan.splitlines() if "Arguments: hashpartitioning" in x and "toks" in x]
