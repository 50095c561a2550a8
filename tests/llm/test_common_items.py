"""Short benchmark items that are common words, and typographic punctuation."""

import random

import pytest
from pyspark.sql import functions as F

from conceptsearch.llm import decontamination as D

BENCH = "item_id long, text string"


def corpus(spark):
    rng = random.Random(2)
    rows = [(k, "the " + " ".join(f"w{rng.randrange(300)}" for _ in range(40))) for k in range(300)]
    rows += [(400, "x rare phrase y " * 3), (401, "a long item " + " ".join(f"q{k}" for k in range(15)) + " end")]
    return spark.createDataFrame(rows, "doc_id long, text string")


ITEMS = [(1, "the"), (2, "rare phrase"), (3, " ".join(f"q{k}" for k in range(15))), (None, "The!")]


@pytest.mark.parametrize("limit", [1000, 0])
def test_common_words_are_reported_and_remove_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_COMMON", limit)
    docs, bench = corpus(spark), spark.createDataFrame(ITEMS, BENCH)
    kept = D.decontaminate(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(300))
    report = D.item_report(D.contaminated(docs, bench), docs.count())
    assert sorted((r["item_id"], r["words"], r["found"], r["removes"]) for r in report.collect()) == \
        [(1, 1, 300, False), (2, 2, 1, True), (3, 15, 1, True)]
    assert D.leaks(docs, bench).count() == 302
    assert D.decontaminate(docs, bench, common_share=1.0).count() == 0


def test_a_long_item_removes_however_often_it_is_found(spark):
    item = " ".join(f"q{k}" for k in range(15))
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("so " + item).alias("text"))
    assert D.decontaminate(docs, spark.createDataFrame([(3, item)], BENCH)).count() == 0


def test_typographic_punctuation_parts_words(spark):
    words = [f"q{k}" for k in range(15)]
    texts = ["“" + "” – ‘".join(words) + "’", "…".join(words), "—".join(words), "«" + " ".join(words) + "»", "é".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = D.contaminated(docs, spark.createDataFrame([(3, " ".join(words))], BENCH)).collect()
    assert sorted((r["doc"], r["agreed"]) for r in found) == [(0, 15), (1, 15), (2, 15), (3, 15)]
