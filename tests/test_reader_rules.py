"""Readers and sinks on malformed lines, large ids and stopped runs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import normalize_qa_text
from conceptsearch.operators import text
from conceptsearch.sources import text_formats as tf
from conceptsearch.sources import vectors


def _write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.mark.parametrize("reader, good, bad", [
    (tf.scan_queries, "1\ta", "1 a"), (tf.scan_qrels, "1\t0\t2\t1", "1\t0\t2"), (tf.scan_run_lenient, "1\t2\t1", "1\t2")])
def test_malformed_lines_fail_the_read(spark, tmp_path, reader, good, bad):
    assert reader(spark, _write(tmp_path, "good", [good])).count() == 1
    with pytest.raises(Exception, match="malformed line"):
        reader(spark, _write(tmp_path, "bad", [good, bad])).collect()


def test_part_files_order_by_number(spark, tmp_path):
    for k, value in ((10001, "early"), (100000, "late")):
        (tmp_path / f"part-{k}").write_text(f"q\t{value}\n")
    assert tf.scan_queries(spark, str(tmp_path)).first()["query"] == "late"


def test_masks_cover_long_texts(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20_000)))], "doc_id long, text string")
    mask = text.whole_word_mask(text.token_arrays(docs), 0.15).first()["mask"]
    assert sum(mask) == round(20_002 * 0.15) and sum(mask[15_000:]) > 500


def test_half_published_shards_are_written_again(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double")).alias("v"))
    path = str(tmp_path / "shards")
    os.makedirs(path + "._shards")      # what a run leaves that stops while naming its files
    (tmp_path / "shards._shards" / "shard_0_0.parquet").write_text("half")
    vectors.write_vector_shards(rows, path, shard_rows=25)
    vectors.write_vector_shards(rows, path, shard_rows=25)
    assert vectors.scan_vector_shards(spark, path).count() == 100


@pytest.mark.parametrize("raw, want", [
    ('"a ""b"" c"', 'a "b" c'), ("plain", "plain"), ('"', ""), ('""', ""), ('"""x"""', "x"), ('"open', '"open'), (None, None), ("", "")])
def test_quotes(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(normalize_qa_text(F.col("t")).alias("x")).first()["x"] == want


def test_the_mask_gets_places_and_no_tokens(spark):
    """Python receives the places of special tokens and word starts only."""
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    out = text.whole_word_mask(text.token_arrays(docs), 0.3)
    udf = [line for line in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in line][0]
    assert "masks(toks" not in udf


@pytest.mark.parametrize("seed", range(20))
def test_greedy_words_one_by_one(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    special = np.unique(np.r_[0, rng.integers(0, n, 2), n - 1])
    plain = np.setdiff1d(np.arange(n), special)
    if not plain.size:
        return
    starts = np.unique(np.r_[plain[0], rng.choice(plain, max(1, plain.size // 4))])
    order, prob = rng.permutation(starts), float(rng.uniform(0.05, 0.9))
    words = {s: [i for i in plain if s <= i and not any(s < t <= i for t in starts)] for s in starts}
    want, target = set(), max(1, round(n * prob))
    for s in order:
        if len(want) + len(words[s]) <= target:
            want |= set(words[s])
    assert set(np.flatnonzero(text._word_mask_np(n, special, order, prob, None))) == want
