"""Exact repeats where hashes are dealt over several levels, against plain Python."""

import random

import pytest

from conceptsearch.llm import substrings
from tests.llm import brute


def rows_of(seed):
    rng = random.Random(seed)
    passage = [" ".join(f"p{rng.randrange(500)}" for _ in range(60)) for _ in range(4)]
    rows = []
    for k in range(160):
        parts = [" ".join(f"w{rng.randrange(9000)}" for _ in range(rng.randrange(0, 60)))]
        if k % 3 == 0:
            parts.insert(rng.randrange(2), passage[k % 4])
        rows.append((k, " ".join(parts)))
    return rows + [(None, passage[0]), (7, passage[1]), (500, None), (501, "short text")]


def test_largest_id_and_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    text = " ".join(f"p{k}" for k in range(30))
    df = spark.createDataFrame([(2**63 - 1, text), (None, text), (3, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup(df).collect()}
    assert got[3] == 0 and got[None] == 30 and got[2**63 - 1] == 30
    assert {t.name for t in spark.catalog.listTables()} == before


@pytest.mark.parametrize("fan, bucket, chunk", [(2, 400, 1500), (3, 1000, 4000), (256, 200, 1000)])
def test_levels_give_the_same_repeats(spark, monkeypatch, fan, bucket, chunk):
    monkeypatch.setattr(substrings, "FAN", fan)
    monkeypatch.setattr(substrings, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    rows = rows_of(fan)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.kept_digests(df).collect()), key=repr)
    want = sorted(((i, *x) for (i, _), x in zip(rows, brute.substrings(rows))), key=repr)
    # rows of one id are ordered as they are read: which of the two keeps the passage is open
    assert [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7]
    assert sum(n for i, _, n, _ in got if i == 7) == sum(n for i, _, n, _ in want if i == 7)


def test_a_task_merges_a_bucket_of_words(spark, monkeypatch, tmp_path):
    """With a few more buckets than nodes, rows are not merged by whole chunks."""
    rng = random.Random(5)
    words = [" ".join(f"w{rng.randrange(9000)}" for _ in range(100)) for _ in range(158)] + [" ".join(f"p{k}" for k in range(100))] * 2
    monkeypatch.setattr(substrings, "FAN", 16)
    monkeypatch.setattr(substrings, "BUCKET_WORDS", 800)   # 20 buckets
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 1000)
    folder = str(tmp_path)

    def watched(make):
        def again(buckets, step):
            inner = make(buckets, step)

            def run(key, rows):
                import uuid

                from conceptsearch.llm.tables import unpack_sorted
                held = [c for c in ("blocks", "others", "hashes") if c in rows]
                n = sum(len(unpack_sorted(x)) for c in held for x in rows[c])
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(f"{held[-1]} {n}")
                return inner(key, rows)

            return run

        return again

    for name in ("_grams_again", "_runs_again"):
        monkeypatch.setattr(substrings, name, watched(getattr(substrings, name)))
    df = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").repartition(40)
    got = {r["doc_id"]: r["n_removed"] for r in substrings.kept_digests(df).collect()}
    assert got == {k: 100 * (k == 159) for k in range(160)}
    seen = [p.read_text().split() for p in tmp_path.iterdir()]
    assert {kind for kind, _ in seen} == {"others", "hashes"}
    assert max(int(n) for _, n in seen) <= 4 * 800
