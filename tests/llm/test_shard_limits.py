"""Shards where ranges are sampled again, and ids that are no integers."""

import random

from conceptsearch.llm import sharding


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Whatever the texts: every round's plan must run."""
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 4)
    for seed in range(3):
        rng = random.Random(seed)
        rows = [(k, "hot" * 5 if k % 3 == 0 else " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(1, 40)))) for k in range(2000)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in sharding.assignment(df).collect())
        assert [r[0] for r in got] == list(range(2000))
        sums = [sum(r[1] for r in got if r[2] == s) for s in range(16)]
        assert max(sums) - min(sums) <= 2 * max(r[1] for r in got)
        for s in range(16):
            assert sorted(r[3] for r in got if r[2] == s) == list(range(sum(r[2] == s for r in got)))


def test_ids_of_any_type(spark):
    rows = [(f"doc-{k}" if k % 5 else None, f"text {k % 40}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    placed, names = sharding.place(df, 4)
    got = placed.collect()
    assert len(got) == 300 and {r[names["shard"]] for r in got} == {0, 1, 2, 3}
    again, _ = sharding.place(df.repartition(5), 4)
    key = lambda r: (str(r["doc_id"]), r["text"], r["shard"])
    assert sorted(map(key, got)) == sorted(map(key, again.collect()))
