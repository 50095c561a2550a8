"""The pipeline over a small table, stage by stage, and its registration."""

import random

import corpus_pipeline
from conceptsearch.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import changed, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(QUERIES) <= set(names)


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    item = prose(30, rng)
    rows = [(k, prose(80, rng), "en", f"s{k % 2}", 1) for k in range(60)]
    rows += [(100, changed(rows[3][1], 75), "en", "s0", 1), (101, rows[4][1], "en", "s1", 1)]
    rows += [(200, "too short", "en", "s0", 1), (201, None, None, None, None)]
    rows += [(300, prose(20, rng) + " " + item + " " + prose(20, rng), "en", "s1", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        ids.append(sorted(r["doc_id"] for r in docs.collect()))
        if k < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert ids[0] == [*range(60), 100, 101, 300]
    assert ids[1] == [*range(60), 300]
    assert ids[2] == [*range(60)]
    assert ids[3] == ids[4] and set(ids[3]) <= set(range(60)) and max(map(ids[3].count, ids[3])) <= 3
    total = sum(len(brute.words(rows[k][1])) for k in range(60))
    assert abs(sum(len(brute.words(rows[k][1])) for k in ids[3]) - total) <= 160
    assert {"shard", "slot"} <= set(docs.columns)
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).columns) == sorted(docs.columns)
