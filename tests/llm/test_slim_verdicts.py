"""Host rules on written measures agree with those on whole rows."""

from pyspark.sql import functions as F

from conceptsearch.llm import quality_rules


def test_both_ways_agree(spark):
    rows = [(k, "again and again " * (k % 9) + f"word{k} " * 3, None if k % 11 == 0 else f"s{k % 4}") for k in range(120)]
    rows += [(200, None, "s1"), (None, "", None), (5, "twice " * 30, "s9"), (5, "twice " * 30, "s9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clashing = docs.withColumns({c: F.lit("x") for c in ("kept", "bad_host", "host")})
    whole, names = quality_rules.verdicts(clashing)
    slim, own = quality_rules.slim_verdicts(docs)
    columns = [*quality_rules.MEASURES, "base_failed", "kept"]
    assert sorted((tuple(r[names[c]] for c in columns) for r in whole.collect()), key=repr) == \
        sorted((tuple(r[own[c]] for c in columns) for r in slim.collect()), key=repr)
    assert "text" not in slim.columns
