"""Exact dedup by the cuckoo-filter index, against plain Python."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from conceptsearch.llm import cuckoo_dedup as C

SCHEMA = "doc_id long, text string"


def keys(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, 32), dtype=np.uint8)


def test_filter_holds_what_was_inserted_until_it_is_removed():
    rng, live, slots = np.random.default_rng(3), keys(3000), C.built(keys(3000), 4)
    assert C.contains(slots, live).all() and (slots != 0).sum() == 3000
    false = C.contains(slots, keys(20000, 9)).mean()
    assert false < 2 * 2 * C.SLOTS / 65536 + 1e-3
    gone = rng.permutation(3000)[:1200]
    C.remove(slots, live[gone])
    stay = np.setdiff1d(np.arange(3000), gone)
    assert C.contains(slots, live[stay]).all() and (slots != 0).sum() == 1800
    assert C.contains(slots, live[gone]).mean() < 0.02
    assert C.insert(slots, live[gone]) and C.contains(slots, live).all()


def test_filter_with_equal_fingerprints():
    alike = keys(6)
    alike[:, :10] = alike[0, :10]         # same buckets, same fingerprint
    slots = C.built(alike, 3)
    C.remove(slots, alike[:4])
    assert (slots != 0).sum() == 2 and C.contains(slots, alike).all()
    C.remove(slots, alike[4:])
    assert not slots.any()


def test_full_filter_says_so():
    slots = np.zeros((4, C.SLOTS), np.uint16)
    assert not C.insert(slots, keys(17))


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def brute(rows):
    ids = {}
    for i, t in rows:
        ids.setdefault(normal(t), []).append(i)
    out, taken = [], set()
    for i, t in rows:
        own = sorted(ids[normal(t)], key=lambda x: (x is None, x))
        kept = i == own[0] and normal(t) not in taken
        if kept:
            taken.add(normal(t))
        out.append((i, own[0], len(own), kept, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(4)
    rows = [(k, rng.choice(["a b", "a  b", "a\n\tb", " a b", "a b ", "", None, " ", "é x", "A b"])) for k in range(90)]
    rows += [(200 + k, "hot text") for k in range(60)] + [(5, "same row"), (5, "same row"), (None, "same row")]
    rows += [(None, "no id"), (None, "no id"), (300, "word " * 60000), (301, "word\n" * 60000)]
    return rows + [(400 + k, f"text {k}") for k in range(300)]


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in df.collect()), key=repr)


def test_groups_match_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    clashing = docs.withColumns({c: F.lit("x") for c in ("digest", "id", "tag", "first", "shard", "size", "own", "n", "maybe")})
    assert result(C.groups(clashing)) == brute(rows)
    assert result(C.groups(docs, waves=3)) == brute(rows)


def test_deduplicate_keeps_columns(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit("x"), "id": F.lit(1), "own": F.lit(2)})
    out = C.deduplicate(docs)
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], normal(r["text"])) for r in out.collect()), key=repr)
    first = {normal(t): min((i for i, u in rows if normal(u) == normal(t)), key=lambda x: (x is None, x or 0)) for _, t in rows}
    assert kept == sorted(((i, t) for t, i in first.items()), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert result(C.groups(empty)) == [] and C.deduplicate(empty).count() == 0


def test_index_grows_from_stored_keys_and_deletes(spark):
    first = C.digests(spark.range(200).selectExpr("id AS doc_id", "concat('t ', id) AS text"))
    more = C.digests(spark.range(100, 20000).selectExpr("id AS doc_id", "concat('t ', id) AS text"))
    small = C.Index(spark, 3).insert(first)
    sizes = {r["shard"]: r["log2"] for r in small.filters.collect()}
    index = small.insert(more)
    assert all(r["log2"] > sizes[r["shard"]] and not r["full"] for r in index.filters.collect())
    assert index.contents().count() == 20000
    assert {r["n"] for r in index.contents().join(first.select("digest"), "digest").collect()} == {1, 2}
    assert sum(int((np.frombuffer(r["slots"], "<u2") != 0).sum()) for r in index.filters.collect()) == 20000
    gone = C.digests(spark.range(0, 30000, 3).selectExpr("id AS doc_id", "concat('t ', id) AS text"))
    less = index.delete(gone)
    assert less.contents().count() == 20000 - 6667
    assert sum(int((np.frombuffer(r["slots"], "<u2") != 0).sum()) for r in less.filters.collect()) == 20000 - 6667
    known, new = less.lookup(more.select("digest", "size").distinct())
    dead = len(range(102, 20000, 3))
    assert new.count() == dead and known.count() == 19900 - dead
    back = less.insert(gone)
    assert back.contents().count() == 20000 + len(range(20001, 30000, 3)) and back.resharded(7).filters.count() == 7
    assert index.contents().count() == 20000          # versions stay as they are
    assert C.Index(spark, 3).delete(gone).filters is None
