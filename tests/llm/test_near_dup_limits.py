"""Near-copy groups over many blocks, and how often a similar pair shares a sketch."""

import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from conceptsearch.llm import near_dups as N


def labels(texts):
    return [set(np.frombuffer(x.as_py(), "<u4").tolist()) for x in N._labels(pa.array(texts))[0]]


def planted(words, rng):
    """A text and a copy with one to four words replaced, dropped or added."""
    own = [f"v{rng.randrange(10**6)}" for _ in range(words)]
    copy = list(own)
    for _ in range(rng.choice([1, 1, 1, 2, 3, 4]) if words > 12 else 1):
        at = rng.choice([0, len(copy) - 1, rng.randrange(len(copy))])
        kind = rng.randrange(3)
        if kind == 0 or len(copy) <= 5:
            copy[at] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            del copy[at]
        else:
            copy.insert(at, f"y{rng.randrange(10**6)}")
    return " ".join(own), " ".join(copy)


@pytest.mark.parametrize("words", [8, 9, 12, 16, 24, 40, 60, 120, 300])
def test_similar_pairs_share_a_sketch(words):
    """All planted pairs of 0.8 or more, thousands of each length."""
    rng = random.Random(words)
    similar, missed = 0, 0
    while similar < 1500:
        pairs = [planted(words, rng) for _ in range(500)]
        texts = [t for p in pairs for t in p]
        sets, keys = labels(texts), [set(enumerate(k)) for k in N._sketch(pa.array(texts))[0].to_pylist()]
        for k in range(0, len(texts), 2):
            a, b = sets[k], sets[k + 1]
            if len(a & b) >= N.SIMILAR * len(a | b) - 1e-9 and a != b:
                similar += 1
                missed += not keys[k] & keys[k + 1]
    assert missed == 0, f"{missed} of {similar}"


def rows_of(texts):
    return pd.DataFrame({"node": [bytes([k // 256, k % 256]) for k in range(len(texts))],
                         "labels": [x.as_py() for x in N._labels(pa.array(texts))[0]]})


def groups(n, links):
    label = list(range(n))
    for a, b in links:
        label = [label[b] if x == label[a] else x for x in label]
    first = {}
    return [first.setdefault(x, k) for k, x in enumerate(label)]


def brute_groups(texts):
    parts = [N.place_of(np.frombuffer(x.as_py(), "<u4")) for x in N._labels(pa.array(texts))[0]]
    return groups(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if N.similarity(parts[a], parts[b]) > 0])


def family(rng, words, copies, drift):
    """A text and copies; with drift each is changed from the one before, a chain."""
    out = [[f"v{rng.randrange(10**6)}" for _ in range(words)]]
    for _ in range(copies):
        new = list(out[-1] if drift else out[0])
        new[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(new)
    return [" ".join(t) for t in out]


def test_links_of_a_bucket_lose_none():
    rng = random.Random(3)
    texts = family(rng, 60, 40, False) + family(rng, 60, 25, True) + family(rng, 90, 8, True) + family(rng, 9, 6, False)
    rng.shuffle(texts)
    texts = list(dict.fromkeys(texts))
    found = N._connect(rows_of(texts))
    number = {bytes([k // 256, k % 256]): k for k in range(len(texts))}
    assert groups(len(texts), [(number[a], number[b]) for a, b in zip(found["a"], found["b"])]) == brute_groups(texts)
    assert len(found) == len(texts) - len(set(brute_groups(texts)))     # only links that connect


def test_a_group_of_near_copies_takes_one_pass(monkeypatch):
    calls = []
    real = N.similarity
    monkeypatch.setattr(N, "similarity", lambda *a: calls.append(1) or real(*a))
    texts = family(random.Random(1), 200, 400, False)
    assert len(N._connect(rows_of(texts))) == 400 and len(calls) <= 2 * len(texts)


@pytest.mark.parametrize("block", [150, 400, 3000])
def test_buckets_of_many_blocks_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
    rng = random.Random(5)
    texts = family(rng, 60, 30, False) + family(rng, 60, 20, True) + family(rng, 12, 5, False) + family(rng, 200, 3, True)
    texts = list(dict.fromkeys(texts))
    # all in one bucket, whatever their sketches
    nodes = pd.DataFrame({"k": range(len(texts)), "text": texts})
    docs = spark.createDataFrame(nodes[["k", "text"]].rename(columns={"k": "doc_id"}))
    sketched = N.materialise(N.sketches(docs), "sketches")
    one = sketched.selectExpr("node", "doc", "array(7L) AS keys", "shingles")
    links = N.links(docs, one)
    of = {r["node"]: r["doc"] for r in sketched.collect()}
    got = groups(len(texts), [(of[r["a"]], of[r["b"]]) for r in links.collect()])
    assert got == brute_groups(texts)
