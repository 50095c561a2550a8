"""Hard negatives by Hilbert blocks and zone maps, against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptsearch.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_neighbours_along_the_curve_are_neighbours_in_space():
    for d, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        key = H.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        along = cells[np.argsort(key)]
        assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    for size in (100, 10**9, 10**15):
        a, b = rng.integers(-size, size, (20, 6)), rng.integers(-size, size, (50, 6))
        least, most = H.bounds(a, b.min(0)[None], b.max(0)[None])
        exact = a.astype(object) @ b.T.astype(object)
        assert (exact >= least).all() and (exact <= most).all()


def test_scores_are_exact():
    rng = np.random.default_rng(3)
    for size in (10**3, 2**28, 2**30):
        a, b = rng.integers(-size, size, (5, 3)), rng.integers(-size, size, (7, 3))
        assert (H.scores(a, b).astype(object) == a.astype(object) @ b.T.astype(object)).all()
    with pytest.raises(OverflowError):
        H.scores(np.full((1, 4), 2**40), np.full((1, 4), 2**40))


def test_best_takes_first_columns_of_ties():
    score = np.array([[3, 5, 5, 5, 1], [2, 2, 2, 2, 2]])
    allowed = np.array([[True, True, False, True, True], [False, True, True, True, False]])
    for factor in (1, 2**60):
        rows, columns = H.best(score * factor, allowed, 2)
        assert sorted(zip(rows.tolist(), columns.tolist())) == [(0, 1), (0, 3), (1, 1), (1, 2)]


def brute(rows, k=5, low=80, high=100):
    own = []
    for tag, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        own.append((tag, i, label, [math.floor(256 * float(np.float32(x))) for x in v]))

    def order(scored):
        return sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))

    out = []
    for tag, i, label, v in own:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other, t) for t, j, other, w in own if t != tag]
        for ps, j, *_ in order(x for x in scored if x[2] == label)[:k]:
            inside = order(x for x in scored if x[2] != label and low * ps <= 100 * x[0] <= high * ps)[:k]
            out += [(i, j, n + 1, x[1], ps, x[0]) for n, x in enumerate(inside)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def odd_rows():
    rng = random.Random(8)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]

    def near(c):
        return [x + rng.gauss(0, 0.1) for x in centres[c]]

    rows = [(k, near(k % 4), 1 if k % 3 else k % 10) for k in range(500)]
    rows += [(700 + k, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0], k % 2) for k in range(40)]      # ties
    rows += [(800, near(1), None), (801, None, 3), (900, [0.1, None, 0.2, 0.1, 0.1, 0.1], 3),
             (1000, [0.1, float("nan"), 0.1, 0.1, 0.1, 0.1], 3), (1001, [float("inf")] * 6, 2),
             (None, near(2), 1), (None, near(2), 4), (1100, [0.5, 0.5], 1), (1200, [], 1), (1300, near(3), 77),
             (300, near(0), 1), (300, near(0), 1), (1400, [1e5, -3e6, 2.0, 0.0, 0.0, 0.0], 1), (1401, [2e5, -1e6, 2.0, 1.0, 0.0, 0.0], 2)]
    return rows


@pytest.mark.parametrize("size, slab", [((64, 8192), 4096), ((5, 7), 3)])
def test_matches_brute_force(spark, monkeypatch, size, slab):
    monkeypatch.setattr(H, "BLOCK_ROWS", size)
    monkeypatch.setattr(H, "SLAB", slab)
    monkeypatch.setattr(H, "LEAST_LOTS", 4)
    monkeypatch.setattr(H, "LEAST_ZONES", 2)
    monkeypatch.setattr(H, "SCORES", 300)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({c: F.lit("x") for c in ("id", "tag", "key", "vector", "anchor", "block")})
    assert got(H.hard_negatives(df)) == brute(rows)


def test_zone_maps_leave_blocks_out(spark, monkeypatch):
    """Two far clusters: an anchor's windows need the blocks of its own only."""
    monkeypatch.setattr(H, "BLOCK_ROWS", (10, 10))
    monkeypatch.setattr(H, "LEAST_LOTS", 2)
    rng, read = random.Random(1), []
    rows = [(k, [(1.0 if k % 2 else -1.0) + rng.gauss(0, 0.02), rng.gauss(0, 0.02)], k // 2 % 3) for k in range(400)]
    inner = H._read
    monkeypatch.setattr(H, "_need", lambda *a, f=H._need: (read.append(a), f(*a))[1])
    assert got(H.hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    every, slabs, dims = H.blocks(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", "label", F.col("vec_id") == 100)
    slab = slabs.first().asDict()
    zones = [r.asDict() for r in every.collect()]
    a = H._Rows(slab, dims)
    _, most = H.bounds(a.vectors, *H._zones(zones, dims))
    assert len(read) == 2 and inner is H._read and 0.4 < (most < 0).mean() < 0.6


def test_empty_and_lonely(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(H.hard_negatives(empty)) == []
    assert got(H.hard_negatives(spark.createDataFrame([(100, [1.0], 2), (101, [1.0], 3)], SCHEMA))) == []
