"""Host and path posteriors of the quality classifier, against plain Python."""

import math
import random
from collections import defaultdict

import pytest

from conceptsearch.llm import quality_classifier as Q


def prior(groups, low, high):
    """The weight of a prior from (n, s, centre) of each group."""
    n = sum(g[0] for g in groups)
    between = sum(k * (s / k - c) ** 2 for k, s, c in groups)
    sampling, spread = sum(c * (1 - c) for *_, c in groups), sum(k * c * (1 - c) for k, _, c in groups)
    variance = (between - sampling) / n
    return min(max(spread / n / variance - 1 if variance > 0 else high, low), high)


def brute(rows):
    """site and score of each (host, path, own), leaving the row itself out."""
    low, high = Q.PRIOR_WEIGHT
    hosts, paths = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for host, path, own in rows:
        for table, key in ((hosts, host), (paths, (host, path))):
            table[key][0] += 1
            table[key][1] += own
    mean = sum(own for *_, own in rows) / len(rows)
    w_host = prior([(n, s, mean) for n, s in hosts.values()], low, high)
    above = {h: (s + w_host * mean) / (n + w_host) for h, (n, s) in hosts.items()}
    w_path = prior([(n, s, above[h]) for (h, _), (n, s) in paths.items()], low, high)

    def odds(p):
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    out = []
    for host, path, own in rows:
        n, s = paths[host, path]
        site = (s - own + w_path * above[host]) / (n - 1 + w_path)
        out.append((site, 1 / (1 + math.exp(-(odds(own) + odds(site) - odds(mean))))))
    return out


def test_posteriors_match_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        host = rng.choice(["a", "a", "a", "b", "c", None, f"rare{k % 40}"])
        good = rng.random() < {"a": 0.9, "b": 0.2}.get(host, 0.5)
        text = " ".join(f"word{rng.randrange(300)}" for _ in range(60)) + "." if good else "buy now !!! $$$ " * rng.randrange(1, 9)
        rows.append((k, text, rng.choice(["en", "de", None]), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(t.startswith("word")), 0) for k, t, *_ in rows if k % 2],
                                   "doc_id long, quality int, toxic int")
    got = Q.quality(docs, labels).orderBy("doc_id").collect()
    want = brute([(r["host"], r["path"], r["own"]) for r in got])
    assert [r["site"] for r in got] == pytest.approx([s for s, _ in want])
    assert [r["score"] for r in got] == pytest.approx([s for _, s in want])
    assert all(r["kept"] == (r["score"] >= Q.KEEP_AT) for r in got)
    held_out = [(r["score"] >= 0.5) == rows[r["doc_id"]][1].startswith("word") for r in got if r["doc_id"] % 2 == 0]
    assert sum(held_out) / len(held_out) > 0.95
