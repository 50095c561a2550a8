"""Collocations by multikey quicksort, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptsearch.llm import collocations as C
from conceptsearch.llm import words as W

SCHEMA = "doc_id long, text string, lang string"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000):
    grams, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in (1, 2, 3):
                grams[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in grams.items():
        candidates = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        scored = []
        for g, a in candidates.items():
            if any(100 * b >= 50 * a for h, b in candidates.items() if len(h) > len(g) and g in (h[:2], h[1:])):
                continue
            score, cut = min((1_000_000 * a * a // (f[g[:c]] * f[g[c:]]), c) for c in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def odd_rows():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(25)] + ["The", "É", "é", "ß", "a-b", " x", "\U0001d518", "x\x00y"]
    weights = [1 / (k + 1) for k in range(len(words))]

    def prose(n):
        return "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in rng.choices(words, weights, k=n))

    rows = [(k, prose(rng.randrange(1, 120)), rng.choice(["en", "de", None, "und", "", "e\nn"])) for k in range(150)]
    rows += [(200, None, "en"), (201, "", "en"), (202, " \n.,", None), (203, "hot pair " * 4000, "en"), (None, "end one two three", "en")]
    rows += [(300 + k, "same three words", "fr") for k in range(12)] + [(400, "tie a", "xx")] * 10 + [(401, "tie b", "xx")] * 10
    rows += [(500, " ".join(f"hot pair v{k % 300}" for k in range(3000)), "en"), (501, "word", "only")]
    return rows


def test_sorted_counts_are_counts():
    rng = np.random.default_rng(4)
    for n, kinds in ((0, 1), (1, 1), (500, 3), (3000, 40)):
        keys = rng.integers(0, kinds, (n, 3)).astype(np.uint64)
        times = rng.integers(1, 4, n)
        for least in (1, 7):
            for depth, (at, count) in enumerate(C.sort_counts(keys, times, least), 1):
                want = Counter()
                for k, t in zip(keys.tolist(), times.tolist()):
                    want[tuple(k[:depth])] += t
                pairs = [(tuple(keys[i, :depth].tolist()), c) for i, c in zip(at.tolist(), count.tolist())]
                assert sorted(pairs) == sorted((g, c) for g, c in want.items() if c >= least)


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:   # three levels of dealing, small chunks, many heavy pairs
        monkeypatch.setattr(C, "FAN", 3)
        monkeypatch.setattr(C, "LEAST_BUCKETS", 20)
        monkeypatch.setattr(C, "CHUNK_BYTES", 2000)
        monkeypatch.setattr(C, "HEAVY", 50)
        monkeypatch.setattr(C, "SAMPLE_BYTES", 20000)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in ("word", "first", "node", "n", "a", "rank")})
    assert got(C.collocations(df)) == brute(rows)
    assert got(C.collocations(df, least=3, top=7)) == brute(rows, 3, 7)


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    rows = [(1, "one two " * 12, "en"), (2, "six two " * 11, "en")]
    real = W.hash_spans

    def clash(data, start, end, stream=0, upto=None):
        out = real(data, start, end, stream, upto)
        return np.where(end - start == 3, np.uint64(5), out) if stream == 0 else out

    monkeypatch.setattr(W, "hash_spans", clash)
    chunk = C._Words(["en"], W.Texts(np.frombuffer(b"one two six", np.uint8), np.array([0, 11])), 0)
    assert len(chunk.vocabulary()[0]) == 1
    rows_of = pa_rows([("en", "one two one"), ("en", "six six one")])
    assert (C._mine(1, np.zeros(0, np.uint64))(rows_of)["kind"] == C.CLASH).any()
    monkeypatch.undo()
    assert got(C.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def pa_rows(rows):
    """Rows of DEALT, one for each text."""
    import pandas as pd

    out = []
    for k, (lang, text) in enumerate(rows):
        data = np.frombuffer(text.encode(), np.uint8)
        w = C._Words([lang], W.Texts(data, np.array([0, len(data)])), 0)
        own, n, of, found, at = w.vocabulary()
        suffix, times = w.suffixes(own, at)
        out.append(C._rows(k, np.zeros(len(own), int), np.zeros(len(times), int), w.langs, own, n, of, found, suffix, times).to_pandas())
    return pd.concat(out, ignore_index=True)


def test_exact_beyond_64_bits(spark, monkeypatch):
    """Counts whose products need more than 64 bits."""
    big = 10**12

    def phrases(*_):
        return spark.createDataFrame(
            [(0, 0, 0, 0, 9 * big, "en", None), (1, 1, 0, 0, 3 * big + 1, "en", "x"), (1, 2, 0, 0, 2 * big + 7, "en", "y"),
             (2, 1, 2, 0, big + 3, None, None)], C.FOUND)

    monkeypatch.setattr(C, "count_phrases", phrases)
    a, l, r = big + 3, 3 * big + 1, 2 * big + 7
    assert got(C.collocations(spark.createDataFrame([], SCHEMA))) == [("en", 1, "x y", a, l, r, 9 * big, 1_000_000 * a * a // (l * r))]


def test_pieces_of_one_word_have_no_phrases(spark):
    rows = [(k, "alone. again, " * 20, "en") for k in range(3)]
    assert got(C.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == []


def test_empty(spark):
    assert got(C.collocations(spark.createDataFrame([], SCHEMA))) == []


def test_a_task_merges_a_bucket_of_words(spark, monkeypatch, tmp_path):
    """With a few more buckets than nodes, rows are not merged by whole chunks."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(9000)}" for _ in range(100)) + ". same three words", "en") for k in range(160)]
    monkeypatch.setattr(C, "FAN", 16)
    monkeypatch.setattr(C, "LEAST_BUCKETS", 20)
    monkeypatch.setattr(C, "CHUNK_BYTES", 2000)
    folder, make = str(tmp_path), C._deal_again

    def again(*args):
        inner = make(*args)

        def run(key, some):
            import uuid

            n = sum(len(C.unpack(x, "<u8")) for x in some["hashes"])
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(n))
            return inner(key, some)

        return run

    monkeypatch.setattr(C, "_deal_again", again)
    df = spark.createDataFrame(rows, SCHEMA).repartition(40)
    assert got(C.collocations(df)) == brute(rows) != []
    seen = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert seen and max(seen) <= 4 * sum(len(t.split()) for _, t, _ in rows) // 20
