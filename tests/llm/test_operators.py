"""Each operator against plain Python, on small tables with odd rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conceptsearch.llm import (
    decontamination,
    license_scan,
    mixing,
    near_dups,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    substrings,
    toxicity,
)
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def changed(text, every):
    ws = text.split()
    return " ".join("zz" + w if k % every == every // 2 else w for k, w in enumerate(ws))


PASSAGE, BASE, SECOND = prose(60), prose(150), prose(120)
ITEM = prose(25)


def odd_rows():
    """Nulls, blanks, a long text, ties, repeated rows, copies, shared passages."""
    long_text = "\n".join(prose(30) for _ in range(700))
    rows = [
        (1, BASE, "en", "a", 5), (2, BASE, "en", "b", 5), (3, changed(BASE, 120), "en", "a", None),
        (4, SECOND, "fr", None, 1), (5, changed(SECOND, 100), "fr", "a", 1), (6, changed(SECOND, 10), "fr", "c", 1),
        (7, None, None, None, None), (8, "", "en", "a", 0), (9, " \n\t ", "en", "a", 4),
        (10, "one two three", "en", "b", 1), (11, "one two three", "en", "c", 1),
        (12, prose(40) + " " + PASSAGE + "\n" + prose(40), "en", "a", 1),
        (13, PASSAGE + " " + prose(30), "en", "a", 1),
        (14, "password: abcdef token=short1 é API_KEY = 'AAAAbbbb99' AKIA" + "A1" * 9 + " " + "0af" * 9, "en", "b", 1),
        (14, "password: abcdef token=short1 é API_KEY = 'AAAAbbbb99' AKIA" + "A1" * 9 + " " + "0af" * 9, "en", "b", 1),
        (15, "same line here\nsame line here\n\nsame line here\n# * $ x|y <z>", "en", "a", 1),
        (16, ("again and " * 30).strip(), "en", "a", 1),
        (17, long_text, "en", "a", 1), (18, prose(50) + " " + long_text[:4000], "en", "d", 1),
        (19, prose(30) + " " + ITEM.upper().replace(" ", ", ") + " " + prose(10), "en", "a", 1),
        (20, prose(30) + " " + changed(ITEM, 9), "en", "a", 1), (None, prose(30), "en", "a", 1),
        (None, prose(30), "en", "a", 1), (21, "Ünï çødé 𝔘𝔫𝔦 secret = \"pässword\"", "de", "e", 1),
    ]
    rows += [(100 + k, prose(60) if k % 3 else BASE, "en", "hot", k) for k in range(60)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators would like for themselves."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.withColumns({"size": F.lit("x"), "shard": F.lit(1.5), "kept": F.lit("k"), "Node": F.lit(2),
                           "copies": F.array(F.lit(1)), "blob": F.lit(0), "n_words": F.lit("n"), "score": F.lit("s")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_secrets(docs, rows):
    got = by_row(secret_scan.secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == sorted(((i, *brute.secrets(t)) for i, t, *_ in rows), key=repr)


def test_secret_rules_consume_what_they_drop(spark):
    texts = ['secret=token"=abcdefgh', "PASSWORD : 12345 passwd:'123456'", "AKIAKIA" + "B" * 20, "token=token=ab",
             "0123456789abcdef" * 2 + "g" + "f" * 23, "api_key==x=y=z", "apikey'= \"a.b-c/d_\"", "password\n=abcdefg"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_row(secret_scan.secrets(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got == sorted(((i, *brute.secrets(t)) for i, t in enumerate(texts)), key=repr)


def test_secret_ledger_scans_only_what_is_new(spark):
    old = spark.createDataFrame([("a", "password=abcdef1"), ("b", "token=abcdef2")], "path string, text string")
    new = spark.createDataFrame([("c", "password=abcdef1"), ("b", "token=abcdef3")], "path string, text string")
    ledger = secret_scan.scan(old)
    more = secret_scan.scan(old.union(new), ledger)
    assert {r["rule"] for r in more.collect()} == {r.key for r in secret_scan.RULES}
    assert more.select("blob").distinct().count() == 1
    changed_rules = (*secret_scan.RULES[:2], secret_scan.Rule("hex", "[0-9a-f]{30,}", 0, 30, "2"))
    assert {r["rule"] for r in secret_scan.scan(old, ledger, changed_rules).collect()} == {"hex@2"}
    out, names = secret_scan.findings(old.union(new), ledger.union(more))
    assert {r["path"]: len(r[names["spans"]]) for r in out.collect()} == {"a": 1, "b": 1, "c": 1}


def test_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 8)
    got = sharding.assignment(docs).collect()
    assert by_row(sharding.assignment(docs), "doc_id", "size", "text_crc32") == sorted(
        ((i, *brute.sizes(t)) for i, t, *_ in rows), key=repr)
    shards = {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        shards.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_shards_are_near_equal_and_agree_on_reruns(spark):
    rows = [(k, "hot" * 5 if k % 3 == 0 else prose(RNG.randint(1, 40))) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_row(sharding.assignment(df), "doc_id", "size", "shard", "slot")
    assert got == by_row(sharding.assignment(df.repartition(7)), "doc_id", "size", "shard", "slot")
    sums = [sum(r[1] for r in got if r[2] == s) for s in range(16)]
    largest = max(r[1] for r in got)
    assert max(sums) - min(sums) <= 2 * largest


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(20000).select(F.struct(F.lit(5).cast("long").alias("a"), F.col("id").alias("b")).alias("key"),
                                     F.when(F.col("id") < 50, 4000).otherwise(1).cast("long").alias("size"))
    cuts, sums = sharding.splitters(rows, 16)
    assert sum(r["rows"] for r in sums) == 20000 and sum(r["bytes"] for r in sums) == 50 * 4000 + 19950
    assert max(r["rows"] for r in sums) <= 2 * 20000 / 128 + 64


def test_write_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert by_row(back, "doc_id", "text") == sorted(((i, t) for i, t, *_ in rows), key=repr)


def test_substrings(docs, rows):
    got = by_row(substrings.kept_digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = [(i, *x) for (i, *_), x in zip(rows, brute.substrings([(i, t) for i, t, *_ in rows]))]
    assert got == sorted(want, key=repr)


def test_substrings_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_WORDS", 2000)
    rng = random.Random(3)
    shared = [prose(n, rng) for n in (19, 20, 21, 39, 50, 80)]
    rows = []
    for k in range(150):
        parts = [prose(rng.randint(0, 25), rng)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng.randint(0, 12), rng)]
        rows.append((rng.randint(0, 10**6), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    got = by_row(substrings.kept_digests(df), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = [(i, *x) for (i, _), x in zip(rows, brute.substrings(rows))]
    assert got == sorted(want, key=repr)


def test_near_groups(docs, rows):
    got = {}
    for r in near_dups.classes(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["class_id"])
    groups, links = brute.near_groups([(i, t) for i, t, *_ in rows])
    want = {}
    for (i, *_), g in zip(rows, groups):
        want.setdefault(i, set()).add(g)
    assert got == want
    assert got[3] == {1} and got[5] == {4} and got[6] == {6} and links


def test_near_links_in_mixed_buckets(spark, monkeypatch):
    """Buckets that hold several groups, in one block and in many."""
    monkeypatch.setattr(near_dups, "BLOCK_SHINGLES", 500)
    rng = random.Random(9)
    passage = prose(40, rng)
    rows = []
    for k in range(60):
        body = passage + " " + prose(20, rng)
        rows += [(3 * k, body), (3 * k + 1, changed(body, 55)), (3 * k + 2, passage + " " + prose(25, rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    groups, _ = brute.near_groups(rows)
    assert {r["doc_id"]: r["class_id"] for r in near_dups.classes(df).collect()} == dict(zip((i for i, _ in rows), groups))


def test_alignment_is_exact_for_labelled_shingles():
    rng = random.Random(1)
    import pyarrow as pa
    for _ in range(60):
        a = prose(rng.randint(1, 80), rng).split()
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b) + 1)
            b[k:k + rng.randint(0, 2)] = [rng.choice(VOCABULARY)] * rng.randint(0, 2)
        if rng.random() < 0.3:
            cut = rng.randrange(len(b) + 1)
            b = b[cut:] + b[:cut]
        left, right = " ".join(a), " ".join(b)
        x, y = (near_dups.place_of(np.frombuffer(near_dups._labels(pa.array([t]))[0][0].as_py(), "<u4"))
                for t in (left, right))
        want = brute.alignment(left, right)
        assert near_dups.similarity(x, y) == pytest.approx(want if want >= 0.8 else 0.0)


def test_one_document_of_each_group_stays(docs, rows):
    out = near_dups.deduplicate(docs)
    assert out.columns == docs.columns
    groups, _ = brute.near_groups([(i, t) for i, t, *_ in rows])
    blank = sorted(((i, t) for (i, t, *_), g in zip(rows, groups) if not brute.words(t)), key=repr)
    no_id = sorted(((i, t) for i, t, *_ in rows if i is None), key=repr)
    kept = by_row(out, "doc_id", "text")
    ids = [i for i, t in kept if brute.words(t) and i is not None]
    assert sorted(ids) == sorted({g for g in groups if g is not None})
    assert [r for r in kept if not brute.words(r[1])] == blank and [r for r in kept if r[0] is None] == no_id


def test_targets_and_taken(docs, rows):
    got = mixing.taken(docs).collect()
    assert by_row(mixing.taken(docs), *got[0].asDict()) == by_row(mixing.taken(docs.repartition(3)), *got[0].asDict())
    size_of = {}
    for _, t, _, s, _ in rows:
        size_of[s] = size_of.get(s, 0) + len(brute.words(t))
    want = brute.targets(size_of)
    source_of = {(i, len(brute.words(t))): s for i, t, _, s, _ in rows}
    taken = dict.fromkeys(size_of, 0)
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == size_of[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["taken"] % r["size"] == 0 if r["size"] else r["taken"] == 0)
        taken[s] += r["taken"]
    largest = {s: max(len(brute.words(t)) for _, t, _, x, _ in rows if x == s) for s in size_of}
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in size_of)


def test_mix_repeats_rows(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    words = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.taken(docs).collect() if r["size"]}
    seen = {}
    for r in out.collect():
        n = len(brute.words(r["text"]))
        if n:
            seen[r["doc_id"], n] = seen.get((r["doc_id"], n), 0) + n
    rows_of = {}
    for r in docs.collect():
        rows_of.setdefault((r["doc_id"], len(brute.words(r["text"]))), []).append(r)
    single = {k: v for k, v in words.items() if len(rows_of[k]) == 1}
    assert {k: seen.get(k, 0) for k in single} == single


def test_rounding_over_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_UNITS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(k, prose(1 + k % 17), "s0" if k % 3 else "s1") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).toPandas()
    got["source"] = ["s0" if k % 3 else "s1" for k in got["doc_id"]]
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 17
    assert len(got) == 2000


def test_pivotal_steps_keep_mass_and_expectation():
    size = np.array([3.0, 5.0, 2.0, 9.0, 4.0, 4.0])
    total, start = np.zeros(6), np.full(6, 0.4)
    for seed in range(4000):
        p = start.copy()
        mixing.round_pairs(p, size, np.random.default_rng(seed))
        assert abs((p * size).sum() - (start * size).sum()) < 1e-9
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 1
        total += p
    assert np.abs(total / 4000 - 0.4).max() < 0.03


def test_masks_are_lossless():
    for gone in itertools.combinations(range(decontamination.SPAN), decontamination.SUBSTITUTED):
        assert any(all(s + k not in gone for k in mask) for mask in decontamination.MASKS
                   for s in range(decontamination.SPAN - decontamination.WINDOW + 1))


def test_leaks(spark, docs, rows):
    items = [(1, ITEM), (2, ITEM), (3, prose(12)), (4, "too short an item"), (5, None),
             (6, " ".join(BASE.split()[100:118])), (7, prose(30)), (8, " ".join(PASSAGE.split()[:9]) + " " + prose(6))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, benchmark).collect()}
    want = brute.leaks([(i, t) for i, t, *_ in rows if i != 17], items)
    assert {x for x in got if x[0] != 17} == want and (19, 1) in got and (20, 1) in got
    kept = decontamination.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    gone = {d for d, _ in got}
    assert by_row(kept, "doc_id") == sorted(((i,) for i, *_ in rows if i not in gone), key=repr)


def test_short_items_are_found(spark, monkeypatch):
    """Copies of items of 1 to 13 words: every pair of substitutions, and at a
    text's ends."""
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in range(1, 14)}
    texts, want = [], set()
    for n, item in items.items():
        gone = [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]
        copies = [["zz" if k in g else w for k, w in enumerate(item)] for g in gone]
        copies = [["start", *c, "end"] for c in copies] + [item, item[2:], item[:-2], item[1:-1]]
        for c in copies:
            if n - sum(w in c for w in item) <= (2 if n >= 9 else 0):
                want.add((len(texts), n))
            texts.append((len(texts), " ".join(c)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, benchmark).collect()} == want
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_SEEDS", 3)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, benchmark).collect()} == want


def test_many_seeds_are_shuffled(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(1, ITEM), (None, BASE)], "item_id long, text string")
    want = by_row(decontamination.leaks(docs, benchmark), "doc_id", "item_id", "best")
    assert (1, None, decontamination.SPAN) in want
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_SEEDS", 3)
    assert by_row(decontamination.leaks(docs, benchmark), "doc_id", "item_id", "best") == want


def test_host_rules(docs, rows):
    out, n = quality_rules.verdicts(docs)
    measured = [n[k] for k in quality_rules.MEASURES[:5]]
    got = by_row(out, "doc_id", *measured, n["base_failed"])
    assert got == sorted(((i, *brute.measures(t), brute.base_failed(t)) for i, t, *_ in rows), key=repr)
    assert quality_rules.keep(docs).columns == docs.columns


def test_bad_hosts_are_rejected(spark):
    rows = [(k, prose(30) if k % 10 else "x", "good") for k in range(400)]
    rows += [(1000 + k, "x" if k % 10 else prose(30), "bad") for k in range(200)]
    rows += [(2000, "x", "sparse"), (2001, prose(30), None), (2002, None, None)]
    out, n = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    kept = {r["doc_id"] for r in out.collect() if r[n["kept"]]}
    assert kept == {k for k in range(400) if k % 10} | {2001}


def test_licenses(spark):
    mit = ("MIT License\n\nCopyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, "
           "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
           "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following "
           "conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial "
           "portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, "
           "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND "
           "NONINFRINGEMENT. IN NO EVENT")
    three = [license_scan.SENTENCES[k] for k in ("bsd-source", "bsd-binary", "bsd-name")]
    texts = ["some prose\nReleased under the MIT License.\nmore", mit, "LICENSED UNDER CC BY-NC 4.0!", None, "",
             "x. Licensed under the Apache License, Version 2.0. All rights reserved.", ". ".join(three) + ".",
             ". ".join(three[:2]) + ".", ". ".join(reversed(three)) + ".", "This is not released under the MIT License.",
             "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.licenses(df).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "CC-BY-NC-4.0", 3: "", 4: "", 5: "Apache-2.0,all-rights-reserved",
                   6: "BSD-3-Clause", 7: "BSD-2-Clause", 8: "", 9: "", 10: "GPL-3.0"}


def test_common_headers_and_spdx_lines(spark):
    gpl = ("This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {}General Public License\n"
           "as published by the Free Software Foundation; either version {}\nof the License, or (at your option) any later version.\n")
    bsd = [license_scan.SENTENCES[k] for k in ("bsd-source", "bsd-binary")]
    bsd.append("Neither the name of the University nor the names of its contributors may be used to endorse or promote products "
               "derived from this software without specific prior written permission")
    cases = [
        (gpl.format("", "2"), "GPL-2.0-or-later"), (gpl.format("Lesser ", "2.1"), "LGPL-2.1-or-later"),
        (gpl.format("Affero ", "3"), "AGPL-3.0-or-later"), ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", "GPL-3.0"),
        ("under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.", "GPL-2.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy", "MPL-2.0"),
        (license_scan.SENTENCES["isc-grant"].replace("or distribute", "or\ndistribute") + ".", "ISC"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This project is licensed under the MIT License.", "MIT"), ("The MIT License\n\ntext", "MIT"),
        ("This project is not licensed under the MIT License.", ""), (". ".join(bsd) + ".", "BSD-3-Clause"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0-or-later"),
        ("SPDX-License-Identifier: BSD-2-Clause\nx", "BSD-2-Clause"), ("SPDX-License-Identifier: ISC.", "ISC"),
        ("SPDX-License-Identifier: mpl-2.0", "MPL-2.0"), ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", "GPL-2.0-or-later"),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-4.0", "Apache-2.0,CC-BY-4.0,MIT"),
        ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("SPDX-License-Identifier: see below", ""),
        ("The documentation is released under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("a new license to print money", ""),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.licenses(df).collect()}
    assert [(t, got[k]) for k, (t, _) in enumerate(cases)] == cases


def test_site_quality(spark):
    rng = random.Random(2)
    rows = [(k, prose(40, rng) if k % 4 else "### " * 20, "en", f"s{k % 7}") for k in range(400)]
    rows += [(500, None, None, None), (501, "", "en", "s1"), (501, "", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.quality(docs, labels).collect()}
    assert len(out) == 402 and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(out[k]["kept"] == (k % 4 > 0) for k in range(400))
    none = quality_classifier.quality(docs, labels.filter("false")).collect()
    assert len(none) == 403 and {r["own"] for r in none} == {0.5}


def test_sparse_sites_follow_the_prior(spark):
    rows = [(k, prose(40), "en", f"s{k % 2}") for k in range(300)] + [(900, prose(40), "en", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality_classifier.quality(docs, labels).collect()}
    mean = np.mean([r["own"] for r in out.values()])
    assert abs(out[900]["site"] - mean) < 0.05


def test_one_row_of_each_labelled_id_is_learned_from(spark):
    rows = [(7 if k % 3 == 0 else k, [float(k), 1.0]) for k in range(300)]
    measured = spark.createDataFrame(rows, "doc_id long, x array<double>")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    got = by_row(quality_classifier.training_rows(measured, labels), "doc_id", "x", "quality")
    assert len(got) == len({d for d, _ in rows}) == len({d for d, *_ in got})
    again = quality_classifier.training_rows(measured.repartition(7, "x"), labels)
    assert by_row(again, "doc_id", "x", "quality") == got


def toxic_rows(n, rng):
    """Toxic where an insult meets a group word; either alone is harmless."""
    rows, labels = [], []
    for k in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = prose(25, rng).split() + ["insulting"] * a + ["grouping"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(a and b)))
    return rows, labels


def test_toxicity_learns_a_pair(spark):
    rows, labels = toxic_rows(900, random.Random(4))
    rows += [(5000, None), (5001, ""), (None, "grouping")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, marks).collect()
    assert len(out) == len(rows)
    truth = {k: t for k, _, t in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 100
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert not next(r for r in out if r["doc_id"] is None)["held_out"]


def test_toxicity_learns_a_rare_pair(spark):
    """A group word that is about as frequent in clean texts as in toxic ones."""
    rng = random.Random(6)
    rows, truth = [], {}
    for k in range(6000):
        slur = rng.random() < 0.08
        a, b = rng.random() < (0.01 if slur else 0.05), rng.random() < (0.08 if slur else 0.2)
        words = prose(25, rng).split() + ["slurring"] * slur + ["insulting"] * a + ["grouping"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        truth[k] = int(slur or (a and b))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1, t) for k, t in truth.items()], "doc_id long, quality int, toxic int")
    held = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, marks).collect() if r["held_out"]}
    of = {k: (("insulting" in t) + ("grouping" in t)) for k, t in rows}
    pairs = [p for k, p in held.items() if of[k] == 2]
    assert len(pairs) > 10 and np.mean(pairs) > 0.8
    assert np.mean([p for k, p in held.items() if of[k] == 1]) < 0.05


def test_toxicity_without_labels_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for marks, predicted in (([], {0}), ([(k, 1, 0) for k in range(9)], {0})):
        labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
        assert {r["predicted"] for r in toxicity.toxicity(docs, labels).collect()} == predicted


def test_empty_tables(spark, empty):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (secret_scan.secrets(empty), sharding.assignment(empty), substrings.kept_digests(empty),
                near_dups.classes(empty), mixing.taken(empty), mixing.mix(empty), decontamination.leaks(empty, benchmark),
                quality_rules.verdicts(empty)[0], license_scan.licenses(empty), toxicity.toxicity(empty, labels),
                quality_classifier.quality(empty, labels), near_dups.deduplicate(empty),
                decontamination.decontaminate(empty, benchmark), quality_rules.keep(empty), sharding.place(empty)[0]):
        assert out.count() == 0


def test_an_empty_benchmark_keeps_all(spark, docs, rows):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, benchmark).count() == len(rows)


def test_log_odds_are_finite():
    assert math.isfinite(float(toxicity.sigmoid(np.array([1e9]))[0]))
