"""Near-duplicate groups by Order MinHash.

A text is the sequence of its runs of ``SHINGLE`` words, each labelled with
how often it occurred before.  A sketch orders them by a seeded hash, takes
the ``KEPT`` smallest and keeps these in text order: two texts share it with
a probability that falls with the shingles they don't share and with changes
of order, so it follows edit similarity.  ``SKETCHES`` of them are buckets.

Candidates are verified by banded alignment: labelled shingles that both
texts have, at places that differ by no more than the similarity allows, and
of these the longest chain in the order of both; m of them make the
similarity m / (a + b - m), which is at most the shingles' Jaccard similarity
and equal to it when order is kept.  Pairs of ``SIMILAR`` or more are links,
and groups are the connected components of equal texts and links.

Within a bucket, an inverted list of its shingles gives every text's overlap
with all others at once; texts whose overlap is enough are aligned unless
links found before connect them, and only links that connect leave the task.
So groups of copies give as many rows as they have texts, not pairs.

Defined cases: texts of fewer than ``SHINGLE`` words are one shingle; null
and blank texts are in no group; a group's id is its smallest document id
(null if it has none); repeated rows are equal texts; an empty table gives
an empty result.

Scale: sketching is map-only; equal texts are one node, with map-side partial
minima.  Buckets of the same texts are handled once.  A large bucket is dealt
into blocks of ``BLOCK_SHINGLES`` that are connected apart, with one leader of
the bucket; only texts outside its largest group then meet other blocks (see
``_large``), so a group of near copies is read once, and no task holds more
than two blocks.  Shingles travel as 32-bit hashes
in text order; two different ones are equal by chance in 1 of 4e9.  Labels
move along links by minimum, with pointer jumping, written to the shared
folder each round.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm import words as W
from conceptsearch.llm.tables import fresh, materialise, same, with_arrays

SHINGLE = 5
SIMILAR = 0.8
SKETCHES = 16
KEPT = 3
#: Texts of few shingles, whose pairs share a sketch more rarely, have more of them.
SHORT_SHINGLES, SHORT_SKETCHES = 40, 48
#: Shingles of a bucket that one block holds.
BLOCK_SHINGLES = 300_000


def labelled_shingles(owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, shingle, shingle with occurrence number, in text order."""
    n = len(word)
    counts = np.bincount(owner) if n else np.zeros(0, np.int64)
    short = counts[owner] < SHINGLE
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if n else np.zeros(0, bool)
    padded_word = np.concatenate((word, np.zeros(SHINGLE - 1, np.uint64)))
    padded_owner = np.concatenate((owner, np.full(SHINGLE - 1, -1)))
    # a short text's words are followed by zeros instead of the next text's
    shingle = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        shingle *= np.uint64(0xA0761D6478BD642F)
        shingle += np.where(padded_owner[k:k + n] == owner, padded_word[k:k + n], np.uint64(0))
    whole = (padded_owner[SHINGLE - 1:SHINGLE - 1 + n] == owner) | (short & first)
    text, shingle = owner[whole], W.mix(shingle[whole])
    order = np.lexsort((shingle, text))
    new = np.ones(len(order), bool)
    new[1:] = (shingle[order][1:] != shingle[order][:-1]) | (text[order][1:] != text[order][:-1])
    at = np.arange(len(order))
    earlier = np.empty(len(order), np.uint64)
    earlier[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return text, shingle, W.mix(shingle ^ W.mix(earlier + np.uint64(1)))


def _sketch(column: pa.Array) -> list[pa.Array]:
    """The keys of each text's sketches, and how many shingles it has."""
    keys, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, piece in W.texts(column).pieces():
        owner, (word,) = W.word_hashes(piece)
        text, shingle, label = labelled_shingles(owner, word)
        size = np.bincount(text, minlength=len(piece))
        sizes.append(size)
        out = np.zeros((len(piece), SHORT_SKETCHES), np.uint64)
        for first, last, some in ((0, SKETCHES, size > 0), (SKETCHES, SHORT_SKETCHES, (size > 0) & (size <= SHORT_SHINGLES))):
            own = some[text]
            _sketch_into(out, range(first, last), np.flatnonzero(some), size[some], shingle[own], label[own])
        keys.append(out[np.arange(SHORT_SKETCHES) < _sketch_count(size)[:, None]])
    flat, size = np.concatenate(keys), np.concatenate(sizes)
    offsets = pa.array(np.concatenate(([0], np.cumsum(_sketch_count(size)))), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64))), pa.array(size, pa.int64())]


def _sketch_count(size: np.ndarray) -> np.ndarray:
    return np.where(size <= SHORT_SHINGLES, SHORT_SKETCHES, SKETCHES)


def _sketch_into(out: np.ndarray, numbers: range, held: np.ndarray, size: np.ndarray, shingle: np.ndarray, label: np.ndarray) -> None:
    """Sketches of these numbers of the texts ``held``, whose shingles follow one another."""
    if not len(held):
        return
    starts = np.cumsum(size) - size
    for s in numbers:
        rank = W.mix(label ^ W.mix(np.array([s + 1], np.uint64)))
        rest = rank
        for k in range(KEPT):
            bound = np.repeat(np.minimum.reduceat(rest, starts), size)
            if k + 1 < KEPT:
                rest = np.where(rank <= bound, np.uint64(2**64 - 1), rank)
        taken = np.flatnonzero(rank <= bound)
        which = np.searchsorted(starts, taken, "right") - 1
        before = np.concatenate(([0], np.cumsum(np.bincount(which, minlength=len(held)))[:-1]))
        place = (np.arange(len(taken)) - before[which]).astype(np.uint64)
        part = W.mix(shingle[taken] ^ W.mix(place + np.uint64(977)))
        out[held, s] = W.mix(np.add.reduceat(part, before) + np.uint64(s))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILAR) -> float:
    """Similarity by banded alignment of two texts' labelled shingles, each
    given as (sorted labels, their places); 0 where it is below ``least``."""
    n, m = len(a[0]), len(b[0])
    need = least / (1 + least) * (n + m) - 1e-9       # shared shingles that the least similarity takes
    if min(n, m) < need:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    x, y = a[1][i], b[1][j]
    band = n + m - 2 * need                            # unmatched shingles that it allows
    near = np.abs(x - y) <= band
    x, y = x[near], y[near]
    y = y[np.argsort(x)]
    if np.all(y[1:] > y[:-1]):
        chain = len(y)
    else:
        tails: list[int] = []
        for v in y.tolist():
            k = bisect_left(tails, v)
            tails[k:k + 1] = [v]
        chain = len(tails)
    return chain / (n + m - chain) if chain >= need else 0.0


def place_of(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted labels and their places, from labels in text order."""
    return np.unique(labels, return_index=True)


def _labels(column: pa.Array) -> list[pa.Array]:
    """32-bit labels of each text, in text order."""
    out = []
    for _, piece in W.texts(column).pieces():
        owner, (word,) = W.word_hashes(piece)
        text, _, label = labelled_shingles(owner, word)
        ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(piece)))))
        short = (label >> np.uint64(32)).astype("<u4")
        out += [short[ends[k]:ends[k + 1]].tobytes() for k in range(len(piece))]
    return [pa.array(out, pa.binary())]


def _connect(rows: pd.DataFrame) -> pd.DataFrame:
    """Links a, b that connect all similar texts among the given ones (node, labels).

    Stars first: a text that nothing holds yet meets all others and takes
    those that are similar to it.  A pair that is still apart then has a text
    outside the largest group, so only those meet the others as well: a group
    of near copies costs one pass, not one for each of its texts."""
    rows = rows.drop_duplicates("node").sort_values("node", kind="stable")
    node = rows["node"].tolist()
    parts = [place_of(np.frombuffer(x, "<u4")) for x in rows["labels"]]
    n = len(node)
    size = np.array([len(p[0]) for p in parts])
    owner = np.repeat(np.arange(n), size)
    every = np.concatenate([p[0] for p in parts])
    order = np.argsort(every, kind="stable")
    holder = owner[order]                              # texts by label
    first = np.searchsorted(every[order], every)
    count = np.searchsorted(every[order], every, "right") - first
    ends = np.concatenate(([0], np.cumsum(size)))
    group, met = np.arange(n), np.zeros(n, bool)
    found = []

    def meet(i: int) -> None:
        met[i] = True
        own = slice(ends[i], ends[i + 1])
        c = count[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        shared = np.bincount(holder[at], minlength=n)
        near = shared >= SIMILAR / (1 + SIMILAR) * (size + size[i]) - 1e-9
        for j in np.flatnonzero(near & (group != group[i])):
            if group[i] != group[j] and similarity(parts[i], parts[j]) > 0:
                found.append((node[i], node[j]))
                group[group == group[j]] = group[i]

    for i in range(n):
        if np.count_nonzero(group == group[i]) == 1:
            meet(i)
    largest = np.bincount(group, minlength=n).argmax()
    for i in np.flatnonzero((group != largest) & ~met):
        if (group != group[0]).any():
            meet(i)
    return pd.DataFrame(found, columns=["a", "b"])


def _min(column: str) -> Column:
    return F.min(column).alias(column)


def sketches(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """node (hash of the whole text), doc, keys, shingles: a row per distinct
    text that is not blank, with its smallest id."""
    rows = docs.select(F.unhex(F.md5(F.col(text))).alias("node"), F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    sketched = with_arrays(rows.filter("text is not null"), ["text"], {"keys": "array<bigint>", "shingles": "bigint"}, _sketch)
    return (sketched.filter("shingles > 0").select("node", "doc", "keys", "shingles")
            .groupBy("node").agg(_min("doc"), F.first("keys").alias("keys"), F.first("shingles").alias("shingles")))


def components(links: DataFrame) -> DataFrame:
    """node, label of the nodes that have links: the smallest node of each
    connected component."""
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        moved = (labels.join(seen, "node").select("node", F.col("label").alias("old"),
                                                  F.least("label", "near").alias("label")))
        # a label's own label is in the same component, and no larger
        top = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        moved = materialise(moved.join(top, "label", "left")
                            .select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("old <> label").limit(1).count():
            return labels


def _buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, blocks of the buckets that hold more than one text; of
    buckets with the same texts, one."""
    rows = materialise(nodes.select("node", "shingles", F.posexplode("keys").alias("s", "key"))
                       .select(F.xxhash64("s", "key").alias("bucket"), "node", "shingles"), "buckets")
    sums = (rows.groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("x"),
                 F.sum(F.xxhash64("node", F.lit(1)) % (1 << 40)).alias("y"), F.sum("shingles").alias("shingles"))
            .filter("n > 1").groupBy("n", "x", "y").agg(_min("bucket"), F.first("shingles").alias("shingles")))
    sums = sums.select("bucket", F.ceil(F.col("shingles") / BLOCK_SHINGLES).alias("blocks"))
    return rows.select("bucket", "node").join(sums, "bucket")


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Verified links a, b that connect all similar texts."""
    buckets = materialise(_buckets(nodes), "shared")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "doc"), "node")
    rows = docs.select(F.unhex(F.md5(F.col(text))).alias("own"), F.col(doc_id).alias("own_doc"), F.col(text).alias("text"))
    held = (rows.join(wanted, same(F.col("own_doc"), F.col("doc")) & (F.col("own") == F.col("node")))
            .select("node", "text"))
    held = materialise(with_arrays(held, ["text"], {"labels": "binary"}, _labels).drop("text")
                       .groupBy("node").agg(F.first("labels").alias("labels")), "labels")
    single, large = buckets.filter("blocks = 1"), buckets.filter("blocks > 1")
    found = single.join(held, "node").groupBy("bucket").applyInPandas(_connect, LINK).distinct()
    if not large.limit(1).count():
        return materialise(found, "links")
    return materialise(materialise(found, "links").union(_large(large, held)).distinct(), "links")


LINK = "a binary, b binary"


def _large(buckets: DataFrame, held: DataFrame) -> DataFrame:
    """Links in buckets of several blocks.  Each block is connected by itself,
    together with one text of the bucket, its leader.  Where that leaves more
    than one group in a bucket, every pair that is still apart has a text
    outside the most frequent group: those texts, dealt into parts, meet all
    blocks.  So a bucket that is one group of near copies is read once,
    however many texts it has."""
    block = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks"))
    rows = materialise(buckets.withColumn("block", block).select("bucket", "block", "blocks", "node"), "blocks")
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    leader = rows.groupBy("bucket", "blocks").agg(_min("node")).select("bucket", number, "node")
    within = (rows.select("bucket", "block", "node").union(leader).join(held, "node")
              .groupBy("bucket", "block").applyInPandas(_connect, LINK))
    within = materialise(within.distinct(), "within")
    labels = components(within)
    named = materialise(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    most = (named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("texts"), F.max("n").alias("n")))
    # as many parts of the texts outside as their share of the blocks
    outside = (named.join(most.withColumnRenamed("n", "held"), "bucket").filter("label <> top")
               .withColumn("parts", F.ceil(F.col("blocks") * (F.col("texts") - F.col("held")) / F.col("texts")))
               .withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))))
    outside = materialise(outside.select("bucket", "blocks", "parts", "part", "node"), "outside")
    if not outside.limit(1).count():
        return within
    parts = outside.select("bucket", "parts").distinct()
    spread = outside.select("bucket", number, "part", "node")
    every = rows.join(parts, "bucket").select(
        "bucket", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), "node")
    across = (spread.union(every.select("bucket", "block", "part", "node")).join(held, "node")
              .groupBy("bucket", "block", "part").applyInPandas(_connect, LINK))
    return within.union(across)


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """node, doc, label (the group) of each distinct text."""
    nodes = materialise(sketches(docs, text, doc_id), "sketches")
    labels = components(links(docs, nodes, text, doc_id))
    return (nodes.select("node", "doc").join(labels, "node", "left")
            .select("node", "doc", F.coalesce("label", "node").alias("label")))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group, the one of the smallest id, with its
    columns unchanged; blank and null texts all stay."""
    nodes = materialise(grouped(docs, text, doc_id), "groups")
    first = nodes.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("x"))
    node, doc = fresh(docs, "node", "doc")
    own = F.unhex(F.md5(F.col(text)))
    rows = docs.groupBy(own.alias("own"), F.col(doc_id).alias("own_doc")).agg(F.count(F.lit(1)).alias("rows"))
    kept = materialise(first.select("x.node", "x.doc").join(
        rows, (F.col("node") == F.col("own")) & same(F.col("doc"), F.col("own_doc"))).select("node", "doc", "rows"), "kept")
    at = same(F.col(doc_id), F.col(doc)) & (own == F.col(node))
    out = docs.join(kept.filter("rows = 1").drop("rows").toDF(node, doc), at, "left_semi")
    if kept.filter("rows > 1").limit(1).count():  # rows that repeat id and text are one document
        again = docs.join(kept.filter("rows > 1").drop("rows").toDF(node, doc), at, "left_semi")
        out = out.unionByName(again.dropDuplicates([doc_id, text]))
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return out.unionByName(docs.filter(blank))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the group) of every row; blank and
    null texts have class null."""
    docs = docs.select("doc_id", "text")
    nodes = materialise(grouped(docs), "groups")
    smallest = nodes.groupBy("label").agg(F.min("doc").alias("class_id"))
    of = nodes.join(smallest, "label").select(F.col("node").alias("of"), "class_id")
    out = docs.select("doc_id", F.unhex(F.md5("text")).alias("node"))
    return out.join(of, F.col("node") == F.col("of"), "left").select("doc_id", "class_id")
