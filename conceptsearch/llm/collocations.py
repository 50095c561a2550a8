"""Collocations: phrases that occur often, counted by sorting suffix pointers.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
these into words.  Every word starts a suffix of its piece; the first
``LONGEST`` words of it are what matters.

A chunk of texts counts its distinct suffixes and words; a task adds up those of
some chunks and deals them out: suffixes by a hash of their two leading words, so all that start with a
phrase meet in one bucket.  A bucket sorts its suffix pointers by multikey
three-way quicksort: each segment is split by a pivot's word at its depth
into smaller, equal and greater ones, and the equal part goes on at the next
word.  Sizes of equal parts are the counts of phrases; a part of less than
``LEAST`` occurrences is abandoned, as no phrase in it can be a candidate.
All segments of a bucket are split at once, in NumPy.

Pairs of leading words that hold more than a thousandth of all suffixes (by a
sample, which decides on nothing but where suffixes go) are dealt by three
words, and their counts added up afterwards.

Words travel as 64-bit hashes with their language.  Each bucket of the
vocabulary compares the words of equal hashes; if any differ, all is counted
again with another hash, so counts are exact.

Defined cases: null and blank texts have no words; a null language is
``und``; null ids and other columns don't matter; repeated rows count again;
an empty table gives an empty result.  Counts are exact up to 3e15.

Scale: texts are read once (and a sample of them once more).  A chunk sends
``FAN`` rows at most, whatever the number of buckets: where that is larger,
rows are merged, about a bucket's words at a time, and dealt again, level by
level.  A word, pair or phrase that a third of all words are is one entry of
each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptsearch.llm import words as W
from conceptsearch.llm.tables import deal_levels, materialise, pack, pack_sorted, unpack, unpack_sorted

LEAST = 10
LONGEST = 3
TOP = 2000
#: A phrase is dropped if a longer one has at least so many hundredths of its occurrences.
SHARE = 50

CHUNK_BYTES = 3 << 20
#: Distinct suffixes and words of a task's chunks that are added up before they are dealt.
HELD = 2_000_000
BUCKET_WORDS, LEAST_BUCKETS = 1_000_000, 32
FAN = 256
SAMPLE_BYTES = 32 << 20
#: Parts of a language that are ranked apart before they are ranked together.
PARTS = 32
#: Pairs with this share of the sample's suffixes are dealt by three words.
HEAVY = 1000

ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = ENDS.copy()
BETWEEN[[0x20, 0x09]] = True

DEALT = ("node bigint, chunk bigint, langs array<string>, words binary, of binary, hashes binary, counts binary, "
         "known binary, first binary, second binary, third binary, times binary")
FOUND = "kind int, first bigint, second bigint, third bigint, n bigint, lang string, word string"
#: Kinds of FOUND: words of a language, a word, a phrase of two or three words, two words with one hash.
LANG, WORD, TWO, THREE, CLASH = 0, 1, 2, 3, 9


# ---- words and suffixes of a chunk ---------------------------------------

def _lang_hash(lang: str, stream: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, salt=bytes([stream])).digest(), "little")


class _Words:
    """The words of some texts: hash with language, and whether a piece starts."""

    def __init__(self, langs: list[str], texts: W.Texts, stream: int) -> None:
        kinds = sorted(set(langs))
        number = {k: n for n, k in enumerate(kinds)}
        self.langs, of = kinds, np.array([number[x] for x in langs], np.int64)
        salt = np.array([_lang_hash(k, stream) for k in kinds], np.uint64)
        self.data = texts.data.copy()
        self.data[(self.data >= 65) & (self.data <= 90)] += 32
        parts: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, t) for t in (np.uint64, bool, np.int64, np.int64, np.int64))]
        for first, piece in W.Texts(self.data, texts.offsets).pieces():
            w, base = W.runs(piece, ~BETWEEN[piece.data]), texts.offsets[first]
            ends = np.cumsum(ENDS[piece.data])[w.start]
            new = np.ones(len(w.text), bool)
            new[1:] = (w.text[1:] != w.text[:-1]) | (ends[1:] != ends[:-1])
            lang = of[first + w.text]
            own = W.mix(W.hash_spans(piece.data, w.start, w.end, stream) ^ salt[lang]) if len(lang) else np.zeros(0, np.uint64)
            parts.append((np.maximum(own, 1), new, lang, w.start + base, w.end + base))  # 0 is no word
        self.hash, self.new, self.lang, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True))

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Distinct hashes, their counts, languages and words; and which of them each word is."""
        own, first, at, n = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)
        raw = self.data.tobytes()
        found = [raw[s:e] for s, e in zip(self.start[first].tolist(), self.end[first].tolist(), strict=True)]
        return own, n, self.lang[first], found, at

    def suffixes(self, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct suffixes of two words or more, a row of LONGEST hashes each, and their counts."""
        n = len(at)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~self.new
        inside = np.concatenate((inside, [False]))
        number = np.concatenate((at + 1, [0, 0]))
        first = np.flatnonzero(inside[1:n + 1])
        second, third = number[first + 1], np.where(inside[first + 2], number[first + 2], 0)
        base = len(own) + 1
        if base < 1 << 21:
            key, times = np.unique((number[first] * base + second) * base + third, return_counts=True)
            pair, third = key // base, key % base
        else:
            pairs, of = np.unique(number[first] * base + second, return_inverse=True)
            key, times = np.unique(of * base + third, return_counts=True)
            pair, third = pairs[key // base], key % base
        hashes = np.concatenate((np.zeros(1, np.uint64), own))
        return np.stack([hashes[pair // base], hashes[pair % base], hashes[third]], axis=1), times


def _pair(suffix: np.ndarray) -> np.ndarray:
    return W.mix(suffix[:, 0] * np.uint64(0x9E3779B97F4A7C15) + suffix[:, 1])


def _bucket(hashed: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _buckets(own: np.ndarray, suffix: np.ndarray, heavy: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and of each suffix."""
    route = _pair(suffix)
    route = np.where(np.isin(route, heavy), W.mix(route + suffix[:, 2]), route)
    return _bucket(W.mix(own ^ np.uint64(0x5851F42D4C957F2D)), buckets), _bucket(route, buckets)


def _cuts(node: np.ndarray) -> tuple[np.ndarray, dict[int, slice]]:
    order = np.argsort(node, kind="stable")
    if not len(node):
        return order, {}
    sorted_node = node[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_node[1:] != sorted_node[:-1])))
    ends = np.append(starts[1:], len(node))
    return order, {int(sorted_node[s]): slice(s, e) for s, e in zip(starts, ends, strict=True)}


def _rows(chunk: int, node_w: np.ndarray, node_s: np.ndarray, langs: list[str], own: np.ndarray, n: np.ndarray,
          lang: np.ndarray, found: list[bytes], suffix: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Rows of DEALT, one for each node."""
    order_w, cuts_w = _cuts(node_w)
    order_s, cuts_s = _cuts(node_s)
    out: dict[str, list] = {c.split()[0]: [] for c in DEALT.split(", ")}
    for k in sorted(cuts_w.keys() | cuts_s.keys()):
        w, s = order_w[cuts_w.get(k, slice(0, 0))], order_s[cuts_s.get(k, slice(0, 0))]
        kinds, of = np.unique(lang[w], return_inverse=True)
        known, at = np.unique(suffix[s], return_inverse=True)
        at = at.reshape(-1, LONGEST)
        sort = np.argsort(at[:, 0] * len(known) + at[:, 1], kind="stable")   # leading words in order take little room
        s, at = s[sort], at[sort].astype(np.uint32)
        cells = {"node": k, "chunk": chunk, "langs": [langs[x] for x in kinds],
                 "words": zstandard.compress(b"\n".join([found[x] for x in w.tolist()]), 1),
                 "of": pack(of.astype(np.uint32)), "hashes": pack(own[w]), "counts": pack(n[w].astype(np.int64)),
                 "known": pack_sorted(known), "first": pack(at[:, 0].copy()), "second": pack(at[:, 1].copy()),
                 "third": pack(at[:, 2].copy()), "times": pack(times[s].astype(np.int64))}
        for name, value in cells.items():
            out[name].append(value)
    return pa.RecordBatch.from_pydict(out, schema=pa.schema(
        [("node", pa.int64()), ("chunk", pa.int64()), ("langs", pa.list_(pa.string())),
         *((c, pa.binary()) for c in list(out)[3:])]))


def _added_up(own: np.ndarray, n: np.ndarray, lang: np.ndarray, found: list[bytes], suffix: np.ndarray, times: np.ndarray) -> tuple:
    """Entries that are equal become one with the sum of their counts."""
    order = np.argsort(own, kind="stable")
    own, lang, words = own[order], lang[order], np.array(found, object)[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (lang[1:] != lang[:-1]) | (words[1:] != words[:-1])   # two words with one hash stay two
    first = np.flatnonzero(new)
    n = np.add.reduceat(n[order], first) if len(first) else n
    order = np.argsort(W.mix(_pair(suffix) + suffix[:, 2]), kind="stable")
    suffix, times = suffix[order], times[order]
    new = np.ones(len(suffix), bool)
    new[1:] = (suffix[1:] != suffix[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return own[first], n, lang[first], words[first].tolist(), suffix[at], np.add.reduceat(times, at) if len(at) else times


def _deal(buckets: int, step: int, heavy: np.ndarray, stream: int):
    """Rows of DEALT from (lang, text); nodes are ``step`` buckets wide."""
    def counted(langs: list[str], held: list[W.Texts]) -> tuple:
        sizes = np.concatenate([np.diff(t.offsets) for t in held])
        w = _Words(langs, W.Texts(np.concatenate([t.data for t in held]), np.concatenate(([0], np.cumsum(sizes)))), stream)
        own, n, lang, found, at = w.vocabulary()
        return w.langs, own, n, lang, found, *w.suffixes(own, at)

    def flush(chunk: int, parts: list[tuple]) -> pa.RecordBatch:
        langs = sorted({x for part in parts for x in part[0]})
        number = {x: k for k, x in enumerate(langs)}
        own, n, lang, suffix, times = (np.concatenate(x) for x in zip(*(
            (own, n, np.array([number[x] for x in names], np.int64)[lang], suffix, times)
            for names, own, n, lang, _, suffix, times in parts), strict=True))
        own, n, lang, found, suffix, times = _added_up(own, n, lang, [w for part in parts for w in part[4]], suffix, times)
        node_w, node_s = _buckets(own, suffix, heavy, buckets)
        return _rows(chunk, node_w // step, node_s // step, langs, own, n, lang, found, suffix, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        langs: list[str] = []
        held: list[W.Texts] = []
        parts: list[tuple] = []
        for batch in batches:
            own = batch.column(0).to_pylist()
            for first, piece in W.texts(batch.column(1)).pieces():
                langs += own[first:first + len(piece)]
                held.append(W.Texts(piece.data.copy(), piece.offsets))
                if sum(len(t.data) for t in held) >= CHUNK_BYTES:
                    parts.append(counted(langs, held))
                    langs, held = [], []
                if sum(len(part[1]) + len(part[6]) for part in parts) >= HELD:
                    yield flush((task << 24) + seq, parts)
                    parts, seq = [], seq + 1
        if held:
            parts.append(counted(langs, held))
        if parts:
            yield flush((task << 24) + seq, parts)

    return run


def _merged(rows: pd.DataFrame) -> tuple:
    """langs, own, n, lang, found, suffix, times of some rows of DEALT, entry after entry."""
    langs = sorted({x for row in rows["langs"] for x in row})
    number = {x: k for k, x in enumerate(langs)}
    own = np.concatenate([unpack(x, "<u8") for x in rows["hashes"]])
    n = np.concatenate([unpack(x, "<i8") for x in rows["counts"]])
    lang = np.concatenate([np.array([number[x] for x in names], np.int64)[unpack(of, "<u4")]
                           for names, of in zip(rows["langs"], rows["of"], strict=True)])
    found = [w for x, names in zip(rows["words"], rows["langs"], strict=True) if len(names)
             for w in zstandard.decompress(x).split(b"\n")]
    suffix = np.concatenate([np.stack([unpack_sorted(k)[unpack(x, "<u4")] for x in at], axis=1)
                             for k, *at in rows[["known", "first", "second", "third"]].itertuples(index=False)])
    times = np.concatenate([unpack(x, "<i8") for x in rows["times"]])
    return langs, own, n, lang, found, suffix, times


def _deal_again(buckets: int, step: int, heavy: np.ndarray):
    """Rows of DEALT for narrower nodes from those of one node and some chunks."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        langs, *entries = _merged(rows)
        own, n, lang, found, suffix, times = _added_up(*entries)
        node_w, node_s = _buckets(own, suffix, heavy, buckets)
        return _rows(int(key[1]), node_w // step, node_s // step, langs, own, n, lang, found, suffix, times).to_pandas()

    return run


# ---- sorting -------------------------------------------------------------

def sort_counts(keys: np.ndarray, times: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of leading words, phrases (as a pointer to a suffix that
    starts with it) and their counts, of those with ``least`` occurrences or
    more: multikey three-way quicksort, all segments in step."""
    n, depths = keys.shape
    flat, pointer = np.ascontiguousarray(keys).ravel(), np.arange(n)
    size, depth = np.array([n] if n else [], np.int64), np.zeros(1 if n else 0, np.int64)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(depths)]
    rng = np.random.default_rng(n)
    while len(size):
        start = np.cumsum(size) - size
        pivot = flat[pointer[start + rng.integers(0, size)] * depths + depth]
        segment = np.repeat(np.arange(len(size)), size)
        value = flat[pointer * depths + depth[segment]]
        bound = pivot[segment]
        side = (value >= bound).astype(np.int64) + (value > bound)     # smaller, equal, greater
        # partition all segments: an element's place among those of its segment and side
        part = segment * 3 + side
        count = np.bincount(part, minlength=3 * len(size))
        order = np.empty(len(part), np.int64)
        base = np.cumsum(count) - count
        for k in range(3):
            mine = np.flatnonzero(side == k)
            before = np.cumsum(count[k::3]) - count[k::3]
            order[base[part[mine]] + np.arange(len(mine)) - before[segment[mine]]] = mine
        pointer = pointer[order]
        weight = np.bincount(part, times, minlength=3 * len(size)).astype(np.int64) if times.sum() < 1 << 53 else _sums(part, times, 3 * len(size))
        times = times[order]
        equal = np.tile([False, True, False], len(size))
        level = np.repeat(depth, 3) + equal
        alive = weight >= least
        for d in range(depths):
            done = np.flatnonzero(alive & equal & (level == d + 1))
            found[d].append((pointer[base[done]], weight[done]))
        alive &= level < depths
        stay = np.repeat(alive, count)
        pointer, times = pointer[stay], times[stay]
        size, depth = count[alive], level[alive]
    return [(np.concatenate([p for p, _ in f]) if f else np.zeros(0, np.int64),
             np.concatenate([c for _, c in f]) if f else np.zeros(0, np.int64)) for f in found]


def _sums(part: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, part, times)
    return out


def _mine(least: int, heavy: np.ndarray):
    """Rows of FOUND from all rows of DEALT of one bucket."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        langs, own, n, lang, found, suffix, times = _merged(rows)
        out = []

        def add(kind: int, count: np.ndarray, keys=None, lang=None, word=None) -> None:
            k = len(count)
            none = [None] * k
            first, second, third = (keys[:, d].view(np.int64) if keys is not None else np.zeros(k, np.int64) for d in range(LONGEST))
            out.append(pd.DataFrame({"kind": np.full(k, kind, np.int32), "first": first, "second": second, "third": third,
                                     "n": count, "lang": none if lang is None else lang, "word": none if word is None else word}))

        names = np.array(langs, object)
        total = _sums(lang, n, len(langs))
        add(LANG, total, lang=names)
        distinct, at, of = np.unique(own, return_index=True, return_inverse=True)
        words = np.array(found, object)
        if ((words != words[at][of]) | (lang != lang[at][of])).any():
            add(CLASH, np.ones(1, np.int64))
        count = _sums(of, n, len(distinct))
        some = np.flatnonzero(count >= least)
        keys = np.zeros((len(some), LONGEST), np.uint64)
        keys[:, 0] = distinct[some]
        add(WORD, count[some], keys, names[lang[at[some]]], [w.decode() for w in words[at[some]]])
        hot = np.isin(_pair(suffix), heavy)
        for part in (~hot, hot):
            own_keys, own_times = suffix[part], times[part]
            _, two, three = sort_counts(own_keys, own_times, least)
            if part is hot:   # a heavy pair is in several buckets: what this one has is a part of its count
                pairs, at, of = np.unique(_pair(own_keys), return_index=True, return_inverse=True)
                two = at, _sums(of, own_times, len(pairs))
            whole = own_keys[three[0], 2] != 0
            keys = own_keys[two[0]].copy()
            keys[:, 2] = 0
            add(TWO, two[1], keys)
            add(THREE, three[1][whole], own_keys[three[0][whole]])
        return pd.concat(out, ignore_index=True)

    return run


# ---- the operator --------------------------------------------------------

def _sampled(stream: int):
    """(first, second, n) of pairs with a share of a batch's suffixes that a heavy pair may have; 0, 0: its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), W.texts(batch.column(1))
            for first, piece in texts.pieces():
                w = _Words(langs[first:first + len(piece)], piece, stream)
                own, _, _, _, at = w.vocabulary()
                suffix, times = w.suffixes(own, at)
                pair, of = np.unique(_pair(suffix), return_inverse=True)
                n = _sums(of, times, len(pair))
                some = n * 4 * HEAVY >= n.sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.append(pair[some], 0).astype(np.uint64).view(np.int64)),
                                                  pa.array(np.append(n[some], len(w.hash)).astype(np.int64))], ["pair", "n"])

    return run


def count_phrases(docs: DataFrame, text: Column, lang: Column, least: int = LEAST) -> DataFrame:
    """Rows of FOUND: the words and phrases of ``least`` occurrences or more."""
    rows = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    for stream in range(len(W._MULTIPLIER)):
        sample = rows.sample(fraction=min(1.0, SAMPLE_BYTES / max(1, size)), seed=7)
        pairs = sample.mapInArrow(_sampled(stream), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        most = pairs.orderBy(F.col("pair") != 0, F.desc("n")).limit(2 * HEAVY).collect()
        words = sum(r["n"] for r in most if r["pair"] == 0)
        heavy = np.sort(np.array([r["pair"] for r in most if r["pair"] != 0 and r["n"] * HEAVY >= words], np.int64).view(np.uint64))
        scale = max(1.0, size / SAMPLE_BYTES)
        buckets = max(LEAST_BUCKETS, int(words * scale) // BUCKET_WORDS)
        step, levels = deal_levels(buckets, FAN)
        dealt = rows.mapInArrow(_deal(buckets, step, heavy, stream), DEALT)
        for groups, narrower in levels:
            group = F.pmod(F.xxhash64("chunk"), F.lit(groups)).alias("group")
            dealt = dealt.groupBy("node", group).applyInPandas(_deal_again(buckets, narrower, heavy), DEALT)
        found = materialise(dealt.groupBy("node").applyInPandas(_mine(least, heavy), FOUND), "phrases")
        if not found.filter(F.col("kind") == CLASH).limit(1).count():
            return found
    raise RuntimeError("collocations: different words have one hash in all hash functions")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    found = count_phrases(docs, F.col(text), F.col(lang), least)

    def kind(k: int) -> DataFrame:
        return found.filter(F.col("kind") == k)

    words = kind(WORD).select(F.col("first").alias("h"), "lang", "word", F.col("n").alias("f"))
    two = (kind(TWO).groupBy("first", "second").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    three = kind(THREE).select("first", "second", "third", F.col("n").alias("a"))

    def word(k: int, of: str) -> DataFrame:
        return words.select(F.col("h").alias(of), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"),
                            *([F.col("lang")] if k == 1 else []))

    def score(l: str, r: str) -> Column:
        return F.expr(f"(1000000 * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div "
                      f"(cast({l} as decimal(19,0)) * cast({r} as decimal(19,0)))")

    longer = (three.select("first", "second", "a").unionByName(three.select(F.col("second").alias("first"), F.col("third").alias("second"), "a"))
              .groupBy("first", "second").agg(F.max("a").alias("longer")))
    short = (two.join(longer, ["first", "second"], "left").filter(F.coalesce(100 * F.col("longer") < SHARE * F.col("a"), F.lit(True)))
             .join(word(1, "first"), "first").join(word(2, "second"), "second")
             .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                     score("f1", "f2").alias("score")))
    heads, tails = two.withColumnRenamed("a", "f12"), two.toDF("second", "third", "f23")
    long = (three.join(heads, ["first", "second"]).join(tails, ["second", "third"])
            .join(word(1, "first"), "first").join(word(2, "second"), "second").join(word(3, "third"), "third")
            .withColumn("s1", score("f1", "f23")).withColumn("s2", score("f12", "f3")))
    early = F.col("s1") <= F.col("s2")
    long = long.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                       F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                       F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the first of each part, then the first of these: a language is spread over PARTS tasks
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    best = (short.unionByName(long).select("*", part)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("part", "rank"))
    ranked = (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
              .filter(F.col("rank") <= top))
    totals = kind(LANG).groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
