"""Toxicity scores from a factorization machine over hashed terms.

A term is a lower-cased word (a run of letters and digits) or a prefix of one,
so that inflected forms share terms.  The machine adds to each term's linear
weight the inner products of all pairs of terms in a text: an insult next to
a mention of a group can weigh more than the sum of both.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows, those with the smallest
hash of their id (a documented bound of the fit, not of the scoring).  Terms
are counted by label as a distributed aggregate, equal texts once; all terms
whose likelihood ratio with the label is ``MIN_RATIO`` or more become the
machine's inputs, and full-batch Adam fits the weights on the driver.  Terms
that matter in pairs only are found next: for every pair of terms that
``MIN_TEXTS`` texts hold each, the toxic texts with both are compared with the
number that the machine expects of them, by likelihood ratio; where it exceeds
twice the logarithm of the number of pairs, both terms become inputs and the
machine is fitted again, until no pair adds a term.  The sample's terms (not
its texts) reach the driver, 4 bytes each, and are broadcast to tasks that
share the pairs out.  Scoring is map-only over all whole texts; the model
travels with the task.

Defined cases: null and empty texts have no terms and get the machine's
constant score; a null id is not held out; repeated label rows count once,
as toxic if one of them is; without labels of both kinds every score is the
share of toxic labels (0 if there are none); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptsearch.llm import words as W
from conceptsearch.llm.tables import fresh, materialise, with_arrays

SAMPLE_ROWS = 16_000
HASH_BITS = 20
MIN_RATIO = 15.0
MIN_TEXTS = 5
#: Share of wrong labels that the comparison of pairs allows for.
NOISE = 0.01
PAIR_ENTRIES = 1 << 20
PREFIX_BYTES = (4, 5, 6, 7, 8)
FACTORS = 6
STEPS = 300
RATE = 0.1
DECAY_LINEAR, DECAY_FACTORS = 2e-5, 2e-4
THRESHOLD = 0.3

TERM_BYTE = np.zeros(256, dtype=bool)
TERM_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For pieces of a text column: the first text's index, and the text and
    the hashed term of each term occurrence."""
    for first, piece in W.texts(pc.utf8_lower(column)).pieces():
        w = W.runs(piece, TERM_BYTE[piece.data])
        for k, upto in enumerate((None, *PREFIX_BYTES)):
            hashed = W.hash_spans(piece.data, w.start, w.end, upto=upto) + np.uint64(k)
            if k:  # a word no longer than the prefix is a term already
                longer = w.end - w.start > upto
                yield first, w.text[longer], (W.mix(hashed[longer]) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
            else:
                yield first, w.text, (W.mix(hashed) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


@dataclass
class Machine:
    """w0 + the linear weights of the inputs present + their pairs' products."""

    constant: float
    inputs: np.ndarray       # hashed terms, sorted
    linear: np.ndarray       # one weight an input
    factors: np.ndarray      # inputs x FACTORS

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and input of each input that occurs in a text, once, in order."""
        position = np.full(1 << HASH_BITS, -1, np.int32)
        position[self.inputs] = np.arange(len(self.inputs))
        width = max(len(self.inputs), 1)
        found = [np.zeros(0, np.int64)]
        for first, text, term in terms(column):
            at = position[term]
            hit = at >= 0
            found.append(np.unique((text[hit] + first) * width + at[hit]))
        both = np.unique(np.concatenate(found))
        return both // width, both % width

    def logits(self, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = self.constant + np.bincount(text, self.linear[at], minlength=n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(text, v, minlength=n) ** 2 - np.bincount(text, v * v, minlength=n))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.logits(*self.present(column), len(column)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_machine(text: np.ndarray, at: np.ndarray, label: np.ndarray, inputs: np.ndarray) -> Machine:
    """Full-batch Adam on the log loss; every run gives the same weights."""
    n, m = len(label), len(inputs)
    share = min(max(label.mean(), 1e-3), 1 - 1e-3)
    rng = np.random.default_rng(7)
    machine = Machine(float(np.log(share / (1 - share))), inputs, np.zeros(m),
                      rng.normal(0, 0.01, (m, FACTORS)))
    weights = [np.array([machine.constant]), machine.linear, machine.factors]
    first = [np.zeros_like(x) for x in weights]
    second = [np.zeros_like(x) for x in weights]
    for step in range(1, STEPS + 1):
        machine.constant = float(weights[0][0])
        error = sigmoid(machine.logits(text, at, n)) - label
        spread = error[text]
        own = np.bincount(at, spread, minlength=m)
        factors = np.empty_like(machine.factors)
        for f in range(FACTORS):
            sums = np.bincount(text, machine.factors[at, f], minlength=n)
            factors[:, f] = np.bincount(at, spread * sums[text], minlength=m) - own * machine.factors[:, f]
        gradient = [np.array([error.sum()]) / n, own / n + DECAY_LINEAR * machine.linear,
                    factors / n + DECAY_FACTORS * machine.factors]
        for x, g, a, b in zip(weights, gradient, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    machine.constant = float(weights[0][0])
    return machine


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, texts): the texts of this task that hold each term."""
    counts = np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        width = 1 << HASH_BITS
        for first, text, term in terms(batch.column(0)):
            both = np.unique((text + first) * width + term)
            for k in (0, 1):
                held, texts = np.unique(both[label[both // width] == k] % width, return_counts=True)
                counts[k][held] += texts
    for k in (0, 1):
        held = np.flatnonzero(counts[k])
        yield pa.RecordBatch.from_arrays(
            [pa.array(held), pa.array(np.full(len(held), k)), pa.array(counts[k][held])],
            ["term", "toxic", "texts"])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the labelled rows to learn from, at most SAMPLE_ROWS
    labels: the id's crc32 modulo 4 is not 2, smallest hashes first."""
    rows = (labels.filter("toxic is not null and doc_id is not null")
            .groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic"))
            .filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    rows = F.broadcast(rows.select(F.col("doc_id").alias("label_id"), "toxic"))  # 16 bytes a row, at most SAMPLE_ROWS
    return (docs.join(rows, F.col("doc_id") == F.col("label_id"))
            .groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
            .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")))


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    rows = training_rows(docs, labels).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = materialise(rows, "labelled")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        constant = 30.0 if toxic else -30.0
        return Machine(constant, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    counted = (rows.select("text", "toxic").mapInArrow(_count_terms, "term long, toxic long, texts long")
               .groupBy("term")
               .agg(F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("a"),
                    F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("b")))
    a, b, n = F.col("a"), F.col("b"), toxic + clean
    cells = ((a, (a + b) * toxic / n), (b, (a + b) * clean / n),
             (toxic - a, (n - a - b) * toxic / n), (clean - b, (n - a - b) * clean / n))
    ratio = 2 * sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))
    held = (counted.select("term", (F.col("a") + F.col("b")).alias("texts"), ratio.alias("ratio"))
            .filter((F.col("ratio") >= MIN_RATIO) | (F.col("texts") >= MIN_TEXTS)).orderBy("term").toArrow())
    inputs = held["term"].to_numpy()
    strong = np.flatnonzero(held["ratio"].to_numpy() >= MIN_RATIO)
    paired = held["texts"].to_numpy() >= MIN_TEXTS
    empty = Machine(0.0, inputs, np.zeros(len(inputs)), np.zeros((len(inputs), FACTORS)))

    def inputs_of(column: pa.Array) -> list[pa.Array]:
        text, at = empty.present(column)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(column)))))
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(at, pa.int32()))]

    sample = (with_arrays(rows, ["text"], {"at": "array<int>"}, inputs_of)
              .select("doc_id", "toxic", "at").orderBy("doc_id", "at").toArrow())
    label = sample["toxic"].to_numpy().astype(float)
    lists = sample["at"].combine_chunks()
    text = np.repeat(np.arange(len(lists), dtype=np.int32), pc.list_value_length(lists).to_numpy())
    at = lists.flatten().to_numpy()
    del sample, lists
    while True:
        place = np.full(len(inputs), -1, np.int32)
        place[strong] = np.arange(len(strong))
        chosen = place[at] >= 0
        machine = fit_machine(text[chosen], place[at[chosen]], label, inputs[strong])
        expected = sigmoid(machine.logits(text[chosen], place[at[chosen]], len(label)))
        more = np.union1d(strong, associated(docs.sparkSession, text, at, label, expected, paired))
        if len(more) == len(strong):
            return machine
        strong = more


def associated(spark: SparkSession, text: np.ndarray, at: np.ndarray, label: np.ndarray, expected: np.ndarray,
               paired: np.ndarray) -> np.ndarray:
    """The terms of all pairs of ``paired`` terms whose texts' labels differ
    from what is expected of them."""
    expected = np.clip(expected, NOISE, 1 - NOISE)
    m = len(paired)
    least = 2 * np.log(max(paired.sum() * (paired.sum() - 1) / 2, 1))
    # a ratio of ``least`` takes so many toxic texts, found or expected
    weight = least / (2 * np.log(1 / NOISE) / (1 - NOISE))
    ok = paired & (np.maximum(np.bincount(at, label[text], minlength=m), np.bincount(at, expected[text], minlength=m)) >= weight)
    place = np.full(m, -1, np.int32)
    terms_of = np.flatnonzero(ok)
    place[terms_of] = np.arange(len(terms_of))
    kept = ok[at]
    if not kept.any():
        return np.zeros(0, np.int64)
    pairs = Pairs(text[kept], place[at[kept]], label, expected, len(terms_of))
    tasks = spark.sparkContext.defaultParallelism * 4
    shared = spark.sparkContext.broadcast(pairs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(shared.value.at, kind="stable")
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.members(order, k, tasks, least, weight))], ["member"])

    found = spark.range(0, tasks, 1, tasks).mapInArrow(search, "member long").distinct().toArrow()
    shared.unpersist()
    return terms_of[np.sort(found["member"].to_numpy())]


@dataclass
class Pairs:
    """A sample's texts with their terms, ordered by text and term."""

    text: np.ndarray
    at: np.ndarray
    label: np.ndarray
    expected: np.ndarray
    terms: int

    def members(self, order: np.ndarray, first: int, step: int, least: float, weight: float) -> np.ndarray:
        """Of the associated pairs (i, j), j > i, all i and j; i = first, first + step, ..."""
        ends = np.searchsorted(self.text, np.arange(len(self.label)), side="right")
        starts = np.searchsorted(self.at[order], np.arange(self.terms + 1))
        out = [np.zeros(0, np.int64)]
        for i in range(first, self.terms, step):
            seen = np.zeros((3, self.terms))
            entry = order[starts[i]:starts[i + 1]]
            after = ends[self.text[entry]] - entry - 1
            cuts = np.searchsorted(np.cumsum(after), np.arange(PAIR_ENTRIES, after.sum(), PAIR_ENTRIES))
            for e, size in zip(np.split(entry, cuts), np.split(after, cuts), strict=True):
                other = self.at[np.repeat(e + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                text = np.repeat(self.text[e], size)
                for total, w in zip(seen, (None, self.label, self.expected), strict=True):
                    total += np.bincount(other, w if w is None else w[text], minlength=self.terms)
            j = np.flatnonzero((np.maximum(seen[1], seen[2]) >= weight) & (seen[0] >= MIN_TEXTS))
            n, toxic, mean = seen[:, j]
            clean = n - toxic
            ratio = 2 * (toxic * np.log(np.maximum(toxic, 1) / mean) + clean * np.log(np.maximum(clean, 1) / (n - mean)))
            j = j[ratio >= least]
            if len(j):
                out += [j, np.array([i])]
        return np.unique(np.concatenate(out))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score from 0 to 1, and that column's name."""
    (name,) = fresh(docs, "score")
    return with_arrays(docs, [text], {name: "double"}, lambda column: [pa.array(machine.scores(column))]), name


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    machine = fit(docs.select("doc_id", "text"), labels)
    scored, _ = score(docs.select("doc_id", "text"), machine)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
