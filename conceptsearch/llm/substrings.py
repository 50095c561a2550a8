"""Exact substring dedup by fixed-block anchors.

Words of a document that lie in a run of ``WINDOW`` words which also starts
earlier (in a document of smaller id, or before in the same one) are removed.

Every document is cut into blocks of ``BLOCK`` words that don't overlap; their
hashes are the index.  All windows of ``BLOCK`` words roll over the index as
probes.  Two runs of ``WINDOW`` (at least 2 * BLOCK - 1) equal words each hold
a whole block of their own document, which the other one's window hits; so
only runs around hits can repeat.  Hits are extended to all runs of
``WINDOW`` words around them, the first of equal runs is found among these,
and the later ones, joined, are the maximal repeats that go.

Documents are handled in chunks of some megabytes.  A chunk resolves repeats
inside itself, so it sends each hash once, however often it holds it, and
gets back the hashes that others hold first.  What moves is sorted hashes as
compressed differences, a few bytes a word.

Defined cases: a null text has no words; null ids come after all others;
rows with equal ids are ordered as they are read, equal rows are
interchangeable; an empty table gives an empty result; only the id and the
text of the input are read.

Scale: chunks are written once to a table in the shared folder, bucketed by
chunk, so what comes back joins them without moving texts again.  Hashes are
dealt by value into buckets of about ``BUCKET_WORDS`` words; a hash that is in
every document has one entry a chunk.  A chunk sends ``FAN`` rows at most,
whatever the number of buckets: where that is larger, rows are merged and
dealt again, level by level, so rows grow with the input.  All levels deal to
about as many nodes, and rows are merged up to about ``BUCKET_WORDS`` words, so
no task holds more than a bucket.  No pair of documents is ever formed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm import words as W
from conceptsearch.llm.tables import deal_levels, new_path, pack, pack_sorted, unpack, unpack_sorted

WINDOW = 20
BLOCK = 10
CHUNK_BYTES = 6 << 20
BUCKET_WORDS = 3_000_000
#: Nodes that a row's hashes are dealt to at a time.
FAN = 256
#: Bits of a block's hash; candidates that share them by chance are told
#: apart by the 96 bits of a run's hash.
BLOCK_BITS = 48

CHUNK_SCHEMA = "chunk long, words long, ids binary, nones binary, sizes binary, texts binary"
SHARED_SCHEMA = "chunk long, hashes binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CHUNK_SCHEMA from (doc_id, text): whole texts, about CHUNK_BYTES."""
    task, seq = TaskContext.get().partitionId(), 0
    ids: list[np.ndarray] = []
    nones: list[np.ndarray] = []
    held: list[W.Texts] = []

    def flush() -> pa.RecordBatch:
        data = np.concatenate([t.data for t in held])
        sizes = np.concatenate([np.diff(t.offsets) for t in held])
        whole = W.Texts(data, np.concatenate(([0], np.cumsum(sizes))))
        n = sum(len(W.words(piece).text) for _, piece in whole.pieces())
        row = ((task << 24) + seq, n, pack(np.concatenate(ids)), pack(np.concatenate(nones)), pack(sizes),
               zstandard.compress(data.tobytes(), 3))
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["chunk", "words", "ids", "nones", "sizes", "texts"])

    for batch in batches:
        column = batch.column(0).cast(pa.int64())
        own = column.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        none = column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        for first, piece in W.texts(batch.column(1)).pieces():
            ids.append(own[first:first + len(piece)].copy())
            nones.append(none[first:first + len(piece)].copy())
            held.append(W.Texts(piece.data.copy(), piece.offsets))
            if sum(len(t.data) for t in held) >= CHUNK_BYTES:
                yield flush()
                ids, nones, held, seq = [], [], [], seq + 1
    if held:
        yield flush()


class _Chunk:
    """A row of the chunk table: its texts, and their words in text order."""

    def __init__(self, row: dict) -> None:
        self.id = row["chunk"]
        self.ids = unpack(row["ids"], "<i8")
        sizes = unpack(row["sizes"], "<i8")
        self.texts = W.Texts(np.frombuffer(zstandard.decompress(row["texts"]), np.uint8),
                             np.concatenate(([0], np.cumsum(sizes))))
        self.owner, self.word = W.word_hashes(self.texts, (0, 1))

    def grams(self) -> np.ndarray:
        """The hash of the BLOCK words at each place (also across texts)."""
        return W.window_hashes(self.word[0], BLOCK) >> np.uint64(64 - BLOCK_BITS)

    def runs(self, stream: int = 0) -> np.ndarray:
        return W.window_hashes(self.word[stream], WINDOW, stream)

    def in_order(self, at: np.ndarray) -> np.ndarray:
        """Places in the order of documents, then of words."""
        rank = np.empty(len(self.ids), np.int64)
        rank[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))
        return at[np.argsort(rank[self.owner[at]], kind="stable")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def _bucket(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """The bucket of each hash of so many bits, by value."""
    return ((values >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Hashes of a chunk, or of several: a row for each node that has any.  ``chunks``
#: lists the chunks, ``owner`` says which of them each hash is of.
GRAMS = "node long, part long, chunks binary, blocks binary, block_owner binary, others binary, other_owner binary"
RUNS = "node long, part long, chunks binary, hashes binary, owner binary, checks binary, ids binary"


def _cuts(node: np.ndarray) -> dict[int, slice]:
    """The slice of each value in a sorted array."""
    if not len(node):
        return {}
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    return {int(node[s]): slice(s, e) for s, e in zip(starts, np.append(starts[1:], len(node)), strict=True)}


def _owners(owner: np.ndarray, chunks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chunks that occur, packed, and the owners as places among them."""
    some, at = np.unique(owner, return_inverse=True)
    return pack(chunks[some]), at.astype(np.uint32)


def _gram_rows(part: int, chunks: np.ndarray, blocks: np.ndarray, block_owner: np.ndarray, others: np.ndarray,
               other_owner: np.ndarray, buckets: int, step: int) -> pa.RecordBatch:
    """Rows of GRAMS from sorted hashes; a node is ``step`` buckets."""
    index = _cuts(_bucket(blocks, BLOCK_BITS, buckets) // step)
    probes = _cuts(_bucket(others, BLOCK_BITS, buckets) // step)
    out: list[list] = [[] for _ in range(7)]
    for k in sorted(index.keys() | probes.keys()):
        i, o = index.get(k, slice(0, 0)), probes.get(k, slice(0, 0))
        some, owner = _owners(np.concatenate((block_owner[i], other_owner[o])), chunks)
        n = i.stop - i.start
        for cells, value in zip(out, (k, part, some, pack_sorted(blocks[i]), pack(owner[:n]),
                                      pack_sorted(others[o]), pack(owner[n:])), strict=True):
            cells.append(value)
    return _batch(out, GRAMS)


def _run_rows(part: int, chunks: np.ndarray, value: np.ndarray, owner: np.ndarray, check: np.ndarray, ids: np.ndarray,
              buckets: int, step: int) -> pa.RecordBatch:
    """Rows of RUNS from sorted hashes."""
    out: list[list] = [[] for _ in range(7)]
    for k, own in _cuts(_bucket(value, 64, buckets) // step).items():
        some, at = _owners(owner[own], chunks)
        for cells, x in zip(out, (k, part, some, pack_sorted(value[own]), pack(at), pack(check[own]), pack(ids[own])), strict=True):
            cells.append(x)
    return _batch(out, RUNS)


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * (len(columns) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _send_grams(buckets: int, step: int):
    """Rows of GRAMS: the hashes of a chunk's own blocks, and of its windows
    that are none of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row)
            grams, whole = c.grams(), W.whole_windows(c.owner, BLOCK)
            first = np.concatenate(([0], np.cumsum(np.bincount(c.owner, minlength=len(c.ids)))))
            place = np.arange(len(grams)) - first[c.owner[:len(grams)]]
            blocks = np.unique(grams[whole & (place % BLOCK == 0)])
            others = np.unique(grams[whole & (place % BLOCK != 0)])
            others = others[~_member(others, blocks)]
            yield _gram_rows(c.id, np.array([c.id]), blocks, np.zeros(len(blocks), np.int64), others,
                             np.zeros(len(others), np.int64), buckets, step)

    return run


def _together(rows: pd.DataFrame, chunks: list[np.ndarray], hashes: str, owner: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows, and the chunk of each."""
    value = np.concatenate([unpack_sorted(x) for x in rows[hashes]])
    return value, np.concatenate([c[unpack(x, "<u4")] for c, x in zip(chunks, rows[owner], strict=True)])


def _numbered(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """All chunks of some rows, and where those of each row are among them."""
    own = [unpack(x, "<i8") for x in rows["chunks"]]
    chunks = np.unique(np.concatenate(own))
    return chunks, [np.searchsorted(chunks, c) for c in own]


def _grams_again(buckets: int, step: int):
    """Rows of GRAMS for narrower nodes, from those of one node and some chunks."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chunks, at = _numbered(rows)
        blocks, block_owner = _together(rows, at, "blocks", "block_owner")
        others, other_owner = _together(rows, at, "others", "other_owner")
        i, o = np.argsort(blocks, kind="stable"), np.argsort(others, kind="stable")
        return _gram_rows(int(key[1]), chunks, blocks[i], block_owner[i], others[o], other_owner[o], buckets, step).to_pandas()

    return run


def _runs_again(buckets: int, step: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chunks, at = _numbered(rows)
        value, owner = _together(rows, at, "hashes", "owner")
        check = np.concatenate([unpack(x, "<u4") for x in rows["checks"]])
        ids = np.concatenate([unpack(x, "<i8") for x in rows["ids"]])
        i = np.argsort(value, kind="stable")
        return _run_rows(int(key[1]), chunks, value[i], owner[i], check[i], ids[i], buckets, step).to_pandas()

    return run


def _by_chunk(values: np.ndarray, owner: np.ndarray, chunks: np.ndarray) -> pd.DataFrame:
    """SHARED_SCHEMA from hashes and the chunk that each is of."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    cuts = _cuts(owner)
    return pd.DataFrame({"chunk": chunks[np.array(list(cuts), np.int64)], "hashes": [pack_sorted(values[s]) for s in cuts.values()]})


def _hit_grams(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, its hashes that are a block of another chunk."""
    chunks, at = _numbered(rows)
    blocks, block_owner = _together(rows, at, "blocks", "block_owner")
    others, other_owner = _together(rows, at, "others", "other_owner")
    value, owner = np.concatenate((blocks, others)), np.concatenate((block_owner, other_owner))
    block = np.arange(len(value)) < len(blocks)
    order = np.argsort(value, kind="stable")
    value, owner, block = value[order], owner[order], block[order]
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    n = np.repeat(np.add.reduceat(block.astype(np.int64), start), np.diff(np.append(start, len(value))))
    hit = (n > 1) | ((n == 1) & ~block)  # a chunk has a hash once, as its block or not
    return _by_chunk(value[hit], owner[hit], chunks)


def _send_runs(buckets: int, step: int):
    """Rows of RUNS: runs of WINDOW words around hits, each once, with the
    first document of the chunk that holds it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not row["found"]:
                continue
            c = _Chunk(row)
            hits = np.sort(np.concatenate([unpack_sorted(x) for x in row["found"]]))
            hit = _member(c.grams(), hits) & W.whole_windows(c.owner, BLOCK)
            upto = np.concatenate(([0], np.cumsum(hit)))
            whole = W.whole_windows(c.owner, WINDOW)
            near = upto[WINDOW - BLOCK + 1:][:len(whole)] > upto[:len(whole)]
            at = c.in_order(np.flatnonzero(whole & near))
            if not len(at):
                continue
            value, first = np.unique(c.runs()[at], return_index=True)
            at = at[first]
            yield _run_rows(c.id, np.array([c.id]), value, np.zeros(len(value), np.int64), c.runs(1)[at].astype(np.uint32),
                            c.ids[c.owner[at]], buckets, step)

    return run


def _later_runs(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, its hashes of runs that another chunk holds first."""
    chunks, at = _numbered(rows)
    value, owner = _together(rows, at, "hashes", "owner")
    check = np.concatenate([unpack(x, "<u4") for x in rows["checks"]])
    ids = np.concatenate([unpack(x, "<i8") for x in rows["ids"]])
    order = np.lexsort((owner, ids, check, value))
    value, owner, check = value[order], owner[order], check[order]
    later = np.concatenate(([False], (value[1:] == value[:-1]) & (check[1:] == check[:-1])))
    return _by_chunk(value[later], owner[later], chunks)


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, kept of each document of a chunk."""
    for row in _rows(batches):
        c = _Chunk(row)
        whole = W.whole_windows(c.owner, WINDOW)
        again = np.zeros(len(whole), bool)
        if len(whole):
            run, at = c.runs(), c.in_order(np.flatnonzero(whole))
            _, first = np.unique(run[at], return_index=True)
            again[at] = True
            again[at[first]] = False
            if row["found"]:
                again |= whole & _member(run, np.sort(np.concatenate([unpack_sorted(x) for x in row["found"]])))
        gone = W.covered(again, WINDOW, len(c.owner))
        kept, seen = [], 0
        for first, piece in c.texts.pieces():
            w = W.words(piece)
            keep = ~gone[seen:seen + len(w.text)]
            seen += len(w.text)
            kept += _joined(piece, w.text[keep], w.start[keep], w.end[keep])
        n = len(c.ids)
        none = unpack(row["nones"], "u1").astype(bool)
        yield pa.RecordBatch.from_arrays([
            pa.array(c.ids, pa.int64(), mask=none), pa.array(np.bincount(c.owner, minlength=n), pa.int64()),
            pa.array(np.bincount(c.owner[gone], minlength=n), pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"])


def _joined(t: W.Texts, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The given words of each text, joined by one space."""
    size = end - start + 1
    last = np.cumsum(size)
    out = np.full(int(last[-1]) if len(last) else 0, 0x20, np.uint8)
    span = np.repeat(np.arange(len(size)), size - 1)
    at = np.arange(len(span)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    out[(last - size)[span] + at] = t.data[start[span] + at]
    raw = out.tobytes()
    cuts = np.concatenate(([0], last))[np.searchsorted(text, np.arange(len(t) + 1))]
    return [raw[cuts[k]:max(cuts[k], cuts[k + 1] - 1)].decode() for k in range(len(t))]


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one
    space) of every row of ``docs``."""
    spark = docs.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    (rows.mapInArrow(_chunks, CHUNK_SCHEMA).write.option("path", new_path(spark, "chunks"))
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name))
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE `{name}`")   # the name only: the plan knows the files
    words = chunks.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-words // BUCKET_WORDS))

    def back(found: DataFrame) -> DataFrame:
        """The chunks with what came back for each, at most its own hashes."""
        lists = found.groupBy("chunk").agg(F.collect_list("hashes").alias("found"))
        return chunks.hint("merge").join(lists, "chunk", "left")

    step, levels = deal_levels(buckets, FAN)

    def dealt(sent: DataFrame, again, schema: str) -> DataFrame:
        """Rows for single buckets, from rows for nodes of ``step``: level by
        level, rows are merged to about a bucket's words and dealt again."""
        for groups, narrower in levels:
            group = F.pmod(F.xxhash64("part"), F.lit(groups)).alias("group")
            sent = sent.groupBy("node", group).applyInPandas(again(buckets, narrower), schema)
        return sent.groupBy("node")

    hits = dealt(chunks.mapInArrow(_send_grams(buckets, step), GRAMS), _grams_again, GRAMS).applyInPandas(_hit_grams, SHARED_SCHEMA)
    runs = back(hits).mapInArrow(_send_runs(buckets, step), RUNS)
    later = dealt(runs, _runs_again, RUNS).applyInPandas(_later_runs, SHARED_SCHEMA)
    return back(later).mapInArrow(_keep, "doc_id long, n_words long, n_removed long, kept string")


def kept_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
