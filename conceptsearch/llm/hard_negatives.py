"""Hard negatives by blocks in Hilbert order with zone maps.

Vectors become integers, floor(``SCALE`` * x), and a row's score is its inner
product with an anchor.  All rows are sorted along a Hilbert curve through
the dimensions of largest variance and cut into blocks, each one row of a
Parquet table with the least and largest value of every dimension (its zone
map) and its labels.

Interval arithmetic gives for an anchor and a zone map the least and the
largest score that the block can hold:

* positives (the best rows of the anchor's label): blocks that surely hold
  enough of the label give a score that the positives reach at least; only
  blocks that can reach it are read;
* negatives (for each positive the best rows of other labels between ``low``
  and ``high`` hundredths of its score): only blocks whose interval meets one
  of the anchor's windows are read.

Bounds only leave out blocks that can't matter, so results are exact.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; a null id is no anchor and comes after all others;
rows that repeat an id are rows of their own; missing components of a shorter
vector count as 0; an anchor with fewer rows has fewer results; an empty
table gives an empty result; other columns are not read.  Arithmetic is
exact; a component or a score beyond 64 bits fails the job with a message.

Scale: anchors are packed into slabs of ``SLAB``, blocks dealt into lots, and
each slab meets each lot in a task of its own, which keeps the best rows of
each anchor; pairs of vectors are never rows.  A label that a third of all
rows share is spread over many blocks.  The work is anchors times the rows
that the zone maps leave.  Nothing but a few numbers for each dimension
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conceptsearch.llm.tables import materialise, pack, unpack

SCALE = 256
#: Rows of a block: a 256th of all rows within these limits.
BLOCK_ROWS = (64, 8192)
#: Anchors that one task takes.
SLAB = 4096
#: Blocks of a lot once there are more than LEAST_LOTS lots; zone maps that one task compares.
LOT_BLOCKS, LEAST_LOTS = 16, 64
ZONE_BLOCKS, LEAST_ZONES = 1024, 16
#: Dimensions and bits of the Hilbert curve.
KEY_DIMS, KEY_BITS = 12, 5
#: Scores that a task holds at a time.
SCORES = 2_000_000

VECTORS = "id bigint, label bigint, anchor boolean, vector binary"
PACKED = ("block bigint, n bigint, ids binary, none binary, labels binary, tags binary, vectors binary, "
          "lo binary, hi binary, kinds binary, counts binary")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along a Hilbert curve of cells, (n, d) integers of so many bits."""
    x = cells.astype(np.int64).copy()
    n, d = x.shape
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(d):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, d - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


# ---- rows, blocks and slabs ----------------------------------------------

def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of VECTORS from (id, label, anchor, vector), those that take part."""
    for batch in batches:
        vector = batch.column("vector")
        size = pc.fill_null(pc.list_value_length(vector), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vector.flatten()
        values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(batch.num_rows), size)
        bad = np.bincount(owner[~np.isfinite(values)], minlength=batch.num_rows) > 0
        ok = ~bad & pc.and_(vector.is_valid(), batch.column("label").is_valid()).to_numpy(zero_copy_only=False)
        values = np.floor(SCALE * values[ok[owner]])
        if len(values) and np.abs(values).max() >= 2.0**63:
            raise OverflowError("hard negatives: a component does not fit in 64 bits")
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(size[ok] * 8))).astype("<i8").tobytes())
        data = pa.py_buffer(values.astype("<i8").tobytes())
        vectors = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(ok.sum()), [None, ends, data]).cast(pa.binary())
        kept = batch.filter(pa.array(ok))
        yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("label"), kept.column("anchor"), vectors],
                                         ["id", "label", "anchor", "vector"])


def _matrix(column: pa.Array | list[bytes], dims: int) -> np.ndarray:
    rows = column if isinstance(column, list) else column.to_pylist()
    if all(len(r) == 8 * dims for r in rows):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), dims).copy()
    return np.array([np.pad(np.frombuffer(r, "<i8"), (0, dims - len(r) // 8)) for r in rows], np.int64).reshape(-1, dims)


def _spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, n, lo, hi, sum, squares) of each batch, in doubles."""
    for batch in batches:
        rows = batch.column("vector").to_pylist()
        if not rows:
            continue
        x = _matrix(rows, max(len(r) for r in rows) // 8).astype(float)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], float(len(x)))), pa.array(x.min(0)),
             pa.array(x.max(0)), pa.array(x.sum(0)), pa.array((x * x).sum(0))], ["dim", "n", "lo", "hi", "sum", "squares"])


def _keyed(dims: int, axes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), dims)[:, axes].astype(float)
            cell = (x - lo) / np.maximum(hi - lo, 1) * (1 << KEY_BITS)
            key = hilbert(np.clip(cell, 0, (1 << KEY_BITS) - 1), KEY_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    return run


def _cut(dims: int, size: int):
    """Rows of PACKED: so many consecutive rows of a partition each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        first, n = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                held.append(batch.slice(at, size))
                n += held[-1].num_rows
                if n >= size:
                    rows = pa.Table.from_batches(held)
                    yield _packed(rows.slice(0, size), first, dims)
                    held, n, first = rows.slice(size).to_batches(), n - size, first + 1
        if n:
            yield _packed(pa.Table.from_batches(held), first, dims)

    return run


def _packed(rows: pa.Table, block: int, dims: int) -> pa.RecordBatch:
    x = _matrix(rows.column("vector").to_pylist(), dims)
    ids, labels = rows.column("id"), rows.column("label").to_numpy()
    kinds, counts = np.unique(labels, return_counts=True)
    cells = [pack(v) for v in (
        ids.fill_null(0).to_numpy(), ids.is_null().to_numpy().astype(np.uint8), labels, rows.column("tag").to_numpy(), x.ravel(),
        x.min(0), x.max(0), kinds, counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(x)], pa.int64()),
                                       *(pa.array([c], pa.binary()) for c in cells)],
                                      ["block", "n", "ids", "none", "labels", "tags", "vectors", "lo", "hi", "kinds", "counts"])


class _Rows:
    """The rows of a block or slab."""

    def __init__(self, row: dict, dims: int) -> None:
        self.ids, self.none = unpack(row["ids"], "<i8"), unpack(row["none"], "u1").astype(bool)
        self.labels, self.tags = unpack(row["labels"], "<i8"), unpack(row["tags"], "<i8")
        self.vectors = unpack(row["vectors"], "<i8").reshape(-1, dims)


# ---- scores and bounds ---------------------------------------------------

def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    most = int(np.abs(a.astype(float)).max(initial=0)) * int(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    out = a.astype(object) @ b.T.astype(object)
    if out.size and not (-(2**63) <= out.min() and out.max() < 2**63):
        raise OverflowError("hard negatives: a score does not fit in 64 bits")
    return out.astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score of each vector with any vector inside each zone."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    lo, hi = lo.astype(float).T, hi.astype(float).T
    least, most = up @ lo + down @ hi, up @ hi + down @ lo
    size = (up - down) @ np.maximum(np.abs(lo), np.abs(hi))
    slack = np.where(size < 2.0**52, 0, size * 1e-12)   # beyond that, doubles round
    return least - slack, most + slack


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest allowed scores of each row; of equal ones the first columns."""
    n, m = score.shape
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if np.abs(score.astype(float)).max() < 2.0**62 / m:
        key = np.where(allowed, score * m + (m - 1 - np.arange(m)), np.iinfo(np.int64).min)
        at = np.argpartition(key, m - k, axis=1)[:, m - k:] if m > k else np.tile(np.arange(m), (n, 1))
    else:
        order = np.lexsort((np.broadcast_to(-np.arange(m), score.shape), score), axis=1)[:, ::-1]
        held = np.take_along_axis(allowed, order, 1)
        at = np.where(held & (np.cumsum(held, 1) <= k), order, -1)
    row, column = np.repeat(np.arange(n), at.shape[1]), at.ravel()
    ok = (column >= 0) & allowed[row, column]
    return row[ok], column[ok]


def _zones(rows: list[dict], dims: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([unpack(r[k], "<i8") for r in rows]).reshape(-1, dims) for k in ("lo", "hi"))


def _counts(zones: list[dict], labels: np.ndarray) -> np.ndarray:
    """How many rows of each label (a row of the result) each zone has."""
    out = np.zeros((len(labels), len(zones)), np.int64)
    for j, z in enumerate(zones):
        kinds, counts = unpack(z["kinds"], "<i8"), unpack(z["counts"], "<i8")
        at = np.minimum(np.searchsorted(kinds, labels), len(kinds) - 1)
        out[:, j] = np.where(kinds[at] == labels, counts[at], 0)
    return out


def _sure(dims: int, k: int):
    """(slab, at, bound): scores that k rows of an anchor's label reach at
    least, by the zones of one chunk."""
    def run(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        a, zones = _Rows(pair.iloc[0], dims), list(pair["zones"].iat[0])
        least, _ = bounds(a.vectors, *_zones(zones, dims))
        labels, of = np.unique(a.labels, return_inverse=True)
        # the anchor itself is in one of the zones: one row less in all
        held = np.clip(_counts(zones, labels)[of] - 1, 0, k)
        least = np.where(held > 0, least, -np.inf)
        order = np.argsort(-least, axis=1)[:, :k]
        held, least = np.take_along_axis(held, order, 1), np.take_along_axis(least, order, 1)
        before = np.cumsum(held, 1) - held
        times = np.clip(k - before, 0, held).ravel()
        at = np.repeat(np.arange(len(a.ids)), order.shape[1])
        return pd.DataFrame({"slab": key[0], "at": np.repeat(at, times), "bound": np.repeat(least.ravel(), times)})

    return run


def _need(dims: int, windows: bool):
    """(slab, block, need): the blocks of one chunk that a slab's anchors must
    read, with a bit for each anchor."""
    def run(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        row = pair.iloc[0]
        a, zones = _Rows(row, dims), list(row["zones"])
        least, most = bounds(a.vectors, *_zones(zones, dims))
        wanted = np.zeros(most.shape, bool)
        if windows:
            at, low, high = (np.array([w[k] for w in row["windows"]]) for k in ("at", "low", "high"))
            np.logical_or.at(wanted, at, (most[at] >= low[:, None]) & (least[at] <= high[:, None]))
        else:
            floor = np.full(len(a.ids), -np.inf)
            for t in row["floors"] if row["floors"] is not None else ():
                floor[t["at"]] = t["bound"]
            labels, of = np.unique(a.labels, return_inverse=True)
            wanted = (most >= floor[:, None]) & (_counts(zones, labels)[of] > 0)
        some = np.flatnonzero(wanted.any(0))
        return pd.DataFrame({"slab": key[0], "block": [zones[j]["block"] for j in some],
                             "need": [np.packbits(wanted[:, j]).tobytes() for j in some]})

    return run


def _read(dims: int, fn):
    """What ``fn`` finds in the blocks of a lot for the anchors of a slab.  Rows
    of a lot are taken in the order of ids, so that ties go to smaller ones."""
    def run(key: tuple[pa.Scalar, ...], lot: pa.Table, slab: pa.Table) -> pa.Table:
        found = []
        if lot.num_rows and slab.num_rows:
            row = slab.to_pylist()[0]
            a, blocks = _Rows(row, dims), lot.to_pylist()
            need = np.array([np.unpackbits(np.frombuffer(b["need"], np.uint8), count=len(a.ids)) for b in blocks]).astype(bool)
            parts = [_Rows(b, dims) for b in blocks]
            ids, none, labels, tags = (np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "none", "labels", "tags"))
            vectors, block = np.concatenate([p.vectors for p in parts]), np.repeat(np.arange(len(parts)), [len(p.ids) for p in parts])
            order = np.lexsort((tags, ids, none))
            ids, none, labels, tags, vectors, block = (x[order] for x in (ids, none, labels, tags, vectors, block))
            anchors = np.flatnonzero(need.any(0))
            step = max(1, SCORES // max(1, len(ids)))
            for s in range(0, len(anchors), step):
                some = anchors[s:s + step]
                allowed = need[:, some].T[:, block]
                found += [pa.table({"slab": pa.array(np.full(len(x["at"]), key[0].as_py())), "at": x["at"],
                                    "place": x["place"], "id": pa.array(ids[x["column"]], mask=none[x["column"]]),
                                    "tag": tags[x["column"]], "score": x["score"]})
                          for x in fn(row, a, some, scores(a.vectors[some], vectors), allowed, labels, tags)]
        return pa.concat_tables(found) if found else FOUND.empty_table()

    return run


FOUND = pa.schema([("slab", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("id", pa.int64()),
                   ("tag", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "slab bigint, at bigint, place bigint, id bigint, tag bigint, score bigint"


def _positives(k: int):
    def run(row, a, some, score, allowed, labels, tags):
        allowed = allowed & (labels == a.labels[some][:, None]) & (tags != a.tags[some][:, None])
        i, j = best(score, allowed, k)
        yield {"at": some[i], "place": np.zeros(len(i), np.int64), "column": j, "score": score[i, j]}

    return run


def _negatives(k: int):
    def run(row, a, some, score, allowed, labels, tags):
        allowed = allowed & (labels != a.labels[some][:, None])
        index = np.full(len(a.ids), -1)
        index[some] = np.arange(len(some))
        by_place: dict[int, list] = {}
        for w in row["windows"]:
            if index[w["at"]] >= 0:
                by_place.setdefault(w["place"], []).append(w)
        for place, ws in by_place.items():
            at, low, high = (np.array([w[f] for w in ws]) for f in ("at", "low", "high"))
            own = score[index[at]]
            i, j = best(own, allowed[index[at]] & (own >= low[:, None]) & (own <= high[:, None]), k)
            yield {"at": at[i], "place": np.full(len(i), place), "column": j, "score": own[i, j]}

    return run


def _numbers(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


# ---- the operator --------------------------------------------------------

def _sorted_blocks(rows: DataFrame, dims: int, size: int, parts: int, name: str) -> DataFrame:
    dealt = rows.repartitionByRange(parts, "key", "tag").sortWithinPartitions("key", "tag")
    return materialise(dealt.mapInArrow(_cut(dims, size), PACKED), name)


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").isNull(), "id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(rows: DataFrame, vec_id: str, vector: str, label: str, anchor: Column) -> tuple[DataFrame, DataFrame, int]:
    """(blocks of all rows, slabs of anchors, dimensions), written in Hilbert order."""
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                      F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"))
    own = materialise(own.mapInArrow(_integers, VECTORS).withColumn("tag", F.monotonically_increasing_id()), "vectors")
    n, anchors = own.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    spread = (own.select("vector").mapInArrow(_spreads, "dim bigint, n double, lo double, hi double, sum double, squares double")
              .groupBy("dim").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                  F.sum("sum").alias("sum"), F.sum("squares").alias("squares")).toPandas().sort_values("dim"))
    dims = max(1, len(spread))
    variance = (spread["squares"] / spread["n"] - (spread["sum"] / spread["n"]) ** 2).to_numpy()
    axes = np.argsort(-variance, kind="stable")[:KEY_DIMS] if len(spread) else np.zeros(1, np.int64)
    lo, hi = (spread[c].to_numpy()[axes] if len(spread) else np.zeros(1) for c in ("lo", "hi"))
    keyed = own.mapInArrow(_keyed(dims, axes, lo, hi), f"{VECTORS}, tag bigint, key bigint")
    size = min(max(n // 256, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    return (_sorted_blocks(keyed, dims, size, max(1, -(-n // (4 * size))), "blocks"),
            _sorted_blocks(keyed.filter("anchor"), dims, SLAB, max(1, -(-anchors // SLAB)), "slabs").withColumnRenamed("block", "slab"),
            dims)


def mine(rows: DataFrame, vec_id: str, vector: str, label: str, anchor: Column,
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score of the first ``negatives`` rows of other labels whose score
    is ``low`` to ``high`` hundredths of a positive's, for each of the first
    ``positives`` rows of the anchor's label."""
    every, slabs, dims = blocks(rows, vec_id, vector, label, anchor)
    n_blocks = every.count()
    chunks, lots = max(LEAST_ZONES, -(-n_blocks // ZONE_BLOCKS)), max(LEAST_LOTS, -(-n_blocks // LOT_BLOCKS))
    zones = materialise(every.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"), "block", "lo", "hi", "kinds", "counts")
                        .groupBy("chunk").agg(F.collect_list(F.struct("block", "lo", "hi", "kinds", "counts")).alias("zones")), "zones")

    def met(slab: DataFrame, fn, schema: str) -> DataFrame:
        """Each slab with the zone maps of each chunk."""
        pairs = slab.withColumn("chunk", _numbers(chunks)).join(zones, "chunk")
        return pairs.groupBy("slab", "chunk").applyInPandas(fn, schema)

    def read(slab: DataFrame, need: DataFrame, fn) -> DataFrame:
        """Each slab with the blocks that it needs, lot by lot."""
        lot = F.pmod(F.xxhash64("block"), F.lit(lots))
        wanted = need.join(every.drop("lo", "hi", "kinds", "counts"), "block").withColumn("lot", lot)
        tasks = slab.withColumn("lot", _numbers(lots))
        return wanted.groupBy("slab", "lot").cogroup(tasks.groupBy("slab", "lot")).applyInArrow(_read(dims, fn), FOUND_SQL)

    own = slabs.drop("lo", "hi", "kinds", "counts")
    sure = met(own, _sure(dims, positives), "slab bigint, at bigint, bound double")
    nth = Window.partitionBy("slab", "at").orderBy(F.desc("bound"))
    floors = (sure.withColumn("r", F.row_number().over(nth)).filter(F.col("r") <= positives)
              .filter(F.col("r") == positives)
              .groupBy("slab").agg(F.collect_list(F.struct("at", "bound")).alias("floors")))
    need = met(materialise(own.join(floors, "slab", "left"), "floors"), _need(dims, False), "slab bigint, block bigint, need binary")
    found = materialise(_top(read(own, need, _positives(positives)), ["slab", "at"], positives), "positives")

    by_hundred = [F.ceil(F.col("score").cast("decimal(38,0)") * low / 100), F.floor(F.col("score").cast("decimal(38,0)") * high / 100)]
    windows = (found.select("slab", "at", F.col("rank").cast("long").alias("place"),
                            by_hundred[0].cast("long").alias("low"), by_hundred[1].cast("long").alias("high"))
               .filter("low <= high").groupBy("slab").agg(F.collect_list(F.struct("at", "place", "low", "high")).alias("windows")))
    with_windows = materialise(own.join(windows, "slab"), "windows")
    need = met(with_windows, _need(dims, True), "slab bigint, block bigint, need binary")
    hard = _top(read(with_windows, need, _negatives(negatives)), ["slab", "at", "place"], negatives)

    anchors = slabs.select("slab", "ids").mapInArrow(_ids, "slab bigint, at bigint, anchor_id bigint")
    of = found.select("slab", "at", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"),
                      F.col("score").alias("positive_score"))
    return (hard.join(of, ["slab", "at", "place"]).join(anchors, ["slab", "at"])
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for slab, ids in zip(batch.column("slab").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            own = unpack(ids, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), slab)), pa.array(np.arange(len(own))), pa.array(own)],
                                             ["slab", "at", "anchor_id"])


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows with an id divisible by 100; where it is divisible
    by 7, the label moves on by one (of ten)."""
    own = embeddings.select(
        "vec_id", "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(own, "vec_id", "embedding", "label", F.col("vec_id") % 100 == 0)
