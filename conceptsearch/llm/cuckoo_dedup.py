"""Exact dedup against an index of live digests behind a cuckoo filter.

Texts are equal when they are after each run of white space became one space;
their digest is the SHA-256 of that.  The index holds

* ``filters``: for each shard a cuckoo filter, ``SLOTS`` fingerprints of 16
  bits in each bucket; a digest's fingerprint lies in one of two buckets;
* ``contents``: the digests that are live, with their texts' size, the row
  that stays (smallest id) and the number of rows, dealt by the same shards.

A batch is reduced to its distinct digests and probes the filters.  What they
don't know is new and goes in without a look at ``contents``; hits are
verified there by digest and size, so a false hit never drops a text.  New
fingerprints push others to their second bucket; a shard that overflows is
built anew, twice as large, from its stored keys.  Deletion verifies digests
first, then takes one fingerprint of each out.

Defined cases: a null text is empty, and equal to other empty ones; a null id
comes after all others; of rows that share id and text, one stays; an empty
table gives an empty result.  Names and columns of the input are kept apart
from the index's own.

Scale: texts are read once and never move; a digest that a third of all rows
share is one row of each map task.  Shards follow a hash of the digest, about
``SHARD_DIGESTS`` each, so none is hot.  All state is written to the shared
folder, each version beside the last: a lost executor repeats its task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptsearch.llm.tables import fresh, materialise, new_path, same
from conceptsearch.llm.words import mix

SLOTS = 4
#: Rounds of pushing after which a filter counts as full.
ROUNDS = 200
#: Digests of a shard, and the least number of shards.
SHARD_DIGESTS = 1_000_000
LEAST_SHARDS = 64
#: Parts in which a whole table arrives at the index.
WAVES = 2

FILTER = "shard bigint, log2 int, slots binary, full boolean"
PROBED = "shard bigint, digest binary, size bigint, maybe boolean"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


# ---- one filter, in NumPy ------------------------------------------------

def places(digests: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and fingerprint (never 0) of digests, an (n, 32) array of bytes."""
    home = digests[:, :8].copy().view("<u8").ravel() & np.uint64((1 << log2) - 1)
    mark = digests[:, 8:10].copy().view("<u2").ravel()
    return home.astype(np.int64), np.where(mark == 0, 1, mark).astype(np.uint16)


def second(bucket: np.ndarray, mark: np.ndarray, log2: int) -> np.ndarray:
    """The other bucket of a fingerprint: the function is its own inverse."""
    return bucket ^ (mix(mark.astype(np.uint64)) & np.uint64((1 << log2) - 1)).astype(np.int64)


def _ranks(sorted_values: np.ndarray) -> np.ndarray:
    at = np.arange(len(sorted_values))
    new = np.ones(len(at), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def insert(slots: np.ndarray, digests: np.ndarray) -> bool:
    """Put digests in; False if the filter is full (and then of no more use)."""
    log2 = len(slots).bit_length() - 1
    bucket, mark = places(digests, log2)
    used = (slots != 0).sum(1)
    rng = np.random.default_rng(log2)
    for _ in range(ROUNDS):
        if not len(bucket):
            return True
        other = second(bucket, mark, log2)
        bucket = np.where(used[other] < used[bucket], other, bucket)
        order = np.argsort(bucket, kind="stable")
        bucket, mark = bucket[order], mark[order]
        slot = used[bucket] + _ranks(bucket)
        fits = slot < SLOTS
        slots[bucket[fits], slot[fits]] = mark[fits]
        np.add.at(used, bucket[fits], 1)
        bucket, mark = bucket[~fits], mark[~fits]
        # the first that waits at a full bucket pushes one out to its other bucket
        push = np.flatnonzero(_ranks(bucket) == 0)
        place = rng.integers(0, SLOTS, len(push))
        out = slots[bucket[push], place]
        slots[bucket[push], place] = mark[push]
        mark[push], bucket[push] = out, second(bucket[push], out, log2)
    return not len(bucket)


def contains(slots: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which digests may be in: all that are, and few others."""
    log2 = len(slots).bit_length() - 1
    bucket, mark = places(digests, log2)
    return ((slots[bucket] == mark[:, None]) | (slots[second(bucket, mark, log2)] == mark[:, None])).any(1)


def remove(slots: np.ndarray, digests: np.ndarray) -> None:
    """Take digests out, all of which are in, each once."""
    log2 = len(slots).bit_length() - 1
    bucket, mark = places(digests, log2)
    other = second(bucket, mark, log2)
    low, high = np.minimum(bucket, other), np.maximum(bucket, other)
    order = np.lexsort((mark, low))
    low, high, mark = low[order], high[order], mark[order]
    rank = _ranks(low * (1 << 16) + mark)   # those of one pair of buckets are alike
    held = np.concatenate((slots[low] == mark[:, None], (slots[high] == mark[:, None]) & (low != high)[:, None]), axis=1)
    at = np.argmax(held & (np.cumsum(held, 1) == rank[:, None] + 1), axis=1)
    slots[np.where(at < SLOTS, low, high), at % SLOTS] = 0
    touched = np.unique(np.concatenate((low, high)))
    slots[touched] = -np.sort(-slots[touched].astype(np.int32), axis=1)


def built(digests: np.ndarray, log2: int) -> np.ndarray:
    """A filter of all digests with 2**log2 buckets, or the next size that holds them."""
    while True:
        slots = np.zeros((1 << log2, SLOTS), np.uint16)
        if insert(slots, digests):
            return slots
        log2 += 1


# ---- one shard, in a task ------------------------------------------------

def _digests(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("digest").to_pylist()), np.uint8).reshape(-1, 32)


def _slots(t: pa.Table) -> np.ndarray | None:
    if not t.num_rows:
        return None
    return np.frombuffer(t.column("slots")[0].as_py(), "<u2").reshape(-1, SLOTS).copy()


def _row(shard: int, slots: np.ndarray, full: bool = False) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "log2": pa.array([len(slots).bit_length() - 1], pa.int32()),
                     "slots": pa.array([slots.astype("<u2").tobytes()], pa.binary()), "full": [full]})


def _probe(batch: pa.Table, held: pa.Table) -> pa.Table:
    slots = _slots(held)
    maybe = contains(slots, _digests(batch)) if slots is not None and batch.num_rows else np.zeros(batch.num_rows, bool)
    return batch.append_column("maybe", pa.array(maybe))


def _insert(key: tuple[pa.Scalar, ...], batch: pa.Table, held: pa.Table) -> pa.Table:
    slots, new = _slots(held), _digests(batch)
    if slots is None:
        return _row(key[0].as_py(), built(new, max(1, (len(new) // SLOTS).bit_length())))
    before = slots.copy()
    done = insert(slots, new)
    return _row(key[0].as_py(), slots if done else before, not done)


def _remove(key: tuple[pa.Scalar, ...], batch: pa.Table, held: pa.Table) -> pa.Table:
    slots = _slots(held)
    if batch.num_rows:
        remove(slots, _digests(batch))
    return _row(key[0].as_py(), slots)


def _rebuild(key: tuple[pa.Scalar, ...], held: pa.Table) -> pa.Table:
    return _row(key[0].as_py(), built(_digests(held), held.column("log2")[0].as_py() + 1))


# ---- the index -----------------------------------------------------------

def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, tag (a number of the row), digest and size (bytes) of each row; written once."""
    own = normalised(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), own.alias("own"))
    return materialise(rows.select("id", F.monotonically_increasing_id().alias("tag"),
                                   F.unhex(F.sha2("own", 256)).alias("digest"),
                                   F.octet_length("own").cast("long").alias("size")), "digests")


@dataclass(frozen=True)
class Index:
    """A version of the index; changes give a new one."""

    spark: SparkSession
    shards: int
    filters: DataFrame | None = None
    parts: tuple[str, ...] = ()     # tables of contents; a digest may have a row in several

    def _shard(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.shards))

    def contents(self) -> DataFrame:
        """digest, size, first (none, id, tag of the row that stays), n."""
        rows = self.spark.read.parquet(*self.parts)
        return rows.groupBy("digest", "size").agg(F.min("first").alias("first"), F.sum("n").alias("n"))

    def _cogrouped(self, batch: DataFrame, fn, schema: str) -> DataFrame:
        return (batch.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(fn, schema))

    def _live(self) -> DataFrame:
        return self.spark.read.parquet(*self.parts).select("shard", "digest", "size").distinct()

    def lookup(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(known, new) of distinct digests, with their shards: the filters are
        asked first, their hits verified against the contents."""
        rows = rows.withColumn("shard", self._shard())
        if self.filters is None:
            return rows.filter("false"), rows
        key = ["shard", "digest", "size"]
        probed = materialise(self._cogrouped(rows.select(key), _probe, PROBED), "probed")
        hits = probed.filter("maybe").drop("maybe")
        return (hits.join(self._live(), key, "left_semi"),
                hits.join(self._live(), key, "left_anti").unionByName(probed.filter("not maybe").drop("maybe")))

    def _write(self, contents: DataFrame) -> str:
        """A table of contents, in buckets by shard, sorted by digest."""
        path = new_path(self.spark, "contents")
        (contents.withColumn("shard", self._shard()).repartition("shard").sortWithinPartitions("shard", "digest")
         .write.option("compression", "zstd").parquet(path))
        return path

    def insert(self, rows: DataFrame) -> "Index":
        """With a batch of ``digests`` rows."""
        path = self._write(rows.groupBy("digest", "size").agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first"),
            F.count(F.lit(1)).alias("n")))
        _, new = self.lookup(self.spark.read.parquet(path).select("digest", "size"))
        held = self.filters if self.filters is not None else self.spark.createDataFrame([], FILTER)
        # known digests gain rows, so the whole batch is a part of the contents
        out = replace(self, filters=held, parts=(*self.parts, path))
        filters = materialise(out._cogrouped(new.select("shard", "digest"), _insert, FILTER), "filters")
        if filters.filter("full").limit(1).count():
            keys = (out._live().select("shard", "digest").distinct()
                    .join(F.broadcast(filters.filter("full").select("shard", "log2")), "shard"))  # a row a shard
            larger = keys.groupBy("shard").applyInArrow(_rebuild, FILTER)
            filters = materialise(filters.filter("not full").unionByName(larger), "filters")
        return replace(out, filters=filters)

    def delete(self, gone: DataFrame) -> "Index":
        """Without the texts of the given digests; those that aren't live are passed over."""
        if self.filters is None:
            return self
        known, _ = self.lookup(gone.select("digest", "size").distinct())
        known = materialise(known, "gone")
        filters = materialise(self._cogrouped(known.select("shard", "digest"), _remove, FILTER), "filters")
        path = self._write(self.contents().join(known.select("digest", "size"), ["digest", "size"], "left_anti"))
        return replace(self, filters=filters, parts=(path,))

    def resharded(self, shards: int) -> "Index":
        """The same contents in another number of shards."""
        out = replace(self, shards=shards, filters=self.spark.createDataFrame([], FILTER))
        keys = self.contents().select("digest").withColumn("shard", out._shard())
        return replace(out, filters=materialise(out._cogrouped(keys, _insert, FILTER), "filters"))


def indexed(rows: DataFrame, waves: int = WAVES) -> Index:
    """The index after all ``digests`` rows have arrived, in waves."""
    shards = max(LEAST_SHARDS, -(-rows.count() // SHARD_DIGESTS))
    index = Index(rows.sparkSession, shards)
    wave = F.pmod(F.xxhash64("tag"), F.lit(waves))
    for k in range(waves):
        index = index.insert(rows.filter(wave == k))
    return index


def groups(docs: DataFrame, waves: int = WAVES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = digests(docs)
    live = indexed(rows, waves).contents().select("digest", "first", F.col("n").alias("group_size"))
    return rows.join(live, "digest").select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), "group_size",
        (F.col("tag") == F.col("first.tag")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of equal texts, the one of the smallest id, with its columns unchanged."""
    rows = digests(docs, text, doc_id)
    first = indexed(rows).contents().select("digest", F.col("first.id").alias("id"))
    # rows that share id and text are one document, whichever of them stays
    copies = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("rows"))
    kept = materialise(first.withColumnRenamed("digest", "of").withColumnRenamed("id", "of_id").join(
        copies, (F.col("of") == F.col("digest")) & same(F.col("of_id"), F.col("id"))).select("digest", "id", "rows"), "kept")
    digest, own_id, own = fresh(docs, "digest", "id", "own")
    tagged = docs.withColumn(own, F.unhex(F.sha2(normalised(F.col(text)), 256)))

    def rows_of(which: str) -> DataFrame:
        wanted = kept.filter(which).select(F.col("digest").alias(digest), F.col("id").alias(own_id))
        return tagged.join(wanted, (F.col(own) == F.col(digest)) & same(F.col(doc_id), F.col(own_id)), "left_semi")

    return rows_of("rows = 1").unionByName(rows_of("rows > 1").dropDuplicates([doc_id, own])).drop(own)
