"""Sampled splitters: shards of near equal bytes by range partitioning.

A size-weighted sample of the keys gives quantile boundaries; every record
falls into the range between two of them, the exact sums of all ranges are
taken, and ranges that came out overfull are sampled again and subdivided.
Ranges in key order, with the running sum inside each, give every record its
exact byte position, and the position its shard: a shard's bytes differ from
an equal share by less than the largest record at either end.

The default key is the text's hash, then the id: equal texts lie together
unless they are too many for a shard, and a group of any size is split.

Law: ``bytes``.  Defined cases: a null text has size 1; records with equal
keys are interchangeable and share a range, whatever their number; a null id
orders first; ids that are no integers order by a hash; an empty table gives an empty result; other columns pass.

Scale: one range is one task's sort, bounded by ``RANGE_ROWS`` on average and
twice that after subdividing (but for equal keys).  The sample, the
boundaries and the range sums grow with rows / RANGE_ROWS: 8,000 ranges for
3e10 records.  Records move once, by range.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptsearch.llm.tables import fresh, text_bytes

N_SHARDS = 16
RANGES_PER_SHARD = 8
RANGE_ROWS = 4_000_000
SAMPLES_PER_RANGE = 32
OVERFULL = 2.0
ROUNDS = 4


def _draw(seed: int, key: Column) -> Column:
    """A number from 0 to 1 that depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _range_of(key: Column, splitters: list[tuple[int, int]]) -> Column:
    """The number of splitters at or below the key, by binary search."""
    if not splitters:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps([{"a": a, "b": b} for a, b in splitters])), "array<struct<a:bigint,b:bigint>>")
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0),
                       lambda at, step: F.when(F.get(held, at + step - 1) <= key, at + step).otherwise(at))


def _looked_up(values: dict[int, int], at: Column) -> Column:
    """The value of each number, null where there is none: a bounded table
    that is part of the plan.  (A join on ``_range_of`` lets Spark 4.1 infer a
    filter on the table's side with the key's column, which isn't there.)"""
    held = [values.get(k) for k in range(max(values, default=-1) + 1)]
    return F.get(F.from_json(F.lit(json.dumps(held)), "array<bigint>"), at)


def _sampled(rows: DataFrame, seed: int, per_range: Column, parts: Column) -> list[tuple[int, int]]:
    """Quantile boundaries of a size-weighted sample within each range.
    ``per_range``: samples expected from it; ``parts``: ranges to make of it."""
    share = F.col("size") * per_range / F.col("bytes")
    sample = (rows.filter(_draw(seed, F.col("key")) < share)
              .select("range", "key", parts.alias("parts"), F.greatest(share, F.lit(1.0)).alias("w")))
    upto = Window.partitionBy("range").orderBy("key")
    part = F.floor(F.sum("w").over(upto) * F.col("parts") / F.sum("w").over(Window.partitionBy("range")))
    cuts = (sample.select("range", "key", "parts", part.alias("part"))
            .filter((F.col("part") > 0) & (F.col("part") < F.col("parts")))
            .groupBy("range", "part").agg(F.min("key").alias("key")))
    return [(r["key"]["a"], r["key"]["b"]) for r in cuts.select("key").collect()]


def splitters(rows: DataFrame, n_shards: int) -> tuple[list[tuple[int, int]], list]:
    """Boundaries of ranges for rows of (key, size), and each range's exact
    sums: (range, rows, bytes).  Bounded by rows / RANGE_ROWS, see above."""
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    n, size = total["rows"], total["bytes"]
    if not n:
        return [], []
    wanted = max(RANGES_PER_SHARD * n_shards, -(-n // RANGE_ROWS))
    first = rows.withColumns({"range": F.lit(0), "bytes": F.lit(size)})
    cuts = sorted(set(_sampled(first, 1, F.lit(wanted * SAMPLES_PER_RANGE), F.lit(wanted))))
    most_rows, most_bytes = OVERFULL * max(n / wanted, 1), OVERFULL * size / wanted
    for seed in range(2, ROUNDS + 2):
        sums = (rows.groupBy(_range_of(F.col("key"), cuts).alias("range"))
                .agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect())
        over = {r["range"]: (r["bytes"], max(r["rows"] / most_rows, r["bytes"] / most_bytes))
                for r in sums if r["rows"] > 1 and (r["rows"] > most_rows or r["bytes"] > most_bytes)}
        if not over or seed == ROUNDS + 1:
            break
        inside = rows.withColumn("range", _range_of(F.col("key"), cuts))
        inside = inside.withColumns({"bytes": _looked_up({k: b for k, (b, _) in over.items()}, F.col("range")),
                                     "parts": _looked_up({k: 2 * int(x + 1) for k, (_, x) in over.items()}, F.col("range"))})
        inside = inside.filter("parts is not null")
        more = sorted(set(cuts) | set(_sampled(inside, seed, F.col("parts") * SAMPLES_PER_RANGE, F.col("parts"))))
        if len(more) == len(cuts):
            break
        cuts = more
    return cuts, sums


def _id_number(docs: DataFrame, doc_id: str) -> Column:
    """Integers as they are, a hash of other ids; null first."""
    kind = docs.schema[doc_id].dataType
    own = F.col(doc_id).cast("long") if isinstance(kind, T.IntegralType) else F.when(
        F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("string")))
    return F.coalesce(own, F.lit(-(1 << 63)))


def place(docs: DataFrame, n_shards: int = N_SHARDS, text: str = "text", doc_id: str = "doc_id"
          ) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns shard and slot (and size), and their names."""
    names = dict(zip(("size", "shard", "slot"), fresh(docs, "size", "shard", "slot"), strict=True))
    key, part, row, bytes_before, rows_before, start = fresh(
        docs, "shard_key", "shard_range", "shard_row", "bytes_before", "rows_before", "shard_start")
    keyed = docs.withColumns({
        names["size"]: text_bytes(F.col(text)),
        key: F.struct(F.xxhash64(F.col(text)).alias("a"),
                      _id_number(docs, doc_id).alias("b"))})
    cuts, sums = splitters(keyed.select(F.col(key).alias("key"), F.col(names["size"]).alias("size")), n_shards)
    rows, size = 0, 0
    before: dict[int, tuple[int, int]] = {}    # one entry a range: bounded by rows / RANGE_ROWS
    for r in sorted(sums, key=lambda r: r["range"]):
        before[r["range"]] = rows, size
        rows, size = rows + r["rows"], size + r["bytes"]
    inside = Window.partitionBy(part).orderBy(key)
    running = F.sum(names["size"]).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn(part, _range_of(F.col(key), cuts))
    placed = (placed.withColumn(rows_before, _looked_up({k: n for k, (n, _) in before.items()}, F.col(part)))
              .withColumn(bytes_before, _looked_up({k: b for k, (_, b) in before.items()}, F.col(part)))
              .withColumn(row, F.col(rows_before) + F.row_number().over(inside) - 1)
              .withColumn(names["shard"], F.col(bytes_before) + running - F.col(names["size"]) / 2))
    placed = placed.withColumn(names["shard"], F.least(
        F.lit(n_shards - 1), F.floor(F.col(names["shard"]) * n_shards / max(size, 1))).cast("int"))
    starts = (placed.groupBy(F.col(names["shard"]).alias(start + "_of")).agg(F.min(row).alias(start)).collect())
    first = F.lit(None).cast("long")
    for r in starts:  # at most n_shards rows
        first = F.when(F.col(names["shard"]) == r[start + "_of"], F.lit(r[start])).otherwise(first)
    placed = placed.withColumn(names["slot"], (F.col(row) - first).cast("long"))
    columns = [F.col(f"`{c}`") for c in (*docs.columns, *names.values())]
    return placed.select(*columns), names


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS) -> None:
    """Parquet files under ``shard=N`` folders, in slot order within a file."""
    placed, names = place(docs, n_shards)
    placed.write.partitionBy(names["shard"]).parquet(path)


def assignment(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slim = docs.select("doc_id", "text")
    placed, _ = place(slim.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")))), n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
