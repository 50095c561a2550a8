"""Mixing sources to target weights by pivotal dependent rounding.

A source's target in words over its size is the expected number of copies of
each of its documents: a whole part that all of them get, and a fraction.
The fractions are rounded by pivotal steps: two documents exchange random
mass, in words, until the copies of one are whole; the other goes on to the
next pair.  A step keeps the words that the source takes and every
document's expected copies, so only the last document of a source is rounded
alone, and a source misses its target by less than that document.

Rows that share id and source are one unit: they get the same copies.

Defined cases: null and empty texts have size 0 and are rounded by a draw of
their own; the null source comes last; a source of size 0 has target 0; a
null id is an id; an empty table gives an empty result; columns pass.

Scale: a source's units are dealt by hash into blocks of ``BLOCK_UNITS``; each
block is rounded in its own task and leaves at most one open unit, and open
units meet in groups of ``FAN_IN`` blocks, level by level, down to one a
source.  A source with a third of all rows is many blocks.  Draws depend on
ids alone, so reruns and retried tasks agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptsearch.llm import words as W
from conceptsearch.llm.tables import fresh, materialise, same, with_arrays

WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3
BLOCK_UNITS = 2_000
FAN_IN = 4096
SEED = 20240607


def _count(column: pa.Array) -> list[pa.Array]:
    parts = [np.bincount(W.words(piece).text, minlength=len(piece)) for _, piece in W.texts(column).pieces()]
    return [pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())]


def with_size(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    (name,) = fresh(docs, "size")
    return with_arrays(docs, [text], {name: "bigint"}, _count), name


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, units, target from source, size, units: weights by
    code point order, the null source last; a target stops at MAX_COPIES times
    the source's size and the excess is shared anew by weight."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    rows = materialise(sizes.select("source", F.col("size").alias("source_size"), "units", weight.alias("weight")),
                       "sources")
    limit = F.col("source_size") * MAX_COPIES
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level rises; it ends when no further source stops at its limit
        stopped = F.col("weight") * level > limit
        r = rows.agg(F.sum(F.when(stopped, limit).otherwise(0)).alias("full"),
                     F.sum(F.when(~stopped, F.col("weight")).otherwise(0.0)).alias("open")).first()
        risen = (total - r["full"]) / r["open"] if r["open"] else level
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return rows.select("source", "source_size", "units",
                       F.least(F.col("weight") * level, limit.cast("double")).alias("target"))


def round_pairs(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int:
    """Rounds fractions in place by pivotal steps that keep ``sum(p * size)``;
    gives the index of the one that stays open, or -1."""
    draws = rng.random(len(p))
    open_at = -1
    for k in range(len(p)):
        if p[k] <= 0.0 or p[k] >= 1.0:
            continue
        if open_at < 0:
            open_at = k
            continue
        i, j = open_at, k
        down = min(p[i] * size[i], (1 - p[j]) * size[j])      # words that could go from i to j
        up = min((1 - p[i]) * size[i], p[j] * size[j])        # and from j to i
        if draws[k] * (down + up) < up:
            if p[i] * size[i] <= (1 - p[j]) * size[j]:
                p[i], p[j], open_at = 0.0, p[j] + down / size[j], j
            else:
                p[i], p[j], open_at = p[i] - down / size[i], 1.0, i
        elif (1 - p[i]) * size[i] <= p[j] * size[j]:
            p[i], p[j], open_at = 1.0, p[j] - up / size[j], j
        else:
            p[i], p[j], open_at = p[i] + up / size[i], 0.0, i
        if not 1e-12 < p[open_at] < 1 - 1e-12:
            p[open_at] = round(p[open_at])
            open_at = -1
    return open_at


def _round_block(last: bool):
    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["draw", "unit_id"], kind="stable", na_position="first").reset_index(drop=True)
        p, size = units["p"].to_numpy().copy(), units["size"].to_numpy().astype(float)
        draw = units["draw"].to_numpy()
        own = size == 0
        p[own] = (draw[own] < p[own]).astype(float)
        seed = int((draw * float(1 << 40)).astype(np.int64).sum() % (1 << 62))
        rng = np.random.default_rng([SEED, seed])
        open_at = round_pairs(p, size, rng)
        if open_at >= 0 and last:
            p[open_at] = float(rng.random() < p[open_at])
            open_at = -1
        units["p"] = p
        units["open"] = np.arange(len(p)) == open_at
        return units

    return run


def rounded(units: DataFrame, shares: DataFrame) -> DataFrame:
    """unit_id, unit_source, copies for units of (unit_id, unit_source, size)
    and the shares of ``targets``."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("units") / BLOCK_UNITS)
    rows = (units.join(shares, same(F.col("unit_source"), F.col("source")))
            .withColumn("whole", F.floor(copies))
            .select("unit_id", "unit_source", "size", "whole", (copies - F.col("whole")).alias("p"),
                    (F.pmod(F.xxhash64(F.lit(SEED), "unit_id"), F.lit(1 << 52)) / float(1 << 52)).alias("draw"),
                    F.pmod(F.xxhash64(F.lit(SEED + 1), "unit_id"), blocks).alias("block")))
    most = shares.agg(F.max("units")).first()[0] or 0
    schema = T.StructType([*rows.schema.fields, T.StructField("open", T.BooleanType())])
    left, level, done = -(-most // BLOCK_UNITS), rows, []
    while True:
        last = left <= 1
        out = materialise(level.groupBy("unit_source", "block").applyInPandas(_round_block(last), schema), "mix")
        done.append(out.filter("not open"))
        if last:
            break
        left = -(-left // FAN_IN)
        level = out.filter("open").drop("open").withColumn("block", F.floor(F.col("block") / FAN_IN))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    return settled.select("unit_id", "unit_source", (F.col("whole") + F.round("p")).cast("long").alias("copies"))


def _mixed(docs: DataFrame, size: str, source: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The copies of each unit and the targets of each source."""
    units = materialise(
        docs.groupBy(F.col(doc_id).alias("unit_id"), F.col(source).alias("unit_source"))
        .agg(F.sum(size).alias("size")), "units")
    sizes = units.groupBy(F.col("unit_source").alias("source")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("units"))
    shares = materialise(targets(sizes), "shares")
    return rounded(units, shares), shares


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Each document as often as the mix takes it, with its columns unchanged."""
    slim, size = with_size(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                       F.col(text).alias("text")))
    copies, _ = _mixed(slim.drop("text"), size, "source", "doc_id")
    unit_id, unit_source, n, copy = fresh(docs, "unit_id", "unit_source", "copies", "copy")
    copies = copies.filter("copies > 0").toDF(unit_id, unit_source, n)
    joined = docs.join(copies, same(F.col(doc_id), F.col(unit_id)) & same(F.col(source), F.col(unit_source)))
    return (joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
            .select(*(F.col(f"`{c}`") for c in docs.columns)))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    slim, size = with_size(docs.select("doc_id", "source", "text"))
    slim = materialise(slim.drop("text"), "sizes")
    copies, shares = _mixed(slim, size, "source", "doc_id")
    out = slim.join(copies, same(F.col("doc_id"), F.col("unit_id")) & same(F.col("source"), F.col("unit_source")))
    shares = shares.select(F.col("source").alias("of"), "source_size", "target")
    return (out.join(shares, same(F.col("source"), F.col("of")))
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))
