"""Small helpers that the operators share: scratch tables in the shared
folder, column names that clash with none of the input, array payloads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptsearch.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder that the session names."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed
    once, and a lost executor costs no more than the task that ran on it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores added where ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_arrays(df: DataFrame, inputs: list[str], outputs: dict[str, str],
                fn: Callable[..., list[pa.Array]]) -> DataFrame:
    """Append columns that ``fn`` computes from the named input columns, one
    Arrow batch at a time.  ``outputs``: new column name to Spark type."""
    added = T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in outputs.items()))
    schema = T.StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = fn(*(batch.column(c) for c in inputs))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new],
                                             [*batch.schema.names, *outputs])

    return df.mapInArrow(run, schema)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus 1; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null; an equi-join condition."""
    return left.eqNullSafe(right)


def deal_levels(buckets: int, fan: int) -> tuple[int, list[tuple[int, int]]]:
    """How hashes are dealt to ``buckets`` where a row goes to ``fan`` nodes at
    most: the buckets of a node at first, and for each further level the groups
    that a node's rows are merged in and the buckets of a narrower node.  All
    levels deal to about as many nodes, and a group has a bucket's share of the
    input, so what is merged at a time does not grow with the input."""
    levels = 1
    while fan ** levels < buckets:
        levels += 1
    each = 1    # nodes that a node is dealt to
    while each ** levels < buckets:
        each += 1
    steps = [each ** (levels - 1 - k) for k in range(levels)]
    return steps[0], [(steps[k - 1], steps[k]) for k in range(1, levels)]


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed differences, byte plane by plane."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_sorted(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)


def pack(values: np.ndarray) -> bytes:
    """Values of a fixed width, byte plane by plane."""
    width = values.dtype.itemsize
    return zstandard.compress(values.view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack(payload: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(payload), np.uint8)
    return planes.reshape(np.dtype(dtype).itemsize, -1).T.copy().view(dtype).ravel()
