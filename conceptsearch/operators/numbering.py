"""Dense row numbers in a total order.

Rows are range-partitioned and sorted, so a partition's rows follow those of
the partition before.  Each row carries its partition and its place in it,
both from one generated column; the counts of the partitions, summed up, are
the offsets.  No window and no task holds more than one partition, and no
row passes through Python.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.session import scratch_path

_PLACE_BITS = 33    # of monotonically_increasing_id: the place in its partition


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """All columns of ``df`` and ``name``, the row's place from 0 on in the
    given order.  Rows that are equal in all of ``order`` get places of their
    own in any order (and share a partition: add a unique last column where
    many may be equal).  The sorted rows are written once to the shared
    folder, so that counts and numbers mean the same partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, f"numbered-{uuid.uuid4().hex}")
    own = "_place"
    while own in df.columns:
        own += "_"
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .withColumn(own, F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path)
    part = F.shiftright(own, _PLACE_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()
    before, offsets = 0, []
    for p, n in sorted(map(tuple, counts)):   # a row a partition: the cluster's setting, not the data
        offsets.append((p, before))
        before += n
    offsets = spark.createDataFrame(offsets, "_part long, _before long")
    place = F.col(own).bitwiseAND((1 << _PLACE_BITS) - 1)
    return (rows.join(F.broadcast(offsets), part == F.col("_part"))
                .select(*df.columns, (F.col("_before") + place).alias(name)))
