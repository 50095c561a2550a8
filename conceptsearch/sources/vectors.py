"""Vector shards.

Shards are Parquet files, or folders of one file, named
``shard_{worker}_{index}.parquet`` holding ``embedding array<float>`` rows in
encoding order.  A vector's global id is
the number of rows in all earlier shards (numeric (worker, index) order) plus
its row index inside its own file, read from the Parquet ``row_index``
metadata: no positional pass over the data.  The per-shard counts are one
row per shard, so their prefix sum is tiny and broadcast.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import parse_shard_name
from conceptsearch.operators.numbering import number_rows
from conceptsearch.session import scratch_path

DEFAULT_SHARD_ROWS = 2_000_000   # Fixed value: rows per encoded shard in the reference


def scan_vector_shards(spark: SparkSession, path: str, vec_col: str = "embedding") -> DataFrame:
    """All shards of a folder with global ids ``(vec_id, v array<double>)``."""
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path).select(
        F.col(vec_col).cast("array<double>").alias("v"),
        F.regexp_extract("_metadata.file_path", r"(shard_\d+_\d+)[^/]*(?:/[^/]*)?$", 1).alias("file"),
        F.col("_metadata.row_index").alias("row"))
    worker, shard = parse_shard_name(F.col("file"))
    raw = raw.withColumn("worker", worker).withColumn("shard", shard)
    sizes = raw.groupBy("worker", "shard").agg(F.count("*").alias("n"))
    # one row per shard file: a bounded table, single-partition window is fine
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(
        Window.orderBy("worker", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (raw.join(F.broadcast(offsets.select("worker", "shard", "offset")), ["worker", "shard"])
               .select((F.col("offset") + F.col("row")).alias("vec_id"), "v"))


def scan_recon_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Reconstructed vectors ``(vec_id, v)``; chunking is partitioning."""
    return spark.read.parquet(path).select("vec_id", F.col("v").cast("array<double>").alias("v"))


FINISHED = "worker long, shard long, n_rows long"


def finished_shards(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a folder of shards: those written to their end."""
    try:
        return spark.read.schema(FINISHED).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/_finished")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINISHED)


def write_vector_shards(vectors: DataFrame, path: str, worker: int = 0,
                        shard_rows: int = DEFAULT_SHARD_ROWS, id_col: str = "vec_id",
                        vec_col: str = "v", at_once: int = 32) -> None:
    """Write vectors as shards ``shard_{worker}_{i}.parquet`` of
    ``shard_rows`` rows in id order (the last may have fewer).

    Rows get their shard from ``number_rows``, so the same input gives the
    same shards.  One job deals the rows of all missing shards into scratch
    files, a file a shard; then every shard is a small write of its own that
    reads its file, ``at_once`` of them at a time, and enters the manifest
    with the next ones that are done.  A run that stops is taken up by
    the next one: shards in the manifest are skipped, others (also half
    written ones) are written.  Ids are unique."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    total = vectors.count()
    done = {r["shard"] for r in finished_shards(spark, path).filter(F.col("worker") == worker).collect()}
    missing = [i for i in range(-(-total // shard_rows)) if i not in done]   # a number a shard
    if not missing:
        return
    rows = number_rows(vectors.select(id_col, F.col(vec_col).cast("array<float>").alias("embedding")), [F.col(id_col).asc()], "row") \
        .select("embedding", "row", F.floor(F.col("row") / shard_rows).cast("long").alias("shard"))
    if done:
        rows = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in missing], "shard long")), "shard", "left_semi")
    dealt = scratch_path(spark, f"shards-{uuid.uuid4().hex}")
    rows.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(dealt)

    def write(i: int) -> tuple:
        (spark.read.schema("embedding array<float>, row long").parquet(f"{dealt}/shard={i}").coalesce(1).sortWithinPartitions("row")
              .select("embedding").write.mode("overwrite").parquet(f"{path}/shard_{worker}_{i}.parquet"))
        return worker, i, min((i + 1) * shard_rows, total) - i * shard_rows

    def finished(written: list) -> None:
        spark.createDataFrame(written, FINISHED).coalesce(1).write.parquet(f"{path}/_finished/{worker}_{uuid.uuid4().hex}")

    written = []
    with ThreadPoolExecutor(min(at_once, len(missing))) as pool:
        try:
            for shard in pool.map(write, missing):
                written.append(shard)
                if len(written) == at_once:
                    finished(written)
                    written = []
        finally:
            if written:
                finished(written)


def write_recon_vectors(vectors: DataFrame, path: str, max_rows_per_file: int = 1_000_000) -> None:
    """Reconstructed vectors as Parquet, files of bounded row count."""
    vectors.select("vec_id", "v").write.mode("overwrite") \
           .option("maxRecordsPerFile", max_rows_per_file).parquet(path)
