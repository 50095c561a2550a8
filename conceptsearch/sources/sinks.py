"""Writers for runs, metrics, latents, the index and descriptions (SURVEY
A12-A15, A18), plus the text encodings the readers consume.

Line-ordered text is written after a range sort: part files come out in
order, and ``sources.text_formats.line_order`` reads them back in order.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptsearch.operators.index import ConceptIndex

INDEX_TABLES = ("postings", "terms", "doc_stats", "stats")


def _tsv(df: DataFrame, cols) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_lines(df: DataFrame, path: str, order_cols, compression: str | None = None) -> None:
    """Write a ``value`` column as text lines in ``order_cols`` order."""
    writer = df.orderBy(*order_cols).select("value").write.mode("overwrite")
    if compression:
        writer = writer.option("compression", compression)
    writer.text(path)


def format_score(score, digits: int) -> "F.Column":
    """Fixed-point text of a score; ties at exactly half go to even, like
    Python's ``%.Nf`` on an exact binary half (SURVEY L25)."""
    return F.format_string(f"%.{digits}f", F.bround(score, digits))


def write_run(run: DataFrame, path: str, variant: str = "trec3") -> None:
    """Run as TSV.

    * ``trec3``  - ``qid pid rank score`` with 3 decimals (concept retrieval);
    * ``round4`` - four fields, score rounded to 4 decimals (rerank output);
    * ``rank3``  - ``qid pid rank`` without score (dense search);
    * ``full``   - full precision, ranks renumbered 1..n in score order (F6).
    """
    if variant == "full":
        from conceptsearch.operators.search import rank_within
        run = rank_within(run.drop("rank"), ["qid"], [F.desc("score"), F.asc("pid")], None)
    fields = {
        "trec3": [F.col("qid"), F.col("pid"), F.col("rank"), format_score(F.col("score"), 3)],
        "round4": [F.col("qid"), F.col("pid"), F.col("rank"), F.round("score", 4)],
        "rank3": [F.col("qid"), F.col("pid"), F.col("rank")],
        "full": [F.col("qid"), F.col("pid"), F.col("rank"), F.col("score")],
    }[variant]
    lines = run.select("qid", "rank", F.concat_ws("\t", *[c.cast("string") for c in fields])
                       .alias("value"))
    write_lines(lines, path, ["qid", "rank"])


def write_metrics(metrics_long: DataFrame, path: str) -> None:
    """The flat metric record ``{name: value}`` as one JSON object.

    The record has one entry per metric name (a handful), so it is one row."""
    obj = metrics_long.agg(F.map_from_entries(F.collect_list(F.struct("metric", "value")))
                           .alias("m"))
    obj.select(F.to_json("m").alias("value")).write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.text(path).select(F.from_json("value", "map<string,double>").alias("m"))
    return m.select(F.explode("m").alias("metric", "value"))


def write_latents(codes: DataFrame, path: str, id_col: str = "docid") -> None:
    """JSONL ``{docid, ids, weight}``."""
    codes.select(F.col(id_col).alias("docid"), "ids", "weight").write.mode("overwrite").json(path)


def write_query_latents(codes: DataFrame, path: str, id_col: str = "qid") -> None:
    """The query-latent object format ``{qid: {ids, weight}}`` (read by A11).

    Each task writes one object holding its own partition's queries (one
    file, one line), so no task ever holds more than its input partition;
    the reader takes every file as one object and unions them."""
    def one_object(batches):
        obj = {}
        for pdf in batches:
            for q, ids, ws in zip(pdf["k"], pdf["ids"], pdf["weight"]):
                obj[q] = {"ids": [int(i) for i in ids], "weight": [float(w) for w in ws]}
        if obj:
            yield pd.DataFrame({"value": [json.dumps(obj)]})

    codes.select(F.col(id_col).cast("string").alias("k"), "ids", "weight") \
         .mapInPandas(one_object, "value string").write.mode("overwrite").text(path)


def save_index(index: ConceptIndex, path: str, partitions: int | None = None) -> None:
    """The index as four Parquet tables; postings range-partitioned and
    sorted by (latent, docid), so a query's latent list prunes row groups on
    read and a latent that many documents have spans several files.  Without
    ``partitions`` adaptive execution sizes the files by their bytes."""
    key = ("latent", "docid")
    dealt = index.postings.repartitionByRange(*([partitions] if partitions else []), *key)
    (dealt.sortWithinPartitions(*key)
          .write.mode("overwrite").parquet(f"{path}/postings"))
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> ConceptIndex:
    return ConceptIndex(*[spark.read.parquet(f"{path}/{t}") for t in INDEX_TABLES])


def write_descriptions(desc: DataFrame, path: str) -> None:
    """JSONL ``{id, interp}``."""
    desc.select(F.col("latent").alias("id"), "interp").write.mode("overwrite").json(path)


def write_queries(queries: DataFrame, path: str) -> None:
    """``qid \\t text`` lines in ``line_no`` order (read by A2)."""
    lines = queries.select(F.concat_ws("\t", F.col("qid").cast("string"), "text").alias("value"),
                           "line_no")
    write_lines(lines, path, ["line_no"])


def write_qrels(qrels: DataFrame, path: str, sep: str = "\t") -> None:
    """``qid 0 pid grade`` lines (read by A4)."""
    lines = qrels.select(F.concat_ws(sep, F.col("qid").cast("string"), F.lit("0"),
                                     F.col("pid").cast("string"), F.col("rel").cast("string"))
                         .alias("value"), "qid", "pid")
    write_lines(lines, path, ["qid", "pid"])


def write_corpus(corpus: DataFrame, path: str, gzip: bool = False) -> None:
    """JSONL corpus ``{id, title, contents}`` (read by A1)."""
    out = corpus.select(F.col("doc_id").cast("string").alias("id"), "title", "contents")
    writer = out.write.mode("overwrite")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.json(path)
