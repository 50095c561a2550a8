"""Concept inverted index.

The index is four flat tables instead of one in-memory dictionary:

* ``postings(latent, docid, tf, dl)`` - one row per kept (document, latent),
  with the document length joined in at build time (C5);
* ``terms(latent, df, idf)`` - one row per latent: at most the model's latent
  count, which bounds it independently of the corpus;
* ``doc_stats(docid, dl)`` - every document, including empty ones (L4);
* ``stats(n, avgdl)`` - one row.

Building needs no shuffle except the per-latent document-frequency
aggregate, which is partially aggregated on the map side, so a latent present
in a third of all documents costs one partial row per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import BM25_B, BM25_K1, doc_saturation
from conceptsearch.functions.scalar import idf as idf_expr


@dataclass
class ConceptIndex:
    postings: DataFrame
    terms: DataFrame
    doc_stats: DataFrame
    stats: DataFrame


def truncate_latents(codes: DataFrame, max_latents: int | None, id_col: str = "docid") -> DataFrame:
    """keep each document's ``max_latents`` heaviest latents.

    Stable on list position for equal weights (the reference's stable sort),
    done with array functions inside the row: no shuffle.  Output
    ``(id, ids, weight)`` in weight-descending order.
    """
    zipped = F.arrays_zip(F.col("weight").alias("w"),
                          F.sequence(F.lit(0), F.size("ids") - 1).alias("pos"),
                          F.col("ids").alias("latent"))
    zipped = F.when(F.size("ids") > 0, zipped).otherwise(
        F.array().cast("array<struct<w:double,pos:int,latent:bigint>>"))
    ordered = F.array_sort(zipped, lambda a, b: F.when(a["w"] > b["w"], -1)
                           .when(a["w"] < b["w"], 1)
                           .when(a["pos"] < b["pos"], -1)
                           .when(a["pos"] > b["pos"], 1).otherwise(0))
    if max_latents is not None:
        ordered = F.slice(ordered, 1, max_latents)
    return codes.select(F.col(id_col), ordered.alias("kept")).select(
        id_col, F.col("kept.latent").alias("ids"), F.col("kept.w").alias("weight"))


def build_index(codes: DataFrame, max_latents: int | None = None, id_col: str = "docid",
                documents: DataFrame | None = None) -> ConceptIndex:
    """Postings, document lengths, collection statistics and idf.

    ``codes`` holds one row per document ``(docid, ids, weight)``, empty
    arrays allowed.  ``documents`` (optional, ``docid``) is the full document
    list: documents without a code row then still count with dl = 0.
    """
    kept = truncate_latents(codes, max_latents, id_col).withColumnRenamed(id_col, "docid")
    doc_stats = kept.select("docid", F.size("ids").cast("long").alias("dl"))
    if documents is not None:
        doc_stats = (documents.select(F.col(id_col).alias("docid")).distinct()
                     .join(doc_stats, "docid", "left")
                     .select("docid", F.coalesce("dl", F.lit(0)).cast("long").alias("dl")))
    stats = doc_stats.agg(F.count("*").alias("n"),
                          F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"))
    postings = kept.select("docid", F.size("ids").cast("long").alias("dl"),
                           F.explode(F.arrays_zip(F.col("ids").alias("latent"),
                                                  F.col("weight").alias("tf"))).alias("p")) \
                   .select(F.col("p.latent").alias("latent"), "docid",
                           F.col("p.tf").alias("tf"), "dl")
    terms = (postings.groupBy("latent").agg(F.count("*").alias("df"))
                     .withColumn("idf", idf_expr(_stats_scalar(stats)["n"], F.col("df"))))
    return ConceptIndex(postings=postings, terms=terms, doc_stats=doc_stats, stats=stats)


def _stats_scalar(stats: DataFrame):
    """``(n, avgdl)`` as one scalar subquery; every use shares one plan, so
    Spark evaluates it once per query."""
    return stats.select(F.struct("n", "avgdl").alias("s")).scalar()


def scored_postings(index: ConceptIndex, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Postings with idf and the document-side factor attached.

    ``terms`` has one row per latent (bounded by the model), so it is
    broadcast; avgdl is a scalar subquery.
    """
    avgdl = _stats_scalar(index.stats)["avgdl"]
    return (index.postings.join(F.broadcast(index.terms.select("latent", "idf")), "latent")
                 .select("latent", "docid", "tf", "dl", "idf",
                         doc_saturation(F.col("tf"), F.col("dl"), avgdl, k1, b).alias("h_d")))
