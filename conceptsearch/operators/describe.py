"""Latent descriptions.

The top passages of each latent are a ``row_number`` cut per latent; a
latent active in a third of all passages still sends only K rows per map
partition to its final task (partial ``WindowGroupLimit``).  The describer
itself is a user callable over the prompt table (the reference calls an
external service); the library ships the prompt in and the parsed
interpretation out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import parse_interpretation
from conceptsearch.operators.search import rank_within
from conceptsearch.operators.text import restrict_to_ids

TOP_K_PASSAGES = 30   # Fixed value: passages per latent in the reference's description run


def latent_postings(codes_exploded: DataFrame, id_col: str = "docid") -> DataFrame:
    """Latent -> (docid, weight) as a flat table."""
    return codes_exploded.select("latent", F.col(id_col).alias("docid"), F.col("w").alias("act"))


def top_docs_per_latent(postings: DataFrame, k: int = TOP_K_PASSAGES) -> DataFrame:
    """the k most activating passages per latent; ties by docid."""
    return rank_within(postings, ["latent"], [F.desc("act"), F.asc("docid")], k)


def activation_text(act) -> "F.Column":
    """The activation as written in the prompt, rounded to 6 decimals."""
    return F.round(act, 6).cast("string")


def prompt_text(top: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per latent, ``Example{i}: {text}\\nActivation: {act}\\n`` for its
    ranked passages, concatenated in rank order (i from 0).

    One group per latent holds at most K rows (the F5 cut).
    Output ``(latent, prompt)``."""
    # at most K passages per latent of the model: a proven bound, broadcast
    texts = restrict_to_ids(corpus.select(F.col("doc_id").alias("docid"), "contents"),
                            top.select("docid"), "docid", max_rows=None)
    piece = F.concat(F.lit("Example"), (F.col("rank") - 1).cast("string"), F.lit(": "),
                     F.coalesce("contents", F.lit("")), F.lit("\nActivation: "),
                     activation_text(F.col("act")), F.lit("\n"))
    parts = top.join(texts, "docid", "left").select("latent", "rank", piece.alias("piece"))
    packed = F.array_sort(F.collect_list(F.struct("rank", "piece")))
    return parts.groupBy("latent").agg(
        F.array_join(F.transform(packed, lambda x: x["piece"]), "").alias("prompt"))


Describer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def stub_describer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Deterministic stand-in for the external describer: a reply whose last
    line carries the interpretation ``topic-<latent>``."""
    for pdf in batches:
        n = pdf["prompt"].str.count("Example")
        reply = ("Common pattern over " + n.astype(str) + " examples.\n[interpretation]:  topic-"
                 + pdf["latent"].astype(str) + "  ")
        yield pd.DataFrame({"latent": pdf["latent"], "response": reply})


def describe_latents(prompts: DataFrame, describer: Describer = stub_describer) -> DataFrame:
    """I3 + H4: run the describer on every prompt, keep the text after the
    last interpretation marker.  Output ``(latent, interp)``."""
    replies = prompts.mapInPandas(describer, "latent long, response string")
    return replies.select("latent", parse_interpretation(F.col("response")).alias("interp"))
