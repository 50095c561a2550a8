"""Encoders and pair scorers as user-supplied batch functions (SURVEY E16,
E18, E19, I1, I2).

The reference encodes and scores with neural models on GPUs; here the model
is a callable over Arrow batches run by ``mapInPandas``, so any encoder can
be plugged in.  The fixture encoder is a hashing projection of whitespace
tokens, the fixture scorer an inner product.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.functions.scalar import l2_normalize
from conceptsearch.operators.text import restrict_to_ids

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_WS = re.compile(r"[ \t\n\r\f]+")


def hashing_encoder(dim: int) -> Encoder:
    """Fixture text encoder: each whitespace token adds +-1 at bucket
    ``md5(token) % dim`` (sign from the next hex digit); the vector is the
    mean over tokens."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[int, float]] = {}
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                v = np.zeros(dim)
                toks = [t for t in _WS.split(text or "") if t]
                for t in toks:
                    hit = cache.get(t)
                    if hit is None:
                        h = hashlib.md5(t.encode("utf-8")).hexdigest()
                        hit = (int(h[:8], 16) % dim, 1.0 if int(h[8], 16) % 2 == 0 else -1.0)
                        cache[t] = hit
                    v[hit[0]] += hit[1]
                out.append(v / len(toks) if toks else v)
            yield pd.DataFrame({"id": pdf["id"].to_numpy(np.int64), "v": out})
    return encode


def embed_batch(texts: DataFrame, encoder: Encoder, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``(id, text)`` -> ``(id, v array<double>)`` through ``encoder``."""
    src = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(encoder, "id long, v array<double>")


def normalize_vectors(vectors: DataFrame, vec_col: str = "v") -> DataFrame:
    """L2-normalise a vector column (norm floored at 1e-12)."""
    return vectors.withColumn(vec_col, l2_normalize(F.col(vec_col)))


Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def inner_product_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fixture pair scorer: inner product of the two vectors of each pair."""
    for pdf in batches:
        if len(pdf) == 0:
            continue
        a = np.stack(pdf["qv"].to_numpy())
        b = np.stack(pdf["dv"].to_numpy())
        yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"],
                            "score": np.einsum("ij,ij->i", a, b)})


def cosine_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pair scorer: cosine of the two vectors of each pair."""
    for pdf in batches:
        if len(pdf) == 0:
            continue
        a = np.stack(pdf["qv"].to_numpy())
        b = np.stack(pdf["dv"].to_numpy())
        s = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"], "score": s})


def _with_vectors(pairs: DataFrame, name: str, vectors: DataFrame, out: str) -> DataFrame:
    """Pairs with the vector of their text id ``name``.  Pairs are cast to the
    vectors' own key, so the large table is joined by it as it is stored, and
    only its rows that a pair names are shuffled (a semi join whose id set is
    broadcast up to a checked size)."""
    key, own = f"_{name}", F.col(name).try_cast(vectors.schema["id"].dataType)
    keyed = pairs.withColumn(key, own).filter(F.col(key).cast("string") == F.col(name))
    wanted = restrict_to_ids(vectors.select(F.col("id").alias(key), F.col("v").alias(out)), keyed.select(key), key)
    return keyed.join(wanted, key).drop(key)


def pair_score(pairs: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame,
               scorer: Scorer = inner_product_scorer, digits: int = 5) -> DataFrame:
    """Score (query, document) pairs with ``scorer``, rounded.

    ``pairs``: ``(query_id, doc_id)`` strings; vectors keyed by ``id``.  The
    pair list is filtered (depth cut, negative cap) before this step: Catalyst
    cannot push filters through the Python scorer."""
    joined = pairs.select("query_id", "doc_id")
    for name, vectors, out in (("query_id", query_vecs, "qv"), ("doc_id", doc_vecs, "dv")):
        joined = _with_vectors(joined, name, vectors, out)
    scored = joined.select("query_id", "doc_id", "qv", "dv") \
                   .mapInPandas(scorer, "query_id string, doc_id string, score double")
    return scored.withColumn("score", F.round("score", digits))
