"""Column-level functions (SURVEY section H).

Everything here returns a ``Column`` built from JVM-side expressions, so it
stays inside whole-stage code generation.  The two text helpers that need a
loop or a literal parser are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scoring constants of the concept retrieval (k1, k2, b) and
# the default depth of a run.
BM25_K1 = 0.6
BM25_K2 = 1.5
BM25_B = 2.0
SPARSE_TOP_K = 1000

# Fixed value: the marker that precedes a latent description in a reply.
INTERPRETATION_MARKER = "[interpretation]:"
# Whitespace that splits tokens and is stripped around fields (the same class
# in Spark and DuckDB).
WHITESPACE = r"[ \t\n\r\f]"


def strip_ws(c) -> Column:
    """Remove surrounding whitespace (Python ``str.strip()`` on ASCII text)."""
    return F.regexp_replace(_col(c), f"^{WHITESPACE}+|{WHITESPACE}+$", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """H8: inner product of two equal-length double arrays."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def vec_sub(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(v, eps: float = 1e-12) -> Column:
    """Divide by the Euclidean norm, floored at ``eps``.

    The norm is computed once per row and paired with the components
    (a row-level expression inside a lambda would be re-evaluated for every
    element, which is quadratic in the width)."""
    v = _col(v)
    norm = F.greatest(l2_norm(v), F.lit(eps))
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def query_saturation(tf_q, k2: float = BM25_K2) -> Column:
    """Query-side factor tf_q (k2+1) / (tf_q + k2)."""
    tf_q = _col(tf_q)
    return (tf_q * F.lit(k2 + 1.0)) / (tf_q + F.lit(k2))


def doc_saturation(tf_d, dl, avgdl, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    """Document-side factor tf_d (k1+1) / (tf_d + k1 (1 - b + b dl/avgdl)).

    With b = 2 the denominator can be zero or negative (SURVEY L2); a zero
    denominator gives NULL, which the score sum then ignores.
    """
    tf_d, dl, avgdl = _col(tf_d), _col(dl), _col(avgdl)
    denom = tf_d + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.try_divide(dl.cast("double"), avgdl))
    return F.try_divide(tf_d * F.lit(k1 + 1.0), denom)


def bm25_term(idf, tf_q, tf_d, dl, avgdl, k1: float = BM25_K1, k2: float = BM25_K2,
              b: float = BM25_B) -> Column:
    """H7: one shared latent's contribution, idf * h_q * h_d."""
    return _col(idf) * query_saturation(tf_q, k2) * doc_saturation(tf_d, dl, avgdl, k1, b)


def idf(n_docs, doc_freq) -> Column:
    """D3: ln((N - n + 0.5) / (n + 0.5)); no +1, no floor, may be negative."""
    n_docs, doc_freq = _col(n_docs), _col(doc_freq)
    return F.log((n_docs.cast("double") - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)))


def reciprocal_rank_score(rank) -> Column:
    """H6: score = 1 / rank when a run line has no score."""
    return F.lit(1.0) / _col(rank).cast("double")


def parse_shard_name(name) -> tuple[Column, Column]:
    """H5: the two trailing integers of ``shard_{worker}_{index}``."""
    name = _col(name)
    pattern = r"shard_(\d+)_(\d+)(\.[A-Za-z0-9.]*)?$"
    return (F.regexp_extract(name, pattern, 1).cast("long"),
            F.regexp_extract(name, pattern, 2).cast("long"))


def parse_interpretation(text) -> Column:
    """H4: text after the last interpretation marker, trimmed; whole text if absent."""
    return strip_ws(F.substring_index(_col(text), INTERPRETATION_MARKER, -1))


def round_score(c, digits: int) -> Column:
    """Numeric rounding (never a formatted string, SURVEY L25)."""
    return F.round(_col(c), digits)


def log_softmax(score, partition_cols) -> Column:
    """S - max(s) - ln(sum(exp(s - max(s)))) over each group."""
    w = Window.partitionBy(*partition_cols)
    s = _col(score)
    shifted = s - F.max(s).over(w)
    return shifted - F.log(F.sum(F.exp(shifted)).over(w))


def normalize_qa_text(text) -> Column:
    """H2: a text wrapped in double quotes loses them and its doubled quotes
    become single ones, as long as it is wrapped.  Each turn takes a leading
    quote away, so there are at most as many turns as leading quotes."""
    text = _col(text)
    turns = F.length(text) - F.length(F.ltrim(text, F.lit('"')))
    wrapped = lambda t: t.startswith('"') & t.endswith('"')
    inner = lambda t: F.replace(t.substr(F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(turns, F.lit(0))), text,
                       lambda t, _: F.when(wrapped(t), inner(t)).otherwise(t))


def _parse_list_one(text):
    if text is None:
        return None
    value = ast.literal_eval(text)
    if isinstance(value, (str, bytes)):
        value = [value]
    return [str(v) for v in value]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_answer_list(texts: pd.Series) -> pd.Series:
    """H3: a Python list literal of answers to an array of strings.

    A literal parser, never ``eval``.
    """
    return texts.map(_parse_list_one)
