"""Text-side operators.

Tokens are whitespace pieces (WordPiece is not available; SURVEY B3
re-aims), with continuation pieces marked ``##``.  A document's tokens stay
one array in one row for masking, so masking is map-only (no shuffle of
tokens); the exploded table ``(doc_id, pos, token)`` is used for pooling.

Randomness (word shuffling, 80/10/10 replacement) is a seeded md5 of the
position, identical in Spark and SQL and stable across task retries.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptsearch.functions.scalar import WHITESPACE
from conceptsearch.operators.numbering import number_rows
from conceptsearch.session import scratch_path

# Special tokens and model input lengths.
CLS, SEP, MASK = "[CLS]", "[SEP]", "[MASK]"
Q_MAX_LEN, P_MAX_LEN, RERANK_MAX_LEN = 32, 144, 256


def doc_input_text(corpus: DataFrame) -> DataFrame:
    """B1: ``title: contents`` when the title is non-empty, else contents."""
    text = F.when(F.length(F.coalesce("title", F.lit(""))) > 0,
                  F.concat(F.col("title"), F.lit(": "), F.col("contents"))).otherwise(F.col("contents"))
    return corpus.select("doc_id", text.alias("input_text"))


# Wanted-id sets up to this many rows are broadcast to filter a large table
# map-side before it is joined.
MAX_BROADCAST_ID_ROWS = 5_000_000


def restrict_to_ids(big: DataFrame, ids: DataFrame, key: str,
                    max_rows: int | None = MAX_BROADCAST_ID_ROWS) -> DataFrame:
    """Keep the rows of ``big`` whose ``key`` is in ``ids`` (one column,
    same name), with a broadcast semi join when the id set is small: the
    large table (a corpus) is filtered where it is read, never shuffled.
    ``max_rows=None`` means the caller has proven the bound."""
    wanted = ids.select(key).distinct()
    if max_rows is not None and wanted.count() > max_rows:
        return big
    return big.join(F.broadcast(wanted), key, "left_semi")


def join_corpus(pairs: DataFrame, corpus: DataFrame, how: str = "inner",
                id_col: str = "doc_id") -> DataFrame:
    """Attach title and contents by document id (``left`` keeps ids
    missing from the corpus, where the reference would fail).  The corpus is
    first cut to the wanted ids (broadcast semi join, size checked)."""
    c = corpus.select(F.col("doc_id").cast("string").alias("_cid"), "title", "contents")
    c = restrict_to_ids(c, pairs.select(F.col(id_col).cast("string").alias("_cid")), "_cid")
    return pairs.join(c, F.col(id_col).cast("string") == F.col("_cid"), how).drop("_cid")


#: Bytes of query texts up to which they are broadcast.
MAX_BROADCAST_TEXT_BYTES = 128 << 20


def join_query_text(pairs: DataFrame, queries: DataFrame,
                    max_broadcast_bytes: int = MAX_BROADCAST_TEXT_BYTES) -> DataFrame:
    """Attach the query text by ``query_id``.  The texts are first cut to
    the queries that the pairs name; they are broadcast only when the bytes
    of what is left are below ``max_broadcast_bytes``."""
    q = queries.select(F.col("qid").cast("string").alias("query_id"), F.col("query"))
    q = restrict_to_ids(q, pairs.select("query_id"), "query_id")
    size = q.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("query"), F.lit(0)) + 64), F.lit(0))).first()[0]
    return pairs.join(F.broadcast(q) if size <= max_broadcast_bytes else q, "query_id", "left")


def query_doc_pairs(pairs: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """B2: model-input pairs ``(query_id, doc_id, query, passage)``."""
    with_doc = join_corpus(pairs, corpus, "left")
    passage = F.when(F.length(F.coalesce("title", F.lit(""))) > 0,
                     F.concat(F.col("title"), F.lit(": "), F.col("contents"))).otherwise(F.col("contents"))
    return join_query_text(with_doc.withColumn("passage", passage), queries) \
        .select("query_id", "doc_id", "query", "passage")


def truncate_tokens(text: Column, max_len: int) -> Column:
    """The first ``max_len`` whitespace tokens (model input length)."""
    return F.slice(F.split(text, " "), 1, max_len)


def limit_ordered(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """First n rows by ``order_col`` (a dry-run / max-samples cut)."""
    return df.orderBy(order_col).limit(n)


def contiguous_shard(df: DataFrame, pos_col: str, num_shards: int) -> DataFrame:
    """Contiguous sharding of rows numbered 0..N-1 by ``pos_col``: the
    first ``N % num_shards`` shards get one extra row.  Pure arithmetic on a
    dense position; N is a scalar subquery."""
    n = df.select(F.count("*")).scalar()
    div = F.floor(n / F.lit(num_shards))
    mod = n - div * num_shards
    big = mod * (div + 1)
    p = F.col(pos_col)
    shard = F.when(p < big, F.floor(p / (div + 1))) \
             .otherwise(mod + F.floor((p - big) / F.greatest(div, F.lit(1))))
    return df.withColumn("shard", shard.cast("long"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a small input: when the input has fewer partitions
    than the cluster has cores (a few large row groups), redistribute it
    round-robin; a large input is left as it is (no shuffle)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def token_arrays(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                 piece_every: int = 5) -> DataFrame:
    """Whitespace tokens of whole texts as one array per document, ``[CLS]``
    first and ``[SEP]`` last; every ``piece_every``-th word (position %
    piece_every = piece_every - 1) is written as a ``##`` continuation piece.
    Output ``(doc_id, toks)``."""
    words = F.filter(F.split(F.col(text_col), WHITESPACE + "+"), lambda w: F.length(w) > 0)
    marked = F.transform(words, lambda w, i: F.when(i % piece_every == piece_every - 1,
                                                    F.concat(F.lit("##"), w)).otherwise(w))
    toks = F.concat(F.array(F.lit(CLS)), marked, F.array(F.lit(SEP)))
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col))) \
        .select("doc_id", toks.alias("toks"))


def token_table(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                piece_every: int = 5) -> DataFrame:
    """The token arrays exploded: ``(doc_id, pos, token)``."""
    return token_arrays(docs, text_col, id_col, piece_every) \
        .select("doc_id", F.posexplode("toks").alias("pos", "token")) \
        .select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def _word_mask_np(n: int, special: np.ndarray, order: np.ndarray, prob: float,
                  max_predictions: int | None) -> np.ndarray:
    """One document's whole-word mask given its ``n`` tokens' special places and
    its word starts in shuffled order.  Words are taken while they fit: up to
    the first that does not by their running sum, then one at a time, each the
    next that still fits, of which there are fewer than that one's length."""
    mask = np.zeros(n, dtype=np.int32)
    if n == 0 or order.size == 0:
        return mask
    ns = np.ones(n, dtype=bool)
    ns[special] = False
    starts = np.sort(order)
    first = np.zeros(n, dtype=np.int64)
    first[starts] = 1
    pos = np.flatnonzero(ns)
    word_of = np.cumsum(first)[pos] - 1             # >= 0: first non-special starts a word
    lens = np.bincount(word_of, minlength=starts.size)
    target = max(1, int(round(n * prob)))
    if max_predictions is not None:
        target = min(target, max_predictions)
    drawn = np.searchsorted(starts, order)
    total = np.cumsum(lens[drawn])
    at = int(np.searchsorted(total, target, side="right"))
    chosen = np.zeros(starts.size, dtype=bool)
    chosen[drawn[:at]] = True
    left = target - (int(total[at - 1]) if at else 0)
    rest = drawn[at:]
    while left > 0 and rest.size:
        fits = np.flatnonzero(lens[rest] <= left)
        if not fits.size:
            break
        chosen[rest[fits[0]]] = True
        left -= int(lens[rest[fits[0]]])
        rest = rest[fits[0] + 1:]
    mask[pos] = chosen[word_of]
    return mask


def whole_word_mask(tokens: DataFrame, mlm_prob: float, seed: int = 42,
                    max_predictions: int | None = None) -> DataFrame:
    """Whole-word masking of each document's token array.

    Words are a non-``##`` token plus its following ``##`` pieces (specials
    never belong to a word).  Words are shuffled by ``md5(seed:doc:start)``
    and taken greedily while the masked piece count stays within
    ``max(1, round_half_even(n_tokens * mlm_prob))``; a word that would
    overshoot is skipped.  Whole texts have no further bound;
    ``max_predictions`` sets one for inputs already cut to a model's length.

    Map-only: a document is one row, so no token is ever shuffled.  Word
    starts and their md5 shuffle order are JVM array functions (every
    row-level array is computed once, outside lambdas); the greedy pass is a
    small NumPy helper per row on Arrow batches, which gets places only:
    no token leaves the JVM.
    ``tokens``: ``(doc_id, toks)``; output adds ``mask array<int>``.
    """
    toks = F.col("toks")
    n = F.size(toks)

    def special(i):
        return toks[i].isin(CLS, SEP)

    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # columns of their own: what is named twice is worked out once
    rows = tokens.withColumn("_plain", F.filter(idx, lambda i: ~special(i))) \
                 .withColumn("_heads", F.filter("_plain", lambda i: ~toks[i].startswith("##")))
    first_ns = F.get("_plain", 0)                                  # null in a text without words
    starts = F.when(first_ns.isNull() | F.get("_heads", 0).eqNullSafe(first_ns), F.col("_heads")) \
              .otherwise(F.concat(F.array(first_ns), "_heads"))
    doc = F.col("doc_id").cast("string")
    keyed = F.transform(starts, lambda st: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), doc, st.cast("string"))).alias("h"), st.alias("s")))
    order = F.transform(F.array_sort(keyed), lambda x: x["s"])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def masks(n_s: pd.Series, special_s: pd.Series, order_s: pd.Series) -> pd.Series:
        return pd.Series([_word_mask_np(int(c), np.asarray(x, dtype=np.int64), np.asarray(o, dtype=np.int64),
                                        mlm_prob, max_predictions)
                          for c, x, o in zip(n_s, special_s, order_s)])

    return rows.withColumn("mask", masks(F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)), F.filter(idx, special), order)) \
               .drop("_plain", "_heads")


def explode_mask(masked: DataFrame, mask_col: str = "mask") -> DataFrame:
    """Arrays to rows ``(doc_id, pos, token, masked)``."""
    z = F.arrays_zip(F.col("toks").alias("token"), F.col(mask_col).alias("m"))
    return masked.select("doc_id", F.posexplode(z).alias("pos", "p")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("p.token").alias("token"),
        F.col("p.m").alias("masked"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """The distinct tokens of all documents with dense ids from 0 on, in the
    order of the tokens: ``(token_id, token, n)``.  Counts are combined before
    they move; ids come from ``number_rows``, so no task holds the vocabulary.
    Input ``(doc_id, toks)``."""
    counts = tokens.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return number_rows(counts, [F.col("token").asc()], "token_id").select("token_id", "token", "n")


def _hash_key(seed: int, tag: str, i) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(tag), F.col("doc_id").cast("string"), i.cast("string"))


def _uniform(seed: int, tag: str, i) -> Column:
    return F.conv(F.substring(F.md5(_hash_key(seed, tag, i)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _hash_number(seed: int, tag: str, i, digits: int) -> Column:
    return F.conv(F.substring(F.md5(_hash_key(seed, tag, i)), 1, digits), 16, 10).cast("long")


def _label(mask_col: str) -> Column:
    return F.transform("toks", lambda t, i: F.when(F.col(mask_col)[i] == 1, t))


def mask_tokens(masked: DataFrame, seed: int = 42, all_use_mask_token: bool = False,
                vocab: DataFrame | None = None, mask_col: str = "mask", prefix: str = "") -> DataFrame:
    """Masked positions become ``[MASK]`` (80 %), a random token (10 %)
    or stay (10 %); labels keep the original token on masked positions and
    are null (the reference's -100) elsewhere.

    The random token is one of ``vocab`` (``vocabulary``), each with the same
    chance; without it, one of the same document, which needs no shuffle.
    Input ``(doc_id, toks, mask)``; output adds ``inputs`` and ``labels``
    (with ``prefix``).  With ``vocab`` the positions to replace, about one in
    a hundred tokens at a mask rate of 15 %, meet the vocabulary by hashed id
    and their documents by doc_id; documents are written once before, in
    buckets by doc_id, and not shuffled."""
    inputs, labels = f"{prefix}inputs", f"{prefix}labels"
    if all_use_mask_token:
        keep = F.transform("toks", lambda t, i: F.when(F.col(mask_col)[i] == 1, F.lit(MASK)).otherwise(t))
        return masked.withColumn(inputs, keep).withColumn(labels, _label(mask_col))
    if vocab is not None:
        return _mask_from_vocabulary(masked, vocab, [(seed, mask_col, inputs, labels)])

    def replace(t, i):
        m = F.col(mask_col)[i] == 1
        return (F.when(m & (_uniform(seed, "r", i) < 0.8), F.lit(MASK))
                 .when(m & (_uniform(seed, "x", i) < 0.5), F.col("toks")[F.pmod(_hash_number(seed, "p", i, 8), F.size("toks"))])
                 .otherwise(t))

    return masked.withColumn(inputs, F.transform("toks", replace)).withColumn(labels, _label(mask_col))


def _drawn(mask_col: str, seed: int) -> Column:
    """Places whose token is replaced by a random one."""
    n = F.size("toks")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (F.col(mask_col)[i] == 1) & (_uniform(seed, "r", i) >= 0.8)
                    & (_uniform(seed, "x", i) < 0.5))


def _mask_from_vocabulary(masked: DataFrame, vocab: DataFrame, tracks: list[tuple[int, str, str, str]]) -> DataFrame:
    """``mask_tokens`` with ``vocab`` on one or more masks at once: a track is
    (seed, mask, inputs, labels), by their column names."""
    spark = masked.sparkSession
    columns, name = masked.columns, f"masked_{uuid.uuid4().hex}"
    drawn = {f"_drawn{k}": _drawn(mask_col, seed) for k, (seed, mask_col, _, _) in enumerate(tracks)}
    # bucketed by document, so that what comes back for a document meets it where it lies
    (masked.withColumns(drawn).withColumn("_key", F.xxhash64("doc_id"))
     .write.option("path", scratch_path(spark, name)).option("compression", "zstd")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "_key").saveAsTable(name))
    rows = spark.table(name)
    spark.sql(f"DROP TABLE `{name}`")   # the name only: the plan knows the files
    size = vocab.count()

    def picked(k: int, seed: int) -> Column:
        return F.transform(f"_drawn{k}", lambda i: F.struct(
            F.lit(k).alias("track"), i.alias("pos"), F.pmod(_hash_number(seed, "p", i, 15), F.lit(max(size, 1))).alias("token_id")))

    each = [picked(k, seed) for k, (seed, *_) in enumerate(tracks)]
    picks = rows.select("_key", "doc_id", F.explode(F.concat(*each)).alias("p")).select("_key", "doc_id", "p.*")
    # equal picks (documents of one id) have one token id, so they are where the join brings them
    found = (picks.join(vocab.select("token_id", "token"), "token_id")
                  .groupBy("token_id", "_key", "doc_id", "track", "pos").agg(F.first("token").alias("token")))
    # by document: bounded by its own row, which holds all its tokens
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("track") == k, F.struct("pos", "token")))).alias(f"_found{k}")
            for k in range(len(tracks))]
    found = found.groupBy("_key", "doc_id").agg(*maps).withColumnRenamed("doc_id", "_doc").withColumnRenamed("_key", "_of")
    out = rows.join(found.hint("shuffle_hash"), (rows["_key"] == found["_of"]) & rows["doc_id"].eqNullSafe(found["_doc"]), "left")

    def replaced(k: int, seed: int, mask_col: str) -> Column:
        return F.transform("toks", lambda t, i: F.when((F.col(mask_col)[i] == 1) & (_uniform(seed, "r", i) < 0.8), F.lit(MASK))
                           .when(F.array_contains(f"_drawn{k}", i), F.try_element_at(f"_found{k}", i)).otherwise(t))

    added = {}
    for k, (seed, mask_col, inputs, labels) in enumerate(tracks):
        added |= {inputs: replaced(k, seed, mask_col), labels: _label(mask_col)}
    return out.withColumns(added).select(*columns, *added)


def clean_labels(toks: str = "toks") -> Column:
    """The tokens as labels of their own, whatever is masked; special
    tokens have none (null, the reference's -100)."""
    return F.transform(toks, lambda t: F.when(~t.isin(CLS, SEP, MASK), t))


def dual_mask_inputs(dual: DataFrame, seed: int = 42, vocab: DataFrame | None = None,
                     all_use_mask_token: bool = False) -> DataFrame:
    """H13 on both masks of H14: encoder and decoder inputs with labels of
    their own (replacements are drawn independently), and the clean labels.
    Input ``dual_mask``'s output; adds ``enc_inputs, enc_labels, dec_inputs,
    dec_labels, labels``."""
    if vocab is not None and not all_use_mask_token:    # both tracks at once: documents are written once
        tracks = [(seed + k, c, f"{c}_inputs", f"{c}_labels") for k, c in enumerate(("enc", "dec"))]
        return _mask_from_vocabulary(dual, vocab, tracks).withColumn("labels", clean_labels())
    enc = mask_tokens(dual, seed, all_use_mask_token, vocab, "enc", "enc_")
    both = mask_tokens(enc, seed + 1, all_use_mask_token, vocab, "dec", "dec_")
    return both.withColumn("labels", clean_labels())


def explode_masked_tokens(df: DataFrame) -> DataFrame:
    """``mask_tokens`` arrays to rows ``(doc_id, pos, token, input_token, label)``."""
    z = F.arrays_zip(F.col("toks").alias("token"), F.col("inputs").alias("input_token"),
                     F.col("labels").alias("label"))
    return df.select("doc_id", F.posexplode(z).alias("pos", "p")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "p.token", "p.input_token", "p.label")


def dual_mask(tokens: DataFrame, encoder_prob: float, decoder_prob: float,
              seed: int = 42) -> DataFrame:
    """Encoder mask at ``encoder_prob``; decoder mask = encoder mask OR an
    independent mask at (pd - pe) / (1 - pe), so it always contains the
    encoder mask.  Input ``(doc_id, toks)``; output adds ``enc`` and ``dec``."""
    enc = whole_word_mask(tokens, encoder_prob, seed).withColumnRenamed("mask", "enc")
    extra = (decoder_prob - encoder_prob) / (1.0 - encoder_prob)
    if extra <= 1e-4:
        return enc.withColumn("dec", F.col("enc"))
    both = whole_word_mask(enc, extra, seed + 1)
    return both.withColumn("dec", F.zip_with("enc", "mask", lambda a, b: F.greatest(a, b))) \
               .drop("mask")


def replace_ratio(masked_tokens: DataFrame) -> DataFrame:
    """Replaced tokens (input differs from a valid label) over attended
    tokens.  Input: ``mask_tokens`` output.  One row ``(replaced, attended, ratio)``."""
    replaced = F.size(F.filter(F.arrays_zip(F.col("inputs").alias("i"), F.col("labels").alias("l")),
                               lambda x: x["l"].isNotNull() & (x["i"] != x["l"])))
    agg = masked_tokens.agg(F.sum(replaced).cast("long").alias("replaced"),
                            F.sum(F.size("toks")).cast("long").alias("attended"))
    return agg.withColumn("ratio", F.col("replaced") / F.col("attended"))


def token_vectors(tokens: DataFrame, dim: int) -> DataFrame:
    """Hashed one-hot token vectors in long form ``(doc_id, pos, dim, x)``:
    +-1 at bucket ``md5(token) % dim``, sign from the next hex digit."""
    h = F.md5(F.col("token"))
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim))
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return tokens.select("doc_id", "pos", bucket.alias("dim"), sign.alias("x"))


def pool_mean(tokens: DataFrame, dim: int, attended_col: str | None = None) -> DataFrame:
    """Masked mean of token vectors per (document, dimension);
    dimensions without any token are 0.  Output ``(doc_id, dim, value)``."""
    t = tokens if attended_col is None else tokens.filter(F.col(attended_col) == 1)
    n = t.groupBy("doc_id").agg(F.count("*").alias("n"))
    sums = token_vectors(t, dim).groupBy("doc_id", "dim").agg(F.sum("x").alias("s"))
    return _every_dim(n, dim).join(sums, ["doc_id", "dim"], "left") \
        .select("doc_id", "dim", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("value"))


def _every_dim(docs: DataFrame, dim: int) -> DataFrame:
    """Each row with every dimension of a vector."""
    return docs.withColumn("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))))


def pool_first(tokens: DataFrame, dim: int) -> DataFrame:
    """The first token's vector (the ``[CLS]`` position)."""
    first = tokens.filter(F.col("pos") == 0)
    vectors = token_vectors(first, dim).select("doc_id", "dim", "x")
    return _every_dim(first.select("doc_id"), dim).join(vectors, ["doc_id", "dim"], "left") \
        .select("doc_id", "dim", F.coalesce("x", F.lit(0.0)).alias("value"))
