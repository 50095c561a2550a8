"""Retrieval operators.

Concept retrieval is term-at-a-time accumulation written as a join plus a
hash aggregate: query latents join the postings on ``latent`` (C4), each
match contributes one H7 term, contributions are summed per (query,
document) with a map-side partial aggregate (D4), and a ``row_number`` cut
gives the top k (F3).  Spark inserts a partial ``WindowGroupLimit`` before
the shuffle, so a query matching most of the corpus sends at most k rows per
map partition to its final task.  That is for up to ``MAX_JOINED_QUERIES``
queries: with more, the pairs of queries and documents outgrow the tables,
so postings and queries meet in cells (``scored_cells``) and no pair moves.

Dense retrieval scores every query against every passage without
materialising the pairs: a query set of checked size is broadcast, a larger
one meets the passages in a grid of blocks and chunks; each task keeps a
running top k per query in NumPy, and one window merges the partial lists
(C3 + F2).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conceptsearch.operators.numbering import number_rows
from conceptsearch.functions.scalar import (BM25_B, BM25_K1, BM25_K2, SPARSE_TOP_K,
                                            query_saturation)
from conceptsearch.operators.index import ConceptIndex, scored_postings

# A query-side table is broadcast only below this many rows (about 32 bytes
# per (qid, latent, weight) row: 2 M rows is 64 MB).
MAX_BROADCAST_QUERY_ROWS = 2_000_000
# Push the query latents into the postings scan as an IN list below this size
# (at most the model's latent count, 24 576 in the reference).
MAX_PUSHED_LATENTS = 32_768
# Queries up to which (query, document) pairs are summed up by a shuffle.
MAX_JOINED_QUERIES = 256
# Postings that one cell of concept search holds (about 40 bytes each).
CELL_POSTINGS = 4_000_000
# Rows of a batch that a cell hands on.
CELL_OUTPUT_ROWS = 250_000
# Bytes of passage vectors that a task holds which ranks all of them.
RANK_PASSAGE_BYTES = 512 << 20
# Bytes of query vectors broadcast in dense search, or held by a grid cell.
DENSE_QUERY_BLOCK_BYTES = 128 << 20
# (query, candidate) entries a task keeps per query block: bounds the running
# top-k buffer (query block rows x k) in each Python worker.
DENSE_MAX_TOPK_ENTRIES = 4_000_000
# Bytes of one query-block x passage-chunk score matrix.
DENSE_SCORE_CHUNK_BYTES = 16 << 20
# Bytes of passage vectors that a grid cell holds.
DENSE_PASSAGE_CHUNK_BYTES = 32 << 20


def rank_within(df: DataFrame, group_cols, order_cols, k: int | None,
                rank_col: str = "rank") -> DataFrame:
    """``row_number`` per group with an optional cut (F3, F5, F7 ...).

    The cut ``rank <= k`` lets Spark place a partial group limit before the
    shuffle, so a group's final task receives at most k rows per partition.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    out = df.withColumn(rank_col, F.row_number().over(w).cast("long"))
    return out.filter(F.col(rank_col) <= k) if k is not None else out


def sparse_search(index: ConceptIndex, query_latents: DataFrame, k: int | None = SPARSE_TOP_K,
                  k1: float = BM25_K1, k2: float = BM25_K2, b: float = BM25_B,
                  push_latents: bool = True) -> DataFrame:
    """C4 + C5 + H7 + D4 + F3: concept-level BM25 run.

    ``query_latents``: ``(qid, latent, weight)``.  Out-of-vocabulary latents
    drop out of the inner join.  Output ``(qid, docid, rank, score)``; ties
    broken by docid (SURVEY L6).
    """
    q = query_latents.select("qid", "latent", query_saturation(F.col("weight"), k2).alias("h_q"))
    postings = scored_postings(index, k1=k1, b=b)
    # one small job: the query-side row count (broadcast decision) and its
    # distinct latents (at most the model's latent count) for scan pruning
    stats = q.agg(F.count("*").alias("n"), F.collect_set("latent").alias("latents"),
                  F.countDistinct("qid").alias("queries")).first()
    n_query_rows, wanted = stats["n"], stats["latents"]
    if push_latents and len(wanted) <= MAX_PUSHED_LATENTS:
        postings = postings.filter(F.col("latent").isin(sorted(wanted)))
    if stats["queries"] > MAX_JOINED_QUERIES:
        chunks = max(1, -(-(index.terms.agg(F.sum("df")).first()[0] or 0) // CELL_POSTINGS))
        blocks = min(q.sparkSession.sparkContext.defaultParallelism, stats["queries"])
        return scored_cells(q, postings, k, blocks, chunks)
    q_side = F.broadcast(q) if n_query_rows <= MAX_BROADCAST_QUERY_ROWS else q
    contrib = F.col("idf") * F.col("h_q") * F.col("h_d")
    scores = (postings.join(q_side, "latent")
                      .groupBy("qid", "docid").agg(F.sum(contrib).alias("score")))
    return rank_within(scores, ["qid"], [F.desc("score"), F.asc("docid")], k) \
        .select("qid", "docid", "rank", "score")


def _in_cells(sides: list[DataFrame], cells: int, order: list[str]) -> DataFrame:
    """The sides in one table, every cell in a partition of its own: each
    cell has first the rows of the first side, then those of the next."""
    one = None
    for kind, side in enumerate(sides):
        side = side.withColumn("kind", F.lit(kind))
        one = side if one is None else one.unionByName(side, allowMissingColumns=True)
    return one.repartitionById(cells, F.col("cell")).sortWithinPartitions("kind", *order)


def _dealt(df: DataFrame, key: str, own: str, parts: int, other: str, others: int) -> DataFrame:
    """Rows dealt by a hash of ``key`` into ``parts``, each with every part of
    the other side."""
    return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(parts))) \
             .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))


def _order(score: np.ndarray, known: np.ndarray, k: int | None) -> np.ndarray:
    """Places of the k first by score, as Spark orders it: NaN first, unknown
    last; equal ones in the order given."""
    if known.all() and not np.isnan(score).any():
        at = np.arange(score.size)
        if k is not None and score.size > k:
            at = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])     # ties kept, cut below
        return at[np.argsort(-score[at], kind="stable")][:k]
    key = np.where(np.isnan(score), 0.0, -score)
    return np.lexsort((np.arange(score.size), key, ~np.isnan(score), ~known))[:k]


def scored_cells(query_side: DataFrame, postings: DataFrame, k: int | None, blocks: int, chunks: int) -> DataFrame:
    """BM25 sums of every query over every document, without moving a pair:
    queries ``(qid, latent, h_q)`` are dealt into ``blocks``, documents with
    their scored postings into ``chunks``, and every block meets every chunk
    in a task.  It holds the chunk's postings by latent and adds up one query
    after the other, latents in ascending order.  With one chunk a query's
    ranks are known in its cell; of more, each sends its first k.  What moves
    is ``blocks`` x postings and, of more chunks than one, k a query and chunk."""
    types = {c: d.schema[c].dataType for d, c in ((query_side, "qid"), (postings, "docid"))}
    fields = [T.StructField("qid", types["qid"]), T.StructField("docid", types["docid"]),
              T.StructField("rank", T.LongType()), T.StructField("score", T.DoubleType())]
    cell = (F.col("block") * chunks + F.col("chunk")).cast("int").alias("cell")
    p = _dealt(postings.select("docid", "latent", "idf", F.col("h_d").alias("h")), "docid", "chunk", chunks, "block", blocks)
    q = _dealt(query_side.select("qid", "latent", F.col("h_q").alias("h")), "qid", "block", blocks, "chunk", chunks)
    rows = _in_cells([p.select(cell, "docid", "latent", "idf", "h"), q.select(cell, "qid", "latent", "h")],
                     blocks * chunks, ["docid", "qid", "latent"])

    def score(batches):
        held = {0: [], 1: []}
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(kinds, 1))
            for kind, piece in ((0, batch.slice(0, first)), (1, batch.slice(first))):
                if piece.num_rows:
                    held[kind].append(piece)
        if held[0] and held[1]:
            yield from _cell_scores(pa.Table.from_batches(held.pop(0)), pa.Table.from_batches(held.pop(1)), k, chunks == 1)

    found = rows.mapInArrow(score, T.StructType(fields))
    if k is not None and chunks == 1:
        return found
    return rank_within(found.drop("rank"), ["qid"], [F.desc("score"), F.asc("docid")], k) \
        .select("qid", "docid", "rank", "score")


def _numbers(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and where they are known."""
    col = table.column(column).combine_chunks()
    return (col.fill_null(0).to_numpy(zero_copy_only=False),
            col.is_valid().to_numpy(zero_copy_only=False))


def _coded(table: pa.Table, column: str):
    """A sorted column as numbers from 0 on in its order, and its values."""
    coded = table.column(column).combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _cell_scores(postings: pa.Table, queries: pa.Table, k: int | None, ranked: bool):
    """Batches (qid, docid, rank, score) of a cell; rows come sorted by id and latent."""
    doc, docs = _coded(postings, "docid")
    latent, listed = _numbers(postings, "latent")
    idf, known = _numbers(postings, "idf")
    h_d, known_h = _numbers(postings, "h")
    known = known & known_h
    at = np.flatnonzero(listed)
    at = at[np.argsort(latent[at], kind="stable")]
    doc, latent, idf, h_d, known = doc[at], latent[at], idf[at], h_d[at], known[at]
    row, qids = _coded(queries, "qid")
    q_latent, q_listed = _numbers(queries, "latent")
    h_q, q_known = _numbers(queries, "h")
    starts, ends = np.searchsorted(latent, q_latent), np.searchsorted(latent, q_latent, "right")
    ends = np.where(q_listed, ends, starts)
    out, held = [], 0

    def batch(parts):
        score = np.concatenate([x[2] for x in parts])
        return pa.RecordBatch.from_arrays(
            [qids.take(pa.array(np.repeat([x[0] for x in parts], [len(x[1]) for x in parts]))),
             docs.take(pa.array(np.concatenate([x[1] for x in parts]))),
             pa.array(np.concatenate([np.arange(1, len(x[1]) + 1) for x in parts])),
             pa.array(score, mask=~np.concatenate([x[3] for x in parts]))], ["qid", "docid", "rank", "score"])

    bounds = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        spans = [(i, slice(starts[i], ends[i])) for i in range(lo, hi) if ends[i] > starts[i]]
        if not spans:
            continue
        hit = np.concatenate([doc[s] for _, s in spans])
        c = np.concatenate([idf[s] * h_q[i] * h_d[s] for i, s in spans])
        sure = np.concatenate([known[s] & q_known[i] for i, s in spans])
        n_sure = None
        if not sure.all():                             # as a sum leaves nulls out
            c = np.where(sure, c, 0.0)
            n_sure = np.bincount(hit, weights=sure, minlength=len(docs))
        found = np.flatnonzero(np.bincount(hit, minlength=len(docs)))
        score = np.bincount(hit, weights=c, minlength=len(docs))[found]
        is_known = np.ones(found.size, bool) if n_sure is None else n_sure[found] > 0
        if k is not None:
            first = _order(score, is_known, k)
            found, score, is_known = found[first], score[first], is_known[first]
        out.append((row[lo], found, score, is_known))
        held += found.size
        if held >= CELL_OUTPUT_ROWS:
            yield batch(out)
            out, held = [], 0
    if out:
        yield batch(out)


def _local_topk(qidx: np.ndarray, pid: np.ndarray, score: np.ndarray, k: int):
    """Exact top k per query index on (score desc, pid asc)."""
    if qidx.size == 0:
        return qidx, pid, score
    order = np.lexsort((pid, -score, qidx))
    qidx, pid, score = qidx[order], pid[order], score[order]
    starts = np.flatnonzero(np.r_[True, qidx[1:] != qidx[:-1]])
    run_start = np.repeat(starts, np.diff(np.r_[starts, qidx.size]))
    keep = (np.arange(qidx.size) - run_start) < k
    return qidx[keep], pid[keep], score[keep]


def _chunks(batches, rows: int):
    """Arrow batches re-cut into pieces of at most ``rows`` rows."""
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            piece = pdf.iloc[lo: lo + rows]
            if len(piece):
                yield piece


def _local_search(ids: np.ndarray, mat: np.ndarray, batches, k: int | None):
    """Top k of every query (``ids``, ``mat``) over frames of (pid, v).

    Memory is bounded: a score matrix is at most ``DENSE_SCORE_CHUNK_BYTES``;
    with a cut, the running top-k buffer holds at most about 2 x queries x k
    entries; without a cut every chunk is emitted as soon as it is scored."""
    rows = max(1, DENSE_SCORE_CHUNK_BYTES // (8 * max(len(ids), 1)))
    buf_q, buf_p, buf_s, held = [], [], [], 0
    for pdf in _chunks(batches, rows):
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64, copy=False)
        pids = pdf["pid"].to_numpy(np.int64)
        s = mat @ x.T                                   # (queries, chunk rows)
        if k is None:
            qi, pj = np.nonzero(np.ones_like(s, dtype=bool))
            yield pd.DataFrame({"qid": ids[qi], "pid": pids[pj], "score": s[qi, pj]})
            continue
        if s.shape[1] > k:
            kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
            qi, pj = np.nonzero(s >= kth[:, None])     # ties kept, cut exactly below
        else:
            qi, pj = np.nonzero(np.ones_like(s, dtype=bool))
        buf_q.append(qi)
        buf_p.append(pids[pj])
        buf_s.append(s[qi, pj])
        held += qi.size
        if held > 2 * len(ids) * k:
            a, b_, c = _local_topk(np.concatenate(buf_q), np.concatenate(buf_p),
                                   np.concatenate(buf_s), k)
            buf_q, buf_p, buf_s, held = [a], [b_], [c], a.size
    if k is None or not buf_q:
        return
    qi, pj, sc = _local_topk(np.concatenate(buf_q), np.concatenate(buf_p),
                             np.concatenate(buf_s), k)
    yield pd.DataFrame({"qid": ids[qi], "pid": pj, "score": sc})


def _matrix(pdf: pd.DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    return pdf[id_col].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.float64)


SCORED = "qid long, pid long, score double"


def _dense_broadcast(passages: DataFrame, queries: pd.DataFrame, k: int | None) -> DataFrame:
    """A query set of checked size meets every passage partition: map-only."""
    bc = passages.sparkSession.sparkContext.broadcast(_matrix(queries, "qid"))
    return passages.mapInPandas(lambda batches: _local_search(*bc.value, batches, k), SCORED)


def dense_grid(queries: DataFrame, passages: DataFrame, k: int | None, blocks: int, chunks: int) -> DataFrame:
    """Partial top k of every cell of a grid: the queries (qid, v) are dealt
    into ``blocks``, the passages (pid, v) into ``chunks``, and every block
    meets every chunk in a task of its own.  Both sides stay on executors."""
    q = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))) \
               .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    p = passages.withColumn("chunk", F.pmod(F.xxhash64("pid"), F.lit(chunks))) \
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def cell(qs: pd.DataFrame, ps: pd.DataFrame) -> pd.DataFrame:
        found = list(_local_search(*_matrix(qs, "qid"), [ps], k)) if len(qs) and len(ps) else []
        return pd.concat(found) if found else pd.DataFrame({"qid": [], "pid": [], "score": []})

    return q.groupBy("block", "chunk").cogroup(p.groupBy("block", "chunk")).applyInPandas(cell, SCORED)


def dense_search(queries: DataFrame, passages: DataFrame, k: int | None,
                 qid_col: str = "qid", pid_col: str = "pid", vec_col: str = "v") -> DataFrame:
    """C3 + F2: exact inner-product top k of every query over all passages.

    A query set of at most ``DENSE_QUERY_BLOCK_BYTES`` (and of at most
    ``DENSE_MAX_TOPK_ENTRIES`` / k queries) is broadcast, and the passages are
    not shuffled.  A larger one never reaches the driver: see ``dense_grid``.
    ``k=None`` ranks every passage (F4, see ``rank_every``).  Output
    ``(qid, pid, rank, score)``.
    """
    q = queries.select(F.col(qid_col).cast("long").alias("qid"),
                       F.col(vec_col).cast("array<double>").alias("v"))
    p = passages.select(F.col(pid_col).cast("long").alias("pid"),
                        F.col(vec_col).cast("array<double>").alias("v"))
    cap = DENSE_QUERY_BLOCK_BYTES // (8 * 1024)         # fits at width 1024
    if k is not None:
        cap = max(1, min(cap, DENSE_MAX_TOPK_ENTRIES // k))
    head = q.limit(cap + 1).toPandas()
    if len(head) == 0:
        return passages.sparkSession.createDataFrame([], "qid long, pid long, rank long, score double")
    dim = max(len(head["v"].iloc[0]), 1)
    n_passages = p.count() if k is None else 0
    if k is None and 8 * n_passages * dim <= RANK_PASSAGE_BYTES:
        blocks = min(passages.sparkSession.sparkContext.defaultParallelism, q.count())
        return rank_every(q, p, n_passages, dim, blocks)
    if len(head) <= cap and 8 * len(head) * dim <= DENSE_QUERY_BLOCK_BYTES:
        partial = _dense_broadcast(p, head, k)
    else:
        block_rows = max(1, DENSE_QUERY_BLOCK_BYTES // (8 * dim))
        if k is not None:
            block_rows = max(1, min(block_rows, DENSE_MAX_TOPK_ENTRIES // k))
        chunk_rows = max(1, min(DENSE_QUERY_BLOCK_BYTES, DENSE_PASSAGE_CHUNK_BYTES) // (8 * dim))
        if k is None:                                   # a cell's pairs are one result
            chunk_rows = max(1, min(chunk_rows, DENSE_SCORE_CHUNK_BYTES // (8 * block_rows)))
        partial = dense_grid(q, p, k, -(-q.count() // block_rows), max(1, -(-p.count() // chunk_rows)))
    if k is None:
        return rank_unbounded(partial)
    return rank_within(partial, ["qid"], [F.desc("score"), F.asc("pid")], k) \
        .select("qid", "pid", "rank", "score")


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    col = batch.column("v")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if col.null_count or flat.size != dim * batch.num_rows:
        raise ValueError(f"a vector is missing or not of width {dim}")
    return flat.reshape(-1, dim)


def rank_every(queries: DataFrame, passages: DataFrame, n_passages: int, dim: int, blocks: int) -> DataFrame:
    """every passage of every query with its rank (score desc, id asc),
    without moving a pair.  The queries (qid, v) are dealt into ``blocks``; a
    task holds all passages (pid, v) and ranks them for one query after the
    other, so what moves is ``blocks`` x passages.  For passages of at most
    ``RANK_PASSAGE_BYTES``; more are ranked by ``rank_unbounded``."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = _in_cells([passages.select(spread.alias("cell"), F.col("pid").alias("id"), "v"),
                      queries.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("cell"),
                                     F.col("qid").alias("id"), "v")], blocks, ["id"])

    def ranked(batches):
        mat, pids, n = np.empty((n_passages, dim)), np.empty(n_passages, np.int64), 0
        at_once = max(1, DENSE_SCORE_CHUNK_BYTES // (32 * max(n_passages, 1)))
        ids, vecs = np.empty(0, np.int64), np.empty((0, dim))
        for batch in batches:
            first = int(np.searchsorted(batch.column("kind").to_numpy(zero_copy_only=False), 1))
            if first:
                part = batch.slice(0, first)
                mat[n: n + first], pids[n: n + first] = _vectors(part, dim), part.column("id").to_numpy(zero_copy_only=False)
                n += first
            if first < batch.num_rows:
                part = batch.slice(first)
                ids = np.concatenate((ids, part.column("id").to_numpy(zero_copy_only=False)))
                vecs = np.concatenate((vecs, _vectors(part, dim)))
                whole = int(np.searchsorted(ids, ids[-1]))        # rows of the last id may go on
                yield from _ranked_queries(ids[:whole], vecs[:whole], pids[:n], mat[:n], at_once)
                ids, vecs = ids[whole:], vecs[whole:]
        yield from _ranked_queries(ids, vecs, pids[:n], mat[:n], at_once)

    return rows.mapInArrow(ranked, "qid long, pid long, rank long, score double")


def _ranked_queries(ids: np.ndarray, vecs: np.ndarray, pids: np.ndarray, mat: np.ndarray, at_once: int):
    """Batches of ranks; both sides come sorted by id.  Queries of one id are
    ranked together."""
    if not len(pids):
        return
    lo = 0
    while lo < len(ids):
        hi = int(np.searchsorted(ids, ids[min(lo + at_once, len(ids)) - 1], "right"))
        scores = vecs[lo:hi] @ mat.T
        bounds = np.flatnonzero(np.r_[True, ids[lo + 1:hi] != ids[lo:hi - 1], True])
        for a, b in zip(bounds[:-1], bounds[1:]):
            score = scores[a] if b == a + 1 else scores[a:b].T.ravel()
            order = _order(score, np.ones(score.size, bool), None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(score.size, ids[lo + a])), pa.array(np.repeat(pids, b - a)[order]),
                 pa.array(np.arange(1, score.size + 1)), pa.array(score[order])], ["qid", "pid", "rank", "score"])
        lo = hi


def rank_unbounded(scores: DataFrame, qid_col: str = "qid", pid_col: str = "pid",
                   score_col: str = "score") -> DataFrame:
    """rank every candidate of every query (score desc, id asc) without a
    cut, spread over the cluster however many candidates one query has.

    Rows are numbered in the order (qid, score desc, pid) by ``number_rows``,
    so one query's candidates span many partitions; a query's rank is its
    row's place minus that of its first row (a per-query minimum, partially
    aggregated).  No window ever holds a whole query.  The result has a row a
    pair: where a depth is enough, ``dense_search`` with k keeps k a query."""
    placed = number_rows(scores.select(qid_col, pid_col, score_col),
                         [F.col(qid_col).asc(), F.col(score_col).desc(), F.col(pid_col).asc()], "_at")
    first = placed.groupBy(qid_col).agg(F.min("_at").alias("_first"))
    return placed.join(first, qid_col).select(
        qid_col, pid_col, (F.col("_at") - F.col("_first") + 1).alias("rank"), score_col)


def topk_merge(partials: DataFrame, k: int, qid_col: str = "qid", pid_col: str = "pid",
               score_col: str = "score") -> DataFrame:
    """merge partial top-k lists (any number of shards) into the global
    top k by (score desc, id asc)."""
    return rank_within(partials.select(qid_col, pid_col, score_col), [qid_col],
                       [F.desc(score_col), F.asc(pid_col)], k)


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors filled up with zeros, and their sizes (-1: one with a null, or none)."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values, at = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), np.maximum(sizes, 0)
    if not flat.null_count and (at == width).all():
        return values.reshape(len(at), width), sizes
    row, first = np.repeat(np.arange(len(at)), at), np.cumsum(at) - at
    mat = np.zeros((len(at), width))
    mat[row, np.arange(len(row)) - first[row]] = values
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return mat, sizes


def _all_pairs(topics: pa.Table, members: pa.RecordBatch):
    """Batches (qid, pid, score) of every topic with every member."""
    qv, pv = topics.column("v").combine_chunks(), members.column("v")
    width = max(pc.max(pc.list_value_length(x)).as_py() or 0 for x in (qv, pv))
    (q, q_size), (p, p_size) = _padded(qv, width), _padded(pv, width)
    qids, pids = topics.column("id").combine_chunks(), members.column("other")
    every, plain = np.arange(len(q)), (q_size == width).all() and (p_size == width).all()
    for lo in range(0, len(p), step := max(1, CELL_OUTPUT_ROWS // len(q))):
        own = p[lo: lo + step]
        unknown = None if plain else ((p_size[lo: lo + step, None] != q_size) | (p_size[lo: lo + step, None] < 0)).ravel()
        yield pa.RecordBatch.from_arrays(
            [qids.take(pa.array(np.tile(every, len(own)))), pids.take(pa.array(np.repeat(np.arange(lo, lo + len(own)), len(q)))),
             pa.array((own @ q.T).ravel(), mask=unknown)], ["qid", "pid", "score"])


def class_scores(topics: DataFrame, members: DataFrame, parts: int = 64) -> DataFrame:
    """Inner products of every topic ``(qid, label, qv)`` with every member ``(pid,
    label, pv)`` of its label: ``(qid, pid, score)``, null where a vector has a
    null or the widths differ.

    A label's members are dealt into ``parts`` and its topics into blocks of
    about ``DENSE_PASSAGE_CHUNK_BYTES``; a task holds one block and meets the
    members of one part batch by batch, so no pair is a row before it has its
    score."""
    spark = topics.sparkSession
    topics, members = topics.filter("label IS NOT NULL"), members.filter("label IS NOT NULL")
    size = topics.agg(F.sum(F.greatest(F.size("qv"), F.lit(0)) * F.lit(8).cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // DENSE_PASSAGE_CHUNK_BYTES))
    label = F.col("label").cast("string").alias("label")
    kinds = T.StructType([T.StructField("qid", topics.schema["qid"].dataType),
                          T.StructField("pid", members.schema["pid"].dataType), T.StructField("score", T.DoubleType())])
    cells = [_dealt(topics.select(label, F.col("qid").alias("id"), F.col("qv").cast("array<double>").alias("v")),
                    "id", "block", blocks, "part", parts).withColumn("kind", F.lit(0)),
             _dealt(members.select(label, F.col("pid").alias("other"), F.col("pv").cast("array<double>").alias("v")),
                    "other", "part", parts, "block", blocks).withColumn("kind", F.lit(1))]
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = ["label", "part", "block"]
    rows = cells[0].unionByName(cells[1], allowMissingColumns=True).repartition(n, *key).sortWithinPartitions(*key, "kind")

    def score(batches):
        cell, held = None, []
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in (*key, "kind"))))
            cuts = [0, *(k for k in range(1, len(own)) if own[k] != own[k - 1]), len(own)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                if own[lo][:3] != cell:
                    cell, held = own[lo][:3], []
                piece = batch.slice(lo, hi - lo)
                if own[lo][3] == 0:
                    held.append(piece)
                elif held:
                    held = [pa.Table.from_batches(held)] if not isinstance(held[0], pa.Table) else held
                    yield from _all_pairs(held[0], piece)

    return rows.mapInArrow(score, kinds)
