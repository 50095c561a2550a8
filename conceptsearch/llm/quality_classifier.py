"""Quality scores by hierarchical empirical Bayes.

A logistic classifier turns a document's own measures into a probability of
good quality.  Probabilities are summed by host and by path (host plus a
second column) over all documents; each host's mean is shrunk towards the
corpus mean and each path's towards its host, with prior weights fitted to
the spread of the means, so sparse sites follow what is known above them.  A
document's score moves its own log odds by the log odds of its path, counted
without the document itself, against the corpus.

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows (smallest
hash of the id); sums and posteriors cover all documents.

Defined cases: null and empty texts have measures of zero; null hosts and
paths are sites of their own; repeated rows count as often as they occur;
without labels of both kinds every document's own probability is the share
of good labels (one half without labels); an empty table gives none.

Scale: measuring is map-only and its slim result is written once; sites are
summed with map-side partial sums; the site table joins back as an equi-join
that Spark may broadcast or split when a site is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm import words as W
from conceptsearch.llm.quality_rules import measure_piece
from conceptsearch.llm.tables import materialise, same, with_arrays

SAMPLE_ROWS = 20_000
STEPS = 30
RIDGE = 1.0
KEEP_AT = 0.5
PRIOR_WEIGHT = (1.0, 10_000.0)
FEATURES = ("log_words", "mean_length", "symbol_share", "dup_line_share", "repeat_share",
            "upper_share", "mark_share", "bar_share", "digit_share", "stop_share", "words_per_line")

_CLASSES = np.zeros((5, 256), dtype=bool)
_CLASSES[0, 0x41:0x5B] = True                 # upper-case letters
_CLASSES[1, list(b"!?")] = True
_CLASSES[2, list(b"|")] = True
_CLASSES[3, 0x30:0x3A] = True                 # digits
_CLASSES[4, list(b".,;:")] = True


def features_piece(t: W.Texts) -> np.ndarray:
    """The classifier's inputs of each text: columns as FEATURES."""
    m = measure_piece(t).astype(float)
    words = np.maximum(m[:, 0], 1)
    chars = np.maximum(m[:, 1], 1)
    lines = np.maximum(m[:, 5], 1)
    shares = []
    for k in range(len(_CLASSES)):
        sums = np.concatenate(([0], np.cumsum(_CLASSES[k][t.data])))
        shares.append((sums[t.offsets[1:]] - sums[t.offsets[:-1]]) / chars)
    upper, mark, bar, digit, stop = shares
    return np.column_stack([
        np.log1p(m[:, 0]), np.minimum(m[:, 1] / words, 30), np.sqrt(m[:, 2] / chars), m[:, 3] / lines,
        m[:, 4] / words, np.sqrt(upper), np.sqrt(mark), np.sqrt(bar), np.sqrt(digit), np.sqrt(stop),
        np.log1p(words / lines)])


def _features(column: pa.Array) -> list[pa.Array]:
    parts = [features_piece(piece) for _, piece in W.texts(column).pieces()]
    x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
    return [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights by Newton steps; the last one is the constant."""
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
        return np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], RIDGE)
    ridge[-1] = 0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9),
                               z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / scale, 0.0)
    out[-1] = w[-1] - float(out[:-1] @ centre)
    return out


def training_rows(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, x, quality of at most SAMPLE_ROWS labels, smallest hash first: of
    documents that share a labelled id, the one whose features' hash is smallest."""
    rows = (labels.filter("quality is not null and doc_id is not null")
            .groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.col("quality").cast("double")).alias("quality"))
            .orderBy(F.xxhash64("label_id"), "label_id").limit(SAMPLE_ROWS))
    joined = measured.join(F.broadcast(rows), F.col(doc_id) == F.col("label_id"))  # 16 bytes a row, at most SAMPLE_ROWS
    return (joined.groupBy(F.col("label_id").alias("doc_id"))
            .agg(F.min_by("x", F.xxhash64("x")).alias("x"), F.first("quality").alias("quality")))


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _weight(sites: DataFrame, centre: Column) -> float:
    """The prior's weight, in documents, for site means around ``centre``:
    by moments, less the variance that mere sampling gives."""
    r = sites.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - centre, 2)).alias("between"),
        F.sum(centre * (1 - centre)).alias("sampling"),
        F.sum(F.col("n") * centre * (1 - centre)).alias("spread")).first()
    if not r["n"]:
        return PRIOR_WEIGHT[1]
    variance = (r["between"] - r["sampling"]) / r["n"]
    weight = r["spread"] / r["n"] / variance - 1 if variance > 0 else PRIOR_WEIGHT[1]
    return min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, host, path, own (the document's probability), site (its path's
    posterior mean without it), score, kept: a row for each row of ``docs``."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"),
                       F.col(path).alias("path"), F.col(text).alias("text"))
    slim = materialise(with_arrays(slim, ["text"], {"x": "array<double>"}, _features).drop("text"), "quality")
    sample = training_rows(slim, labels).orderBy("doc_id").toArrow()
    x = sample["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    weights = fit_logistic(x, sample["quality"].to_numpy())
    odds = sum((F.col("x")[k] * float(w) for k, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    rows = slim.select("doc_id", "host", "path", (1 / (1 + F.exp(-odds))).alias("own"))

    paths = materialise(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s")),
                        "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = total["s"] / total["n"] if total["n"] else 0.5
    w_host = _weight(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + w_host * mean) / (F.col("n") + w_host)).alias("above"))
    paths = paths.join(hosts, same(F.col("host"), F.col("h"))).drop("h")
    w_path = _weight(paths, F.col("above"))
    paths = paths.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "above")
    out = rows.join(paths, same(F.col("host"), F.col("h")) & same(F.col("path"), F.col("p")))
    site = (F.col("s") - F.col("own") + w_path * F.col("above")) / (F.col("n") - 1 + w_path)
    out = out.withColumn("site", site)
    moved = _log_odds(F.col("own")) + _log_odds(F.col("site")) - _log_odds(F.lit(mean))
    return (out.withColumn("score", 1 / (1 + F.exp(-moved)))
            .select("doc_id", "host", "path", "own", "site", "score", (F.col("score") >= KEEP_AT).alias("kept")))
