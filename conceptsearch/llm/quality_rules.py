"""Host-level quality rules.

Every document is measured by rules on its words, lines and symbols.  Rule
failures are summed by host (the domain, here the source), each host's
failure rates are shrunk towards the corpus by a beta prior fitted to all
hosts, and hosts whose shrunk rate passes a limit are rejected with all their
documents.  Documents that fail a base rule are rejected on their own.

Defined cases: a null or empty text has no words and fails the base rules; a
null host is a host of its own; repeated rows count as often as they occur;
an empty table gives an empty result; other columns pass unchanged.

Scale: measuring is map-only; hosts are summed with map-side partial sums, so
a host with a third of all rows costs one row per task.  The host table joins
back as an ordinary equi-join that Spark may broadcast when it is small or
split when one host is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conceptsearch.llm import words as W
from conceptsearch.llm.tables import fresh, materialise, same, with_arrays

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Rules that count against a host, beside the base rules.
MAX_SYMBOL_SHARE = 0.1
MAX_DUP_LINE_SHARE = 0.3
#: A host is rejected when the shrunk rate of one rule is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
NEWLINE = 0x0A


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks keys that occur more than once, and those that occurred earlier."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    equal = ordered[1:] == ordered[:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][equal]] = True
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    return again, later


def _in_text(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of one text."""
    return W.mix(hashes ^ W.mix(owner.astype(np.uint64) + np.uint64(1)))


def measure_piece(t: W.Texts) -> np.ndarray:
    """The measures of each text: one row per text, columns as MEASURES."""
    n = len(t)
    out = np.zeros((n, len(MEASURES)), np.int64)
    if not len(t.data):
        return out
    separator = W.SEPARATOR[t.data]
    w = W.runs(t, ~separator)
    out[:, 0] = np.bincount(w.text, minlength=n)
    code_points = np.concatenate(([0], np.cumsum(~separator & ((t.data & 0xC0) != 0x80))))
    out[:, 1] = code_points[t.offsets[1:]] - code_points[t.offsets[:-1]]
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[t.data])))
    out[:, 2] = symbols[t.offsets[1:]] - symbols[t.offsets[:-1]]

    lines = W.runs(t, t.data != NEWLINE)
    before = np.concatenate(([0], np.cumsum(~separator)))
    has_word = before[lines.end] > before[lines.start]
    owner = lines.text[has_word]
    hashed = W.hash_spans(t.data, lines.start[has_word], lines.end[has_word])
    out[:, 5] = np.bincount(owner, minlength=n)
    out[:, 3] = np.bincount(owner[_repeats(_in_text(hashed, owner))[1]], minlength=n)

    word = W.hash_spans(t.data, w.start, w.end)
    whole = W.whole_windows(w.text, WINDOW)
    at = np.flatnonzero(whole)
    again = np.zeros(len(whole), bool)
    if len(at):
        window = W.window_hashes(word, WINDOW)[at]
        again[at] = _repeats(_in_text(window, w.text[at]))[0]
        inside = W.covered(again, WINDOW, len(word))
        out[:, 4] = np.bincount(w.text[inside], minlength=n)
    return out


def _measure(column: pa.Array) -> list[pa.Array]:
    parts = [measure_piece(piece) for _, piece in W.texts(column).pieces()]
    out = np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64)
    return [pa.array(out[:, k]) for k in range(len(MEASURES))]


def measures(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column for each measure, and the names they got."""
    names = dict(zip(MEASURES, fresh(df, *MEASURES), strict=True))
    return with_arrays(df, [text], dict.fromkeys(names.values(), "bigint"), _measure), names


def base_failed(names: dict[str, str]) -> Column:
    words = F.col(names["n_words"])
    return (words < MIN_WORDS) | (F.col(names["n_repeat_words"]) * 100 > words * MAX_REPEAT_PERCENT)


def _rules(names: dict[str, str]) -> dict[str, Column]:
    c = {k: F.col(v) for k, v in names.items()}
    return {
        "base": base_failed(names),
        "symbols": c["n_symbols"] > MAX_SYMBOL_SHARE * c["word_chars"],
        "dup_lines": c["n_dup_lines"] > MAX_DUP_LINE_SHARE * c["n_lines"],
    }


def host_rates(measured: DataFrame, names: dict[str, str], host: str) -> DataFrame:
    """host, n, the shrunk failure rate of each rule, rejected: a row a host."""
    rules = _rules(names)
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(rule.cast("long")).alias(f"f_{k}") for k, rule in rules.items()))
    hosts = materialise(hosts, "hosts")
    total = hosts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
        *(F.sum(f"f_{k}").alias(f"f_{k}") for k in rules),
        *(F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / F.col("n")).alias(f"s_{k}") for k in rules),
    ).first()
    rates = []
    for k in rules:
        mean, weight = _beta_prior(total["n"] or 0, total["hosts"], total[f"f_{k}"] or 0,
                                   total[f"s_{k}"] or 0.0)
        rates.append(((F.col(f"f_{k}") + mean * weight) / (F.col("n") + weight)).alias(f"rate_{k}"))
    out = hosts.select("host", "n", *rates)
    return out.withColumn("rejected", F.greatest(*(F.col(f"rate_{k}") for k in rules)) > MAX_HOST_RATE)


def _beta_prior(n: int, hosts: int, failed: int, squares: float) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior, by the moments of the
    hosts' rates; the part of their variance that is mere sampling is taken off."""
    if not n:
        return 0.0, PRIOR_WEIGHT[1]
    mean = failed / n
    spread = mean * (1 - mean)
    variance = squares / n - mean * mean - spread * hosts / n
    weight = spread / variance - 1 if variance > 0 else PRIOR_WEIGHT[1]
    return mean, min(max(weight, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])


def _judged(measured: DataFrame, names: dict[str, str], rates: DataFrame, host: str) -> tuple[DataFrame, dict[str, str]]:
    """Measured rows with ``base_failed`` and ``kept``, by the rates of their hosts."""
    rejected = rates.filter("rejected").select(F.col("host").alias("bad_host"))
    failed, kept, bad = fresh(measured, "base_failed", "kept", "bad_host")
    out = measured.join(rejected.withColumn(bad + "_hit", F.lit(True)).withColumnRenamed("bad_host", bad),
                        same(F.col(host), F.col(bad)), "left")
    out = out.withColumn(failed, base_failed(names))
    out = out.withColumn(kept, ~F.col(failed) & F.col(bad + "_hit").isNull()).drop(bad, bad + "_hit")
    return out, names | {"base_failed": failed, "kept": kept}


def verdicts(docs: DataFrame, text: str = "text", host: str = "source") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its measures, ``base_failed`` and ``kept``; and the names
    that these columns got.  Texts are measured for the hosts and for the
    rows, as neither pass moves or writes them."""
    counted, own = measures(docs.select(docs[host].alias("host"), docs[text].alias("text")))
    measured, names = measures(docs, text)
    return _judged(measured, names, host_rates(counted, own, "host"), host)


def slim_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source"
                  ) -> tuple[DataFrame, dict[str, str]]:
    """As ``verdicts``, of doc_id and host alone: measures are written without
    the texts, so these are read and measured once."""
    measured, names = measures(docs.select(doc_id, host, text), text)
    measured = materialise(measured.drop(text), "measures")
    return _judged(measured, names, host_rates(measured, names, host), host)


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that pass, with their columns unchanged."""
    out, names = verdicts(docs, text, host)
    return out.filter(F.col(names["kept"])).select(*(F.col(f"`{c}`") for c in docs.columns))
