"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from conceptsearch.llm.license_scan import INCLUDED, RULES, SENTENCES, normalised
from conceptsearch.llm.secret_scan import BASE, RULES as SECRET_RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    kinds = []
    for k, r in enumerate(SECRET_RULES):
        p = _quoted(r.pattern)
        kinds.append(f"""
  SELECT doc_id, {k} AS k, '{r.kind}' AS kind, regexp_extract_all(t, {p}) AS m,
         regexp_extract_all(t, {p}, {r.group}) AS g, {r.least} AS least, string_split_regex(t, {p}) AS gaps
  FROM texts WHERE regexp_matches(t, {p})""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in BASE)
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE)
    listed = "string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k)"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
spans AS (
  SELECT doc_id, k, kind, length(g[i]) AS tested, least, length(m[i]) AS size,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
  FROM each),
listed AS (
  SELECT doc_id, {counts}, {listed} AS spans, {listed} FILTER (k < {len(BASE)}) AS base
  FROM spans WHERE tested >= least GROUP BY doc_id)
SELECT t.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN listed l ON t.doc_id = l.doc_id"""


_SUBSTRINGS = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM docs),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM starts)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (SELECT unnest(range(0, 20)) AS d)),
kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS kept, count(gone.i) AS n_removed
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

_HOST_RULES = f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
lines AS (
  SELECT doc_id, sum(n - 1) AS dup, sum(n) AS lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
starts AS (
  SELECT doc_id, i, w[i:i + 4] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM starts) WHERE n > 1),
inside AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (SELECT unnest(range(0, 5)) AS d) GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
         coalesce(lines, 0) AS lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN inside r ON d.doc_id = r.doc_id),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
failures AS (
  SELECT source, unnest([base_failed, n_symbols > 0.1 * word_chars, n_dup_lines > 0.3 * lines]) AS failed,
         unnest([1, 2, 3]) AS rule FROM judged),
hosts AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f FROM failures GROUP BY source, rule),
moments AS (
  SELECT rule, sum(n) AS n, count(*) AS hosts, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS sq FROM hosts GROUP BY rule),
spread AS (SELECT rule, m, m * (1 - m) AS s, sq - m * m - m * (1 - m) * hosts / n AS v FROM moments),
prior AS (SELECT rule, m, CASE WHEN v > 0 THEN least(greatest(s / v - 1, 1), 10000) ELSE 10000 END AS weight FROM spread),
bad AS (
  SELECT source, max((f + m * weight) / (n + weight)) > 0.5 AS rejected
  FROM hosts JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source"""


def _rule_pattern(sequence: tuple[str, ...]) -> str:
    """What finds a rule in ``,number,number,``."""
    numbers = [str(list(SENTENCES).index(s) + 1) for s in sequence]
    return f",{',([0-9]+,)*'.join(numbers)},"


def _licenses() -> str:
    """The reading by lines and the one that takes line ends as spaces."""
    known = ", ".join(_quoted(normalised(s)) for s in SENTENCES.values())
    rules = ", ".join(
        f"CASE WHEN regexp_matches(a, '{_rule_pattern(seq)}') OR regexp_matches(b, '{_rule_pattern(seq)}') THEN '{name}' END"
        for name, seq in RULES)
    dropped = " AND ".join(f"NOT (x = '{less}' AND list_contains(found, '{more}'))" for less, more in INCLUDED.items())

    def ids(text: str, ends: str) -> str:
        return f"""list_filter(list_transform(string_split_regex({text}, '{ends}'),
               lambda s: list_position(known, trim(s))), lambda k: k > 0)"""

    other = r"[^\p{L}\p{M}\p{N}\x01\n]+"
    paragraphs = "regexp_replace(t, '\\n *\\n', chr(1), 'g')"
    return f"""
WITH marked AS (
  SELECT doc_id, [{known}] AS known,
         regexp_replace(regexp_replace(lower(coalesce(text, '')), '[.!?;]+(\\s|$)', chr(1) || '\\1', 'g'), '{other}', ' ', 'g') AS t
  FROM documents),
read AS (
  SELECT doc_id, {ids("t", "[\\n\\x01]")} AS a,
         {ids(f"regexp_replace(replace({paragraphs}, chr(10), ' '), ' {{2,}}', ' ', 'g')", "\\x01")} AS b
  FROM marked),
coded AS (
  SELECT doc_id, len(a)::BIGINT AS sentences, ',' || array_to_string(a, ',') || ',' AS a,
         ',' || array_to_string(b, ',') || ',' AS b FROM read),
matched AS (
  SELECT doc_id, sentences, list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))) AS found FROM coded)
SELECT doc_id, sentences, coalesce(array_to_string(list_filter(found, lambda x: {dropped}), ','), '') AS licenses
FROM matched"""


_EQUAL_TEXTS = r"""
WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER own AS keep_id, count(*) OVER own AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM docs WINDOW own AS (PARTITION BY t)"""

_HARD_NEGATIVES = """
WITH own AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own_label, o.vec_id, o.label, list_inner_product(a.v, o.v)::BIGINT AS score
  FROM own a JOIN own o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
positive AS (
  SELECT anchor_id, own_label, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER own)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND s.label <> p.own_label
     AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW own AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER own <= 5"""

_COLLOCATIONS = r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.g, a, cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:cut] JOIN f r ON r.lang = c.lang AND r.g = c.g[cut + 1:c.k]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3] AS g, a FROM c WHERE k = 3) GROUP BY lang, g),
kept AS (
  SELECT o.*, array_to_string(o.g, ' ') AS phrase FROM lowest o LEFT JOIN longer s ON s.lang = o.lang AND s.g = o.g
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT k.lang, row_number() OVER own AS rank, phrase, a, l, r, n, score
FROM kept k JOIN totals t ON k.lang = t.lang
WINDOW own AS (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER own <= 2000"""

ORACLE = {
    "op1_secret_ledger": _secrets(),
    "op3_block_anchors": _SUBSTRINGS,
    "op7_host_rules": _HOST_RULES,
    "op8_sentence_rules": _licenses(),
    "op11_cuckoo_index": _EQUAL_TEXTS,
    "op12_hilbert_blocks": _HARD_NEGATIVES,
    "op13_suffix_quicksort": _COLLOCATIONS,
}
