"""Oracle SQL: token masking, text encoders, QA text, descriptions, losses."""

from __future__ import annotations

from conceptsearch.plans import oracle_training  # noqa: F401  (defines shared CTEs)
from conceptsearch.plans.oracle import ORACLE, cte, sql
from conceptsearch.plans.queries_text import (DEC_PROB, EMBED_DIM, ENC_PROB, KD_CE_WEIGHT,
                                              MLM_PROB, PROMPT_DOCS, TEMPERATURE, TOP_DOCS,
                                              WARMUP_STEPS, WORKERS)

WS = "[ \\t\\n\\r\\f]"
HEX8 = "CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

cte("tok_words", f"""SELECT doc_id, list_filter(string_split_regex(text, '{WS}+'), lambda w: length(w) > 0)
        AS words FROM documents""")
cte("tokens", """SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token FROM (
        SELECT doc_id, list_concat(['[CLS]'], list_transform(words, lambda w, i:
            CASE WHEN (i - 1) % 5 = 4 THEN '##' || w ELSE w END), ['[SEP]']) AS t FROM tok_words)""",
    "tok_words")


def wwm_ctes(p: str, prob: float, seed: int) -> list[str]:
    """Whole-word mask CTEs with prefix ``p``; ``{p}mask`` is the result."""
    return [
        f"""{p}tk AS (SELECT doc_id, pos, token, token IN ('[CLS]', '[SEP]') AS special FROM tokens)""",
        f"""{p}fns AS (SELECT doc_id, min(pos) FILTER (WHERE NOT special) AS first_ns, count(*) AS n
            FROM {p}tk GROUP BY doc_id)""",
        f"""{p}st AS (SELECT t.doc_id, t.pos, t.token, t.special, CAST(sum(CASE WHEN NOT t.special AND
            (NOT starts_with(t.token, '##') OR t.pos = f.first_ns) THEN 1 ELSE 0 END) OVER (
            PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS word FROM {p}tk t JOIN {p}fns f ON f.doc_id = t.doc_id)""",
        f"""{p}words AS (SELECT doc_id, word, min(pos) AS start, CAST(count(*) AS BIGINT) AS len
            FROM {p}st WHERE NOT special AND word > 0 GROUP BY doc_id, word)""",
        f"""{p}per AS (SELECT w.doc_id,
            greatest(1, CAST(round_even(f.n * CAST({prob!r} AS DOUBLE), 0) AS BIGINT)) AS target,
            list({{'word': w.word, 'len': w.len}}
                 ORDER BY md5('{seed}:' || w.doc_id || ':' || w.start), w.word) AS ws
            FROM {p}words w JOIN {p}fns f ON f.doc_id = w.doc_id GROUP BY w.doc_id, f.n)""",
        f"""{p}chosen AS (SELECT doc_id, unnest(list_reduce(ws, lambda acc, x:
            CASE WHEN acc.t < target AND acc.t + x.len <= target
                 THEN {{'t': acc.t + x.len, 'c': list_append(acc.c, x.word)}} ELSE acc END,
            {{'t': CAST(0 AS BIGINT), 'c': []::BIGINT[]}}).c) AS word FROM {p}per)""",
        f"""{p}mask AS (SELECT s.doc_id, s.pos, s.token, CASE WHEN s.special THEN 0
            WHEN c.word IS NOT NULL THEN 1 ELSE 0 END AS masked
            FROM {p}st s LEFT JOIN {p}chosen c ON c.doc_id = s.doc_id AND c.word = s.word)""",
    ]


EXTRA = (DEC_PROB - ENC_PROB) / (1.0 - ENC_PROB)
MT = [f"""mt AS (SELECT m.doc_id, m.pos, m.token, m.masked,
        CAST({HEX8.format(x="'42:r:' || m.doc_id || ':' || m.pos")} AS DOUBLE) / 4294967296.0 AS u_r,
        CAST({HEX8.format(x="'42:x:' || m.doc_id || ':' || m.pos")} AS DOUBLE) / 4294967296.0 AS u_x,
        {HEX8.format(x="'42:p:' || m.doc_id || ':' || m.pos")} % f.n AS pick
        FROM w1_mask m JOIN w1_fns f ON f.doc_id = m.doc_id)""",
      """mt2 AS (SELECT mt.doc_id, mt.pos, mt.token, mt.masked,
        CASE WHEN mt.masked = 1 AND mt.u_r < 0.8 THEN '[MASK]'
             WHEN mt.masked = 1 AND mt.u_x < 0.5 THEN r.token ELSE mt.token END AS input_token,
        CASE WHEN mt.masked = 1 THEN mt.token END AS label
        FROM mt LEFT JOIN tokens r ON r.doc_id = mt.doc_id AND r.pos = mt.pick)"""]

ORACLE["whole_word_mask"] = sql("SELECT doc_id, pos, token FROM w1_mask WHERE masked = 1", "tokens",
                                extra=wwm_ctes("w1_", MLM_PROB, 42))
ORACLE["mask_tokens"] = sql("SELECT doc_id, pos, input_token, label FROM mt2 WHERE label IS NOT NULL",
                            "tokens", extra=wwm_ctes("w1_", MLM_PROB, 42) + MT)
ORACLE["replace_ratio"] = sql("""SELECT CAST(count(*) FILTER (WHERE label IS NOT NULL AND input_token <> token)
        AS BIGINT) AS replaced, count(*) AS attended,
        round(count(*) FILTER (WHERE label IS NOT NULL AND input_token <> token) / count(*), 9) AS ratio
    FROM mt2""", "tokens", extra=wwm_ctes("w1_", MLM_PROB, 42) + MT)
ORACLE["dual_mask"] = sql("""SELECT e.doc_id, e.pos, e.masked AS enc_masked,
        greatest(e.masked, d.masked) AS dec_masked
    FROM e_mask e JOIN d_mask d ON d.doc_id = e.doc_id AND d.pos = e.pos
    WHERE greatest(e.masked, d.masked) = 1""", "tokens",
                          extra=wwm_ctes("e_", ENC_PROB, 42) + wwm_ctes("d_", EXTRA, 43))

cte("vocab", """SELECT row_number() OVER (ORDER BY token) - 1 AS token_id, token, n
        FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token)""", "tokens")


def replaced(p: str, mask: str, seed: int) -> list[str]:
    """Masked tokens with replacements from the vocabulary; ``{p}out`` is the result."""
    def u(tag: str) -> str:
        return f"""CAST({HEX8.format(x=f"'{seed}:{tag}:' || doc_id || ':' || pos")} AS DOUBLE) / 4294967296.0"""

    return [f"""{p}dr AS (SELECT doc_id, pos, token, masked, {u("r")} AS u_r, {u("x")} AS u_x,
        CAST('0x' || substr(md5('{seed}:p:' || doc_id || ':' || pos), 1, 15) AS BIGINT)
            % (SELECT count(*) FROM vocab) AS pick FROM {mask})""",
            f"""{p}out AS (SELECT d.doc_id, d.pos, d.token,
        CASE WHEN d.masked = 1 AND d.u_r < 0.8 THEN '[MASK]'
             WHEN d.masked = 1 AND d.u_x < 0.5 THEN v.token ELSE d.token END AS input_token,
        CASE WHEN d.masked = 1 THEN d.token END AS label
        FROM {p}dr d LEFT JOIN vocab v ON v.token_id = d.pick)"""]


ORACLE["vocabulary"] = sql("SELECT token_id, token, n FROM vocab", "vocab")
ORACLE["mask_tokens_vocabulary"] = sql(
    "SELECT doc_id, pos, input_token, label FROM v_out WHERE label IS NOT NULL", "vocab",
    extra=wwm_ctes("w1_", MLM_PROB, 42) + replaced("v_", "w1_mask", 42))
ORACLE["dual_mask_inputs"] = sql("""SELECT e.doc_id, e.pos, e.input_token AS enc_inputs, e.label AS enc_labels,
        d.input_token AS dec_inputs, d.label AS dec_labels,
        CASE WHEN e.token NOT IN ('[CLS]', '[SEP]', '[MASK]') THEN e.token END AS labels
    FROM ei_out e JOIN di_out d ON d.doc_id = e.doc_id AND d.pos = e.pos
    WHERE d.label IS NOT NULL OR e.token IN ('[CLS]', '[SEP]', '[MASK]')""", "vocab",
                                 extra=wwm_ctes("e_", ENC_PROB, 42) + wwm_ctes("d_", EXTRA, 43) + [
    """both_mask AS (SELECT e.doc_id, e.pos, e.token, greatest(e.masked, d.masked) AS masked
        FROM e_mask e JOIN d_mask d ON d.doc_id = e.doc_id AND d.pos = e.pos)""",
    *replaced("ei_", "e_mask", 42), *replaced("di_", "both_mask", 43)])

SIGN = ("CASE WHEN CAST(('0x' || substr(md5({x}), 9, 1)) AS INTEGER) % 2 = 0 "
        "THEN CAST(1.0 AS DOUBLE) ELSE CAST(-1.0 AS DOUBLE) END")
ORACLE["embed_batch"] = sql(f"""SELECT d.doc_id, CAST(r.dim AS BIGINT) AS dim,
        round(coalesce(s.v / n.n, 0.0), 9) AS value
    FROM documents d CROSS JOIN range({EMBED_DIM}) r(dim)
    LEFT JOIN (SELECT doc_id, {HEX8.format(x="tok")} % {EMBED_DIM} AS dim, sum({SIGN.format(x="tok")}) AS v
               FROM (SELECT doc_id, unnest(words) AS tok FROM tok_words) GROUP BY ALL) s
        ON s.doc_id = d.doc_id AND s.dim = r.dim
    LEFT JOIN (SELECT doc_id, len(words) AS n FROM tok_words) n ON n.doc_id = d.doc_id""", "tok_words")
ORACLE["pool_mean"] = sql(f"""SELECT n.doc_id, r.dim, round(coalesce(s.v, 0) / n.n, 9) AS value
    FROM (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) n CROSS JOIN range({EMBED_DIM}) r(dim)
    LEFT JOIN (SELECT doc_id, {HEX8.format(x="token")} % {EMBED_DIM} AS dim, sum({SIGN.format(x="token")}) AS v
               FROM tokens GROUP BY ALL) s ON s.doc_id = n.doc_id AND s.dim = r.dim""", "tokens")
ORACLE["pool_first"] = sql(f"""SELECT t.doc_id, r.dim, CASE WHEN {HEX8.format(x="t.token")} % {EMBED_DIM} = r.dim
        THEN {SIGN.format(x="t.token")} ELSE 0.0 END::DOUBLE AS value
    FROM tokens t CROSS JOIN range({EMBED_DIM}) r(dim) WHERE pos = 0""", "tokens")

cte("qa_turns", """SELECT q.conv_id, q.turn, q.text AS q, a.text AS a FROM conversations q LEFT JOIN conversations a
        ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""")
cte("qa_clean", f"""SELECT conv_id, turn, regexp_replace(coalesce(q, ''), '[\\t\\n\\r"]', ' ', 'g') AS qc,
        list_filter(string_split_regex(regexp_replace(coalesce(a, ''), '[''"\\\\]', '', 'g'), '{WS}+'),
                    lambda w: length(w) > 0) AS words FROM qa_turns""", "qa_turns")
ORACLE["normalize_qa_text"] = sql("""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'say "this" ' || qc
    ELSE qc END AS question FROM qa_clean""", "qa_clean")
ORACLE["parse_answer_list"] = sql("""SELECT conv_id, turn, array_to_string(words, '|') AS answers,
    CAST(len(words) AS BIGINT) AS n_answers FROM qa_clean""", "qa_clean")
ORACLE["parse_interpretation"] = f"""SELECT conv_id, turn, regexp_replace(string_split(
        CASE WHEN turn % 2 = 0 THEN text || chr(10) || '[interpretation]:  ' || role || ' ' ELSE text END,
        '[interpretation]:')[-1], '^{WS}+|{WS}+$', '', 'g') AS interp FROM conversations"""

ORACLE["latent_postings"] = sql("SELECT latent, docid, round(w, 6) AS act FROM lat_p", "lat_p")
cte("top_lat", """SELECT latent, docid, w, row_number() OVER (PARTITION BY latent ORDER BY w DESC, docid)
        AS "rank" FROM lat_p""", "lat_p")
ORACLE["top_docs_per_latent"] = sql(f"""SELECT latent, docid, "rank", round(w, 6) AS act FROM top_lat
    WHERE "rank" <= {TOP_DOCS}""", "top_lat")
cte("prompts", f"""SELECT t.latent, string_agg('Example' || (t."rank" - 1) || ': ' || coalesce(c.contents, '')
        || chr(10) || 'Activation: ' || CAST(round(t.w, 6) AS VARCHAR) || chr(10), '' ORDER BY t."rank")
        AS prompt FROM top_lat t LEFT JOIN corpus_t c ON c.doc_id = t.docid
        WHERE t."rank" <= {PROMPT_DOCS} GROUP BY t.latent""", "top_lat", "corpus_t")
ORACLE["prompt_text"] = sql("SELECT latent, prompt FROM prompts", "prompts")
ORACLE["describe_latents"] = sql("SELECT latent, 'topic-' || latent AS interp FROM prompts", "prompts")

# exact: sums in cents, half-up rounding to millionths in integer arithmetic
ORACLE["running_mean"] = """SELECT epoch, step,
        sign(s) * ((2 * abs(s) * 10000 + w) // (2 * w)) / 1000000.0 AS running_mean FROM (
    SELECT epoch, step, sum(cents * n) OVER win AS s, sum(n) OVER win AS w
    FROM (SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS epoch, event_id AS step,
                 CAST(round(value * 100) AS BIGINT) AS cents, 1 + user_id % 3 AS n FROM events)
    WINDOW win AS (PARTITION BY epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

# four queries a batch; row and key numbers start anew in each
cte("st_rows", """SELECT q.qid // 100 AS batch_id, (q.qid // 25) % 4 AS row_id, q.v FROM qv q
        WHERE CAST(q.qid AS VARCHAR) IN (SELECT query_id FROM groups_t)""", "qv", "groups_t")
cte("st_keys", """SELECT CAST(g.query_id AS BIGINT) // 100 AS batch_id,
        ((CAST(g.query_id AS BIGINT) // 25) % 4) * 4 + g.slot AS key_id,
        (CAST(g.query_id AS BIGINT) // 25) % 4 AS row_id,
        g.slot, p.v FROM groups_t g JOIN pv p ON CAST(p.docid AS VARCHAR) = g.doc_id""", "groups_t", "pv")
cte("st_qk", """SELECT r.batch_id, r.row_id, k.key_id AS col, list_dot_product(r.v, k.v) AS score,
        t.key_id AS target FROM st_rows r JOIN st_keys k ON k.batch_id = r.batch_id
        JOIN st_keys t ON t.batch_id = r.batch_id AND t.row_id = r.row_id AND t.slot = 0""", "st_rows", "st_keys")
cte("st_all", """SELECT batch_id, row_id, col, score, target FROM st_qk
        UNION ALL SELECT a.batch_id, a.row_id, 1000000000 + b.row_id, list_dot_product(a.v, b.v), a.key_id
            FROM st_keys a JOIN st_rows b ON b.batch_id = a.batch_id AND b.row_id <> a.row_id WHERE a.slot = 0
        UNION ALL SELECT a.batch_id, a.row_id, 2000000000 + b.row_id, list_dot_product(a.v, b.v), t.key_id
            FROM st_rows a JOIN st_rows b ON b.batch_id = a.batch_id AND b.row_id <> a.row_id
            JOIN st_keys t ON t.batch_id = a.batch_id AND t.row_id = a.row_id AND t.slot = 0
        UNION ALL SELECT a.batch_id, a.row_id, 3000000000 + b.row_id, list_dot_product(a.v, b.v), a.key_id
            FROM st_keys a JOIN st_keys b ON b.batch_id = a.batch_id AND b.row_id <> a.row_id
            AND b.slot = 0 WHERE a.slot = 0""", "st_qk", "st_keys", "st_rows")
cte("st_rank", """SELECT col, target, row_number() OVER (PARTITION BY batch_id, row_id
        ORDER BY score DESC, col) AS rk FROM st_qk""", "st_qk")
ORACLE["accuracy_at_k"] = sql("""SELECT 'acc1' AS metric, round(avg(CASE WHEN rk <= 1 THEN 1.0 ELSE 0.0 END) * 100, 6)
        AS value FROM st_rank WHERE col = target
    UNION ALL SELECT 'acc3', round(avg(CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END) * 100, 6)
        FROM st_rank WHERE col = target""", "st_rank")
ORACLE["batch_mrr"] = sql("""SELECT 'mrr' AS metric, round(avg(100.0 / rk), 6) AS value FROM st_rank
    WHERE col = target""", "st_rank")


def log_softmax_at_target(table: str, scale: str, where: str = "true") -> str:
    return f"""SELECT batch_id, scale, z - m - ln(sum_exp) AS lp FROM (
        SELECT *, sum(exp(z - m)) OVER (PARTITION BY batch_id, row_id) AS sum_exp FROM (
            SELECT *, max(z) OVER (PARTITION BY batch_id, row_id) AS m FROM (
                SELECT *, {scale} AS scale, score * {scale} AS z FROM {table} WHERE {where})))
    WHERE col = target"""


ORACLE["contrastive_loss"] = sql(
    f"SELECT round(-avg(lp), 9) AS loss FROM ({log_softmax_at_target('st_qk', repr(1 / TEMPERATURE))})", "st_qk")
ORACLE["contrastive_loss_all_pairs"] = sql(
    f"SELECT round(-avg(lp), 9) AS loss FROM ({log_softmax_at_target('st_all', repr(1 / TEMPERATURE))})", "st_all")
WARM = (f"greatest(CAST(1.0 AS DOUBLE), CAST({1 / TEMPERATURE!r} AS DOUBLE) "
        f"* least(CAST(1.0 AS DOUBLE), batch_id / CAST({WARMUP_STEPS} AS DOUBLE)))")
ORACLE["contrastive_loss_steps"] = sql(
    f"""SELECT batch_id, batch_id AS step, round(any_value(scale), 9) AS scale, round(-avg(lp) * {WORKERS}, 9) AS loss
    FROM ({log_softmax_at_target('st_all', WARM)}) GROUP BY batch_id""", "st_all")

COS = ("list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) "
       "* sqrt(list_dot_product(p.v, p.v)))")
cte("kd_t", f"""SELECT g.query_id, g.slot, t.score AS teacher, round({COS}, 5) AS student
        FROM groups_t g JOIN tr_flat t ON t.query_id = g.query_id AND t.doc_id = g.doc_id
        JOIN qv q ON CAST(q.qid AS VARCHAR) = g.query_id
        JOIN pv p ON CAST(p.docid AS VARCHAR) = g.doc_id""", "groups_t", "tr_flat", "qv", "pv")
cte("kd_lsm", """SELECT query_id, slot, teacher, student,
        teacher - max(teacher) OVER g - ln(sum(exp(teacher - mt)) OVER g) AS t,
        student - max(student) OVER g - ln(sum(exp(student - ms)) OVER g) AS s
        FROM (SELECT *, max(teacher) OVER (PARTITION BY query_id) AS mt,
                        max(student) OVER (PARTITION BY query_id) AS ms FROM kd_t)
        WINDOW g AS (PARTITION BY query_id)""", "kd_t")
cte("kdb_own", f"""SELECT q.batch_id, q.row_id, q.col % 4 AS slot, q.score / {TEMPERATURE!r} AS student, t.score AS teacher
        FROM st_qk q JOIN groups_t g ON CAST(g.query_id AS BIGINT) // 25 = q.batch_id * 4 + q.row_id AND g.slot = q.col % 4
        JOIN tr_flat t ON t.query_id = g.query_id AND t.doc_id = g.doc_id
        WHERE q.col // 4 = q.row_id""", "st_qk", "groups_t", "tr_flat")
KDB_KL = """kl_t AS (
        SELECT avg(kl) AS kl FROM (SELECT batch_id, row_id, sum(exp(t) * (t - s)) AS kl FROM (
            SELECT batch_id, row_id,
                teacher - max(teacher) OVER g - ln(sum(exp(teacher - mt)) OVER g) AS t,
                student - max(student) OVER g - ln(sum(exp(student - ms)) OVER g) AS s
            FROM (SELECT *, max(teacher) OVER (PARTITION BY batch_id, row_id) AS mt,
                            max(student) OVER (PARTITION BY batch_id, row_id) AS ms FROM kdb_own)
            WINDOW g AS (PARTITION BY batch_id, row_id)) GROUP BY batch_id, row_id))"""
KDB_CE = "ce_t AS (SELECT -avg(lp) AS ce FROM (" + log_softmax_at_target(
    "st_qk", repr(1 / TEMPERATURE), "NOT (col // 4 = row_id AND col % 4 > 0)") + "))"
ORACLE["kd_kl_loss"] = sql(f"""SELECT round(kl, 9) AS kl, round(ce, 9) AS ce,
    round({KD_CE_WEIGHT!r} * ce + kl, 9) AS loss FROM kl_t, ce_t""", "kdb_own", "st_qk",
                           extra=[KDB_KL, KDB_CE])
ORACLE["rdrop_loss"] = sql("""SELECT round(avg(kl) / 2, 9) AS kl, round(avg(ce), 9) AS ce,
        round(avg(kl) / 2 + avg(ce), 9) AS loss FROM (
    SELECT query_id, sum(exp(t) * (t - s) + exp(s) * (s - t)) AS kl,
           sum(CASE WHEN slot = 0 THEN -(t + s) / 2 END) AS ce
    FROM kd_lsm GROUP BY query_id)""", "kd_lsm")
ORACLE["log_softmax"] = sql("SELECT query_id, CAST(slot AS BIGINT) AS slot, round(t, 9) AS lp FROM kd_lsm",
                            "kd_lsm")
ORACLE["eval_means"] = sql("""SELECT round(avg(teacher), 4) AS avg_kd_label, round(avg(student), 4) AS avg_student
    FROM kd_t""", "kd_t")
