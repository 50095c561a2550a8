"""Oracle SQL: dense ranking, run handling and training-set assembly."""

from __future__ import annotations

from conceptsearch.plans.fixtures import N_NEG, N_POS, THETA
from conceptsearch.plans.oracle import ORACLE, _d, cte, sql, trec_avg, trec_ctes

COS = ("list_dot_product(q.v, p.v) / (sqrt(list_dot_product(q.v, q.v)) "
       "* sqrt(list_dot_product(p.v, p.v)))")

cte("labeled", """SELECT d.qid, d.pid, d.rnk, d.score, (p.label = q.label) AS same
        FROM dense_run d JOIN qv q ON q.qid = d.qid JOIN pv p ON p.docid = d.pid""",
    "dense_run", "qv", "pv")
cte("tr_flat", f"""SELECT CAST(qid AS VARCHAR) AS query_id, CASE WHEN same THEN 0 ELSE 1 END AS kind,
        CAST(row_number() OVER (PARTITION BY qid, same ORDER BY rnk) - 1 AS BIGINT) AS pos,
        CAST(pid AS VARCHAR) AS doc_id, score
        FROM labeled
        QUALIFY pos < CASE WHEN same THEN {N_POS} ELSE {N_NEG} END""", "labeled")
cte("rec_lists", """SELECT query_id,
        list(doc_id ORDER BY pos) FILTER (WHERE kind = 0) AS pos_ids,
        list(score ORDER BY pos) FILTER (WHERE kind = 0) AS pos_scores,
        list(doc_id ORDER BY pos) FILTER (WHERE kind = 1) AS neg_ids,
        list(score ORDER BY pos) FILTER (WHERE kind = 1) AS neg_scores
        FROM tr_flat GROUP BY query_id""", "tr_flat")
cte("pairs4", "SELECT query_id, kind, pos, doc_id FROM tr_flat WHERE kind = 0 OR pos < 4", "tr_flat")
cte("corpus_t", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN ''
        ELSE source END AS title, text AS contents FROM documents""")
cte("qtext", "SELECT doc_id AS qid, text AS query FROM documents")
cte("cos_pairs", f"""SELECT a.query_id, a.doc_id, round({COS}, 5) AS score
        FROM pairs4 a JOIN qv q ON CAST(q.qid AS VARCHAR) = a.query_id
        JOIN pv p ON CAST(p.docid AS VARCHAR) = a.doc_id""", "pairs4", "qv", "pv")
cte("head_t", f"""SELECT d.qid, d.pid, round({COS}, 5) AS score FROM dense_run d
        JOIN qv q ON q.qid = d.qid JOIN pv p ON p.docid = d.pid WHERE d.rnk <= 20""",
    "dense_run", "qv", "pv")
cte("merged", """SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY part, score DESC, o, pid)
            AS rnk, score FROM (
        SELECT qid, pid, score, 0 AS part, 0 AS o FROM head_t
        UNION ALL
        SELECT d.qid, d.pid, h.last - (d.rnk - 20), 1, d.rnk FROM dense_run d
        JOIN (SELECT qid, min(score) AS last FROM head_t GROUP BY qid) h ON h.qid = d.qid
        WHERE d.rnk > 20)""", "head_t", "dense_run")
cte("groups_t", """SELECT query_id, 0 AS slot, pos_ids[(2 % len(pos_ids)) + 1] AS doc_id FROM rec_lists
        WHERE len(pos_ids) > 0 AND len(neg_ids) > 0
        UNION ALL
        SELECT query_id, i + 1, neg_ids[((6 + i) % len(neg_ids)) + 1] FROM rec_lists,
        range(0, 3) t(i) WHERE len(pos_ids) > 0 AND len(neg_ids) > 0""", "rec_lists")

ORACLE["dense_search"] = sql('SELECT qid, pid, rnk AS "rank", round(score, 6) AS score FROM dense_run',
                             "dense_run")
ORACLE["topk_merge"] = sql("""SELECT qid, pid, "rank", round(score, 6) AS score FROM (
    SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS "rank"
    FROM dense_all) WHERE "rank" <= 10""", "dense_all")
ORACLE["rank_all"] = sql("""SELECT qid, pid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid)
    AS "rank", round(score, 6) AS score FROM dense_all""", "dense_all")
ORACLE["dense_rank_on_save"] = sql("""SELECT qid, pid, row_number() OVER (PARTITION BY qid
    ORDER BY score DESC, pid) AS "rank" FROM dense_run""", "dense_run")
ORACLE["truncate_run"] = sql("""SELECT qid, pid, score FROM (SELECT *, row_number() OVER
    (PARTITION BY qid ORDER BY score DESC, rnk) AS c FROM run3) WHERE c <= 10""", "run3")
ORACLE["sort_queries"] = sql("""SELECT CAST(qid AS VARCHAR) AS qid_text,
    row_number() OVER (ORDER BY CAST(qid AS VARCHAR)) - 1 AS position FROM qv""", "qv")
ORACLE["rank_cut"] = sql('SELECT qid, pid, rnk AS "rank" FROM dense_run WHERE rnk <= 20', "dense_run")
ORACLE["reciprocal_rank_score"] = sql("SELECT qid, pid, round(1.0 / rnk, 6) AS rr FROM dense_run",
                                      "dense_run")
ORACLE["dot_product"] = sql("""SELECT j.qid, j.pid, round(list_dot_product(q.v, p.v), 6) AS score
    FROM qrels_l j JOIN qv q ON q.qid = j.qid JOIN pv p ON p.docid = j.pid""", "qrels_l", "qv", "pv")
ORACLE["l2_normalize"] = sql("""SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS dim,
    round(unnest(v) / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS value FROM emb""", "emb")
ORACLE["zip_unzip"] = sql("""SELECT docid, count(*) AS n,
    string_agg(CAST(latent AS VARCHAR), ',' ORDER BY latent) AS ids_text, round(sum(w), 6) AS w_sum
    FROM lat_p GROUP BY docid""", "lat_p")
ORACLE["rounding"] = sql("""SELECT qid, docid, round(score, 3) AS s3, round(score, 4) AS s4,
    round(score, 5) AS s5 FROM run""", "run")
ORACLE["parse_shard_name"] = sql("""SELECT vec_id, CAST(label AS BIGINT) AS worker,
    CAST(vec_id % 7 AS BIGINT) AS shard FROM emb""", "emb")
ORACLE["union_train_vectors"] = sql("""SELECT 'passage' AS kind, docid AS id, CAST(len(v) AS BIGINT) AS dim
    FROM pv UNION ALL SELECT 'query', qid, CAST(len(v) AS BIGINT) FROM qv""", "pv", "qv")
ORACLE["run_counts"] = sql("""SELECT 'run_queries' AS metric, CAST(count(DISTINCT qid) AS BIGINT) AS value FROM run3
    UNION ALL SELECT 'run_rows', count(*) FROM run3
    UNION ALL SELECT 'run_docs', count(DISTINCT pid) FROM run3
    UNION ALL SELECT 'qrels_queries', count(DISTINCT qid) FROM qrels_l
    UNION ALL SELECT 'judgements', count(*) FROM qrels_l""", "run3", "qrels_l")

cte("recon_v", f"""SELECT e.vec_id, list(coalesce(c.s, 0.0) + b.b ORDER BY b.i) AS v
        FROM emb e CROSS JOIN bias_t b LEFT JOIN (
            SELECT k.vec_id, dec.i, sum(k.z * dec.wd) AS s
            FROM (SELECT vec_id, latent, z FROM pre_all WHERE z > {_d(THETA)}) k
            JOIN dec ON k.latent = dec.latent GROUP BY k.vec_id, dec.i) c
        ON c.vec_id = e.vec_id AND c.i = b.i GROUP BY e.vec_id""", "emb", "bias_t", "pre_all", "dec")
cte("recon_run", """SELECT qid, pid, rnk, score FROM (
        SELECT q.vec_id AS qid, p.vec_id AS pid, list_dot_product(q.v, p.v) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, p.v) DESC,
                                  p.vec_id) AS rnk
        FROM recon_v q JOIN qv ON qv.qid = q.vec_id, recon_v p JOIN pv ON pv.docid = p.vec_id)
        WHERE rnk <= 50""", "recon_v", "qv", "pv")
cte("dense_run_p", "SELECT qid, pid, rnk, score FROM dense_run", "dense_run")
ORACLE["recon_vs_original"] = sql(
    """SELECT o.metric, o.value AS original, r.value AS reconstructed,
    round(r.value - o.value, 5) AS diff FROM (""" + trec_avg("o_") + ") o JOIN ("
    + trec_avg("r_") + ") r ON o.metric = r.metric",
    "dense_run_p", "recon_run", "qrels_g",
    extra=trec_ctes("dense_run_p", "qrels_g", (10, 50), ("ndcg", "recall"), prefix="o_")
    + trec_ctes("recon_run", "qrels_g", (10, 50), ("ndcg", "recall"), prefix="r_"))

ORACLE["train_records"] = sql("SELECT query_id, kind, pos, doc_id, round(score, 6) AS score FROM tr_flat",
                              "tr_flat")
ORACLE["neg_cap"] = sql("""SELECT query_id, kind, pos, doc_id, round(score, 6) AS score FROM tr_flat
    WHERE kind = 0 OR pos < 4""", "tr_flat")
ORACLE["pairs_union"] = sql("SELECT query_id, kind, pos, doc_id FROM pairs4", "pairs4")
ORACLE["first_positive_filter"] = sql("""SELECT query_id,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS BIGINT) AS pos, doc_id
    FROM (SELECT t.query_id, t.pos, t.doc_id FROM tr_flat t JOIN rec_lists r USING (query_id)
          WHERE t.kind = 0 AND (t.pos = 0 OR t.score >= r.pos_scores[1]
                OR coalesce(t.score > list_max(r.neg_scores), false)))""", "tr_flat", "rec_lists")
ORACLE["pair_score"] = sql("SELECT query_id, doc_id, score FROM cos_pairs", "cos_pairs")
ORACLE["rerank_tail_merge"] = sql('SELECT qid, pid, rnk AS "rank", round(score, 6) AS score FROM merged',
                                  "merged")
ORACLE["row_presence_guard"] = sql("""SELECT "check", CAST(violations AS BIGINT) AS violations FROM (
    SELECT 'positives_length' AS "check",
        CAST(count(*) FILTER (WHERE len(coalesce(pos_ids, [])) <> len(coalesce(pos_scores, []))) AS BIGINT)
        AS violations FROM rec_lists
    UNION ALL SELECT 'negatives_length', count(*) FILTER (WHERE len(coalesce(neg_ids, []))
        <> len(coalesce(neg_scores, []))) FROM rec_lists
    UNION ALL SELECT 'empty_negatives', count(*) FILTER (WHERE neg_ids IS NULL) FROM rec_lists
    UNION ALL SELECT 'duplicate_pid', coalesce(sum(c - 1), 0) FROM
        (SELECT count(*) AS c FROM merged GROUP BY qid, pid)
    UNION ALL SELECT 'missing_query', count(*) FROM qv
        WHERE CAST(qid AS VARCHAR) NOT IN (SELECT query_id FROM rec_lists))""",
                                   "rec_lists", "merged", "qv")
ORACLE["group_doc_ids"] = sql("SELECT query_id, CAST(slot AS BIGINT) AS slot, doc_id FROM groups_t",
                              "groups_t")
ORACLE["kd_label_join"] = sql("""SELECT g.query_id, CAST(g.slot AS BIGINT) AS slot, g.doc_id,
    round(t.score, 6) AS kd_label FROM groups_t g
    LEFT JOIN tr_flat t ON t.query_id = g.query_id AND t.doc_id = g.doc_id""", "groups_t", "tr_flat")
ORACLE["merge_teacher_scores"] = sql("""SELECT query_id, kind,
    CAST(row_number() OVER (PARTITION BY query_id, kind ORDER BY pos) - 1 AS BIGINT) AS pos,
    doc_id, round(score, 6) AS score FROM (
        SELECT a.query_id, a.kind, a.pos, a.doc_id, c.score FROM pairs4 a
        LEFT JOIN (SELECT * FROM cos_pairs WHERE CAST(doc_id AS BIGINT) % 5 <> 0) c
        ON c.query_id = a.query_id AND c.doc_id = a.doc_id
        WHERE a.kind = 0 OR c.score IS NOT NULL)""", "pairs4", "cos_pairs")
ORACLE["readable_export"] = sql("""SELECT t.query_id, t.kind, t.pos, t.doc_id,
    coalesce(c.title, '') AS title, c.contents, round(t.score, 6) AS score
    FROM tr_flat t LEFT JOIN corpus_t c ON CAST(c.doc_id AS VARCHAR) = t.doc_id WHERE t.pos < 5""",
                                "tr_flat", "corpus_t")
ORACLE["hard_subset"] = sql("""SELECT qid, pos, "rank" FROM (
    SELECT query_id AS qid, CAST(kind * 100 + pos AS BIGINT) AS pos,
        row_number() OVER (PARTITION BY query_id ORDER BY
            CASE WHEN kind * 100 + pos = 0 THEN 'infinity'::DOUBLE ELSE score END DESC,
            kind * 100 + pos) AS "rank"
    FROM tr_flat) WHERE "rank" <= 7""", "tr_flat")
ORACLE["merge_worker_runs"] = sql("""SELECT qid, pid, rnk AS "rank", 1 AS worker FROM dense_run
        WHERE qid % 50 = 0 AND rnk <= 10
    UNION ALL SELECT qid, pid, rnk, 0 FROM dense_run WHERE qid % 50 <> 0""", "dense_run")
ORACLE["dedupe_first"] = """SELECT d.doc_id, d.n_chars FROM documents d
    JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) f ON f.doc_id = d.doc_id"""
ORACLE["holdout_split"] = """SELECT doc_id, CASE WHEN row_number() OVER
    (ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id) <= 100 THEN 'eval' ELSE 'train' END AS split
    FROM documents"""
ORACLE["unpack_groups"] = sql("""SELECT query_id, CAST(slot AS BIGINT) AS slot, doc_id,
    CAST((CAST(query_id AS BIGINT) // 25) * 4 + slot AS BIGINT) AS flat_index FROM groups_t""",
                              "groups_t")
ORACLE["doc_input_text"] = sql("""SELECT doc_id, CASE WHEN length(coalesce(title, '')) > 0
    THEN title || ': ' || contents ELSE contents END AS input_text FROM corpus_t""", "corpus_t")
ORACLE["query_doc_pairs"] = sql("""SELECT a.query_id, a.doc_id, q.query,
    CASE WHEN length(coalesce(c.title, '')) > 0 THEN c.title || ': ' || c.contents ELSE c.contents END
        AS passage
    FROM pairs4 a LEFT JOIN corpus_t c ON CAST(c.doc_id AS VARCHAR) = a.doc_id
    LEFT JOIN qtext q ON CAST(q.qid AS VARCHAR) = a.query_id""", "pairs4", "corpus_t", "qtext")
ORACLE["truncate_tokens"] = """SELECT doc_id, CAST(len(string_split(text, ' ')[1:32]) AS BIGINT) AS n_kept,
    array_to_string(string_split(text, ' ')[1:32], ' ') AS text_kept FROM documents"""
ORACLE["limit_ordered"] = "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100"
ORACLE["contiguous_shard"] = """WITH n AS (SELECT count(*) AS n, count(*) // 7 AS dv, count(*) % 7 AS md
        FROM documents)
    SELECT doc_id, CAST(CASE WHEN doc_id < md * (dv + 1) THEN doc_id // (dv + 1)
        ELSE md + (doc_id - md * (dv + 1)) // greatest(dv, 1) END AS BIGINT) AS shard
    FROM documents, n"""
ORACLE["join_corpus"] = sql("""SELECT a.query_id, a.kind, a.pos, a.doc_id, c.title,
    CAST(length(c.contents) AS BIGINT) AS n_chars
    FROM pairs4 a LEFT JOIN corpus_t c ON CAST(c.doc_id AS VARCHAR) = a.doc_id""", "pairs4", "corpus_t")
ORACLE["join_query_text"] = sql("""SELECT a.query_id, a.doc_id, CAST(length(q.query) AS BIGINT) AS query_len
    FROM pairs4 a LEFT JOIN qtext q ON CAST(q.qid AS VARCHAR) = a.query_id""", "pairs4", "qtext")
