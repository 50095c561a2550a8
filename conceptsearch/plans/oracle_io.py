"""Oracle SQL: sources and sinks (expected rows of each round trip)."""

from __future__ import annotations

from conceptsearch.plans import oracle_text, oracle_training  # noqa: F401  (shared CTEs)
from conceptsearch.plans.oracle import ORACLE, sql

WS = "[ \\t\\n\\r\\f]"

ORACLE["scan_corpus"] = sql("SELECT doc_id, title, contents FROM corpus_t", "corpus_t")
ORACLE["scan_queries"] = f"""SELECT CAST(item_id AS VARCHAR) AS qid,
    regexp_replace(regexp_replace(text, '[\\t\\n\\r]', ' ', 'g')
        || CASE WHEN item_id % 2 = 0 THEN ' (v2)' ELSE '' END, '^{WS}+|{WS}+$', '', 'g') AS query
    FROM benchmark"""
ORACLE["scan_qa_queries"] = sql(f"""SELECT query, arg_min(array_to_string(words, '|'), line) AS answers,
        CAST(len(arg_min(words, line)) AS BIGINT) AS n_answers FROM (
    SELECT CASE WHEN conv_id % 3 = 0 THEN 'say "this" ' || qc ELSE regexp_replace(qc, '^{WS}+', '', 'g') END AS query,
           words, [conv_id, turn] AS line FROM qa_clean) GROUP BY query""", "qa_clean")
ORACLE["scan_qrels"] = sql("""SELECT f.form, CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS pid,
        CAST(CASE WHEN pid % 5 = 0 THEN 0 ELSE rel END AS INTEGER) AS rel
    FROM qrels_g, (VALUES ('tab'), ('blank')) f(form)""", "qrels_g")
ORACLE["scan_run_lenient"] = sql("""SELECT CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS pid,
    CAST(rnk AS INTEGER) AS "rank", round(1.0 / rnk, 6) AS score FROM dense_run""", "dense_run")
ORACLE["scan_run_strict"] = sql("""SELECT CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS pid, score
    FROM run3""", "run3")
ORACLE["sink_run"] = sql("""SELECT CAST(qid AS VARCHAR) AS qid, CAST(pid AS VARCHAR) AS pid,
    CAST(rnk AS INTEGER) AS "rank", score FROM run3""", "run3")
ORACLE["scan_vector_shards"] = sql("""SELECT vec_id, CAST(len(v) AS BIGINT) AS dim,
    round(list_sum(v), 6) AS checksum FROM emb""", "emb")
ORACLE["sink_vector_shards"] = sql("""SELECT CAST(vec_id >= 250 AS BIGINT) AS worker,
        (vec_id - CASE WHEN vec_id >= 250 THEN 250 ELSE 0 END) // 97 AS shard, count(*) AS n_rows,
        round(sum(list_sum(v)), 4) AS checksum FROM emb GROUP BY 1, 2""", "emb")
ORACLE["scan_recon_vectors"] = ORACLE["sae_reconstruct"]
ORACLE["sink_recon_vectors"] = ORACLE["sae_reconstruct"]
ORACLE["scan_train_records"] = ORACLE["train_records"]
ORACLE["scan_passage_latents"] = sql("SELECT docid, latent, round(w, 6) AS w FROM lat_p", "lat_p")
ORACLE["sink_latents"] = ORACLE["scan_passage_latents"]
ORACLE["scan_query_latents"] = sql("SELECT qid, latent, round(weight, 6) AS weight FROM lat_q", "lat_q")
ORACLE["sink_metrics"] = ORACLE["macro_average"]
ORACLE["index_save_load"] = ORACLE["build_inverted_index"]
ORACLE["index_load_counts"] = sql("""SELECT 'vocabulary' AS metric, CAST(count(*) AS DOUBLE) AS value FROM terms
    UNION ALL SELECT 'postings', CAST(count(*) AS DOUBLE) FROM post
    UNION ALL SELECT 'documents', CAST(count(*) AS DOUBLE) FROM dstats
    UNION ALL SELECT 'empty_documents', CAST(count(*) FILTER (dl = 0) AS DOUBLE) FROM dstats
    UNION ALL SELECT 'avgdl', round(coalesce(avg(CAST(dl AS DOUBLE)), 0.0), 9) FROM dstats
    UNION ALL SELECT 'saved_documents', CAST(n AS DOUBLE) FROM istats
    UNION ALL SELECT 'saved_avgdl', round(avgdl, 9) FROM istats""", "terms", "post", "dstats", "istats")
ORACLE["index_load_tables"] = sql("""SELECT 'term' AS kind, latent AS id, df AS n, round(idf, 9) AS idf FROM terms
    UNION ALL SELECT 'document', docid, dl, CAST(NULL AS DOUBLE) FROM dstats""", "terms", "dstats")
ORACLE["sink_descriptions"] = ORACLE["describe_latents"]
