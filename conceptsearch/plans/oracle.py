"""Independent DuckDB SQL for every registered query.

The oracle re-derives everything from the base tables (``embeddings``,
``documents``, ``conversations``, ``events`` ...) with plain SQL: cross
products and list functions where Spark uses broadcast NumPy, window
functions where Spark uses array functions.  Fragments are named CTEs with
their dependencies; ``sql(body, *ctes)`` assembles a self-contained query.
"""

from __future__ import annotations

from conceptsearch.functions.scalar import BM25_B, BM25_K1, BM25_K2
from conceptsearch.plans.fixtures import (DENSE_K, DICTIONARY_SIZE, JUDGED_POOL, MAX_LATENTS,
                                          QUERY_EVERY, SPARSE_K, THETA)


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *deps: str) -> None:
    CTES[name] = (body, deps)


def cte_list(*names: str) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return [f"{n} AS ({CTES[n][0]})" for n in order]


def sql(body: str, *names: str, extra: list[str] | None = None) -> str:
    parts = cte_list(*names) + (extra or [])
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


CENTER = "list_transform(list_zip(x.v, mu_t.mu), lambda t: t[1] - t[2])"
H_Q = f"((ql.weight * {_d(BM25_K2 + 1.0)}) / (ql.weight + {_d(BM25_K2)}))"

cte("emb", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings")
cte("qv", f"SELECT vec_id AS qid, v, label FROM emb WHERE vec_id % {QUERY_EVERY} = 0", "emb")
cte("pv", f"SELECT vec_id AS docid, v, label FROM emb WHERE vec_id % {QUERY_EVERY} <> 0", "emb")
cte("dict", f"""SELECT l AS latent, list_transform(range(d.d), lambda i:
        (CAST(CAST(('0x' || substr(md5('w:' || l || ':' || i), 1, 8)) AS BIGINT) AS DOUBLE)
         / CAST(4294967296.0 AS DOUBLE) * 2.0 - 1.0) / sqrt(CAST(d.d AS DOUBLE))) AS w
        FROM range({DICTIONARY_SIZE}) t(l), (SELECT max(len(embedding)) AS d FROM embeddings) d""")
cte("mu_t", """SELECT list(m ORDER BY i) AS mu FROM (
        SELECT i, avg(x) AS m FROM (
            SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pv) GROUP BY i)""", "pv")
cte("pre_all", f"""SELECT x.vec_id, d.latent, list_dot_product({CENTER}, d.w) AS z
        FROM emb x, mu_t, dict d""", "emb", "mu_t", "dict")
cte("pre_p", f"""SELECT x.docid, d.latent, list_dot_product({CENTER}, d.w) AS z
        FROM pv x, mu_t, dict d""", "pv", "mu_t", "dict")
cte("pre_q", f"""SELECT x.qid, d.latent, list_dot_product({CENTER}, d.w) AS z
        FROM qv x, mu_t, dict d""", "qv", "mu_t", "dict")
cte("lat_p", f"SELECT docid, latent, z AS w FROM pre_p WHERE z > {_d(THETA)}", "pre_p")
cte("lat_q", f"SELECT qid, latent, z AS weight FROM pre_q WHERE z > {_d(THETA)}", "pre_q")
cte("post", f"""SELECT latent, docid, w AS tf FROM (
        SELECT *, row_number() OVER (PARTITION BY docid ORDER BY w DESC, latent) AS rn
        FROM lat_p) WHERE rn <= {MAX_LATENTS}""", "lat_p")
cte("dstats", """SELECT pv.docid, CAST(count(post.latent) AS BIGINT) AS dl
        FROM pv LEFT JOIN post ON pv.docid = post.docid GROUP BY pv.docid""", "pv", "post")
cte("istats", """SELECT CAST(count(*) AS BIGINT) AS n, coalesce(avg(CAST(dl AS DOUBLE)), 0.0) AS avgdl
        FROM dstats""", "dstats")
cte("terms", """SELECT latent, CAST(count(*) AS BIGINT) AS df,
        ln((CAST(istats.n AS DOUBLE) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
        FROM post, istats GROUP BY latent, istats.n""", "post", "istats")
cte("scored", f"""SELECT post.latent, post.docid, post.tf, dstats.dl, terms.idf,
        (post.tf * {_d(BM25_K1 + 1.0)}) / NULLIF(post.tf + {_d(BM25_K1)} * ({_d(1.0 - BM25_B)}
            + {_d(BM25_B)} * (CAST(dstats.dl AS DOUBLE) / NULLIF(istats.avgdl, 0))), 0) AS h_d
        FROM post JOIN dstats ON post.docid = dstats.docid
        JOIN terms ON post.latent = terms.latent, istats""", "post", "dstats", "terms", "istats")
cte("contrib", f"""SELECT ql.qid, s.docid, s.latent, s.idf * {H_Q} * s.h_d AS c
        FROM lat_q ql JOIN scored s ON ql.latent = s.latent""", "lat_q", "scored")
cte("scores", "SELECT qid, docid, sum(c) AS score FROM contrib GROUP BY qid, docid", "contrib")
cte("run", f"""SELECT qid, docid, rnk, score FROM (
        SELECT qid, docid, score,
               row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rnk
        FROM scores) WHERE rnk <= {SPARSE_K}""", "scores")
cte("dense_all", """SELECT q.qid, p.docid AS pid, list_dot_product(q.v, p.v) AS score
        FROM qv q, pv p""", "qv", "pv")
cte("pools", f"SELECT greatest(1, count(*) // {JUDGED_POOL}) AS n FROM pv", "pv")
POOL = "CAST('0x' || substr(md5('j:' || {}), 1, 8) AS BIGINT) % (SELECT n FROM pools)"
cte("qrels_g", f"""SELECT q.qid, p.docid AS pid, CAST(1 + p.docid % 3 AS INTEGER) AS rel FROM (
        SELECT qid, label FROM qv UNION ALL SELECT max(vec_id) + 1, 0 FROM emb) q
        JOIN pv p ON p.label = q.label AND {POOL.format("p.docid")} = {POOL.format("q.qid")}""", "emb", "qv", "pv", "pools")
cte("qrels_l", """SELECT q.qid, p.docid AS pid, CAST(1 + p.docid % 3 AS INTEGER) AS rel FROM (
        SELECT qid, label FROM qv UNION ALL SELECT max(vec_id) + 1, 0 FROM emb) q
        JOIN pv p ON p.label = q.label""", "emb", "qv", "pv")
cte("qrels_b", "SELECT qid, pid, 1 AS rel FROM qrels_g", "qrels_g")
cte("dense_run", f"""SELECT qid, pid, rnk, score FROM (
        SELECT qid, pid, score,
               row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rnk
        FROM dense_all) WHERE rnk <= {DENSE_K}""", "dense_all")
# the sparse run as the reference writes it: 3 decimals
cte("run3", "SELECT qid, docid AS pid, rnk, round(score, 3) AS score FROM run", "run")


def trec_ctes(run: str, qrels: str, ks, measures=("ndcg", "map", "recall"),
              scope: str = "inner", prefix: str = "") -> list[str]:
    """trec_eval measures in SQL (score as FLOAT desc, pid as text desc);
    the last CTE ``{prefix}perq`` holds ``(qid, metric, value)``."""
    k_max = max(ks)
    evalq_sql = (f"SELECT DISTINCT qid FROM {qrels}" if scope == "left" else
             f"SELECT DISTINCT qid FROM {qrels} WHERE qid IN (SELECT qid FROM {run})")
    ctes = [
        f"{prefix}evalq AS ({evalq_sql})",
        f"""{prefix}ranked AS (SELECT * FROM (
    SELECT r.qid, r.pid, row_number() OVER (PARTITION BY r.qid
        ORDER BY CAST(r.score AS FLOAT) DESC, CAST(r.pid AS VARCHAR) DESC) AS rk
    FROM {run} r WHERE r.qid IN (SELECT qid FROM {prefix}evalq)) WHERE rk <= {k_max})""",
        f"""{prefix}judged AS (SELECT {prefix}ranked.qid, {prefix}ranked.rk, coalesce(j.rel, 0) AS rel FROM {prefix}ranked
    LEFT JOIN {qrels} j ON j.qid = {prefix}ranked.qid AND j.pid = {prefix}ranked.pid)""",
        f"""{prefix}hits AS (SELECT *, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END)
    OVER (PARTITION BY qid ORDER BY rk) AS h FROM {prefix}judged)""",
        f"""{prefix}ideal AS (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS pos
    FROM {qrels} WHERE rel > 0)""",
        f"{prefix}nrel AS (SELECT qid, count(*) AS num_rel FROM {qrels} WHERE rel >= 1 GROUP BY qid)",
    ]
    parts = []
    for k in ks:
        if "ndcg" in measures:
            parts.append(f"""SELECT e.qid, 'NDCG@{k}' AS metric, coalesce(
    (SELECT sum(CASE WHEN rel > 0 THEN rel / log2(rk + 1) ELSE 0 END) FROM {prefix}judged
     WHERE {prefix}judged.qid = e.qid AND rk <= {k})
    / NULLIF((SELECT sum(rel / log2(pos + 1)) FROM {prefix}ideal WHERE {prefix}ideal.qid = e.qid AND pos <= {k}), 0),
    0.0) AS value FROM {prefix}evalq e""")
        if "map" in measures:
            parts.append(f"""SELECT e.qid, 'MAP@{k}' AS metric, coalesce(
    (SELECT sum(CASE WHEN rel >= 1 THEN h / rk ELSE 0 END) FROM {prefix}hits WHERE {prefix}hits.qid = e.qid AND rk <= {k})
    / NULLIF((SELECT num_rel FROM {prefix}nrel WHERE {prefix}nrel.qid = e.qid), 0), 0.0) AS value FROM {prefix}evalq e""")
        if "recall" in measures:
            parts.append(f"""SELECT e.qid, 'Recall@{k}' AS metric, coalesce(
    (SELECT CAST(count(*) AS DOUBLE) FROM {prefix}judged WHERE {prefix}judged.qid = e.qid AND rk <= {k} AND rel >= 1)
    / NULLIF((SELECT num_rel FROM {prefix}nrel WHERE {prefix}nrel.qid = e.qid), 0), 0.0) AS value FROM {prefix}evalq e""")
    ctes.append(f"{prefix}perq AS (" + "\nUNION ALL\n".join(parts) + ")")
    return ctes


def with_trec(run: str, qrels: str, ks, measures=("ndcg", "map", "recall"), scope="inner",
              final: str | None = None, deps=()) -> str:
    final = final or "SELECT metric, round(avg(value), 5) AS value FROM perq GROUP BY metric"
    return sql(final, *deps, extra=trec_ctes(run, qrels, ks, measures, scope))


def trec_avg(prefix: str) -> str:
    return f"SELECT metric, round(avg(value), 5) AS value FROM {prefix}perq GROUP BY metric"


ORACLE: dict[str, str] = {}

ORACLE["sae_pre_activation"] = sql("SELECT vec_id, latent, round(z, 6) AS z FROM pre_all", "pre_all")
ORACLE["sae_encode_threshold"] = sql(
    f"SELECT vec_id, latent, round(z, 6) AS w FROM pre_all WHERE z > {_d(THETA)}", "pre_all")
ORACLE["sae_encode_topk"] = sql("""SELECT vec_id, "rank", latent, round(z, 6) AS z FROM (
    SELECT vec_id, latent, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, latent) AS "rank"
    FROM pre_all) WHERE "rank" <= 8""", "pre_all")
ORACLE["sae_encode_bottomk"] = sql("""SELECT vec_id, "rank", latent, round(z, 6) AS z FROM (
    SELECT vec_id, latent, z, row_number() OVER (PARTITION BY vec_id ORDER BY z ASC, latent) AS "rank"
    FROM pre_all) WHERE "rank" <= 8""", "pre_all")
ORACLE["sae_encode_min_active"] = sql(f"""SELECT vec_id, latent, round(z, 6) AS w FROM (
    SELECT vec_id, latent, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, latent) AS rn
    FROM pre_all) WHERE z > {_d(THETA)} OR rn <= 8""", "pre_all")
ORACLE["sae_min_active_marks"] = sql(f"""SELECT vec_id, latent, z > {_d(THETA)} AS above,
    CASE WHEN z <= {_d(THETA)} THEN rn END AS rank FROM (
    SELECT vec_id, latent, z, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, latent) AS rn
    FROM pre_all) WHERE z > {_d(THETA)} OR rn <= 8""", "pre_all")
cte("dec", "SELECT latent, unnest(w) AS wd, generate_subscripts(w, 1) AS i FROM dict", "dict")
cte("bias_t", "SELECT unnest(mu) AS b, generate_subscripts(mu, 1) AS i FROM mu_t", "mu_t")
ORACLE["sae_reconstruct"] = sql(f"""SELECT e.vec_id, CAST(b.i - 1 AS BIGINT) AS dim,
    round(coalesce(c.s, 0.0) + b.b, 6) AS value
    FROM emb e CROSS JOIN bias_t b LEFT JOIN (
        SELECT k.vec_id, dec.i, sum(k.z * dec.wd) AS s
        FROM (SELECT vec_id, latent, z FROM pre_all WHERE z > {_d(THETA)}) k
        JOIN dec ON k.latent = dec.latent GROUP BY k.vec_id, dec.i) c
    ON c.vec_id = e.vec_id AND c.i = b.i""", "emb", "bias_t", "pre_all", "dec")
ORACLE["sae_min_active_recon"] = ORACLE["sae_reconstruct"]
ORACLE["truncate_latents"] = sql("""SELECT docid, "rank", latent, round(w, 6) AS w FROM (
    SELECT docid, latent, w, row_number() OVER (PARTITION BY docid ORDER BY w DESC, latent) AS "rank"
    FROM lat_p) WHERE "rank" <= 3""", "lat_p")
ORACLE["build_inverted_index"] = sql("""SELECT post.latent, post.docid, round(post.tf, 6) AS tf, dstats.dl
    FROM post JOIN dstats ON post.docid = dstats.docid""", "post", "dstats")
ORACLE["doc_stats"] = sql("SELECT docid, dl FROM dstats", "dstats")
ORACLE["index_stats"] = sql("SELECT n, round(avgdl, 9) AS avgdl FROM istats", "istats")
ORACLE["idf"] = sql("SELECT latent, df, round(idf, 9) AS idf FROM terms", "terms")
ORACLE["term_join"] = sql("""SELECT ql.qid, ql.latent, post.docid FROM lat_q ql
    JOIN post ON ql.latent = post.latent""", "lat_q", "post")
ORACLE["doclen_join"] = sql("""SELECT latent, docid, dl, round(idf, 9) AS idf, round(h_d, 9) AS h_d
    FROM scored""", "scored")
ORACLE["bm25_term"] = sql("SELECT qid, docid, latent, round(c, 6) AS c FROM contrib", "contrib")
ORACLE["bm25_accumulate"] = sql("SELECT qid, docid, round(score, 6) AS score FROM scores", "scores")
ORACLE["sparse_topk"] = sql("""SELECT qid, docid, rnk AS "rank", round(score, 6) AS score FROM run""",
                            "run")
ORACLE["ndcg_at_k"] = with_trec("run3", "qrels_l", (10, 100, 1000), ("ndcg",), deps=("run3", "qrels_l"))
ORACLE["recall_at_k"] = with_trec("run3", "qrels_l", (10, 100, 1000), ("recall",), deps=("run3", "qrels_l"))
ORACLE["map_at_k"] = with_trec("run3", "qrels_l", (10, 100, 1000), ("map",), deps=("run3", "qrels_l"))
ORACLE["mrr_trec"] = sql("""SELECT 'MRR@10' AS metric, round(coalesce(sum(rr) / greatest(count(*), 1), 0.0), 5) AS value
    FROM (SELECT e.qid, coalesce(1.0 / min(t.rk2) FILTER (WHERE j.rel >= 1), 0.0) AS rr
      FROM (SELECT DISTINCT qid FROM qrels_l WHERE qid IN (SELECT qid FROM run3)) e
      LEFT JOIN (SELECT qid, pid, row_number() OVER (PARTITION BY qid
                    ORDER BY CAST(score AS FLOAT) DESC, CAST(pid AS VARCHAR) DESC) AS rk2
                 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rnk) AS c
                       FROM run3) WHERE c <= 10) t ON t.qid = e.qid
      LEFT JOIN qrels_l j ON j.qid = t.qid AND j.pid = t.pid
      GROUP BY e.qid)""", "run3", "qrels_l")
ORACLE["mrr_msmarco"] = sql("""SELECT 'mrr' AS metric, round(coalesce(sum(1.0 / f), 0.0)
        / (SELECT count(DISTINCT qid) FROM qrels_l) * 100, 4) AS value
    FROM (SELECT r.qid, min(r.rnk) AS f FROM run3 r JOIN qrels_l j ON j.qid = r.qid AND j.pid = r.pid
          WHERE r.rnk <= 10 AND j.rel >= (SELECT CASE WHEN max(rel) >= 3 THEN 2 ELSE 1 END FROM qrels_l)
          GROUP BY r.qid)""", "run3", "qrels_l")
ORACLE["rel_threshold"] = sql("""SELECT 'graded' AS qrels, CAST(CASE WHEN max(rel) >= 3 THEN 2 ELSE 1 END AS INTEGER) AS threshold FROM qrels_g
    UNION ALL SELECT 'binary', CAST(CASE WHEN max(rel) >= 3 THEN 2 ELSE 1 END AS INTEGER) FROM qrels_b""",
                              "qrels_g", "qrels_b")
cte("dense_run_p", 'SELECT qid, pid, rnk, score FROM dense_run', "dense_run")
ORACLE["macro_average"] = with_trec("dense_run_p", "qrels_g", (10, 50, 100, 200, 1000),
                                    deps=("dense_run_p", "qrels_g"))
ORACLE["qrels_inner"] = with_trec("run3", "qrels_l", (10,), ("ndcg",), "inner",
                                  final="SELECT qid, round(value, 6) AS ndcg10 FROM perq",
                                  deps=("run3", "qrels_l"))
ORACLE["qrels_left"] = with_trec("run3", "qrels_l", (10,), ("ndcg",), "left",
                                 final="SELECT qid, round(value, 6) AS ndcg10 FROM perq",
                                 deps=("run3", "qrels_l"))
