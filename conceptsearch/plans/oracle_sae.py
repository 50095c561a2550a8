"""Oracle SQL: autoencoder training-time operators."""

from __future__ import annotations

from conceptsearch.plans.fixtures import THETA
from conceptsearch.plans.oracle import CENTER, ORACLE, _d, cte, sql
from conceptsearch.plans.queries_sae import BATCH_K, BATCH_ROWS, DEAD_AFTER, GRADIENT_STEP, PURSUIT_ROUNDS

cte("bt_pre", f"SELECT docid // {BATCH_ROWS} AS batch_id, docid, latent, z FROM pre_p", "pre_p")
cte("bt_kept", f"""SELECT batch_id, docid, latent, z FROM (
        SELECT p.*, row_number() OVER (PARTITION BY p.batch_id ORDER BY z DESC, docid, latent) AS rn, n.b
        FROM bt_pre p JOIN (SELECT batch_id, count(DISTINCT docid) AS b FROM bt_pre GROUP BY batch_id) n
        USING (batch_id)) WHERE rn <= {BATCH_K} * b""", "bt_pre")
cte("dead_t", """SELECT d.latent, CAST(CASE WHEN f.last IS NULL THEN nb.n ELSE nb.n - 1 - f.last END AS BIGINT)
        AS since_fired FROM dict d
        LEFT JOIN (SELECT latent, max(batch_id) AS last FROM bt_kept GROUP BY latent) f ON f.latent = d.latent,
        (SELECT max(batch_id) + 1 AS n FROM bt_kept) nb""", "dict", "bt_kept")
cte("aux_t", f"""SELECT docid, latent, z FROM (
        SELECT p.*, row_number() OVER (PARTITION BY docid ORDER BY z DESC, latent) AS rn FROM pre_p p
        WHERE latent IN (SELECT latent FROM dead_t WHERE since_fired > {DEAD_AFTER})) WHERE rn <= {2 * BATCH_K}""",
    "pre_p", "dead_t")
cte("aux_dec", """SELECT a.docid, dec.i, sum(a.z * dec.wd) AS dr FROM aux_t a
        JOIN dec ON dec.latent = a.latent GROUP BY a.docid, dec.i""", "aux_t", "dec")
cte("bt_dec", """SELECT k.docid, dec.i, sum(k.z * dec.wd) AS s FROM bt_kept k
        JOIN dec ON dec.latent = k.latent GROUP BY k.docid, dec.i""", "bt_kept", "dec")
cte("x_p", "SELECT docid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pv", "pv")

ORACLE["sae_encode_batchtopk"] = sql("SELECT batch_id, docid, latent, round(z, 6) AS z FROM bt_kept",
                                     "bt_kept")
ORACLE["sae_calibrate_threshold"] = sql(f"""SELECT 'batches' AS mode, count(*) AS n_batches,
        round(sum(cut) / count(*), 9) AS theta FROM (SELECT batch_id, min(z) AS cut FROM bt_kept GROUP BY batch_id)
    UNION ALL SELECT 'compat', count(*), round(sum(cut) / ((SELECT count(*) FROM pv) // {BATCH_ROWS}), 9)
        FROM (SELECT batch_id, min(z) AS cut FROM bt_kept GROUP BY batch_id)""", "bt_kept", "pv")
ORACLE["dead_latents"] = sql(f"SELECT latent, since_fired, since_fired > {DEAD_AFTER} AS dead FROM dead_t",
                             "dead_t")
ORACLE["dead_aux_recon"] = sql("""SELECT docid, CAST(i - 1 AS BIGINT) AS dim, round(dr, 6) AS value
    FROM aux_dec""", "aux_dec")
ORACLE["sae_loss"] = sql("""SELECT round(avg(e * e + (1.0 / 32) * (e - dr) * (e - dr)), 9) AS loss,
        round(avg(e * e), 9) AS recon_mse FROM (
        SELECT x.x - (coalesce(s.s, 0.0) + b.b) AS e, coalesce(a.dr, 0.0) AS dr FROM x_p x
        JOIN bias_t b ON b.i = x.i
        LEFT JOIN bt_dec s ON s.docid = x.docid AND s.i = x.i
        LEFT JOIN aux_dec a ON a.docid = x.docid AND a.i = x.i)""", "x_p", "bias_t", "bt_dec", "aux_dec")
cte("x_all", "SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb", "emb")
ORACLE["nmse"] = sql(f"""SELECT round(mse, 9) AS mse, round(bmse, 9) AS baseline_mse,
        round(mse / bmse, 9) AS nmse FROM (
        SELECT avg((x.x - r.value) * (x.x - r.value)) AS mse,
               avg((x.x - m.mx) * (x.x - m.mx)) AS bmse
        FROM x_all x JOIN (SELECT e.vec_id, u.i, coalesce(c.s, 0.0) + u.b AS value
                           FROM emb e CROSS JOIN bias_t u LEFT JOIN (
                               SELECT k.vec_id, dec.i, sum(k.z * dec.wd) AS s
                               FROM (SELECT * FROM pre_all WHERE z > {_d(THETA)}) k
                               JOIN dec ON dec.latent = k.latent GROUP BY k.vec_id, dec.i) c
                           ON c.vec_id = e.vec_id AND c.i = u.i) r
             ON r.vec_id = x.vec_id AND r.i = x.i
        JOIN (SELECT i, avg(x) AS mx FROM x_all GROUP BY i) m ON m.i = x.i)""",
                     "x_all", "emb", "bias_t", "pre_all", "dec")

# gradient of mean (r - x)^2 by the decoder, a plain step, norms and projection by dimension
cte("res_t", f"""SELECT x.vec_id, x.i, coalesce(s.s, 0.0) + b.b - x.x AS e FROM x_all x JOIN bias_t b ON b.i = x.i
        LEFT JOIN (SELECT k.vec_id, dec.i, sum(k.z * dec.wd) AS s FROM pre_all k JOIN dec ON dec.latent = k.latent
                   WHERE k.z > {_d(THETA)} GROUP BY k.vec_id, dec.i) s ON s.vec_id = x.vec_id AND s.i = x.i""",
    "x_all", "bias_t", "pre_all", "dec")
cte("grad_t", f"""SELECT d.latent, d.i, d.wd, coalesce(g.g, 0.0) AS g FROM dec d LEFT JOIN (
        SELECT k.latent, r.i, 2.0 * sum(k.z * r.e) / (SELECT count(*) FROM x_all) AS g
        FROM pre_all k JOIN res_t r ON r.vec_id = k.vec_id WHERE k.z > {_d(THETA)} GROUP BY k.latent, r.i) g
        ON g.latent = d.latent AND g.i = d.i""", "dec", "pre_all", "res_t", "x_all")
cte("normed_t", f"""SELECT latent, i, g, (wd - {GRADIENT_STEP} * g) / sqrt(sum((wd - {GRADIENT_STEP} * g)
        * (wd - {GRADIENT_STEP} * g)) OVER (PARTITION BY i)) AS w FROM grad_t""", "grad_t")
ORACLE["decoder_unit_norm"] = sql("""SELECT latent, CAST(i - 1 AS BIGINT) AS dim, round(w, 9) AS w,
    round(g - sum(g * w) OVER (PARTITION BY i) * w, 9) AS g FROM normed_t""", "normed_t")


def pursuit_ctes(rounds: int) -> list[str]:
    """One pursuit round after another: the atom that fits best what is left
    joins the active ones, and all move along their common slope."""
    out = [f"""gp_x AS MATERIALIZED (SELECT x.vec_id, {CENTER} AS x FROM emb x, mu_t)""",
           "gp_left0 AS (SELECT vec_id, x AS v FROM gp_x)",
           "gp_w0 AS (SELECT vec_id, CAST(0 AS BIGINT) AS latent, CAST(0 AS DOUBLE) AS w FROM gp_x WHERE false)"]
    for k in range(1, rounds + 1):
        out += [
            f"""gp_best{k} AS (SELECT l.vec_id, d.latent FROM gp_left{k - 1} l, dict d QUALIFY row_number() OVER (
                PARTITION BY l.vec_id ORDER BY list_dot_product(l.v, d.w) DESC, d.latent) = 1)""",
            f"""gp_basis{k} AS (SELECT vec_id, latent, max(w) AS w FROM (SELECT * FROM gp_w{k - 1} WHERE w > 0
                UNION ALL SELECT vec_id, latent, 0.0 FROM gp_best{k}) GROUP BY vec_id, latent)""",
            f"""gp_slope{k} AS MATERIALIZED (SELECT b.vec_id, b.latent, b.w, list_dot_product(l.v, d.w) AS slope
                FROM gp_basis{k} b JOIN gp_left{k - 1} l ON l.vec_id = b.vec_id JOIN dict d ON d.latent = b.latent)""",
            f"""gp_along{k} AS (SELECT vec_id, list(a ORDER BY i) AS a FROM (SELECT s.vec_id, dec.i, sum(s.slope * dec.wd) AS a
                FROM gp_slope{k} s JOIN dec ON dec.latent = s.latent GROUP BY s.vec_id, dec.i) GROUP BY vec_id)""",
            f"""gp_w{k} AS MATERIALIZED (SELECT s.vec_id, s.latent, greatest(s.w + s.slope * CASE WHEN list_dot_product(a.a, a.a) > 0
                THEN list_dot_product(a.a, l.v) / list_dot_product(a.a, a.a) ELSE 0 END, 0) AS w
                FROM gp_slope{k} s JOIN gp_along{k} a ON a.vec_id = s.vec_id JOIN gp_left{k - 1} l ON l.vec_id = s.vec_id)""",
            f"""gp_left{k} AS MATERIALIZED (SELECT x.vec_id, list_transform(list_zip(x.x, r.r), lambda t: t[1] - t[2]) AS v FROM gp_x x
                JOIN (SELECT vec_id, list(r ORDER BY i) AS r FROM (SELECT w.vec_id, dec.i, sum(w.w * dec.wd) AS r
                      FROM gp_w{k} w JOIN dec ON dec.latent = w.latent GROUP BY w.vec_id, dec.i) GROUP BY vec_id) r
                ON r.vec_id = x.vec_id)"""]
    return out


ORACLE["gradient_pursuit"] = sql(
    f"SELECT vec_id, latent, round(w, 6) AS w FROM gp_w{PURSUIT_ROUNDS} WHERE w > 0", "emb", "mu_t", "dict", "dec",
    extra=pursuit_ctes(PURSUIT_ROUNDS))
