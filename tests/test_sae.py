"""Autoencoder operators against NumPy, plus the properties of SURVEY 5."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conceptsearch.operators import sae
from conceptsearch.operators.sae_fit import _step_gradients

RNG = np.random.default_rng(7)
M, D, N = 12, 6, 40
W = RNG.normal(size=(M, D))
BIAS = RNG.normal(size=D) * 0.1
X = RNG.normal(size=(N, D))


@pytest.fixture(scope="module")
def model():
    return sae.SaeModel(w_enc=W.copy(), w_dec=W.T.copy(), bias_pre=BIAS.copy())


@pytest.fixture(scope="module")
def vecs(spark):
    rows = [(i, [float(x) for x in X[i]], i // 10) for i in range(N)]
    return spark.createDataFrame(rows, "id long, v array<double>, batch_id long")


def z_np():
    return (X - BIAS) @ W.T


def codes_dict(df):
    return {r["id"]: (list(r["ids"]), list(r["weight"])) for r in df.collect()}


def test_threshold_encode_matches_numpy(vecs, model):
    got = codes_dict(sae.encode_threshold(vecs, model, 0.5))
    z = z_np()
    for i in range(N):
        ids = list(np.flatnonzero(z[i] > 0.5))
        assert got[i][0] == ids
        assert got[i][1] == pytest.approx(list(z[i, ids]))


def test_topk_is_subset_of_pre_activations_and_sorted(vecs, model):
    got = codes_dict(sae.encode_topk(vecs, model, 4))
    z = z_np()
    for i in range(N):
        ids, ws = got[i]
        assert ws == sorted(ws, reverse=True)
        assert ws == pytest.approx(list(z[i, ids]))
        assert min(ws) >= np.sort(z[i])[-4]


def test_bottomk_ascending(vecs, model):
    got = codes_dict(sae.encode_bottomk(vecs, model, 3))
    z = z_np()
    for i in range(N):
        assert got[i][1] == pytest.approx(list(np.sort(z[i])[:3]))


def test_min_active_contains_threshold_set(vecs, model):
    thr = codes_dict(sae.encode_threshold(vecs, model, 1.0))
    mina = codes_dict(sae.encode_min_active(vecs, model, 1.0, 5))
    for i in range(N):
        assert set(thr[i][0]) <= set(mina[i][0])
        assert len(mina[i][0]) == max(5, len(thr[i][0]))


def test_batch_topk_single_row_equals_topk(spark, model):
    one = spark.createDataFrame([(0, [float(x) for x in X[0]], 0)], "id long, v array<double>, batch_id long")
    kept = sae.batch_topk(one, model, 4).orderBy(F.desc("z")).collect()
    top = codes_dict(sae.encode_topk(one, model, 4))[0]
    assert [r["latent"] for r in kept] == top[0]


def test_batch_topk_keeps_k_times_b_per_batch(vecs, model):
    counts = {r["batch_id"]: r["count"] for r in sae.batch_topk(vecs, model, 3).groupBy("batch_id")
              .count().collect()}
    assert counts == {b: 30 for b in range(4)}


def test_reconstruct_empty_code_is_bias(spark, model):
    df = spark.createDataFrame([(1, [], [])], "id long, ids array<long>, weight array<double>")
    v = sae.reconstruct(df, model).first()["v"]
    assert v == pytest.approx(list(BIAS))


def test_reconstruct_matches_numpy(vecs, model):
    codes = sae.encode_threshold(vecs, model, 0.5)
    got = {r["id"]: r["v"] for r in sae.reconstruct(codes, model).collect()}
    z = z_np()
    zm = z * (z > 0.5)
    exp = zm @ W + BIAS
    for i in range(N):
        assert got[i] == pytest.approx(list(exp[i]))


def _pursuit_np(x, dictionary, rounds):
    weights = np.zeros(dictionary.shape[0])
    for _ in range(rounds):
        residual = x - weights @ dictionary
        inner = dictionary @ residual
        selected = weights != 0
        selected[np.argmax(inner)] = True
        grad = selected * inner
        c = grad @ dictionary
        step = (c @ residual) / (c @ c) if c @ c else 0.0
        weights = np.maximum(weights + step * grad, 0)
    return weights


def test_gradient_pursuit_matches_numpy_loop(vecs, model):
    got = sae.gradient_pursuit(vecs, model, 5).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], {})[r["latent"]] = r["w"]
    for i in range(N):
        exp = _pursuit_np(X[i] - BIAS, W, 5)
        nz = {int(j): exp[j] for j in np.flatnonzero(exp)}
        assert by_id.get(i, {}) == pytest.approx(nz)


def test_decoder_unit_norm_per_input_dimension(spark, model):
    out = sae.decoder_unit_norm(model.dictionary_df(spark)).toPandas()
    norms = out.groupby("dim")["w"].apply(lambda s: float(np.sqrt((s ** 2).sum())))
    assert norms.to_numpy() == pytest.approx(np.ones(D))


def _loss_np(w_enc, w_dec, bias, x, sel, sel_a, alpha):
    z = (x - bias) @ w_enc.T
    r = (z * sel) @ w_dec.T + bias
    ra = (z * sel_a) @ w_dec.T
    e = x - r
    return float(np.mean(e * e + alpha * (e - ra) ** 2))


def test_fit_gradient_matches_finite_differences(spark):
    rng = np.random.default_rng(3)
    m, d, b = 16, 8, 6
    w_enc = rng.normal(size=(m, d))
    w_dec = rng.normal(size=(d, m))
    bias = rng.normal(size=d) * 0.1
    x = rng.normal(size=(b, d))
    k, alpha = 2, 1.0 / 32
    z = (x - bias) @ w_enc.T
    keep = k * b
    cut = np.sort(z.ravel())[-keep]
    sel = z >= cut
    last_fired = np.full(m, 5.0)
    fired = sel.any(axis=0)
    dead = (last_fired + 1) * (~fired) > 3
    zd = np.where(dead[None, :], z, -np.inf)
    sel_a = np.zeros_like(sel)
    top = np.argsort(-zd, axis=1)[:, :2 * k]
    np.put_along_axis(sel_a, top, True, axis=1)
    sel_a &= dead[None, :]
    assert sel_a.any()
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(b)], "id long, v array<double>")
    bc = spark.sparkContext.broadcast((w_enc, w_dec, bias))
    kept_ids, kept_latents = np.nonzero(sel)
    state = spark.sparkContext.broadcast((kept_ids, kept_latents, b, dead, alpha, k))
    g = _step_gradients(rows, bc, state, m, d)
    assert g["loss"] == pytest.approx(_loss_np(w_enc, w_dec, bias, x, sel, sel_a, alpha))
    eps = 1e-6
    for name, param, grad in (("enc", w_enc, g["g_enc"]), ("dec", w_dec, g["g_dec"]),
                              ("bias", bias, g["g_b"])):
        flat = param.ravel()
        for idx in rng.choice(flat.size, size=min(12, flat.size), replace=False):
            old = flat[idx]
            flat[idx] = old + eps
            up = _loss_np(w_enc, w_dec, bias, x, sel, sel_a, alpha)
            flat[idx] = old - eps
            dn = _loss_np(w_enc, w_dec, bias, x, sel, sel_a, alpha)
            flat[idx] = old
            assert grad.ravel()[idx] == pytest.approx((up - dn) / (2 * eps), rel=1e-4, abs=1e-8), name


def test_mean_vector(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [list(r) for r in X]}))
    assert sae.mean_vector(df, "v") == pytest.approx(X.mean(axis=0))


def test_fit_runs_steps_and_moves_the_model(spark, model):
    from conceptsearch.operators.sae_fit import fit_batchtopk
    rows = [(i, [float(x) for x in X[i]], i // 10) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, v array<double>, batch_id long")
    fitted, hist = fit_batchtopk(df, model, k=2, epochs=2, lr=1e-2, dead_after=1)
    h = hist.orderBy("step").collect()
    assert [r["step"] for r in h] == list(range(1, 9))
    assert all(np.isfinite(r["loss"]) for r in h)
    assert not np.allclose(fitted.w_enc, model.w_enc)
    # decoder rows (one per input dimension) are unit norm after each step
    assert np.linalg.norm(fitted.w_dec, axis=1) == pytest.approx(np.ones(D), abs=0.2)


def test_fit_does_not_depend_on_the_tasks(spark, model, monkeypatch):
    from conceptsearch.operators import sae_fit
    rows = [(i, [float(x) for x in X[i]], i // 20) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, v array<double>, batch_id long")
    one, hist = sae_fit.fit_batchtopk(df, model, k=2, lr=1e-2, dead_after=0)
    monkeypatch.setattr(sae_fit, "TASK_ROWS", 3)
    monkeypatch.setattr(sae_fit, "PIECE_BYTES", 8 * model.n_latents * 2)
    monkeypatch.setattr(sae_fit, "LATENT_BLOCK", 3)
    many, again = sae_fit.fit_batchtopk(df.repartition(5), model, k=2, lr=1e-2, dead_after=0)
    assert np.allclose(one.w_enc, many.w_enc) and np.allclose(one.w_dec, many.w_dec)
    pairs = zip(hist.orderBy("step").collect(), again.orderBy("step").collect(), strict=True)
    assert all(a["loss"] == pytest.approx(b["loss"]) and a["cut"] == pytest.approx(b["cut"]) for a, b in pairs)


def test_kept_entries_are_exactly_as_many_with_ties(spark, model):
    from conceptsearch.operators.sae_fit import _kept_entries
    rows = [(i, [float(x) for x in X[i % 3]]) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    bc = spark.sparkContext.broadcast((model.w_enc, model.w_dec, model.bias_pre))
    kept = _kept_entries(df, bc, 10)
    assert len(kept) == 10 and not kept.duplicated(["id", "latent"]).any()


def test_model_save_load_round_trip(spark, model):
    import uuid
    from conceptsearch.session import scratch_path
    path = scratch_path(spark, f"tests/model-{uuid.uuid4().hex}")
    sae.save_model(model, path)
    back = sae.load_model(spark, path)
    assert np.array_equal(back.w_enc, model.w_enc)
    assert np.array_equal(back.w_dec, model.w_dec)
    assert np.array_equal(back.bias_pre, model.bias_pre)


def test_fit_saves_every_epoch(spark, model):
    import uuid
    from conceptsearch.operators.sae_fit import fit_batchtopk
    from conceptsearch.session import scratch_path
    rows = [(i, [float(x) for x in X[i]], i // 20) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, v array<double>, batch_id long")
    path = scratch_path(spark, f"tests/fit-{uuid.uuid4().hex}")
    fitted, _ = fit_batchtopk(df, model, k=2, epochs=2, lr=1e-2, save_path=path)
    last = sae.load_model(spark, f"{path}/epoch=1")
    assert np.allclose(last.w_enc, fitted.w_enc)


def test_a_run_of_batches_is_one_task(spark, model, monkeypatch):
    """Steps in one task, in several, and batch by batch are the same steps."""
    from conceptsearch.operators import sae_fit
    rows = [(i, [float(x) for x in X[i]], i // 7) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, v array<double>, batch_id long")
    jobs = []
    one_run = sae_fit._run_of_steps
    monkeypatch.setattr(sae_fit, "_run_of_steps", lambda *a: jobs.append(1) or one_run(*a))
    fits = []
    for run_bytes, model_bytes in ((1 << 20, 1 << 20), (8 * D * 15, 1 << 20), (1 << 20, 0)):
        monkeypatch.setattr(sae_fit, "RUN_BYTES", run_bytes)
        monkeypatch.setattr(sae_fit, "RUN_MODEL_BYTES", model_bytes)
        fitted, hist = sae_fit.fit_batchtopk(df, model, k=2, epochs=2, lr=1e-2, dead_after=1)
        fits.append((fitted, [tuple(r) for r in hist.orderBy("step").collect()], len(jobs)))
        jobs.clear()
    assert fits[0][2] == 2 and fits[1][2] > 2 and fits[2][2] == 0
    for fitted, hist, _ in fits[1:]:
        assert np.allclose(fitted.w_enc, fits[0][0].w_enc) and np.allclose(fitted.w_dec, fits[0][0].w_dec)
        assert [h[:3] for h in hist] == [h[:3] for h in fits[0][1]]
        assert np.allclose([h[3:] for h in hist], [h[3:] for h in fits[0][1]])
