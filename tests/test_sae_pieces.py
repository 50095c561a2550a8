"""Encoders, decoders and batch selections in small pieces, against NumPy."""

import numpy as np
import pytest

from conceptsearch.operators import sae

N, M, D = 57, 11, 4


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return sae.SaeModel(np.round(rng.normal(size=(M, D)), 1), np.round(rng.normal(size=(D, M)), 1), np.round(rng.normal(size=D), 1))


@pytest.fixture(scope="module")
def x():
    return np.round(np.random.default_rng(2).normal(size=(N, D)), 1)    # coarse: many ties


@pytest.fixture(scope="module")
def vectors(spark, x):
    return spark.createDataFrame([(k, k // 20, v.tolist()) for k, v in enumerate(x)],
                                 "id long, batch_id long, v array<double>").repartition(3)


@pytest.fixture(params=[1, 40, 8_000_000])
def cells(request, monkeypatch):
    monkeypatch.setattr(sae, "PIECE_CELLS", request.param)


def rows(df, *columns):
    return {r["id"]: tuple(np.asarray(r[c]) for c in columns) for r in df.collect()}


def order(z, largest=True):
    return [sorted(range(M), key=lambda c: (-r[c] if largest else r[c], c)) for r in z]


def test_codes(vectors, model, x, cells):
    z = (x - model.bias_pre) @ model.w_enc.T
    threshold = rows(sae.encode_threshold(vectors, model, 0.5), "ids", "weight")
    top = rows(sae.encode_topk(vectors, model, 4), "ids", "weight")
    bottom = rows(sae.encode_bottomk(vectors, model, 20), "ids", "weight")
    for k in range(N):
        assert threshold[k][0].tolist() == np.flatnonzero(z[k] > 0.5).tolist()
        assert threshold[k][1] == pytest.approx(z[k][z[k] > 0.5])
        assert z[k][top[k][0]] == pytest.approx(np.sort(z[k])[::-1][:4]) and len(set(top[k][0])) == 4
        assert bottom[k][1] == pytest.approx(np.sort(z[k]))
        assert (np.diff(top[k][0])[np.diff(top[k][1]) == 0] > 0).all()     # ties by latent


def test_top_is_exact_on_ties():
    z = np.array([[1.0, 2, 2, 2, 0], [0, 0, 0, 0, 0], [5, 4, 3, 2, 1]])
    assert sae._top(z, 2).tolist() == [[1, 2], [0, 1], [0, 1]] and sae._top(z, 9).tolist()[0] == [1, 2, 3, 0, 4]
    assert sae._top(z[:0], 2).shape == (0, 2) and sae._top(z[:, :0], 2).shape == (3, 0)


def test_topped_up_codes_are_marked_and_left_out_of_the_reconstruction(vectors, model, x, cells):
    z = (x - model.bias_pre) @ model.w_enc.T
    codes = sae.encode_min_active(vectors, model, 1.0, 5)
    got = rows(codes, "ids", "weight", "n_above")
    for k in range(N):
        above = np.flatnonzero(z[k] > 1.0)
        assert got[k][2] == len(above) and got[k][0][:len(above)].tolist() == above.tolist()
        assert len(got[k][0]) == max(5, len(above)) and len(set(got[k][0])) == len(got[k][0])
        assert sorted(got[k][1])[::-1][:5] == pytest.approx(np.sort(z[k])[::-1][:5])
    want = np.where(z > 1.0, z, 0) @ model.w_dec.T + model.bias_pre
    recon = rows(sae.reconstruct(codes, model), "v")
    assert all(recon[k][0] == pytest.approx(want[k]) for k in range(N))
    assert any(len(got[k][0]) > got[k][2] for k in range(N))


def test_batch_selection_and_loss(vectors, model, x, cells, spark):
    z = (x - model.bias_pre) @ model.w_enc.T
    kept = sae.batch_topk(vectors, model, 2).collect()
    dead = spark.createDataFrame([(c, c in (1, 4, 7)) for c in range(M)], "latent long, dead boolean")
    loss = sae.sae_loss(vectors, model, 2, dead).first()
    total = squares = 0.0
    for b in range(3):
        own = [k for k in range(N) if k // 20 == b]
        entries = sorted(((round(-z[k, c], 9), k, c) for k in own for c in range(M)))[:2 * len(own)]
        assert sorted((r["id"], r["latent"]) for r in kept if r["batch_id"] == b) == sorted((k, c) for _, k, c in entries)
        sparse, aux = np.zeros((N, M)), np.zeros((N, M))
        for v, k, c in entries:
            sparse[k, c] = z[k, c]
        for k in own:
            for c in sorted((1, 4, 7), key=lambda c: (-z[k, c], c))[:4]:
                aux[k, c] = z[k, c]
        e = x[own] - sparse[own] @ model.w_dec.T - model.bias_pre
        squares += (e * e).sum()
        total += (e * e + (e - aux[own] @ model.w_dec.T) ** 2 / 32).sum()
    assert loss["loss"] == pytest.approx(total / x.size) and loss["recon_mse"] == pytest.approx(squares / x.size)


def test_dead_latents_are_selected_without_a_shuffle(vectors, model, x, spark):
    dead = spark.createDataFrame([(c, c in (0, 3, 9)) for c in range(M)], "latent long, dead boolean")
    codes = sae.dead_aux_codes(vectors, model, dead, 1)
    plan = sae.reconstruct(codes, model, with_bias=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "").replace("REPARTITION_BY_NUM", "") or plan.count("Exchange") == 1
    z = (x - model.bias_pre) @ model.w_enc.T
    got = rows(codes, "ids", "weight")
    assert all(got[k][0].tolist() == sorted((0, 3, 9), key=lambda c: (-z[k, c], c))[:2] for k in range(N))
    none = sae.dead_aux_codes(vectors, model, dead.withColumn("dead", dead["latent"] < 0), 1)
    assert all(len(v[0]) == 0 for v in rows(none, "ids").values())


def test_nmse_in_pieces(vectors, model, x, cells):
    z = (x - model.bias_pre) @ model.w_enc.T
    recon = np.where(z > 0.3, z, 0) @ model.w_dec.T + model.bias_pre
    out = sae.nmse(vectors, model, 0.3).first()
    assert out["mse"] == pytest.approx(((x - recon) ** 2).mean())
    assert out["baseline_mse"] == pytest.approx(((x - x.mean(0)) ** 2).mean())


def test_empty(vectors, model):
    none = vectors.filter("id < 0")
    assert sae.reconstruct(sae.encode_min_active(none, model, 0.0, 3), model).count() == 0
    assert sae.encode_topk(none, model, 3).count() == 0
