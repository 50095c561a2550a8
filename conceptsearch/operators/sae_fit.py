"""BatchTopK autoencoder fitting as data-parallel steps.

One optimiser step per batch, as in the reference (steps are sequential by
definition).  Batches of at most ``TASK_ROWS`` rows have work for one task
only: a run of such batches, of at most ``RUN_BYTES`` together, is one task
that takes one step after the other; the model goes out with it and comes
back.  Of a larger batch, or with a model above ``RUN_MODEL_BYTES``, a step is
two Spark jobs over that batch's rows, dealt into tasks of about
``TASK_ROWS``:

1. the batch's k*B largest pre-activations, ties by (id, latent): every task
   sends its own k*B largest, and a bounded top-n keeps k*B of these, as
   (id, latent), so both jobs mean the same entries to the last bit;
2. every task sums the gradient of ``mean(e^2 + alpha (e - dead_recon)^2)``
   over its rows, and the sums are added up by blocks of latents.

Either way the total gradient norm is then clipped (100), the decoder
normalised along the latent axis and its gradient projected (E14), and AdamW applied
(lr, eps 6e-10, weight decay 0.01, betas 0.9/0.999).  Only the model
(latents x input width), k*B entries and per-step scalars ever reach the
driver: all are parameters, none grows with the data.
The input is written once to the shared checkpoint folder, sorted by batch,
so each step's scan skips the row groups of other batches.  Ids are unique
within a batch.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.operators.sae import MAX_MODEL_BROADCAST_BYTES, SaeModel, save_model
from conceptsearch.session import scratch_path

# Optimiser defaults of the reference's training run.
ADAM_EPS = 6e-10
WEIGHT_DECAY = 0.01
BETAS = (0.9, 0.999)
CLIP_NORM = 100.0

#: Rows of a batch that one task takes, bytes of its rows x latents matrices,
#: latents whose gradients one task adds up.
TASK_ROWS = 512
PIECE_BYTES = 64 << 20
LATENT_BLOCK = 1024

#: Bytes of vectors that one task steps through, and of the model it takes along.
RUN_BYTES = 32 << 20
RUN_MODEL_BYTES = 64 << 20


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)


def _pieces(batches, m: int):
    """Frames cut so that a matrix of rows x latents stays under PIECE_BYTES."""
    rows = max(1, PIECE_BYTES // (8 * m))
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo: lo + rows]


def _largest(z: np.ndarray, ids: np.ndarray, latents: np.ndarray, n: int) -> pd.DataFrame:
    """The n largest, ties by (id, latent)."""
    if z.size > n:
        at = np.flatnonzero(z >= np.partition(z, z.size - n)[z.size - n])
        z, ids, latents = z[at], ids[at], latents[at]
    order = np.lexsort((latents, ids, -z))[:n]
    return pd.DataFrame({"id": ids[order], "latent": latents[order], "z": z[order]})


def _largest_entries(batches, weights, keep_n: int) -> pd.DataFrame | None:
    """(id, latent, z) of the keep_n largest pre-activations of the frames."""
    w_enc, _, bias = weights
    held = None
    for pdf in _pieces(batches, len(w_enc)):
        z = (_stack(pdf["v"]) - bias) @ w_enc.T
        latents = np.tile(np.arange(z.shape[1]), len(z))
        new = _largest(z.ravel(), np.repeat(pdf["id"].to_numpy(), z.shape[1]), latents, keep_n)
        held = new if held is None else pd.concat([held, new])
        held = _largest(held["z"].to_numpy(), held["id"].to_numpy(), held["latent"].to_numpy(), keep_n)
    return held


def _kept_entries(rows: DataFrame, bc, keep_n: int) -> pd.DataFrame:
    """(id, latent, z) of the batch's keep_n largest pre-activations."""
    def local(batches):
        held = _largest_entries(batches, bc.value, keep_n)
        if held is not None:
            yield held

    return (rows.mapInPandas(local, "id long, latent long, z double")
            .orderBy(F.desc("z"), "id", "latent").limit(keep_n).toPandas())


@dataclass
class _Fit:
    """A fit under way: weights (encoder, decoder, bias), their moments, steps
    since each latent fired, steps taken."""
    params: list
    m1: list
    m2: list
    last_fired: np.ndarray
    t: int = 0

    @classmethod
    def start(cls, init: SaeModel) -> _Fit:
        params = [init.w_enc.copy(), init.w_dec.copy(), init.bias_pre.copy()]
        return cls(params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params],
                   np.zeros(len(init.w_enc)))

    def kept(self, entries: pd.DataFrame, n_rows: int, dead_after: int, alpha: float, k: int):
        """What a step needs of the kept entries: the latents that fired, and
        the state of ``_step_gradients``."""
        fired = np.isin(np.arange(len(self.last_fired)), entries["latent"])
        dead = (self.last_fired + 1) * (~fired) > dead_after
        entries = entries.sort_values("id", kind="stable")
        return fired, (entries["id"].to_numpy(), entries["latent"].to_numpy(), n_rows, dead, alpha, k)

    def step(self, grads: dict, fired: np.ndarray, lr: float) -> None:
        self.t += 1
        self.last_fired = (self.last_fired + 1) * (~fired)
        g_enc, g_dec, g_b = grads["g_enc"], grads["g_dec"], grads["g_b"]
        total = np.sqrt(sum(float((g * g).sum()) for g in (g_enc, g_dec, g_b)))
        if total > CLIP_NORM:
            scale = CLIP_NORM / (total + 1e-6)
            g_enc, g_dec, g_b = g_enc * scale, g_dec * scale, g_b * scale
        # decoder unit norm along the latent axis (one norm per input dim)
        w_dec = self.params[1]
        w_dec[:] = w_dec / np.linalg.norm(w_dec, axis=1, keepdims=True)
        g_dec = g_dec - (g_dec * w_dec).sum(axis=1, keepdims=True) * w_dec
        for i, (p, g) in enumerate(zip(self.params, (g_enc, g_dec, g_b))):
            p *= (1.0 - lr * WEIGHT_DECAY)
            self.m1[i] = BETAS[0] * self.m1[i] + (1 - BETAS[0]) * g
            self.m2[i] = BETAS[1] * self.m2[i] + (1 - BETAS[1]) * g * g
            mh = self.m1[i] / (1 - BETAS[0] ** self.t)
            vh = self.m2[i] / (1 - BETAS[1] ** self.t)
            p -= lr * mh / (np.sqrt(vh) + ADAM_EPS)

    def arrays(self) -> list[np.ndarray]:
        return [*self.params, *self.m1, *self.m2, self.last_fired]

    def moved(self, arrays: list[np.ndarray], t: int) -> _Fit:
        """The same fit after steps that gave these ``arrays``."""
        a = [x.reshape(own.shape).copy() for x, own in zip(arrays, self.arrays(), strict=True)]
        return _Fit(a[:3], a[3:6], a[6:9], a[9], t)


RUN_SCHEMA = "step int, batch_id long, loss double, cut double, part int, state binary"


def _run_of_steps(rows: DataFrame, fit: _Fit, k: int, lr: float, alpha: float, dead_after: int):
    """One step for each batch of ``rows``, all in one task: the fit after
    them, and their history ``(step, batch_id, loss, cut)``."""
    bc = rows.sparkSession.sparkContext.broadcast(fit)

    def run(batches):
        now = bc.value.moved(bc.value.arrays(), bc.value.t)
        steps = []

        def step(frames):
            n_rows = sum(map(len, frames))
            entries = _largest_entries(frames, now.params, k * n_rows)
            fired, state = now.kept(entries, n_rows, dead_after, alpha, k)
            g_enc, g_dec, g_b, loss, _ = _gradient_sums(frames, now.params, state)
            now.step({"g_enc": g_enc, "g_dec": g_dec, "g_b": g_b}, fired, lr)
            steps.append((now.t, int(frames[0]["batch_id"].iloc[0]), loss, float(entries["z"].min())))

        held = []
        for pdf in batches:                            # sorted by batch
            for b, frame in pdf.groupby("batch_id", sort=False):
                if held and held[0]["batch_id"].iloc[0] != b:
                    step(held)
                    held = []
                held.append(frame)
        if held:
            step(held)
        yield pd.DataFrame(steps, columns=["step", "batch_id", "loss", "cut"]).assign(part=-1, state=None)
        for i, a in enumerate(now.arrays()):
            yield pd.DataFrame({"step": [now.t], "batch_id": [0], "loss": [0.0], "cut": [0.0], "part": [i],
                                "state": [np.ascontiguousarray(a).tobytes()]})

    got = rows.coalesce(1).sortWithinPartitions("batch_id", "id").mapInPandas(run, RUN_SCHEMA).collect()
    bc.unpersist()
    done = [(r["step"], r["batch_id"], r["loss"], r["cut"]) for r in got if r["part"] < 0]
    parts = sorted((r["part"], r["state"]) for r in got if r["part"] >= 0)
    return fit.moved([np.frombuffer(x) for _, x in parts], done[-1][0]), done


def _runs(steps, most_rows: int):
    """Batches ``(batch_id, n)`` that follow one another, grouped: those of one
    task's size, together of at most ``most_rows`` rows, or a larger one alone."""
    held, n_held = [], 0
    for b, n in steps:
        if held and (n > TASK_ROWS or n_held + n > most_rows):
            yield held
            held, n_held = [], 0
        if n > TASK_ROWS:
            yield [(b, n)]
        else:
            held.append((b, n))
            n_held += n
    if held:
        yield held


def fit_batchtopk(vectors: DataFrame, init: SaeModel, k: int, epochs: int = 1,
                  lr: float = 5e-5, alpha: float = 1.0 / 32, dead_after: int = 20,
                  save_path: str | None = None) -> tuple[SaeModel, DataFrame]:
    """Fit from ``init`` over ``vectors`` ``(id, v, batch_id)``; batches are
    visited in ``batch_id`` order every epoch.  With ``save_path`` the
    weights are written after every epoch (``save_path/epoch=<n>``, see
    ``sae.save_model``) so a lost driver restarts from the last epoch by
    passing ``sae.load_model(...)`` as ``init``.  Returns the model and a
    history table ``(epoch, step, batch_id, loss, cut)``."""
    spark = vectors.sparkSession
    path = scratch_path(spark, f"sae_fit/input-{uuid.uuid4().hex}")
    (vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"),
                    F.col("batch_id").cast("long").alias("batch_id"))
     .repartitionByRange("batch_id", "id").sortWithinPartitions("batch_id", "id").write.parquet(path))
    data = spark.read.parquet(path)
    steps = data.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id")
    m, d = init.w_enc.shape
    model_bytes = init.w_enc.nbytes + init.w_dec.nbytes
    if model_bytes > MAX_MODEL_BROADCAST_BYTES:
        raise ValueError("the model is above MAX_MODEL_BROADCAST_BYTES: it travels to every task")
    most_rows = RUN_BYTES // (8 * max(d, 1)) if model_bytes <= RUN_MODEL_BYTES else 0
    fit, history = _Fit.start(init), []
    for epoch in range(epochs):
        for run in _runs(steps.toLocalIterator(), most_rows):
            if most_rows and run[0][1] <= TASK_ROWS:
                rows = data.filter(F.col("batch_id").between(run[0][0], run[-1][0]))
                fit, done = _run_of_steps(rows, fit, k, lr, alpha, dead_after)
                history += [(epoch, *step) for step in done]
                continue
            (b, n_rows), = run
            rows = data.filter(F.col("batch_id") == b).repartition(-(-n_rows // TASK_ROWS), "id")
            bc = spark.sparkContext.broadcast(tuple(fit.params))
            kept = _kept_entries(rows, bc, k * n_rows)
            fired, state = fit.kept(kept, n_rows, dead_after, alpha, k)
            state = spark.sparkContext.broadcast(state)
            grads = _step_gradients(rows, bc, state, m, d)
            fit.step(grads, fired, lr)
            history.append((epoch, fit.t, int(b), float(grads["loss"]), float(kept["z"].min())))
            bc.unpersist()
            state.unpersist()
        w_enc, w_dec, bias = fit.params
        if save_path:
            save_model(SaeModel(w_enc=w_enc, w_dec=w_dec, bias_pre=bias), f"{save_path}/epoch={epoch}")
    hist = spark.createDataFrame(history, "epoch int, step int, batch_id long, loss double, cut double")
    w_enc, w_dec, bias = fit.params
    return SaeModel(w_enc=w_enc, w_dec=w_dec, bias_pre=bias), hist


def _gradient_sums(batches, weights, state):
    """Sums of the gradients (encoder, decoder, bias) and the loss over the
    frames, and the rows seen; ``state`` as for ``_step_gradients``."""
    w_enc, w_dec, bias = weights
    kept_ids, kept_latents, n_rows, dead, alpha, k = state
    m, d = w_enc.shape
    n_aux = min(2 * k, m)
    g_enc, g_dec, g_b, loss, seen = np.zeros((m, d)), np.zeros((d, m)), np.zeros(d), 0.0, 0
    for pdf in _pieces(batches, m):
        seen += len(pdf)
        ids, x = pdf["id"].to_numpy(), _stack(pdf["v"])
        xc = x - bias
        z = xc @ w_enc.T
        first, last = np.searchsorted(kept_ids, ids), np.searchsorted(kept_ids, ids, "right")
        sel = np.zeros(z.shape, bool)
        for i in np.flatnonzero(last > first):
            sel[i, kept_latents[first[i]:last[i]]] = True
        sel_a = np.zeros(z.shape, bool)
        if dead.any():
            z_dead = np.where(dead, z, -np.inf)
            top = np.argpartition(-z_dead, n_aux - 1, axis=1)[:, :n_aux]
            np.put_along_axis(sel_a, top, True, axis=1)
            sel_a &= dead
        zs, za = z * sel, z * sel_a
        e = x - (zs @ w_dec.T + bias)
        rest = e - za @ w_dec.T
        scale = 2.0 / (n_rows * d)
        g, ga = -scale * (e + alpha * rest), -scale * alpha * rest
        g_dec += g.T @ zs + ga.T @ za
        delta = (g @ w_dec) * sel + (ga @ w_dec) * sel_a
        g_enc += delta.T @ xc
        g_b += g.sum(axis=0) - (delta @ w_enc).sum(axis=0)
        loss += float((e * e + alpha * rest ** 2).sum()) / (n_rows * d)
    return g_enc, g_dec, g_b, loss, seen


def _step_gradients(rows: DataFrame, bc, state, m: int, d: int) -> dict:
    """Gradient of one step: sums of every task, added up by blocks of latents.
    ``state``: ids and latents of the kept entries (sorted by id), the batch's
    rows, the dead latents, alpha, k."""
    def part(batches):
        g_enc, g_dec, g_b, loss, seen = _gradient_sums(batches, bc.value, state.value)
        for lo in range(0, m if seen else 0, LATENT_BLOCK):
            own = slice(lo, lo + LATENT_BLOCK)
            # the first block carries what belongs to no latent
            yield pd.DataFrame({
                "block": [lo], "task": [TaskContext.get().partitionId()],
                "sums": [np.concatenate((g_enc[own].ravel(), g_dec[:, own].T.ravel())).tobytes()],
                "rest": [np.append(g_b, loss).tobytes() if lo == 0 else b""]})

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("task")
        total = [sum(np.frombuffer(x) for x in parts[c]) for c in ("sums", "rest")]
        return pd.DataFrame({"block": parts["block"].iloc[:1], "sums": [total[0].tobytes()], "rest": [total[1].tobytes()]})

    out = (rows.mapInPandas(part, "block long, task long, sums binary, rest binary")
           .groupBy("block").applyInPandas(added, "block long, sums binary, rest binary").orderBy("block").collect())
    halves = [np.frombuffer(r["sums"]).reshape(2, -1, d) for r in out]
    rest = np.frombuffer(out[0]["rest"])
    return {"g_enc": np.concatenate([h[0] for h in halves]), "g_dec": np.concatenate([h[1] for h in halves]).T.copy(),
            "g_b": rest[:-1], "loss": float(rest[-1])}
