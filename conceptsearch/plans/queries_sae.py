"""Registered queries: autoencoder training-time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptsearch.operators import sae
from conceptsearch.plans.fixtures import THETA, Fixture
from conceptsearch.plans.registry import _r, register

BATCH_ROWS = 20    # fixture batch: passages with the same docid // 20
BATCH_K = 2        # fixture BatchTopK k (k * B entries kept per batch)
DEAD_AFTER = 3     # fixture dead threshold in batches
GRADIENT_STEP = 0.5   # step of the fixture's decoder
PURSUIT_ROUNDS = 8
ALPHA = 1.0 / 32   # Fixed value: auxiliary loss weight of the reference


def _batched(fx: Fixture) -> DataFrame:
    return fx.passages().withColumn("batch_id", (F.col("docid") / BATCH_ROWS).cast("long"))


def _kept(fx: Fixture) -> DataFrame:
    return sae.batch_topk(_batched(fx), fx.model, BATCH_K, "batch_id", "docid", "v")


def _dead(fx: Fixture) -> DataFrame:
    return sae.dead_latents(_kept(fx), fx.model.n_latents, DEAD_AFTER)


def _aux(fx: Fixture) -> DataFrame:
    return sae.dead_aux_codes(fx.passages(), fx.model, _dead(fx), BATCH_K, "docid")


@register("sae_encode_batchtopk")
def q_batchtopk(spark, sf):
    return _kept(Fixture(spark, sf)).select("batch_id", F.col("id").alias("docid"), "latent",
                                            _r("z").alias("z"))


@register("sae_calibrate_threshold")
def q_calibrate(spark, sf):
    fx = Fixture(spark, sf)
    kept = _kept(fx)
    n = fx.passages().count()
    true_mean = sae.calibrate_threshold(kept).select(F.lit("batches").alias("mode"), "n_batches",
                                                     _r("theta", 9).alias("theta"))
    compat = sae.calibrate_threshold(kept, compat_rows=n, batch_size=BATCH_ROWS).select(
        F.lit("compat").alias("mode"), "n_batches", _r("theta", 9).alias("theta"))
    return true_mean.unionByName(compat)


@register("dead_latents")
def q_dead_latents(spark, sf):
    return _dead(Fixture(spark, sf))


@register("dead_aux_recon")
def q_dead_aux_recon(spark, sf):
    fx = Fixture(spark, sf)
    recon = sae.reconstruct(_aux(fx).filter(F.size("ids") > 0), fx.model, with_bias=False)
    return recon.select(F.col("id").alias("docid"), F.posexplode("v").alias("dim", "value")) \
                .select("docid", F.col("dim").cast("long").alias("dim"), _r("value").alias("value"))


@register("sae_loss")
def q_sae_loss(spark, sf):
    fx = Fixture(spark, sf)
    out = sae.sae_loss(_batched(fx), fx.model, BATCH_K, _dead(fx), ALPHA, "batch_id", "docid")
    return out.select(_r("loss", 9).alias("loss"), _r("recon_mse", 9).alias("recon_mse"))


@register("nmse")
def q_nmse(spark, sf):
    fx = Fixture(spark, sf)
    out = sae.nmse(fx.vectors(), fx.model, THETA)
    return out.select(_r("mse", 9).alias("mse"), _r("baseline_mse", 9).alias("baseline_mse"),
                      _r("nmse", 9).alias("nmse"))


@register("gradient_pursuit")
def q_gradient_pursuit(spark, sf):
    fx = Fixture(spark, sf)
    out = sae.gradient_pursuit(fx.vectors(), fx.model, PURSUIT_ROUNDS, "vec_id")
    return out.select(F.col("id").alias("vec_id"), "latent", _r("w").alias("w"))


@register("decoder_unit_norm")
def q_decoder_unit_norm(spark, sf):
    """The decoder after a plain gradient step over all vectors, normalised,
    with the gradient's part along it removed."""
    fx = Fixture(spark, sf)
    grad = sae.decoder_gradient(fx.vectors(), fx.model, THETA, "vec_id")
    stepped = fx.model.dictionary_df(spark).join(grad, "latent").select(
        "latent", F.zip_with("w_dec", "g", lambda w, g: w - F.lit(GRADIENT_STEP) * g).alias("w_dec"))
    out = sae.decoder_unit_norm(stepped, grad)
    return out.select("latent", F.col("dim").cast("long").alias("dim"), _r("w", 9).alias("w"), _r("g", 9).alias("g"))


@register("sae_fit")
def q_sae_fit(spark, sf):
    from conceptsearch.operators.sae_fit import fit_batchtopk
    fx = Fixture(spark, sf)
    model, history = fit_batchtopk(_batched(fx).select(F.col("docid").alias("id"), "v", "batch_id"),
                                   fx.model, k=BATCH_K, epochs=2, lr=5e-5)
    return history
