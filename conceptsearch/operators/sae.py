"""Sparse autoencoder operators.

The model is two weight matrices and a pre-bias: ``w_enc`` (m x d),
``w_dec`` (d x m) and ``bias_pre`` (d).  Its size is fixed by the model
(latents x input width), not by the data, so it is broadcast once behind an
explicit size check.  Vector arithmetic runs as NumPy GEMM inside
``mapInArrow``/``applyInPandas`` on Arrow batches, cut into pieces whose
rows x latents matrix stays under ``PIECE_CELLS``: at 24 576 latents a piece
is 325 rows, 64 MB a matrix, and the encoders hold about five (the shifted
rows, z, its mask and a partial sort).  The relational parts (masks, ranks,
joins, aggregates) are DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest model (both matrices, float64) we agree to broadcast.  24 576 x 768
# tied weights are about 300 MB in float64; the limit leaves room for that.
MAX_MODEL_BROADCAST_BYTES = 1 << 30

CODE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
    T.StructField("weight", T.ArrayType(T.DoubleType())),
])


@dataclass
class SaeModel:
    w_enc: np.ndarray      # (m, d): row l is latent l's encoder direction
    w_dec: np.ndarray      # (d, m): column l is latent l's decoder direction
    bias_pre: np.ndarray   # (d,)

    @property
    def n_latents(self) -> int:
        return int(self.w_enc.shape[0])

    @property
    def dim(self) -> int:
        return int(self.w_enc.shape[1])

    @property
    def nbytes(self) -> int:
        return int(self.w_enc.nbytes + self.w_dec.nbytes + self.bias_pre.nbytes)

    @classmethod
    def tied(cls, dictionary: DataFrame, bias_pre: np.ndarray,
             latent_col: str = "latent", weight_col: str = "w",
             n_latents: int | None = None) -> "SaeModel":
        """Tied initialisation: decoder = encoder transposed (as the
        reference initialises).  ``dictionary`` has one row per latent; its
        size is checked before it is collected."""
        m = n_latents if n_latents is not None else dictionary.count()
        d = int(len(bias_pre))
        if 2 * m * d * 8 > MAX_MODEL_BROADCAST_BYTES:
            raise ValueError(f"model of {m} x {d} exceeds the broadcast limit")
        pdf = dictionary.select(latent_col, weight_col).orderBy(latent_col).toPandas()
        ids = pdf[latent_col].to_numpy()
        if not np.array_equal(ids, np.arange(m)):
            raise ValueError("latent ids must be dense from 0")
        w = np.stack(pdf[weight_col].to_numpy()).astype(np.float64) if m else np.zeros((0, d))
        return cls(w_enc=w.copy(), w_dec=w.T.copy(), bias_pre=np.asarray(bias_pre, dtype=np.float64))

    def broadcast(self, spark: SparkSession):
        if self.nbytes > MAX_MODEL_BROADCAST_BYTES:
            raise ValueError(f"model of {self.nbytes} bytes exceeds the broadcast limit")
        return spark.sparkContext.broadcast((self.w_enc, self.w_dec, self.bias_pre))

    def dictionary_df(self, spark: SparkSession) -> DataFrame:
        """Decoder directions as a table ``(latent, w_dec array<double>)``."""
        pdf = pd.DataFrame({"latent": np.arange(self.n_latents, dtype=np.int64),
                            "w_dec": self.w_dec.T.astype(np.float64).tolist()})
        return spark.createDataFrame(pdf, "latent long, w_dec array<double>")


def _partial_sums(df: DataFrame, vec_col: str) -> DataFrame:
    """One row per Arrow batch: ``(n, s array<double>)``, the row count and the
    element-wise vector sum, computed in NumPy."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64, copy=False)
                yield pd.DataFrame({"n": [len(pdf)], "s": [x.sum(axis=0)]})

    return df.select(F.col(vec_col).cast("array<double>").alias("v")) \
             .mapInPandas(run, "n long, s array<double>")


def save_model(model: SaeModel, path: str) -> None:
    """The model as a Parquet table under a shared folder: one row per latent
    ``(latent, w_enc, w_dec)`` plus ``bias_pre`` on every row (model-sized)."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    pdf = pd.DataFrame({"latent": np.arange(model.n_latents, dtype=np.int64),
                        "w_enc": model.w_enc.tolist(), "w_dec": model.w_dec.T.tolist(),
                        "bias_pre": [np.asarray(model.bias_pre).tolist()] * model.n_latents})
    spark.createDataFrame(pdf, "latent long, w_enc array<double>, w_dec array<double>, "
                               "bias_pre array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> SaeModel:
    """Read a model written by ``save_model`` (size checked before collecting)."""
    df = spark.read.parquet(path)
    first = df.select(F.count("*").alias("m"), F.max(F.size("w_enc")).alias("d")).first()
    if 2 * first["m"] * first["d"] * 8 > MAX_MODEL_BROADCAST_BYTES:
        raise ValueError("model exceeds the broadcast limit")
    pdf = df.orderBy("latent").toPandas()
    w_enc = np.stack(pdf["w_enc"].to_numpy()).astype(np.float64)
    w_dec = np.stack(pdf["w_dec"].to_numpy()).astype(np.float64).T.copy()
    return SaeModel(w_enc=w_enc, w_dec=w_dec,
                    bias_pre=np.asarray(pdf["bias_pre"].iloc[0], dtype=np.float64))


def mean_vector(df: DataFrame, vec_col: str = "v") -> np.ndarray:
    """Per-dimension mean of a vector column (``bias_pre`` of the fixture).

    NumPy partial sums per Arrow batch; only one row per batch is shuffled
    and one row per dimension reaches the driver.
    """
    parts = _partial_sums(df, vec_col)
    rows = (parts.select("n", F.posexplode("s").alias("pos", "x"))
                 .groupBy("pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
                 .orderBy("pos").collect())
    return np.array([r["s"] / r["n"] for r in rows], dtype=np.float64)


def _matrix(series: pd.Series, d: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, d))
    return np.stack(series.to_numpy()).astype(np.float64, copy=False)


def _pre(x: np.ndarray, w_enc: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return (x - bias) @ w_enc.T


# Cells of the largest rows x latents matrix (64 MB of doubles) of one piece.
PIECE_CELLS = 8_000_000


def _input(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"),
                          F.col(vec_col).cast("array<double>").alias("v"))


def _arrow_matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of an Arrow list column, all of width d, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow list column: so many of the values for each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def _map_pieces(vectors: DataFrame, model: SaeModel, id_col: str, vec_col: str, fn, schema, width: int | None = None) -> DataFrame:
    """Map-only over vectors: ``fn(ids, x, (w_enc, w_dec, bias))`` gives the
    Arrow columns for pieces of rows whose matrix of ``width`` (default: all
    latents) stays under PIECE_CELLS, however many rows a batch has."""
    bc = model.broadcast(vectors.sparkSession)
    d = model.dim
    rows = max(1, PIECE_CELLS // max(model.n_latents if width is None else width, d, 1))
    names = [f.name for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                piece = batch.slice(lo, rows)
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(fn(ids, _arrow_matrix(piece.column(1), d), bc.value), names)

    return _input(vectors, id_col, vec_col).mapInArrow(run, schema)


def pre_activations(vectors: DataFrame, model: SaeModel, id_col: str = "id",
                    vec_col: str = "v") -> DataFrame:
    """z = (x - bias_pre) W_enc^T, one row per (id, latent).  The result
    is rows x latents by definition; the encoders never make these rows."""
    def piece(ids, x, weights):
        z = _pre(x, weights[0], weights[2])
        n, m = z.shape
        return [pa.array(np.repeat(ids, m)), pa.array(np.tile(np.arange(m), n)), pa.array(z.ravel())]

    return _map_pieces(vectors, model, id_col, vec_col, piece, "id long, latent long, z double")


def _masked_codes(ids: np.ndarray, z: np.ndarray, mask: np.ndarray) -> list[pa.Array]:
    """Codes of the marked entries, latents ascending."""
    counts = mask.sum(axis=1)
    return [pa.array(ids), _lists(counts, np.nonzero(mask)[1]), _lists(counts, z[mask])]


def encode_threshold(vectors: DataFrame, model: SaeModel, theta: float,
                     id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Keep latents with z > theta; ids ascending; rows may be empty.

    Output ``(id, ids array<long>, weight array<double>)``, one row per input
    vector, so empty codes still count as documents downstream.
    """
    def piece(ids, x, weights):
        z = _pre(x, weights[0], weights[2])
        return _masked_codes(ids, z, z > theta)

    return _map_pieces(vectors, model, id_col, vec_col, piece, CODE_SCHEMA)


def _top(z: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest entries in their order; of equal
    entries the first columns.  A partial selection: only k a row are sorted."""
    n, m = z.shape
    k = min(k, m)
    if n == 0 or k == 0:
        return np.zeros((n, k), np.int64)
    cut = -np.partition(-z, k - 1, axis=1)[:, k - 1:k]
    above, equal = z > cut, z == cut
    equal &= np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)
    columns = np.nonzero(above | equal)[1].reshape(n, k)
    order = np.argsort(-np.take_along_axis(z, columns, 1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, 1)


def encode_topk(vectors: DataFrame, model: SaeModel, k: int, id_col: str = "id",
                vec_col: str = "v", largest: bool = True) -> DataFrame:
    """E3 (largest) / E4 (smallest): the k extreme pre-activations of each row,
    in score order, no sign filter.  Ties broken by latent id."""
    def piece(ids, x, weights):
        z = _pre(x, weights[0], weights[2])
        columns = _top(z if largest else -z, k)
        counts = np.full(len(ids), columns.shape[1])
        return [pa.array(ids), _lists(counts, columns.ravel()), _lists(counts, np.take_along_axis(z, columns, 1).ravel())]

    return _map_pieces(vectors, model, id_col, vec_col, piece, CODE_SCHEMA)


def encode_bottomk(vectors: DataFrame, model: SaeModel, k: int, id_col: str = "id",
                   vec_col: str = "v") -> DataFrame:
    """The k smallest pre-activations, ascending."""
    return encode_topk(vectors, model, k, id_col, vec_col, largest=False)


MARKED_CODE_SCHEMA = T.StructType([*CODE_SCHEMA.fields, T.StructField("n_above", T.IntegerType())])


def encode_min_active(vectors: DataFrame, model: SaeModel, theta: float, min_active: int,
                      id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """E5: latents above theta (ascending id), topped up per row with the next
    largest pre-activations until ``min_active`` entries exist.

    The first ``n_above`` entries of a row are those above theta, the others
    are top-ups: they count as codes, but the reconstruction leaves them out
    (``threshold_part``)."""
    def piece(ids, x, weights):
        z = _pre(x, weights[0], weights[2])
        mask = z > theta
        above = mask.sum(axis=1)
        short = np.flatnonzero(above < min(min_active, z.shape[1]))
        top = _top(z[short], min_active)                       # its first are those above theta
        extra = np.arange(top.shape[1]) >= above[short, None]
        counts = above.copy()
        counts[short] += extra.sum(axis=1)
        start = np.cumsum(counts) - counts
        columns = np.zeros(int(counts.sum()), np.int64)
        row, column = np.nonzero(mask)
        columns[start[row] + np.arange(len(row)) - (np.cumsum(above) - above)[row]] = column
        row, place = np.nonzero(extra)
        columns[start[short[row]] + place] = top[row, place]
        values = z[np.repeat(np.arange(len(ids)), counts), columns]
        return [pa.array(ids), _lists(counts, columns), _lists(counts, values), pa.array(above, pa.int32())]

    return _map_pieces(vectors, model, id_col, vec_col, piece, MARKED_CODE_SCHEMA)


def threshold_part(codes: DataFrame) -> DataFrame:
    """The codes above theta of ``encode_min_active``: what its reconstruction uses."""
    return codes.withColumns({c: F.slice(c, F.lit(1), F.col("n_above")) for c in ("ids", "weight")}).drop("n_above")


def explode_codes(codes: DataFrame, id_col: str = "id", keep_pos: bool = False) -> DataFrame:
    """H9: parallel arrays to one row per (id, latent)."""
    cols = [F.col(id_col)]
    z = F.posexplode(F.arrays_zip(F.col("ids").alias("latent"), F.col("weight").alias("w")))
    out = codes.select(*cols, z.alias("pos", "lw"))
    sel = [id_col] + (["pos"] if keep_pos else []) + [F.col("lw.latent").alias("latent"),
                                                       F.col("lw.w").alias("w")]
    return out.select(*sel)


def nest_codes(exploded: DataFrame, id_col: str = "id", order_col: str = "latent") -> DataFrame:
    """H9 inverse: rows back to parallel arrays, ordered by ``order_col``.

    One row per id; the size of each group is bounded by the model's latent
    count, not by the data."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"),
                                                  F.col("latent"), F.col("w"))))
    return (exploded.groupBy(id_col).agg(packed.alias("p"))
                    .select(id_col, F.col("p.latent").alias("ids"), F.col("p.w").alias("weight")))


def _decode(counts: np.ndarray, latents: np.ndarray, weights: np.ndarray, atoms: np.ndarray) -> np.ndarray:
    """Sums of weighted decoder directions for rows of so many entries each,
    in pieces whose directions stay under PIECE_CELLS."""
    out = np.zeros((len(counts), atoms.shape[1]))
    ends, row = np.cumsum(counts), 0
    most = max(1, PIECE_CELLS // max(atoms.shape[1], 1))
    while row < len(counts):
        first = ends[row] - counts[row]
        last = max(row + 1, int(np.searchsorted(ends, first + most, "right")))
        some = np.flatnonzero(counts[row:last])
        if len(some):
            own = slice(first, ends[last - 1])
            starts = (ends - counts)[row:last][some] - first
            out[row + some] = np.add.reduceat(atoms[latents[own]] * weights[own, None], starts, axis=0)
        row = last
    return out


def reconstruct(codes: DataFrame, model: SaeModel, id_col: str = "id",
                with_bias: bool = True) -> DataFrame:
    """Z W_dec^T (+ bias_pre) from sparse codes ``(id, ids, weight)``.
    Codes of ``encode_min_active`` are decoded from their part above theta."""
    if "n_above" in codes.columns:
        codes = threshold_part(codes)
    bc = model.broadcast(codes.sparkSession)

    def run(batches):
        _, w_dec, bias = bc.value
        atoms = np.ascontiguousarray(w_dec.T)
        for batch in batches:
            counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            v = _decode(counts, batch.column(1).flatten().to_numpy(zero_copy_only=False),
                        batch.column(2).flatten().to_numpy(zero_copy_only=False), atoms)
            v = v + bias if with_bias else v
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(np.full(len(v), v.shape[1]), v.ravel())], ["id", "v"])

    return (codes.select(F.col(id_col).cast("long").alias("id"), "ids", "weight")
                 .mapInArrow(run, "id long, v array<double>"))


def _batch_kept(x: np.ndarray, w_enc: np.ndarray, bias: np.ndarray, keep_n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of the ``keep_n`` largest pre-activations of a batch, in
    the order of places (row * latents + latent); of equal ones the first.
    Pieces of rows are selected one after another, so no more than a piece
    and twice what is kept is held."""
    m = max(len(w_enc), 1)
    step = max(1, PIECE_CELLS // m)
    places, values = np.zeros(0, np.int64), np.zeros(0)
    for lo in range(0, len(x), step):
        z = _pre(x[lo:lo + step], w_enc, bias).ravel()
        at = np.arange(z.size) + lo * m
        for _ in range(2):          # the piece by itself, then with what is held
            if z.size > keep_n:
                cut = np.partition(z, z.size - keep_n)[z.size - keep_n] if keep_n else np.inf
                keep = z > cut
                keep[np.flatnonzero(z == cut)[:keep_n - np.count_nonzero(keep)]] = True
                z, at = z[keep], at[keep]
            if _ == 0:
                z, at = np.concatenate((values, z)), np.concatenate((places, at))
        places, values = at, z
    return places, values


def batch_topk(vectors: DataFrame, model: SaeModel, k: int, batch_col: str = "batch_id",
               id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Training-time mask, the k*B largest pre-activations of each batch
    of B rows, ties by (id, latent).

    One group per batch; a batch holds B rows (a training parameter, 4096 in
    the reference), so the group size is bounded by the batch size.
    Output ``(batch_id, id, latent, z)`` for the kept entries.
    """
    bc = model.broadcast(vectors.sparkSession)
    d = model.dim

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        w_enc, _, bias = bc.value
        pdf = pdf.sort_values("id", kind="stable")
        places, z = _batch_kept(_matrix(pdf["v"], d), w_enc, bias, k * len(pdf))
        rows, lat = np.divmod(places, max(len(w_enc), 1))
        return pd.DataFrame({"batch_id": np.full(len(z), pdf["batch_id"].iloc[0], dtype=np.int64),
                             "id": pdf["id"].to_numpy(np.int64)[rows], "latent": lat, "z": z})

    return (vectors.select(F.col(batch_col).cast("long").alias("batch_id"),
                           F.col(id_col).cast("long").alias("id"),
                           F.col(vec_col).cast("array<double>").alias("v"))
                   .groupBy("batch_id")
                   .applyInPandas(per_batch, "batch_id long, id long, latent long, z double"))


def calibrate_threshold(kept: DataFrame, compat_rows: int | None = None,
                        batch_size: int | None = None) -> DataFrame:
    """Mean over batches of the smallest kept activation.

    Default divides by the true number of batches; with ``compat_rows`` and
    ``batch_size`` the divisor is floor(N / B) as in the reference (SURVEY L12).
    Output one row ``(n_batches, theta)``.
    """
    per_batch = kept.groupBy("batch_id").agg(F.min("z").alias("cut"))
    agg = per_batch.agg(F.count("*").alias("n_batches"), F.sum("cut").alias("s"))
    if compat_rows is not None and batch_size:
        divisor = F.lit(float(compat_rows // batch_size))
    else:
        divisor = F.col("n_batches").cast("double")
    return agg.select("n_batches", F.try_divide(F.col("s"), divisor).alias("theta"))


def dead_latents(kept: DataFrame, n_latents: int, dead_after: int = 20) -> DataFrame:
    """Per latent, batches since it last fired; dead if more than
    ``dead_after``.  Batches are numbered 0..T-1 in training order."""
    spark = kept.sparkSession
    n_batches = kept.select(F.max("batch_id") + 1).scalar()
    last = kept.groupBy("latent").agg(F.max("batch_id").alias("last_batch"))
    all_latents = spark.range(n_latents).withColumnRenamed("id", "latent")
    since = F.when(F.col("last_batch").isNull(), n_batches) \
             .otherwise(n_batches - 1 - F.col("last_batch"))
    return (all_latents.join(F.broadcast(last) if n_latents <= 1_000_000 else last, "latent", "left")
                       .select("latent", since.cast("long").alias("since_fired"))
                       .withColumn("dead", F.col("since_fired") > F.lit(dead_after)))


def dead_aux_codes(vectors: DataFrame, model: SaeModel, dead: DataFrame, k: int,
                   id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """E10 (codes): per row the 2k largest pre-activations among dead latents
    (fewer if fewer latents are dead), in score order, ties by latent.

    Map-only: a piece of rows meets the dead latents' directions alone, so
    rows x latents never become rows.  Dead latents are a model-sized table."""
    own = np.array(sorted(r[0] for r in dead.filter("dead").select("latent").collect()), np.int64)
    part = SaeModel(model.w_enc[own], model.w_dec[:, own], model.bias_pre)

    def piece(ids, x, weights):
        z = _pre(x, weights[0], weights[2])
        columns = _top(z, 2 * k)
        counts = np.full(len(ids), columns.shape[1])
        return [pa.array(ids), _lists(counts, own[columns].ravel()), _lists(counts, np.take_along_axis(z, columns, 1).ravel())]

    return _map_pieces(vectors, part, id_col, vec_col, piece, CODE_SCHEMA)


# Decoder entries (latents x width) up to which the exploded decoder is broadcast.
MAX_BROADCAST_DECODER_ENTRIES = 4_000_000


def decode_exploded(codes: DataFrame, dictionary: DataFrame, bias: DataFrame | None = None,
                    id_col: str = "id", model_entries: int | None = None) -> DataFrame:
    """Sparse x dense decode in relational form: one row per (id, dim).

    ``codes`` is ``(id, latent, z)``; ``dictionary`` is ``(latent, w_dec)``.
    The exploded decoder (``model_entries`` = latents x width rows) is
    broadcast only up to ``MAX_BROADCAST_DECODER_ENTRIES``; a larger model
    joins by shuffle on ``latent``.  For whole vectors use ``reconstruct``.
    """
    dec = dictionary.select("latent", F.posexplode("w_dec").alias("dim", "wd"))
    small = model_entries is not None and model_entries <= MAX_BROADCAST_DECODER_ENTRIES
    out = (codes.join(F.broadcast(dec) if small else dec, "latent")
                .groupBy(id_col, "dim").agg(F.sum(F.col("z") * F.col("wd")).alias("value")))
    if bias is not None:
        out = (out.join(F.broadcast(bias), "dim")
                  .select(id_col, "dim", (F.col("value") + F.col("b")).alias("value")))
    return out


def bias_table(spark: SparkSession, bias: np.ndarray) -> DataFrame:
    pdf = pd.DataFrame({"dim": np.arange(len(bias), dtype=np.int64), "b": bias.astype(np.float64)})
    return spark.createDataFrame(pdf, "dim long, b double")


def exploded_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "v") -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"),
                          F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim", "x"))


def nmse(vectors: DataFrame, model: SaeModel, theta: float, vec_col: str = "v") -> DataFrame:
    """E12 in bulk: two passes of NumPy partial sums, no per-dimension rows.

    Pass 1 gives the mean vector (one row per batch).  Pass 2 reconstructs
    every batch with the threshold mask and emits its sums of squared errors
    against the reconstruction and against the mean.  One-row result
    ``(mse, baseline_mse, nmse)``, row-weighted (SURVEY L13)."""
    mean = mean_vector(vectors, vec_col)

    def piece(ids, x, weights):
        w_enc, w_dec, bias = weights
        z = _pre(x, w_enc, bias)
        r = np.where(z > theta, z, 0.0) @ w_dec.T + bias
        return [pa.array([x.size]), pa.array([float(((x - r) ** 2).sum())]), pa.array([float(((x - mean) ** 2).sum())])]

    parts = _map_pieces(vectors.withColumn("_no_id", F.lit(0)), model, "_no_id", vec_col, piece, "n long, se double, be double")
    return parts.agg((F.sum("se") / F.sum("n")).alias("mse"),
                     (F.sum("be") / F.sum("n")).alias("baseline_mse")) \
                .withColumn("nmse", F.try_divide(F.col("mse"), F.col("baseline_mse")))


def sae_loss(vectors: DataFrame, model: SaeModel, k: int, dead: DataFrame,
                  alpha: float = 1.0 / 32, batch_col: str = "batch_id", id_col: str = "id",
                  vec_col: str = "v") -> DataFrame:
    """E11 in bulk: per batch (one group of B rows, the batch-size
    parameter) the BatchTopK reconstruction, the dead-latent auxiliary
    reconstruction (top 2k dead pre-activations per row, decoded without
    bias) and the sums of e^2 and (e - dead_recon)^2.  The dead-latent set
    is model-sized and broadcast.  One-row result ``(loss, recon_mse)``."""
    spark = vectors.sparkSession
    dead_ids = np.array(sorted(r[0] for r in dead.filter("dead").select("latent").collect()),
                        dtype=np.int64)
    bc = model.broadcast(spark)
    dead_bc = spark.sparkContext.broadcast(dead_ids)
    d = model.dim

    def per_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        w_enc, w_dec, bias = bc.value
        pdf = pdf.sort_values("id", kind="stable")
        x = _matrix(pdf["v"], d)
        m, atoms, dead_idx = max(len(w_enc), 1), np.ascontiguousarray(w_dec.T), dead_bc.value
        places, z = _batch_kept(x, w_enc, bias, k * len(pdf))
        counts = np.bincount(places // m, minlength=len(x))
        loss = squares = 0.0
        step = max(1, PIECE_CELLS // m)
        first = np.concatenate(([0], np.cumsum(counts)))
        for lo in range(0, len(x), step):
            hi = min(lo + step, len(x))
            own = slice(first[lo], first[hi])
            e = x[lo:hi] - _decode(counts[lo:hi], places[own] % m, z[own], atoms) - bias
            zd = _pre(x[lo:hi], w_enc[dead_idx], bias)
            top = _top(zd, 2 * k)
            aux = _decode(np.full(hi - lo, top.shape[1]), dead_idx[top].ravel(), np.take_along_axis(zd, top, 1).ravel(), atoms)
            loss += float((e * e + alpha * (e - aux) ** 2).sum())
            squares += float((e * e).sum())
        return pd.DataFrame({"n": [x.size], "l": [loss], "e2": [squares]})

    parts = vectors.select(F.col(batch_col).cast("long").alias("batch_id"),
                           F.col(id_col).cast("long").alias("id"),
                           F.col(vec_col).cast("array<double>").alias("v")) \
                   .groupBy("batch_id").applyInPandas(per_batch, "n long, l double, e2 double")
    return parts.agg((F.sum("l") / F.sum("n")).alias("loss"),
                     (F.sum("e2") / F.sum("n")).alias("recon_mse"))


def gradient_pursuit(vectors: DataFrame, model: SaeModel, target_l0: int = 32,
                     id_col: str = "id", vec_col: str = "v") -> DataFrame:
    """Batched gradient matching pursuit on the decoder directions,
    ``target_l0`` rounds, weights clamped at zero.  Rows are independent;
    the row id is kept.  Output ``(id, latent, w)`` for non-zero weights."""
    bc = model.broadcast(vectors.sparkSession)
    d = model.dim

    def run(batches):
        _, w_dec, bias = bc.value
        atoms = np.ascontiguousarray(w_dec.T)
        rows = max(1, PURSUIT_CELLS // max(len(atoms), target_l0 * d))
        for pdf in batches:
            ids = pdf["id"].to_numpy(np.int64)
            for first in range(0, len(pdf), rows):
                x = _matrix(pdf["v"].iloc[first:first + rows], d) - bias
                used, w = _pursue(x, atoms, target_l0)
                row, slot = np.nonzero(w)
                order = np.lexsort((used[row, slot], row))
                row, slot = row[order], slot[order]
                yield pd.DataFrame({"id": ids[first + row], "latent": used[row, slot], "w": w[row, slot]})

    return _input(vectors, id_col, vec_col).mapInPandas(run, "id long, latent long, w double")


# Cells of the largest work array of one pursuit piece (64 MB of doubles).
PURSUIT_CELLS = 8_000_000


def _pursue(x: np.ndarray, atoms: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Latents used and their weights, ``rounds`` slots a row.  Only a row's
    active atoms are kept: the least-squares slope on them, the best step
    along it, and what it leaves of the row."""
    n = len(x)
    used = np.zeros((n, rounds), np.int64)
    w = np.zeros((n, rounds))
    left = x.copy()
    for k in range(rounds):
        best = np.argmax(left @ atoms.T, axis=1)
        active = w != 0
        known = (active & (used == best[:, None])).any(axis=1)
        used[~known, k] = best[~known]           # slot k is free until now
        active[~known, k] = True
        basis = atoms[used] * active[:, :, None]
        slope = np.einsum("nkd,nd->nk", basis, left)
        along = np.einsum("nk,nkd->nd", slope, basis)
        length = (along * along).sum(axis=1)
        step = np.divide((along * left).sum(axis=1), length, out=np.zeros(n), where=length > 0)
        w = np.maximum(w + step[:, None] * slope, 0.0)
        left = x - np.einsum("nk,nkd->nd", w, basis)
    return used, w


#: Latents whose gradients one task adds up.
GRADIENT_BLOCK = 1024


def decoder_gradient(vectors: DataFrame, model: SaeModel, theta: float, id_col: str = "id",
                     vec_col: str = "v") -> DataFrame:
    """Gradient of the mean squared reconstruction error (threshold codes) by
    the decoder: ``(latent, g array<double>)``, a row a latent.

    Every task adds up its own rows and sends blocks of latents; what moves
    and what a task holds is bounded by the model, not by the data."""
    bc = model.broadcast(vectors.sparkSession)
    m, d = model.n_latents, model.dim
    rows = max(1, PIECE_CELLS // max(m, d, 1))

    def part(batches):
        w_enc, w_dec, bias = bc.value
        atoms, g, n = np.ascontiguousarray(w_dec.T), np.zeros((m, d)), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                x = _arrow_matrix(batch.slice(lo, rows).column(1), d)
                z = _pre(x, w_enc, bias)
                z[z <= theta] = 0.0
                g += z.T @ (z @ atoms + bias - x)
                n += len(x)
        for lo in range(0, m if n else 0, GRADIENT_BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([n]), pa.array([g[lo:lo + GRADIENT_BLOCK].tobytes()], pa.binary())],
                                             ["block", "n", "sums"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x) for x in parts["sums"]).reshape(-1, d) * (2.0 / (parts["n"].sum() * d))
        return pd.DataFrame({"latent": np.arange(len(total)) + parts["block"].iat[0], "g": list(total)})

    return (_input(vectors, id_col, vec_col).mapInArrow(part, "block long, n long, sums binary")
            .groupBy("block").applyInPandas(added, "latent long, g array<double>"))


def decoder_unit_norm(dictionary: DataFrame, grad: DataFrame | None = None) -> DataFrame:
    """Divide decoder weights by their norm along the latent axis (one
    norm per input dimension, SURVEY L14) and, when a gradient table is given,
    remove its component parallel to the normalised weights.

    ``dictionary``: ``(latent, w_dec array<double>)`` with ``w_dec[i] = W_dec[i, latent]``;
    ``grad``: same shape ``(latent, g array<double>)``.  Output long form
    ``(latent, dim, w, g)``.
    """
    w = dictionary.select("latent", F.posexplode("w_dec").alias("dim", "w"))
    norms = w.groupBy("dim").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    normed = w.join(F.broadcast(norms), "dim") \
              .select("latent", "dim", (F.col("w") / F.col("norm")).alias("w"))
    if grad is None:
        return normed.withColumn("g", F.lit(None).cast("double"))
    g = grad.select("latent", F.posexplode("g").alias("dim", "g"))
    both = normed.join(g, ["latent", "dim"])
    proj = both.groupBy("dim").agg(F.sum(F.col("g") * F.col("w")).alias("gp"))
    return (both.join(F.broadcast(proj), "dim")
                .select("latent", "dim", "w", (F.col("g") - F.col("gp") * F.col("w")).alias("g")))
