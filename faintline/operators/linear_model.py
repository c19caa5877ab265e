"""Linear reconstruction models: rank-k encoder/decoder and block means.

A linear autoencoder's optimum is the projection on the leading principal components, so the model
is found from one matrix of sums instead of by training. Models are plain tables:
``(model, time_seq, mean)`` and ``(model, component, time_seq, loading)``.

A fit is exact whatever the shape: series of up to ``MAX_SIDE`` samples use the position by position matrix, summed
from one centred partial per task (``fit_linear_ae``); longer ones the same matrix in blocks (``blocked_model``). For few
long series there is also the event by event matrix (``fit_linear_ae_wide``). ``method="subspace"`` asks for repeated
products with a narrow matrix instead, until the variances settle (``fit_linear_ae_subspace``).

A missing sample (null or NaN) counts as its position's mean: it adds nothing to the sums, and is rebuilt from the
event's other samples. Components beyond the data's rank have variance 0 and no loadings.
Matrices of up to ``MAX_MODEL_CELLS`` cells are sent to every task; past larger ones, which are read stretch by stretch,
the events are streamed (``blocked_model``), with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faintline.operators.evaluate import model_errors
from faintline.operators.shape import stack

MAX_SIDE = 4096
FAN_IN = 32  # groups of tasks whose partial matrices are added first
PARTIAL = "row int, vals array<double>"  # one row of a partial matrix
MAX_MODEL_CELLS = 8_000_000  # largest loading matrix handed to tasks as a broadcast (64 MB)


@dataclass(frozen=True)
class LinearModel:
    means: DataFrame  # model, time_seq, mean
    loadings: DataFrame  # model, component, time_seq, loading
    spectrum: DataFrame  # model, component, variance


# ---------------------------------------------------------------- fitting


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a column with one list per row."""
    n, d = matrix.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype="int32") * d, np.ascontiguousarray(matrix).ravel())


def _numbered_rows(matrix: np.ndarray) -> pa.RecordBatch:
    rows = pa.array(np.arange(len(matrix), dtype="int32"))
    return pa.RecordBatch.from_arrays([rows, _lists(matrix)], ["row", "vals"])


def _sum_rows(partials: DataFrame) -> np.ndarray:
    """Add up partial matrices row by row on the executors, in two levels; the driver gets the sum alone."""

    def add(table: pa.Table) -> pa.Table:
        total = _matrix(table["vals"]).sum(axis=0)[None, :]
        return pa.table({"row": table["row"].slice(0, 1), "vals": _lists(total)})

    # first within groups of tasks, so that no task adds up one row of every other task
    some = partials.withColumn("part", F.spark_partition_id() % FAN_IN).groupBy("part", "row").applyInArrow(add, PARTIAL)
    summed = some.groupBy("row").applyInArrow(add, PARTIAL)
    return _matrix(summed.toArrow().sort_by("row")["vals"])


def series_length(arrays: DataFrame, values: str = "vals") -> int:
    lo, hi = arrays.agg(F.min(F.size(values)), F.max(F.size(values))).first()
    if lo != hi:
        raise ValueError(f"series lengths differ: {lo} to {hi}")
    return lo


def _check_rank(k: int, limit: int) -> None:
    if not 1 <= k <= limit:
        raise ValueError(f"k must be between 1 and {limit}")


def _rank(variances: np.ndarray, side: int) -> int:
    """How many of the falling variances are more than rounding errors."""
    return int((variances > max(variances[0], 0.0) * side * np.finfo(float).eps * 8).sum())


def _filled(matrix: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Deviations from the mean; missing samples deviate by nothing."""
    centred = matrix - mean
    centred[np.isnan(centred)] = 0.0
    return centred


def position_means(arrays: DataFrame, d: int, values: str = "vals") -> tuple[np.ndarray, int]:
    """Mean of every position over the events that have a sample there, and the number of events."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, n = np.zeros(d), np.zeros(d), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(values))
                sums += np.nansum(x, axis=0)
                counts += (~np.isnan(x)).sum(axis=0)
                n += len(x)
        if n:
            yield _numbered_rows(np.stack([sums, counts, np.full(d, float(n))]))

    sums, counts, n = _sum_rows(arrays.select(values).mapInArrow(partial, PARTIAL))
    return sums / np.maximum(counts, 1), int(n[0])


def _as_model(spark: SparkSession, name: str, mean: np.ndarray, vectors: np.ndarray, variances: np.ndarray) -> LinearModel:
    d, k = vectors.shape
    component, position = np.meshgrid(np.arange(1, k + 1), np.arange(1, d + 1))
    loadings = pd.DataFrame(
        {
            "model": name,
            "component": component.ravel().astype("int32"),
            "time_seq": position.ravel().astype("int32"),
            "loading": vectors.ravel(),
        }
    )
    means = pd.DataFrame({"model": name, "time_seq": np.arange(1, d + 1, dtype="int32"), "mean": mean})
    return LinearModel(
        spark.createDataFrame(means, "model string, time_seq int, mean double"),
        spark.createDataFrame(loadings, "model string, component int, time_seq int, loading double"),
        _spectrum(spark, name, variances),
    )


def _spectrum(spark: SparkSession, name: str, variances: np.ndarray) -> DataFrame:
    rows = [(name, i + 1, float(v)) for i, v in enumerate(variances)]
    return spark.createDataFrame(rows, "model string, component int, variance double")


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Make the largest entry of every vector positive, so that a fit repeats exactly."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def fit_linear_ae(arrays: DataFrame, k: int, name: str = "linear", values: str = "vals", method: str = "exact") -> LinearModel:
    """Rank-k model of array rows. Each task adds its centred rows into one matrix of sums."""
    if method not in ("exact", "subspace"):
        raise ValueError("method is exact or subspace")
    arrays = arrays.filter(F.col(values).isNotNull())
    if method == "subspace":
        return fit_linear_ae_subspace(arrays, k, name, values)
    d = series_length(arrays, values)
    if d > MAX_SIDE:
        from faintline.operators.blocked_model import fit_blocked

        return fit_blocked(arrays, k, name, values)
    _check_rank(k, d)
    mean, n = position_means(arrays, d, values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = _filled(_matrix(batch.column(values)), mean)
                total += x.T @ x
        if total.any():
            yield _numbered_rows(total)

    sums = arrays.select(values).mapInArrow(partial, PARTIAL)
    gram = _sum_rows(sums) if n else np.zeros((d, d))
    variances, vectors = np.linalg.eigh(gram / max(n, 1)) if gram.size else (np.zeros(d), np.eye(d))
    order = np.argsort(variances)[::-1][:k]
    return _as_model(arrays.sparkSession, name, mean, _signed(vectors[:, order]), np.maximum(variances[order], 0.0))


def fit_linear_ae_wide(
    arrays: DataFrame, k: int, name: str = "linear", values: str = "vals", event: str = "event_id", stretch: int = 1024
) -> LinearModel:
    """Rank-k model of series longer than they are many, from the event by event matrix.

    Work is grouped by stretches of ``stretch`` positions; a group has one short array per event. ``k`` may
    exceed the rank, for instance the number of events.
    """
    d = series_length(arrays, values)
    n, ids = arrays.agg(F.count(event), F.count_distinct(event)).first()
    if n != ids:
        raise ValueError("needs each event once")
    _check_rank(k, d)
    cuts = F.sequence(F.lit(0), F.lit((d - 1) // stretch))
    cut = F.transform(cuts, lambda s: F.slice(values, s * stretch + 1, F.lit(stretch)))
    pieces = arrays.select(event, F.posexplode(cut).alias("stretch", "vals"))

    def centred(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(table.sort_by(event)["vals"])
        mean = np.nansum(x, axis=0) / np.maximum((~np.isnan(x)).sum(axis=0), 1)
        return _filled(x, mean), mean

    def partial(table: pa.Table) -> pa.Table:
        x, _ = centred(table)
        return pa.Table.from_batches([_numbered_rows(x @ x.T)])

    gram = _sum_rows(pieces.groupBy("stretch").applyInArrow(partial, PARTIAL))
    values_, vectors = np.linalg.eigh(gram)
    order = np.argsort(values_)[::-1][:k]
    variances = np.append(np.maximum(values_[order], 0.0) / n, np.zeros(max(0, k - n)))
    rank = max(1, _rank(values_[order], max(n, d)))
    variances[rank:] = 0.0
    roots = np.sqrt(np.maximum(values_[order[:rank]], np.finfo(float).tiny))
    weights = vectors[:, order[:rank]] / roots

    def loadings_of(table: pa.Table) -> pa.Table:
        x, mean = centred(table)
        first = table["stretch"][0].as_py() * stretch + 1
        positions = np.arange(first, first + len(mean), dtype="int32")
        return pa.table({"time_seq": positions, "mean": mean, "loadings": _lists(x.T @ weights)})

    solved = pieces.groupBy("stretch").applyInArrow(loadings_of, "time_seq int, mean double, loadings array<double>")
    model = F.lit(name).alias("model")
    return LinearModel(
        solved.select(model, "time_seq", "mean"),
        solved.select(model, "time_seq", F.posexplode("loadings").alias("c", "loading")).select(
            "model", (F.col("c") + 1).alias("component"), "time_seq", "loading"
        ),
        _spectrum(arrays.sparkSession, name, variances),
    )


def fit_linear_ae_subspace(
    arrays: DataFrame, k: int, name: str = "linear", values: str = "vals", rounds: int | None = None, extra: int = 8,
    seed: int = 23, tolerance: float = 1e-9,
) -> LinearModel:
    """Rank-k model by block power iteration (randomised subspace iteration).

    Every round reads the rows once and multiplies them by a matrix of ``k + extra`` columns, which
    is also all that a task emits. Rounds go on until no variance changes by more than ``tolerance`` of
    the largest, or for exactly ``rounds`` rounds if given.
    """
    spark = arrays.sparkSession
    d = series_length(arrays, values)
    width = min(k + extra, d)
    _check_rank(k, d)
    mean, n = position_means(arrays, d, values)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    before, done = np.full(width, np.inf), 0
    while True:
        shared = spark.sparkContext.broadcast(basis)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, total = shared.value, np.zeros((d, width))
            for batch in batches:
                if batch.num_rows:
                    x = _filled(_matrix(batch.column(values)), mean)
                    total += x.T @ (x @ q)
            if total.any():
                yield _numbered_rows(total)

        image = _sum_rows(arrays.select(values).mapInArrow(partial, PARTIAL)) / n
        inner = basis.T @ image
        variances, turn = np.linalg.eigh((inner + inner.T) / 2)
        ritz = basis @ turn[:, ::-1]
        done += 1
        settled = np.abs(variances - before)[-k:].max() <= tolerance * max(variances[-1], np.finfo(float).tiny)
        if done == rounds or (rounds is None and settled):
            break
        before = variances
        basis = np.linalg.qr(image)[0]
    return _as_model(spark, name, mean, _signed(ritz[:, :k]), np.maximum(variances[::-1][:k], 0.0))


# ---------------------------------------------------------------- saving


def save_model(model: LinearModel, path: str) -> None:
    model.means.write.mode("overwrite").parquet(f"{path}/means")
    model.loadings.write.mode("overwrite").parquet(f"{path}/loadings")
    model.spectrum.write.mode("overwrite").parquet(f"{path}/spectrum")


def load_model(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel(
        spark.read.schema("model string, time_seq int, mean double").parquet(f"{path}/means"),
        spark.read.schema("model string, component int, time_seq int, loading double").parquet(f"{path}/loadings"),
        spark.read.schema("model string, component int, variance double").parquet(f"{path}/spectrum"),
    )


# ---------------------------------------------------------------- applying


def _small_matrices(model: LinearModel) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean vector and loading matrix when they are small enough for every task, else None."""
    if model.loadings.limit(MAX_MODEL_CELLS + 1).count() > MAX_MODEL_CELLS:
        return None
    means = model.means.select("time_seq", "mean").toArrow().sort_by("time_seq")
    table = model.loadings.select("time_seq", "component", "loading").toArrow()
    table = table.sort_by([("time_seq", "ascending"), ("component", "ascending")])
    return means["mean"].to_numpy(), table["loading"].to_numpy().reshape(len(means), -1)


def encode(arrays: DataFrame, model: LinearModel, values: str = "vals") -> DataFrame:
    """Latent table ``event_id, component, z``."""
    small = _small_matrices(model)
    if small is None:
        from faintline.operators.blocked_model import encode_blocked

        zs = encode_blocked(arrays, model, values)
        return zs.select("event_id", F.posexplode("zs").alias("c", "z")).select("event_id", (F.col("c") + 1).alias("component"), "z")
    shared = arrays.sparkSession.sparkContext.broadcast(small)

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, w = shared.value
        for batch in batches:
            if batch.num_rows:
                zs = _lists(_filled(_matrix(batch.column(values)), mean) @ w)
                yield pa.RecordBatch.from_arrays([batch.column("event_id"), zs], ["event_id", "zs"])

    zs = arrays.select("event_id", values).mapInArrow(latent, "event_id long, zs array<double>")
    return zs.select("event_id", F.posexplode("zs").alias("c", "z")).select(
        "event_id", (F.col("c") + 1).alias("component"), "z"
    )


def score_arrays(arrays: DataFrame, model: LinearModel, values: str = "vals") -> DataFrame:
    """Reconstructions as arrays ``event_num, target, actual, pred``."""
    small = _small_matrices(model)
    if small is None:
        from faintline.operators.blocked_model import score_blocked

        parts = F.sort_array(F.collect_list(F.struct("stretch", "actual", "pred")))
        rows = score_blocked(arrays, model, values).groupBy("row", "event_num", "target").agg(parts.alias("p"))
        return rows.select("event_num", "target", F.flatten("p.actual").alias("actual"), F.flatten("p.pred").alias("pred"))
    return _rebuild(arrays, small, values)


def _rebuild(
    arrays: DataFrame, small: tuple[np.ndarray, np.ndarray], values: str, ranks: Sequence[int] = ()
) -> DataFrame:
    """Reconstructions from the first k components for every k in ``ranks`` (all components if none)."""
    shared = arrays.sparkSession.sparkContext.broadcast(small)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, w = shared.value
        for batch in batches:
            if batch.num_rows:
                centred = _filled(_matrix(batch.column("actual")), mean)
                for k in ranks or [w.shape[1]]:
                    pred = _lists(centred @ w[:, :k] @ w[:, :k].T + mean)
                    dims = pa.array(np.full(batch.num_rows, k, dtype="int32"))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pred, dims], [*batch.schema.names, "pred", "latent_dims"])

    rows = arrays.select(F.col("event_id").alias("event_num"), "target", F.col(values).alias("actual"))
    schema = "event_num long, target string, actual array<double>, pred array<double>, latent_dims int"
    scored = rows.mapInArrow(rebuild, schema)
    return scored if ranks else scored.drop("latent_dims")


def predictions_long(preds: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Array predictions as one row per sample."""
    keys = ["event_num", "target", *more]
    return preds.select(*keys, F.posexplode(F.arrays_zip("actual", "pred")).alias("pos", "s")).select(
        *keys, (F.col("pos") + 1).alias("time_seq"), F.col("s.actual").alias("actual"), F.col("s.pred").alias("pred")
    )


def score(arrays: DataFrame, model: LinearModel, values: str = "vals") -> DataFrame:
    """Predictions ``event_num, target, time_seq, actual, pred``, one row per sample."""
    small = _small_matrices(model)
    if small is None:
        from faintline.operators.blocked_model import STRETCH, score_blocked

        return pieces_long(score_blocked(arrays, model, values), STRETCH)
    return predictions_long(_rebuild(arrays, small, values))


def pieces_long(pieces: DataFrame, stretch: int) -> DataFrame:
    """Predictions by event and stretch as one row per sample."""
    at = F.col("stretch") * stretch + F.col("pos") + 1
    rows = pieces.select("event_num", "target", "stretch", F.posexplode(F.arrays_zip("actual", "pred")).alias("pos", "s"))
    return rows.select("event_num", "target", at.cast("int").alias("time_seq"), F.col("s.actual").alias("actual"), F.col("s.pred").alias("pred"))


# ---------------------------------------------------------------- block means


def _check_block(length: int, block: int) -> None:
    if length % block:
        raise ValueError(f"block {block} does not divide the series length {length}")


def block_mean_array(values: str, block: int) -> Column:
    """An array with every block of ``block`` elements replaced by its mean.

    The block must divide the array's length; other lengths raise while the job runs. Missing samples
    are skipped, as in the long form; a block of them only has a null mean. An empty array stays empty.
    """
    n_blocks = (F.size(values) / block).cast("int")
    checked = F.when(F.size(values) % block != 0, F.raise_error(F.lit(f"block {block} does not divide the series"))).otherwise(n_blocks)

    def mean_of(b):
        part = F.slice(values, b * block + 1, F.lit(block))
        found = F.filter(part, lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x), F.size(found))

    latent = F.transform(F.sequence(F.lit(0), checked - 1), mean_of)
    repeated = F.flatten(F.transform(latent, lambda m: F.array_repeat(m, block)))
    return F.when(F.size(values) == 0, F.array().cast("array<double>")).otherwise(repeated)


def block_mean_arrays(arrays: DataFrame, block: int, values: str = "vals") -> DataFrame:
    """Block-mean reconstruction of array rows: computed inside each row, no shuffle."""
    return arrays.select(
        F.col("event_id").alias("event_num"),
        "target",
        F.col(values).alias("actual"),
        block_mean_array(values, block).alias("pred"),
    )


def block_mean_long(rows: DataFrame, block: int) -> DataFrame:
    """Block-mean reconstruction of long rows; windows are only ``block`` samples long."""
    w = Window.partitionBy("event_id", "target", F.floor((F.col("time_seq") - 1) / block))
    return rows.select(
        F.col("event_id").alias("event_num"), "target", "time_seq", F.col("strain").alias("actual"), F.avg("strain").over(w).alias("pred")
    )


def block_mean_latent(rows: DataFrame, block: int) -> DataFrame:
    """Latent table of the block-mean model."""
    component = (F.floor((F.col("time_seq") - 1) / block) + 1).cast("int")
    return rows.groupBy("event_id", component.alias("component")).agg(F.avg("strain").alias("z"))


def sweep_block_means(arrays: DataFrame, blocks: Sequence[int], length: int, values: str = "vals") -> DataFrame:
    """Predictions of several block sizes from one reading, marked with their latent length."""
    for block in blocks:
        _check_block(length, block)
    models = [F.struct(F.lit(length // b).alias("latent_dims"), block_mean_array(values, b).alias("pred")) for b in blocks]
    preds = arrays.select(
        F.col("event_id").alias("event_num"), "target", F.col(values).alias("actual"), F.explode(F.array(*models)).alias("m")
    )
    return predictions_long(preds.select("event_num", "target", "m.latent_dims", "actual", "m.pred"), ["latent_dims"])


def sweep_loss(preds: DataFrame) -> DataFrame:
    """Loss table ``k, loss`` of a sweep."""
    return model_errors(preds, "latent_dims").withColumnsRenamed({"latent_dims": "k", "av_mse": "loss"})


def sweep_linear(arrays: DataFrame, background: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Predictions of linear models of several ranks, from one fit of the largest and one reading."""
    largest = fit_linear_ae(background, max(ks))
    small = _small_matrices(largest)
    if small is not None:
        return predictions_long(_rebuild(arrays, small, "vals", list(ks)), ["latent_dims"])
    parts = []
    for k in ks:
        keep = F.col("component") <= k
        model = LinearModel(largest.means, largest.loadings.filter(keep), largest.spectrum.filter(keep))
        parts.append(score(arrays, model).withColumn("latent_dims", F.lit(k)))
    return stack([p.select("event_num", "target", "latent_dims", "time_seq", "actual", "pred") for p in parts])
