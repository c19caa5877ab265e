"""Linear reconstruction models of long series, fitted and applied in blocks of positions.

Series are cut into stretches of ``stretch`` positions. Matrices over positions are tables of blocks:

* the symmetric matrix of sums: ``p, q, tile, vals`` for stretches ``p <= q``, ``TILE`` rows of a block per row.
  Partial blocks of groups of events are summed in a shuffle, so a task holds one block.
* narrow matrices (a few columns): ``stretch, tile, vals``.

``leading`` finds the largest eigenvalues by the block Lanczos method with full reorthogonalisation: each step
multiplies the newest columns by the matrix of sums, block by block, and takes from the driver only the small
projected matrix. It stops when the residuals of all wanted pairs are below a tolerance, and restarts from the best
vectors when the basis is full. Loadings are written by tasks.

Models are applied by streaming: a task reads one stretch of the model once, and events pass by it. The model is copied
``lanes`` times, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintline.operators import linear_model as lm
from faintline.session import settle

STRETCH = 2048
TILE = 128
GROUP = 2048  # events whose sums one task adds up
WIDTH = 32  # columns of a Lanczos step
LANES = 4
BLOCK = "p int, q int, tile int, vals array<double>"
PANEL = "stretch int, tile int, vals array<double>"


def _tiles(keys: dict[str, int], matrix: np.ndarray) -> list[dict]:
    return [{**keys, "tile": at // TILE, "vals": matrix[at : at + TILE].ravel()} for at in range(0, len(matrix), TILE)]


def _table(rows: list[dict], names: list[str]) -> pa.Table:
    columns = [pa.array([r[n] for r in rows], pa.int32()) for n in names[:-1]]
    return pa.table([*columns, pa.array([r["vals"] for r in rows], pa.list_(pa.float64()))], names)


def _adding(keys: list[str]) -> Callable[[pa.Table], pa.Table]:
    def add(table: pa.Table) -> pa.Table:
        total = lm._matrix(table["vals"]).sum(axis=0)[None, :]
        return pa.table([*[table[k].slice(0, 1) for k in keys], lm._lists(total)], [*keys, "vals"])

    return add


def _slice_of(values: str, stretch: int, which: Column) -> Column:
    return F.slice(values, which * stretch + 1, F.lit(stretch))


# ---------------------------------------------------------------- the matrix of sums


def gram(arrays: DataFrame, mean: np.ndarray, n: int, stretch: int, values: str = "vals") -> DataFrame:
    """Covariances of positions, divided by ``n``, as blocks ``p, q, tile, vals`` with ``p <= q``."""
    parts, groups = -(-len(mean) // stretch), max(1, -(-n // GROUP))
    rows = arrays.select((F.monotonically_increasing_id() % groups).cast("int").alias("g"), values)
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("q", F.explode(F.sequence("p", F.lit(parts - 1))))
    rows = rows.select("g", "p", "q", _slice_of(values, stretch, F.col("p")).alias("x"), _slice_of(values, stretch, F.col("q")).alias("y"))

    def product(table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        x = lm._filled(lm._matrix(table["x"]), mean[p * stretch : (p + 1) * stretch])
        y = x if p == q else lm._filled(lm._matrix(table["y"]), mean[q * stretch : (q + 1) * stretch])
        return _table(_tiles({"p": p, "q": q}, x.T @ y / n), ["p", "q", "tile", "vals"])

    partial = rows.groupBy("p", "q", "g").applyInArrow(product, BLOCK)
    return settle(partial.groupBy("p", "q", "tile").applyInArrow(_adding(["p", "q", "tile"]), BLOCK), "gram")


def multiply(blocks: DataFrame, panel: DataFrame, d: int, stretch: int) -> DataFrame:
    """The matrix of sums times a narrow matrix."""
    last = -(-d // stretch) - 1
    s = F.col("stretch")
    above = F.transform(F.sequence(F.lit(0), s), lambda p: F.struct(p.alias("p"), s.alias("q")))
    below = F.when(s < last, F.transform(F.sequence(s + 1, F.greatest(s + 1, F.lit(last))), lambda q: F.struct(s.alias("p"), q.alias("q"))))
    keys = F.concat(above, F.coalesce(below, F.array().cast("array<struct<p:int,q:int>>")))
    dealt = panel.select(F.explode(keys).alias("k"), "stretch", "tile", "vals").select("k.p", "k.q", "stretch", "tile", "vals")

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        p, q = left["p"][0].as_py(), left["q"][0].as_py()
        side = {}
        for which in {p, q}:
            rows = right.filter(pc.equal(right["stretch"], which)).sort_by("tile")
            n_rows = min(stretch, d - which * stretch)
            side[which] = np.concatenate([v.as_py() for v in rows["vals"]]).reshape(n_rows, -1)
        out, behind = [], np.zeros_like(side[q])
        for tile, vals in zip(left["tile"].to_pylist(), left["vals"]):
            part = vals.values.to_numpy().reshape(-1, len(side[q]))
            out.append({"stretch": p, "tile": tile, "vals": (part @ side[q]).ravel()})
            if p != q:
                behind += part.T @ side[p][tile * TILE : tile * TILE + len(part)]
        if p != q:
            out += _tiles({"stretch": q}, behind)
        return _table(out, ["stretch", "tile", "vals"])

    parts = blocks.groupBy("p", "q").cogroup(dealt.groupBy("p", "q")).applyInArrow(product, PANEL)
    return parts.groupBy("stretch", "tile").applyInArrow(_adding(["stretch", "tile"]), PANEL)


# ---------------------------------------------------------------- narrow matrices


def _map(panel: DataFrame, change: Callable[[np.ndarray, np.ndarray | None], np.ndarray], width: int, other: int = 0) -> DataFrame:
    """Each tile changed by a function of its ``vals`` (and of ``more``, a second matrix of ``other`` columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                x = batch.column("vals")[k].values.to_numpy().reshape(-1, width)
                more = batch.column("more")[k].values.to_numpy().reshape(-1, other) if other else None
                rows.append({"stretch": batch.column("stretch")[k].as_py(), "tile": batch.column("tile")[k].as_py(), "vals": change(x, more).ravel()})
            yield from _table(rows, ["stretch", "tile", "vals"]).to_batches()

    return panel.mapInArrow(run, PANEL)


def _sum(panel: DataFrame, part: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, other: int) -> np.ndarray:
    """The sum over tiles of a small matrix made from both matrices' tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.column("vals")[k].values.to_numpy().reshape(-1, width)
                made = part(x, batch.column("more")[k].values.to_numpy().reshape(-1, other))
                total = made if total is None else total + made
        if total is not None:
            yield lm._numbered_rows(total)

    return lm._sum_rows(panel.mapInArrow(run, lm.PARTIAL))


def _beside(panel: DataFrame, more: DataFrame) -> DataFrame:
    return panel.join(more.withColumnRenamed("vals", "more"), ["stretch", "tile"])


def _random(template: DataFrame, d: int, stretch: int, width: int, seed: int) -> DataFrame:
    """A random matrix whose tiles depend on the seed and their place only."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n_rows = min(TILE, min(stretch, d - s * stretch) - t * TILE)
                rows.append({"stretch": s, "tile": t, "vals": np.random.default_rng([seed, s, t]).standard_normal(n_rows * width)})
            yield from _table(rows, ["stretch", "tile", "vals"]).to_batches()

    return template.select("stretch", "tile").mapInArrow(draw, PANEL)


def _orthonormal(n2: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """From the inner products of columns: the combination that makes them orthonormal, and the way back."""
    values, vectors = np.linalg.eigh((n2 + n2.T) / 2)
    keep = values > scale**2
    roots = np.sqrt(values[keep])
    return vectors[:, keep] / roots, roots[:, None] * vectors[:, keep].T


def leading(blocks: DataFrame, d: int, k: int, stretch: int, width: int | None = None, tolerance: float = 1e-10, seed: int = 29) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` largest eigenvalues, falling, and their vectors as a narrow matrix.

    Fewer than ``k`` come back only if the matrix has no more directions than that. The driver holds the projected
    matrix, whose side is at most ``2 * k + 4 * width``.
    """
    width = min(d, width or max(WIDTH, min(256, k // 8)))
    capacity = min(d, 2 * k + 4 * width)
    spark = blocks.sparkSession
    sizes = [(s, t) for s in range(-(-d // stretch)) for t in range(-(-min(stretch, d - s * stretch) // TILE))]
    template = spark.createDataFrame(sizes, "stretch int, tile int")

    def appended(basis: DataFrame | None, m: int, new: DataFrame, w: int, scale: float) -> tuple[DataFrame, int, np.ndarray, np.ndarray]:
        """The basis with ``new``, made orthogonal to it and within itself; its products with the basis, and the way back."""
        if basis is None:
            both = _beside(new, new)
            turn, back = _orthonormal(_sum(both, lambda x, y: x.T @ x, w, w), scale)
            return settle(_map(new, lambda x, _: x @ turn, w), "basis"), turn.shape[1], np.zeros((0, w)), back
        both = settle(_beside(basis, new), "step")
        once = _sum(both, lambda b, z: b.T @ z, m, w)

        def again(b: np.ndarray, z: np.ndarray) -> np.ndarray:
            left = z - b @ once
            return np.concatenate([b.T @ left, left.T @ left])

        found = _sum(both, again, m, w)
        twice, n2 = found[:m], found[m:]
        whole = once + twice
        turn, back = _orthonormal(n2 - twice.T @ twice, scale)
        if not turn.shape[1]:
            return basis, 0, whole, back
        grown = _map(both, lambda b, z: np.concatenate([b, (z - b @ whole) @ turn], axis=1), m, w)
        return settle(grown, "basis"), turn.shape[1], whole, back

    basis, m, _, _ = appended(None, 0, _random(template, d, stretch, width, seed), width, 0.0)
    newest, projected, confirmed, draws = m, np.zeros((m, m)), None, 1
    while True:
        start = m - newest
        image = multiply(blocks, _map(basis, lambda x, _: x[:, start:], m), d, stretch)
        scale = 1e-12 * max(np.abs(projected).max(initial=0.0), np.finfo(float).tiny)
        image = settle(image, "image")
        grown, new, products, back = appended(basis, m, image, newest, max(scale, 1e-300))
        projected[:, start:] = products
        projected[start:, :] = products.T
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        top = min(k, m)
        limit = tolerance * max(values[0], np.finfo(float).tiny)
        residuals = np.linalg.norm(back @ turn[start:, :top], axis=0) if new else np.zeros(top)
        if m >= d or (m >= k and new and residuals.max() <= limit):
            break
        if not new or residuals.max() <= limit:
            # the basis is closed under the matrix: other directions are tried until they bring no larger values
            if confirmed is not None and len(confirmed) == top and top == k and np.abs(values[:top] - confirmed).max() <= limit:
                break
            confirmed = values[:top].copy()
            w = min(width, d - m)
            grown, new, _, _ = appended(basis, m, _random(template, d, stretch, w, seed + draws), w, 1e-8)
            draws += 1
            if not new:
                break
            products = None
        if m + new > capacity and products is not None and m > k + width:
            keep = k + width
            old = m
            grown = settle(_map(grown, lambda x, _: np.concatenate([x[:, :old] @ turn[:, :keep], x[:, old:]], axis=1), old + new), "basis")
            projected, m = np.diag(values[:keep]), keep
        projected = np.pad(projected, (0, new))
        basis, m, newest = grown, m + new, new
    vectors = turn[:, : min(k, m)]
    return np.maximum(values[: min(k, m)], 0.0), settle(_map(basis, lambda x, _: x @ vectors, m), "vectors")


# ---------------------------------------------------------------- fitting


def _entries(panel: DataFrame, width: int, stretch: int) -> DataFrame:
    """``time_seq, row``: the rows of a narrow matrix."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, t, vals in zip(batch.column("stretch").to_pylist(), batch.column("tile").to_pylist(), batch.column("vals")):
                x = vals.values.to_numpy().reshape(-1, width)
                first = s * stretch + t * TILE + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x), dtype="int32")), lm._lists(x)], ["time_seq", "row"])

    return panel.mapInArrow(rows, "time_seq int, row array<double>")


def fit_blocked(
    arrays: DataFrame, k: int, name: str = "linear", values: str = "vals", stretch: int = STRETCH, width: int | None = None, tolerance: float = 1e-10
) -> lm.LinearModel:
    """Rank-k model of array rows of any length and number, within blocks of ``stretch`` positions.

    Missing samples count as their position's mean; components beyond the data's rank have variance 0 and no loadings.
    """
    arrays = arrays.filter(F.col(values).isNotNull())
    spark, d = arrays.sparkSession, lm.series_length(arrays, values)
    lm._check_rank(k, d)
    mean, n = lm.position_means(arrays, d, values)
    variances, vectors = leading(gram(arrays, mean, n, stretch, values), d, k, stretch, width, tolerance)
    found, rank = len(variances), lm._rank(variances, max(n, d))
    variances = np.append(np.where(np.arange(found) < rank, variances, 0.0), np.zeros(k - found))
    loadings = _entries(vectors, found, stretch).select("time_seq", F.posexplode("row").alias("c", "loading"))
    loadings = settle(loadings.filter(F.col("c") < max(rank, 1)).select((F.col("c") + 1).alias("component"), "time_seq", "loading"), "loadings")
    # the largest entry of every vector is positive, so that a fit repeats
    sign = loadings.groupBy("component").agg(F.max_by(F.signum("loading"), F.struct(F.round(F.abs("loading"), 9), -F.col("time_seq"))).alias("sign"))
    signed = loadings.join(F.broadcast(sign), "component")  # a row per component
    means = pd.DataFrame({"model": name, "time_seq": np.arange(1, d + 1, dtype="int32"), "mean": mean})
    return lm.LinearModel(
        spark.createDataFrame(means, "model string, time_seq int, mean double"),
        signed.select(F.lit(name).alias("model"), "component", "time_seq", (F.col("loading") * F.col("sign")).alias("loading")),
        lm._spectrum(spark, name, variances),
    )


def denoised(model: lm.LinearModel, noise: float) -> lm.LinearModel:
    """The model that best rebuilds clean series from series with independent noise of standard deviation ``noise``.

    With the noise integrated out, the best linear map of rank k is V diag(l / (l + noise^2)) V' with the leading
    variances l and vectors V; encoder and decoder each get the root of the factor. No noise changes nothing.
    """
    if noise < 0:
        raise ValueError("noise must not be negative")
    kept = F.coalesce(F.try_divide(F.col("variance"), F.col("variance") + F.lit(float(noise) ** 2)), F.lit(1.0))
    factor = model.spectrum.select("component", F.sqrt(kept).alias("factor"))
    loadings = model.loadings.join(F.broadcast(factor), "component")  # a row per component
    return lm.LinearModel(model.means, loadings.select("model", "component", "time_seq", (F.col("loading") * F.col("factor")).alias("loading")), model.spectrum)


# ---------------------------------------------------------------- applying


def _heads(model: lm.LinearModel, stretch: int, lanes: int) -> DataFrame:
    """The model's rows, ``lanes`` copies: they come before the events of their stretch and lane."""
    rows = model.loadings.groupBy("time_seq").agg(F.sort_array(F.collect_list(F.struct("component", "loading"))).alias("l"))
    rows = model.means.join(rows, "time_seq", "left").select("time_seq", "mean", F.col("l.loading").alias("ws"))
    which = F.floor((F.col("time_seq") - 1) / stretch).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    return rows.select(which.alias("stretch"), "time_seq", "mean", "ws", copies.alias("lane"))


def _pieces(rows: DataFrame, values: str, stretch: int, lanes: int, more: list[str]) -> DataFrame:
    cuts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / stretch).cast("int"))
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int").alias("lane")
    return rows.select("row", lane, *more, values, F.explode(cuts).alias("stretch")).select(
        "row", "lane", "stretch", *more, _slice_of(values, stretch, F.col("stretch")).alias("x")
    )


def _past_model(heads: DataFrame, pieces: DataFrame, apply: Callable, schema: str) -> DataFrame:
    """Stream pieces of events past the model's stretch: ``apply(batch, mean, loadings)`` gives a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mean, loadings, w = None, [], [], None
        for batch in batches:
            keys = list(zip(batch.column("stretch").to_pylist(), batch.column("lane").to_pylist()))
            head = batch.column("time_seq").is_valid().to_pylist()
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or head[i] != head[i - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if keys[lo] != key:
                    key, mean, loadings, w = keys[lo], [], [], None
                if head[lo]:
                    mean.append(part.column("mean").to_numpy())
                    loadings.append(lm._matrix(part.column("ws")))
                else:
                    if w is None:
                        mean, w = np.concatenate(mean), np.concatenate(loadings)
                        loadings = []
                    yield apply(part, mean, w)

    parts = heads.unionByName(pieces, allowMissingColumns=True)
    order = F.col("time_seq").asc_nulls_last()
    dealt = parts.repartition("stretch", "lane").sortWithinPartitions("stretch", "lane", order)
    return dealt.mapInArrow(run, schema)


def _rows(arrays: DataFrame, values: str) -> DataFrame:
    target = F.col("target") if "target" in arrays.columns else F.lit(None).cast("string")
    rows = arrays.filter(F.col(values).isNotNull())
    return settle(rows.select(F.monotonically_increasing_id().alias("row"), "event_id", target.alias("target"), F.col(values).alias("vals")), "series")


def _latent(rows: DataFrame, heads: DataFrame, stretch: int, lanes: int) -> DataFrame:
    """``row, zs``, summed over stretches in their order."""

    def project(batch: pa.RecordBatch, mean: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        zs = lm._lists(lm._filled(lm._matrix(batch.column("x")), mean) @ w)
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("stretch"), zs], ["row", "stretch", "zs"])

    parts = _past_model(heads, _pieces(rows, "vals", stretch, lanes, []), project, "row long, stretch int, zs array<double>")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("stretch", "zs"))), lambda s: s["zs"])  # a short array per stretch

    def add(a, b):
        return F.zip_with(a, b, lambda x, y: x + y)

    grouped = parts.groupBy("row").agg(ordered.alias("all"))
    return grouped.select("row", F.reduce(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.get("all", F.lit(0)), add).alias("zs"))


def encode_blocked(arrays: DataFrame, model: lm.LinearModel, values: str = "vals", stretch: int = STRETCH, lanes: int = LANES) -> DataFrame:
    """``event_id, zs``: an array of latent values per event."""
    rows = _rows(arrays, values)
    return rows.select("row", "event_id").join(_latent(rows, _heads(model, stretch, lanes), stretch, lanes), "row").select("event_id", "zs")


def score_blocked(arrays: DataFrame, model: lm.LinearModel, values: str = "vals", stretch: int = STRETCH, lanes: int = LANES) -> DataFrame:
    """``row, event_num, target, stretch, actual, pred``: a row per event and stretch; ``row`` tells events apart."""
    rows, heads = _rows(arrays, values), _heads(model, stretch, lanes)
    known = rows.join(_latent(rows, heads, stretch, lanes), "row")
    pieces = _pieces(known, "vals", stretch, lanes, ["event_id", "target", "zs"])

    def rebuild(batch: pa.RecordBatch, mean: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        pred = lm._lists(lm._matrix(batch.column("zs")) @ w.T + mean)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "event_id", "target", "stretch", "x")], pred], ["row", "event_num", "target", "stretch", "actual", "pred"])

    return _past_model(heads, pieces, rebuild, "row long, event_num long, target string, stretch int, actual array<double>, pred array<double>")
