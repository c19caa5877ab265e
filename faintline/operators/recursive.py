"""Recursive filters along series of any length, by a scan of affine state maps.

A cascade of second-order sections is one linear system with a short state. Over a block of rows the state
at the end is a fixed matrix (its power is the number of rows) times the state at the start, plus what the
block's samples add. So tasks first compute what each block adds, one small row per block is composed in order, and the
blocks run again from their true start states. Running that forward and then backward gives a filter
without phase shift. Within a block, short chunks run side by side and are corrected by their start states in
the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.operators.blocks import MARGIN_ROWS, row_index
from faintline.operators.signal import BAND_HZ, LINES_HZ, SAMPLE_RATE_HZ
from faintline.session import settle

CHUNK = 128


@dataclass(frozen=True)
class System:
    """state' = a state + b x; y = c state + d x."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float


def system(sections: Sequence[Sequence[float]]) -> System:
    """Sections ``b0, b1, b2, a1, a2`` (a0 = 1), each fed by the one before, as one system of two states a section."""
    n = 2 * len(sections)
    a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b0, b1, b2, a1, a2) in enumerate(sections):
        own, inner, enters = slice(2 * k, 2 * k + 2), np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        a[own] = np.outer(enters, c)
        a[own, own] = inner
        b[own] = enters * d
        c, d = b0 * c, b0 * d
        c[2 * k] += 1.0
    return System(a, b, c, d)


def band_pass_sections(low: float, high: float, rate: float, order: int = 4) -> list[list[float]]:
    """A Butterworth band pass: ``order`` sections, by the bilinear transform with both edges kept in place."""
    if not 0 < low < high < rate / 2:
        raise ValueError("needs 0 < low < high < half the rate")
    twice = 2 * rate
    lo, hi = (twice * np.tan(np.pi * f / rate) for f in (low, high))
    k = np.arange(order)
    half = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)) * (hi - lo) / 2
    root = np.sqrt(half**2 - lo * hi + 0j)
    analog = np.concatenate([half + root, half - root])
    poles = (twice + analog) / (twice - analog)
    gain = ((hi - lo) * twice) ** order / np.prod(twice - analog).real
    complex_ = poles[poles.imag > 1e-12 * np.abs(poles)]
    real = np.sort(poles[np.abs(poles.imag) <= 1e-12 * np.abs(poles)].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in complex_] + [(-(x + y), x * y) for x, y in zip(real[::2], real[1::2])]
    each = gain ** (1 / order)
    return [[each, 0.0, -each, float(a1), float(a2)] for a1, a2 in pairs]


def notch_section(line: float, rate: float, quality: float = 30.0) -> list[float]:
    """A section that takes out one frequency; ``quality`` is the frequency over the width taken out."""
    if not 0 < line < rate / 2:
        raise ValueError("needs 0 < line < half the rate")
    w = 2 * np.pi * line / rate
    alpha = np.sin(w) / (2 * quality)
    scale = 1 + alpha
    return [1 / scale, -2 * np.cos(w) / scale, 1 / scale, -2 * np.cos(w) / scale, (1 - alpha) / scale]


def clean_sections(
    rate: float = SAMPLE_RATE_HZ, band: tuple[float, float] = BAND_HZ, lines: Sequence[float] = LINES_HZ, order: int = 4, quality: float = 30.0
) -> list[list[float]]:
    """The band pass followed by a notch for each power line."""
    return [*band_pass_sections(*band, rate, order), *(notch_section(f, rate, quality) for f in lines)]


def run(use: System, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and end state of one block. Whole chunks run side by side from a zero state first."""
    n, m = len(x), len(use.b)
    chunks = n // CHUNK
    y, state = np.empty(n), start
    if chunks:
        rows = x[: chunks * CHUNK].reshape(chunks, CHUNK)
        states, free, echo, power = np.zeros((chunks, m)), np.empty((chunks, CHUNK)), np.empty((CHUNK, m)), use.c
        for t in range(CHUNK):
            free[:, t] = states @ use.c + use.d * rows[:, t]
            states = states @ use.a.T + rows[:, t, None] * use.b
            echo[t], power = power, power @ use.a
        whole = np.linalg.matrix_power(use.a, CHUNK)
        starts = np.empty((chunks, m))
        for k in range(chunks):
            starts[k] = state
            state = whole @ state + states[k]
        y[: chunks * CHUNK] = (free + starts @ echo.T).ravel()
    for t in range(chunks * CHUNK, n):
        y[t] = use.c @ state + use.d * x[t]
        state = use.a @ state + use.b * x[t]
    return y, state


def recursive_filter(
    df: DataFrame, keys: Sequence[str], order: str, value: str, sections: Sequence[Sequence[float]], name: str = "filtered", backward: bool = False,
    width: float | None = None, rows: int = MARGIN_ROWS, more: Sequence[str] = (),
) -> DataFrame:
    """Run the sections along each series, from a state of rest; missing samples count as 0.

    ``backward`` runs from the last row to the first. The output is ``keys, order, value, filtered`` with the
    columns ``more``; series are cut into blocks of ``rows`` rows.
    """
    keys = list(keys)
    use = system(sections)
    m = len(use.b)
    indexed = row_index(df.select(*keys, order, value, *more), keys, order, "__idx", width=width)
    blocks = settle(indexed.withColumn("__at", F.floor((F.col("__idx") - 1) / rows)), "indexed")

    def samples(table: pa.Table) -> np.ndarray:
        x = np.nan_to_num(table[value].to_numpy().astype("float64"))
        return x[::-1] if backward else x

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("__idx")
        end = run(use, samples(table), np.zeros(m))[1]
        return table.select([*keys, "__at"]).slice(0, 1).append_column("n", pa.array([len(table)])).append_column("state", pa.array([end.tolist()]))

    def carried(table: pa.Table) -> pa.Table:
        """Start states of a series' blocks; one short row per block."""
        table = table.sort_by([("__at", "descending" if backward else "ascending")])
        state, starts = np.zeros(m), []
        for n, end in zip(table["n"].to_pylist(), table["state"].to_pylist()):
            starts.append(state.tolist())
            state = np.linalg.matrix_power(use.a, n) @ state + end
        return table.select([*keys, "__at"]).append_column("start", pa.array(starts, pa.list_(pa.float64())))

    def again(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by("__idx")
        y = run(use, samples(table), np.array(start["start"][0].as_py()))[0]
        return table.select([*keys, order, value, *more]).append_column(name, pa.array(y[::-1] if backward else y))

    key = T.StructType([df.schema[c] for c in keys]).add("__at", "long")
    summary = blocks.select(*keys, "__at", "__idx", value).groupBy(*keys, "__at").applyInArrow(ends, T.StructType(list(key.fields)).add("n", "long").add("state", T.ArrayType(T.DoubleType())))
    starts = summary.groupBy(*keys).applyInArrow(carried, T.StructType(list(key.fields)).add("start", T.ArrayType(T.DoubleType())))
    out = T.StructType([df.schema[c] for c in (*keys, order, value, *more)] + [T.StructField(name, T.DoubleType())])
    return blocks.groupBy(*keys, "__at").cogroup(starts.groupBy(*keys, "__at")).applyInArrow(again, out)


def zero_phase(
    df: DataFrame, keys: Sequence[str], order: str, value: str, sections: Sequence[Sequence[float]], name: str = "filtered", width: float | None = None,
    rows: int = MARGIN_ROWS,
) -> DataFrame:
    """The sections forward and then backward along each series: ``keys, order, value, filtered``."""
    once = settle(recursive_filter(df, keys, order, value, sections, "__once", False, width, rows), "forward")
    twice = recursive_filter(once, keys, order, "__once", sections, name, True, width, rows, [value])
    return twice.select(*keys, order, value, name)
