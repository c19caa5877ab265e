"""Zero-phase filters for evenly sampled series.

Filters are symmetric kernels, so no recursion runs along the series: a block needs only half a
kernel of rows from each neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faintline.functions.times import micros
from faintline.operators.blocks import match_keys, row_index, with_margins

# Pass band and power lines in Hz, usual sampling rate.
BAND_HZ = (70, 175)
LINES_HZ = (60, 120, 180)
SAMPLE_RATE_HZ = 4096


def low_pass(cutoff: float, rate: float, taps: int) -> np.ndarray:
    """Ideal low pass cut to an odd number of taps and tapered by a Hamming window."""
    if taps % 2 == 0:
        raise ValueError("taps must be odd")
    n = np.arange(taps) - taps // 2
    return 2 * cutoff / rate * np.sinc(2 * cutoff / rate * n) * np.hamming(taps)


def band_pass(low: float, high: float, rate: float, taps: int) -> np.ndarray:
    return low_pass(high, rate, taps) - low_pass(low, rate, taps)


def band_stop(low: float, high: float, rate: float, taps: int) -> np.ndarray:
    stop = -band_pass(low, high, rate, taps)
    stop[taps // 2] += 1
    return stop


def cascade(*kernels: np.ndarray) -> np.ndarray:
    """One kernel that does what the given ones do in turn."""
    out = np.ones(1)
    for kernel in kernels:
        out = np.convolve(out, kernel)
    return out


def clean_kernel(
    rate: float = SAMPLE_RATE_HZ,
    band: tuple[float, float] = BAND_HZ,
    lines: Sequence[float] = LINES_HZ,
    taps: int = 257,
    line_width: float = 2.0,
) -> np.ndarray:
    """Band pass with the power lines cut out."""
    notches = [band_stop(f - line_width, f + line_width, rate, taps) for f in lines]
    return cascade(band_pass(*band, rate, taps), *notches)


def fir_filter(
    df: DataFrame, keys: Sequence[str], order: str, value: str, kernel: np.ndarray, name: str = "filtered",
    width: float | None = None,
) -> DataFrame:
    """Convolve each series with a symmetric kernel; samples outside the series count as zero.

    Tasks work on blocks of bounded length; the output is ``keys, order, value, filtered``.
    """
    keys = list(keys)
    kernel = np.asarray(kernel, dtype="float64")
    half = len(kernel) // 2
    if len(kernel) % 2 == 0 or not np.allclose(kernel, kernel[::-1]):
        raise ValueError("the kernel must be symmetric with an odd number of taps")
    rows = row_index(df.select(*keys, order, value), keys, order, "__idx", width=width)
    cut, block, own = with_margins(rows, "__idx", before=half, after=half)

    def convolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("__idx")
        full = np.convolve(table[value].to_numpy(), kernel)[half : half + len(table)]
        out = table.select([*keys, order, value]).append_column(name, pa.array(full, from_pandas=True))
        return out.filter(table[own])

    schema = T.StructType([df.schema[c] for c in (*keys, order, value)] + [T.StructField(name, T.DoubleType())])
    return cut.groupBy(*keys, block).applyInArrow(convolve, schema)


def phase(time: Column, line: float) -> Column:
    """Phase of a spectral line, reduced in integers (to a millihertz) before the sine is taken."""
    turns = F.pmod(F.pmod(micros(time), F.lit(1_000_000_000)) * F.lit(round(line * 1000)), F.lit(1_000_000_000))
    return turns / 1e9 * F.lit(2 * math.pi)


def remove_lines(
    df: DataFrame, keys: Sequence[str], time: str, value: str, lines: Sequence[float] = LINES_HZ, name: str = "filtered"
) -> DataFrame:
    """Subtract from each series the sinusoid fitted to it at each line.

    The fit needs a few sums per series and line, so the samples themselves are not shuffled.
    """
    keys = list(keys)
    x = F.col(value)
    sums, fitted = [], F.lit(0.0)
    for i, line in enumerate(lines):
        s, c = F.sin(phase(F.col(time), line)), F.cos(phase(F.col(time), line))
        sums += [
            F.var_pop(s).alias(f"__vs{i}"),
            F.var_pop(c).alias(f"__vc{i}"),
            F.covar_pop(s, c).alias(f"__sc{i}"),
            F.covar_pop(x, s).alias(f"__xs{i}"),
            F.covar_pop(x, c).alias(f"__xc{i}"),
        ]
        vs, vc, sc, xs, xc = (F.col(f"__{p}{i}") for p in ("vs", "vc", "sc", "xs", "xc"))
        det = vs * vc - sc * sc
        a = F.coalesce(F.try_divide(xs * vc - xc * sc, det), F.lit(0.0))
        b = F.coalesce(F.try_divide(xc * vs - xs * sc, det), F.lit(0.0))
        fitted = fitted + a * s + b * c
    fits = df.groupBy(*keys).agg(*sums)
    return match_keys(df, fits, keys).select(*df.columns, (x - fitted).alias(name))


def crop(df: DataFrame, keys: Sequence[str], time: str, seconds: int = 1) -> DataFrame:
    """Drop ``seconds`` at both ends of each series."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    margin = F.expr(f"INTERVAL {int(seconds)} SECONDS")
    return (
        match_keys(df, ends, list(keys))
        .filter((F.col(time) >= F.col("__lo") + margin) & (F.col(time) <= F.col("__hi") - margin))
        .drop("__lo", "__hi")
    )
