"""Signal transforms on arrays, and their use on streams of blocks: one stream in order in one task, streams side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def predict_residual(samples: np.ndarray, coefficients: Sequence[int], shift: int) -> np.ndarray:
    """What a linear predictor (whole numbers, its sum shifted right, rounding down) leaves of the samples."""
    x = np.asarray(samples, np.int64)
    padded = np.concatenate([np.zeros(len(coefficients), np.int64), x])
    guess = sum(c * padded[len(coefficients) - 1 - k : len(padded) - 1 - k] for k, c in enumerate(coefficients))
    return x - (guess >> shift)


def predict_restore(residual: np.ndarray, coefficients: Sequence[int], shift: int) -> np.ndarray:
    """The inverse of predict_residual: each sample needs those before it."""
    n = len(coefficients)
    state, out = [0] * n, []
    for r in np.asarray(residual).tolist():
        v = r + (sum(c * s for c, s in zip(coefficients, state, strict=True)) >> shift)
        out.append(v)
        if n:
            state = [v, *state[:-1]]
    return np.array(out, np.int64)


def _kernel(n: int) -> np.ndarray:
    k, t = np.arange(n)[:, None], np.arange(2 * n)[None, :]
    return np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5))


def mdct(block: np.ndarray) -> np.ndarray:
    """The modified discrete cosine transform of 2n samples (windowed by the caller)."""
    return _kernel(len(block) // 2) @ block


def imdct(coefficients: np.ndarray) -> np.ndarray:
    """2n samples of n coefficients; overlap-added halves of neighbouring blocks give the signal back."""
    n = len(coefficients)
    return _kernel(n).T @ coefficients * (2.0 / n)


def overlap_add(blocks: Sequence[np.ndarray]) -> np.ndarray:
    """Blocks of 2n samples, each half over the next."""
    if not len(blocks):
        return np.zeros(0)
    n = len(blocks[0]) // 2
    out = np.zeros(n * (len(blocks) + 1))
    for k, b in enumerate(blocks):
        out[k * n : (k + 2) * n] += b
    return out


def best_lag(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The lag within +-most at which a, moved later by it, correlates best with b; the least of equals."""
    size = 1 << (len(a) + len(b)).bit_length()
    c = np.fft.irfft(np.fft.rfft(b, size) * np.conj(np.fft.rfft(a, size)), size)
    lags = np.arange(-most, most + 1)
    return int(lags[int(np.argmax(np.round(c[lags % size], 9)))])


def interpolated_matrices(before: np.ndarray, after: np.ndarray, slots: int) -> np.ndarray:
    """Matrices of each time slot on the way from one to another, the last being the other."""
    w = (np.arange(1, slots + 1) / slots)[:, None, None]
    return before + (after - before) * w


def mix(bands: np.ndarray, matrices: np.ndarray) -> np.ndarray:
    """(slot, channel, band) through (slot, object, channel): objects."""
    return np.einsum("tcb,toc->tob", bands, matrices)


def band_map(starts: np.ndarray, bands: int) -> np.ndarray:
    """The parameter band of each of the bands; starts are the first bands of each."""
    return np.searchsorted(starts, np.arange(bands), "right") - 1


def rematrix(samples: np.ndarray, matrix: np.ndarray, bits: int) -> np.ndarray:
    """Rows of samples through a matrix of fixed-point numbers, row by row: each output feeds the next, sums are shifted right, rounding down."""
    out = np.asarray(samples, np.int64).copy()
    for k in range(len(matrix)):
        out[:, k] = (out * matrix[k]).sum(1) >> bits
    return out


def transform_streams(df: DataFrame, stream: str, order: str, coefficients: str) -> DataFrame:
    """Rows of coefficients as windowed, overlap-added samples: stream, order, samples (n for each row). A stream is transformed in order by one task."""
    kinds = [df.schema[c].dataType.simpleString() for c in (stream, order)]

    def transformed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        carried, out = None, []
        for c in pdf[coefficients]:
            n = len(c)
            window = np.sin(np.pi * (np.arange(2 * n) + 0.5) / (2 * n))
            block = imdct(np.asarray(c, float)) * window
            out.append((block[:n] + (0 if carried is None or len(carried) != n else carried)).tolist())
            carried = block[n:]
        return pd.DataFrame({stream: pdf[stream].to_numpy(), order: pdf[order].to_numpy(), "samples": out})

    return df.select(stream, order, coefficients).groupBy(stream).applyInPandas(transformed, f"{stream} {kinds[0]}, {order} {kinds[1]}, samples array<double>")


def dither(seed: int, n: int, shift: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two channels of n noise samples of a 23-bit generator, and the seed after them. One step mixes the seed's upper sixteen bits in twice."""
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n):
        high = seed >> 7
        a[i], b[i] = seed >> 15 & 255, high & 255
        seed = (seed << 16 ^ high ^ high << 5) & 0x7FFFFF
    return *(np.where(x > 127, x - 256, x) << shift for x in (a, b)), seed


def cross_faded(samples: np.ndarray, at: int, replacement: np.ndarray, fade: int) -> np.ndarray:
    """samples with `replacement` from `at`: over the first and last `fade` of it the two are mixed, linearly; what would lie outside is left out."""
    out = samples.astype(np.float64).copy()
    n = len(replacement)
    weight = np.minimum(np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / (fade + 1), 1.0)
    first, last = max(at, 0), min(at + n, len(out))
    if last > first:
        w, r = weight[first - at : last - at], replacement[first - at : last - at]
        out[first:last] += (r - out[first:last]) * w
    return out
