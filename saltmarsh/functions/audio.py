"""16-bit PCM in binary columns: array arithmetic per clip, so pandas functions over numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = 32768.0


def samples(pcm: bytes) -> np.ndarray:
    return np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2")


def pcm(x: np.ndarray) -> bytes:
    return np.clip(np.trunc(x), -32768, 32767).astype("<i2").tobytes()


def energy(body: bytes) -> float:
    """Root mean square over full scale; 0 without samples."""
    x = samples(body).astype(float)
    return float(np.sqrt((x * x).mean()) / FULL) if len(x) else 0.0


def resampled(body: bytes, source: int, target: int) -> bytes:
    """Linear interpolation; the length and the values are cut, not rounded."""
    x = samples(body).astype(float)
    n = int(len(x) * target / source)
    if source == target or not len(x):
        return body
    at = np.arange(n) * (source / target)
    return pcm(np.interp(at, np.arange(len(x)), x))


def peak_normalised(body: bytes, peak: float = 0.95) -> bytes:
    """Attenuated to ``peak`` of full scale where louder; never amplified."""
    x = samples(body).astype(float)
    top = np.abs(x).max() if len(x) else 0.0
    return pcm(x * (peak * 32767 / top)) if top > peak * 32767 else body


def clipping(body: bytes, line: int = 32767) -> tuple[float, int]:
    """Share of samples at full scale, and the longest run of them."""
    x = np.abs(samples(body).astype(int)) >= line
    if not len(x):
        return 0.0, 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
    return float(x.mean()), int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def trimmed(body: bytes, frame: int = 320, line: float = 0.002) -> bytes:
    """Without quiet frames at either end; a clip of quiet frames alone becomes empty."""
    x = samples(body)
    loud = [k for k in range(0, len(x), frame) if energy(x[k : k + frame].tobytes()) >= line]
    return x[loud[0] : loud[-1] + frame].tobytes() if loud else b""


def scale_for_snr(signal: float, noise: float, db: float) -> float:
    """What noise of one RMS is multiplied by to stand ``db`` below a signal of another; 0 where either is none."""
    return signal / noise / 10 ** (db / 20) if signal > 0 and noise > 0 else 0.0


def mixed(signal: bytes, noise: bytes, db: float) -> bytes:
    """Signal with noise at a level, the whole scaled down if it would clip."""
    x, n = samples(signal).astype(float), samples(noise).astype(float)
    if not len(x) or not len(n):
        return signal
    n = np.resize(n, len(x))
    y = x + n * scale_for_snr(np.sqrt((x * x).mean()), np.sqrt((n * n).mean()), db)
    top = np.abs(y).max()
    return pcm(y * (32767 / top) if top > 32767 else y)


def wav_header(n_bytes: int, rate: int) -> bytes:
    """The 44 bytes before ``n_bytes`` of mono PCM."""
    import struct

    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n_bytes, b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", n_bytes)


def prepared(body: bytes, source: int, target: int) -> bytes:
    """Trimmed, then normalised, then resampled."""
    return resampled(peak_normalised(trimmed(body)), source, target)


def energy_of(column: Column) -> Column:
    
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else energy(x) for x in s], dtype="float64")

    return F.pandas_udf(run, "double")(column)


def silent(column: Column, line: float = 0.002) -> Column:
    """Whether a clip is too quiet to be worth recognising."""
    return energy_of(column) < line
