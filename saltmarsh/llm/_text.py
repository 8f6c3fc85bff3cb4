"""Arrow batches as flat byte arrays: the shared ground of the operators that read whole texts."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a task holds in working arrays at once (a longer text forms a slice of its own). So few
#: that the arrays made of them, of eight bytes an element, stay in a core's cache.
SLICE_BYTES = 1 << 18

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string or binary column into runs of whole rows.

    Yields (first row, end row, bytes as uint8, offsets from 0). A null row has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + max_bytes, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay inside one row."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[inner < len(mask)]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    start[inner] = mask[inner]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    last = inner[inner > 0] - 1
    end[last] = mask[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


_ODD = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64.

    The tables stay with the interpreter, not in a global that would travel with every function.
    """
    kept = sys.__dict__.setdefault("_saltmarsh_powers", {})
    if len(kept.get("power", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > 32 * SLICE_BYTES:  # for one very long text; not kept
            return made[0][:n], made[1][:n]
        kept["power"], kept["inverse"] = made
    return kept["power"][:n], kept["inverse"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a one-to-one map)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each position lies."""
    return np.searchsorted(offsets, starts, side="right") - 1


def safe_name(taken: list[str], wanted: str) -> str:
    """A column name that is not taken."""
    while wanted.lower() in {x.lower() for x in taken}:
        wanted = "_" + wanted
    return wanted
