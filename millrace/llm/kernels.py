"""Vectorised text kernels shared by the operators that work on characters.

Texts of a batch are laid end to end as one array of code points, so that hashing, sorting and marking are single numpy
calls over many documents.  A chunk holds about ``CHUNK_CHARS`` code points, or one document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_CHARS = 1 << 20
_MASK = (1 << 64) - 1
_MUL = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; spreads the low entropy of a polynomial over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def chunks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Positions and texts of the non-null texts, in chunks of bounded size."""
    at: list[int] = []
    own: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        if t is None:
            continue
        if own and size + len(t) > CHUNK_CHARS:
            yield at, own
            at, own, size = [], [], 0
        at.append(i)
        own.append(t)
        size += len(t)
    if own:
        yield at, own


def windows(flat: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document index and start of every window of ``width`` code points that lies inside one document."""
    if len(flat) < width:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = _hash_run(flat.astype(np.uint64) + np.uint64(1), width)
    ends = np.cumsum(lengths)
    inside = np.zeros(len(flat) + 1, np.int32)
    starts = ends - lengths
    long = lengths >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    pos = np.flatnonzero(np.cumsum(inside[: len(h)]) > 0)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - width + 1, 0))
    return mix64(h[pos]), doc, pos


def _hash_run(x: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values, by doubling."""
    parts: list[tuple[int, np.ndarray]] = []
    size, h, mul = 1, x, _MUL
    left = width
    while True:
        if left & size:
            parts.append((size, h))
            left -= size
        if not left:
            break
        h = h[:-size] * np.uint64(mul) + h[size:]
        mul = mul * mul & _MASK
        size *= 2
    n = len(x) - width + 1
    out = np.zeros(n, np.uint64)
    at = 0
    for size, h in parts:
        out = out * np.uint64(pow(_MUL, size, 1 << 64)) + h[at : at + n]
        at += size
    return out
