"""Cross-polytope hashing: fast Hadamard pseudo-rotations, nearest signed axis, multiprobe."""

from __future__ import annotations

import numpy as np


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal fast Walsh-Hadamard transform of each row (width a power of two)."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def width(d: int) -> int:
    """The power of two that vectors of length d are padded to; 32 at least, as sign flips of a few entries make no random rotations."""
    return max(32, 1 << (d - 1).bit_length())


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width(x.shape[1]) - x.shape[1])))


def rotations(d: int, count: int, seed: int) -> np.ndarray:
    """Random signs (count, 3, d) for ``count`` pseudo-rotations of three sign flips and transforms each."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], dtype=np.float32), size=(count, 3, d))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def nearest_axes(y: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest of the 2d signed axes of each row, nearest first; axis i is i, its opposite d + i."""
    d = y.shape[1]
    both = np.concatenate([y, -y], axis=1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    part = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1) % (2 * d)


def sketch(x: np.ndarray, seed: int) -> np.ndarray:
    """128 sign bits of each row under random projections, as two signed 64-bit integers."""
    plane = np.random.default_rng(seed).standard_normal((x.shape[1], 128)).astype(np.float32)
    bits = np.packbits((x @ plane) > 0, axis=1)
    return bits.view(">i8").astype(np.int64)
