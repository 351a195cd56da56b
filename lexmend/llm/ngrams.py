"""Hashed text features for the linear classifiers, computed on whole batches of texts at once."""

from __future__ import annotations

import numpy as np

FACTOR = np.uint64(0x9E3779B97F4A7C15)


def groups(texts: list[bytes], most: int = 1 << 18):
    """Runs of texts (start, stop) of about ``most`` bytes, at least one text each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def byte_grams(data: np.ndarray, sizes: tuple[int, ...], bins: int) -> list[np.ndarray]:
    """For each size n, the bin of the n bytes that start at each place of ``data`` (fewer at its end).

    Multiplicative hashing: the top bits of the product pick the bin. ``bins`` is a power of two.
    """
    out, code, shift = [], np.zeros(len(data), np.uint64), np.uint64(64 - bins.bit_length() + 1)
    for n in range(1, max(sizes) + 1):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] + np.uint64(1)
        if n in sizes:
            out.append(((code + np.uint64(n << 56)) * FACTOR >> shift).astype(np.int64))
    return out
