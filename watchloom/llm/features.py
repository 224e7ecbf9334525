"""Hashed byte n-gram counts of texts or passages, for the classifiers."""

from __future__ import annotations

import numpy as np

from watchloom.llm.kernel import LOWER

#: ASCII letters keep their lower-case form, other ASCII becomes a blank, non-ASCII bytes stay.
LETTERS = np.array([LOWER[b] if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def owners(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def gram_counts(data: np.ndarray, offs: np.ndarray, order: int, bits: int) -> np.ndarray:
    """(texts, 2**bits) counts of the byte n-grams of one order; none crosses a text's end."""
    texts, dims = len(offs) - 1, 1 << bits
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros((texts, dims), np.float32)
    own = owners(offs)
    x = np.zeros(n, np.uint32)
    for j in range(order):
        x = (x << np.uint32(8)) | data[j : j + n]
    h = (x * np.uint32(2654435761)) >> np.uint32(32 - bits)
    inside = own[:n] == own[order - 1 :]
    return np.bincount(own[:n][inside] * dims + h[inside], minlength=texts * dims).reshape(texts, dims).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def passages(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of passages of ``size`` bytes and, per text, its first passage. A rest under half a passage joins the one before; every text has a passage."""
    lens = np.diff(offs)
    n = np.maximum(1, (lens + size // 2) // size)
    first = np.concatenate([[0], np.cumsum(n)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], n)
    starts = np.repeat(offs[:-1], n) + within * size
    return np.append(starts, offs[-1]), first
