"""Vectorised work on the UTF-8 bytes of Arrow string columns.

A batch is cut into blocks of whole rows of at most ``max_bytes`` bytes (a longer text is a block of its own), so the
memory of a task is bounded by the block, not by the batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
GOLD = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}

#: ASCII A-Z become a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20, max_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of each block."""
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col.cast(pa.large_string()) if not pa.types.is_large_binary(col.type) else col, "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        hi = min(hi, n, lo + max_rows)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 20)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            a = np.full(size, b, U)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U)
    return _powers["up"], _powers["down"]


def byte_class(inside) -> np.ndarray:
    return np.array([bool(inside(b)) for b in range(256)])


#: Words between white space: no byte of ``[\x20\x09-\x0D]``.
SPACED = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words of ASCII letters, digits and all non-ASCII characters.
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())


def word_runs(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; a run never crosses a text's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = inside[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * U(GOLD))


def ngram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; len(words) - k + 1 of them."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = np.zeros(n, U)
    for j in range(k):
        h = mix(h * U(BASE) + words[j : j + n] + U(j + 1))
    return h


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w consecutive values, in two accumulations over blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])
