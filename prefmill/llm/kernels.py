"""Numpy kernels shared by the text operators: window hashes, sliding minima, anchors, runs.

Everything here works on one batch of documents at a time and knows nothing of
Spark. Documents of a batch are laid end to end; no window crosses a border.
"""

from __future__ import annotations

import numpy as np

_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two 64-bit columns."""
    return mix((a * _MUL) ^ (b + (a >> np.uint64(17))))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: ``len(values) - width + 1`` results."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        gap = width - have
        out = np.minimum(out[:-gap], out[gap:])
    return out


def word_at_each_byte(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one integer: ``len(data) - 7`` results."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for k in range(8):
        part = data[k:k + (n - k + 7) // 8 * 8]
        if len(part) % 8:
            part = part[: len(part) // 8 * 8]
        out[k::8] = part.view(np.uint64) if part.flags.aligned else np.frombuffer(part.tobytes(), np.uint64)
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(start, start + count)`` for all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def new_run(*cols: np.ndarray) -> np.ndarray:
    """True where a run of equal rows begins."""
    n = len(cols[0])
    first = np.zeros(n, bool)
    if n:
        first[0] = True
        for c in cols:
            first[1:] |= c[1:] != c[:-1]
    return first


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``width`` from one of ``starts``."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:-1]) > 0


def anchors(gram_hash: np.ndarray, span: int):
    """Minimizers: each window of ``span`` neighbouring grams picks its smallest, the leftmost among equals.

    Returns, per chosen gram, its position and the first and last window that
    picked it. Two windows of the same content pick the same gram.
    ``gram_hash`` is of one document.
    """
    n = len(gram_hash) - span + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    low = np.uint64((1 << 24) - 1)
    at, lo, hi = [], [], []
    step = 1 << 23
    for base in range(0, n, step):
        part = gram_hash[base:base + step + span - 1]
        tagged = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        least = sliding_min(tagged, span)
        first = np.flatnonzero(new_run(least))
        last = np.append(first[1:], len(least)) - 1
        at.append((least[first] & low).astype(np.int64) + base)
        lo.append(first + base)
        hi.append(last + base)
    return np.concatenate(at), np.concatenate(lo), np.concatenate(hi)
