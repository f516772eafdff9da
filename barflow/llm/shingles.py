"""Words and word-shingle hashes of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import STEP_BYTES, steps

_ODD = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the polynomial's base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, STEP_BYTES + 64)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of byte values times powers; see ``part_hashes``."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:len(raw)], out=out[1:])
    return out


def part_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Polynomial hashes of byte ranges, equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[stop] - prefix[start]) * down[start]


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word (A-Z lower-cased), and the n+1 first words of rows."""
    low = _LOWER[raw]
    ink = np.zeros(len(raw) + 1, bool)
    np.logical_not(_SPACE[raw], out=ink[:len(raw)])
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    before = np.concatenate([[False], ink[:-1]])
    start, stop = np.flatnonzero(ink & (~before | edge)), np.flatnonzero(before & (~ink | edge))
    h = mix(part_hashes(prefix_hashes(low), start, stop) + (stop - start).astype(np.uint64))
    return start, stop, h, np.searchsorted(start, offs)


def shingle_hashes(word_hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of every ``n`` neighbouring words, over row borders too; empty if there are fewer."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + word_hashes[i:m + i]
    return mix(out)


def sequence_hash(word_hashes: np.ndarray) -> np.ndarray:
    """One hash of a sequence shorter than a shingle; never that of a shingle."""
    out = np.array([len(word_hashes)], np.uint64) * np.uint64(_ODD)
    for h in word_hashes:
        out = out * np.uint64(_BASE) + h
    return mix(out ^ np.uint64(_ODD))


def sets(raw: np.ndarray, offs: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """Each row's distinct shingle hashes, sorted: of ``n`` words, or of the whole if it has fewer."""
    for i, j in steps(offs):
        _, _, h, first = words(raw[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        s = shingle_hashes(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                x = np.sort(s[a:b - n + 1])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            else:
                yield sequence_hash(h[a:b]) if b > a else np.zeros(0, np.uint64)
