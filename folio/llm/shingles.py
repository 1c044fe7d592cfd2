"""Sets of hashed word shingles, in numpy over the raw bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value a byte; white space counts as nothing.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words of more bytes are hashed on their own: sums modulo 2**64 collide for certain between some words of a thousand letters.
_LONG = 64
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers = np.ones(1, U), np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all others (64-bit avalanche, in place on a copy)."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (_BASE, _INVERSE))
    return _powers


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and where each text's begin (with the end)."""
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    raw = (b"\n".join(parts) + b"\n").lower()
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    space = _SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(stop) > len(start):  # a step that begins with white space
        stop = stop[len(stop) - len(start) :]
    power, inverse = _grown(len(data) + 1)
    total = np.cumsum(_BYTE[data] * power[: len(data)])
    h = (total[stop - 1] - np.where(start > 0, total[start - 1], U(0))) * inverse[start]
    h = mix(h)
    for i in np.flatnonzero(stop - start > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : stop[i]])
    return h, np.concatenate([[0], np.searchsorted(start, ends)])


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text its distinct shingles' hashes, ascending; a text of fewer words is one shingle; without words it has none."""
    h, at = word_hashes(texts)
    if len(h) >= words:
        run = sum(h[i : len(h) - words + 1 + i] * _MULT[i] for i in range(words))
        run = mix(run)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(run[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix((h[a:b] * _MULT[32 : 32 + b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
