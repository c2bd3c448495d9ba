"""Vectorised hashing of the words of many texts with numpy."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the polynomial hashes and of the finalizer.
BYTE_MULT, WORD_MULT, WORD_MULT_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes that are hashed at once; longer input is cut at a separator.
SEGMENT = 1 << 21


def space_table() -> np.ndarray:
    """True for the bytes that separate words: space and 0x09-0x0D."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = space_table()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * BYTE_MULT)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _inverse(m: np.uint64) -> np.uint64:
    return np.uint64(pow(int(m), -1, 1 << 64))


def powers(mult: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult^0..mult^n and its inverses, modulo 2^64."""
    found = _powers.get(int(mult))
    if found is None or len(found[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        out = []
        for m in (mult, _inverse(mult)):
            x = np.full(size, m, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        found = _powers[int(mult)] = (out[0], out[1])
    return found


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, mult: np.uint64) -> np.ndarray:
    """Hashes of values[starts:ends], each independent of where it lies."""
    up, down = powers(mult, len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes | None], separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words begin (one number more than texts).

    separator: which bytes separate words. A null text has no words.
    """
    edge = bytes([int(np.flatnonzero(separator)[0])])
    data = np.frombuffer(edge.join([b"", *(t or b"" for t in texts), b""]), dtype=np.uint8)
    firsts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])  # a text's bytes begin one behind this
    gap = separator[data]
    change = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = change[0::2], change[1::2]
    hashes = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + SEGMENT, side="right")))
        part = data[at : ends[hi - 1]]
        hashes[lo:hi] = spans(_byte_value[part], starts[lo:hi] - at, ends[lo:hi] - at, BYTE_MULT)
        lo = hi
    return hashes, np.searchsorted(starts, firsts)


def window_hashes(words: np.ndarray, bounds: np.ndarray, size: int, mult: np.uint64 = WORD_MULT) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether a window of `size` words begins there within its text, and the hashes of those windows."""
    n = len(words)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    ok = left >= size
    at = np.flatnonzero(ok)
    return ok, spans(words, at, at + size, mult)
