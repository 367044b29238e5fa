"""Words and word shingles of many texts at once, as 64-bit hashes in NumPy."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bytes hashed at once, whatever the length of a word or text; powers beyond so many are not kept.
BLOCK, KEPT = 1 << 18, 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1, and their inverses, modulo 2**64. KEPT of them at most stay in memory."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (BASE, INVERSE):
        out = np.full(n if n > KEPT else min(KEPT, max(n, 2 * len(_powers[0]))), base, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    if n <= KEPT:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes over all others."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def polynomial(data: np.ndarray, start: int, end: int, lower: bool) -> int:
    """The sum of a word's bytes, each times BASE to the power of its place, a block at a time."""
    up, _ = powers(BLOCK)
    total = 0
    for lo in range(start, end, BLOCK):
        part = data[lo : min(end, lo + BLOCK)]
        codes = (LOWER[part] if lower else part).astype(np.uint64) + np.uint64(1)
        total += int((codes * up[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, lo - start, 1 << 64)
    return total % (1 << 64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of the texts in data, and where each text's words begin, with the end of all.

    A word is a run without ASCII white space, hashed with A-Z in lower case. Hashes are made for BLOCK bytes at a time,
    longer words by themselves, so that memory beyond a few bytes for each byte and word does not grow with a text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)  # a text begins or ends here
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(starts)
    inside[:-1] &= ~inside[1:] | edge[1:n]
    ends = np.flatnonzero(inside) + 1
    sums = np.empty(len(starts), np.uint64)
    up, down = powers(BLOCK + 1)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + BLOCK, "right"))
        if j <= i:  # a word longer than a block
            sums[i] = polynomial(data, lo, int(ends[i]), lower)
            i += 1
            continue
        part = data[lo : int(ends[j - 1])]
        codes = (LOWER[part] if lower else part).astype(np.uint64)
        codes += np.uint64(1)
        codes *= up[: len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes, out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        sums[i:j] = (total[b] - total[a]) * down[a]
        i = j
    return mix(sums + (ends - starts).astype(np.uint64) * STEPS[0]), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word runs of one text; of its whole sequence, if it has fewer words; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(k, n)
    out = np.full(n - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        out += hashes[j : n - width + 1 + j] * STEPS[j]
    return mix(out)
