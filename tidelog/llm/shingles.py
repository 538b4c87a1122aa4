"""Sets of word shingles of whole texts, computed on the bytes of Arrow batches with numpy.

A word's hash is a polynomial over its bytes, A-Z lower-cased by table; a shingle's is one over its words'
hashes. Both wrap at 64 bits and are mixed. Texts are taken in pieces of bounded size, cut between words,
so a very long text needs no more than its words' hashes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers (fixed values, from the golden ratio and the primes of public hash functions).
BYTE, WORD, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
PIECE = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: np.uint64 = BYTE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(256)


def _hash_piece(b: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words of b; edge marks bytes that begin a text."""
    global _POWERS
    word = ~BLANK[b]
    fresh = word.copy()
    fresh[1:] &= ~word[:-1] | edge[1:]
    at = np.flatnonzero(fresh)
    if not len(at):
        return np.zeros(0, np.uint64), at
    inside = np.flatnonzero(word)
    first = np.searchsorted(inside, at)
    offset = np.arange(len(inside)) - np.repeat(first, np.diff(np.append(first, len(inside))))
    if (top := int(offset.max())) >= len(_POWERS):
        _POWERS = powers(2 * top + 1)
    sums = np.add.reduceat((LOWER[b[inside]].astype(np.uint64) + np.uint64(1)) * _POWERS[offset], first)
    return mixed(sums), at


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts data[offsets[i]:offsets[i + 1]], and each text's first word's number."""
    lo, end = int(offsets[0]), int(offsets[-1])
    edge = np.zeros(end - lo + 1, bool)
    edge[offsets - lo] = True
    hashes, places, a = [], [], lo
    while a < end:
        z = min(a + PIECE, end)
        step = 4096
        while z < end and not edge[z - lo]:  # on to the next blank or text
            stops = np.flatnonzero(BLANK[data[z : min(z + step, end)]] | edge[z - lo : min(z + step, end) - lo])
            if len(stops):
                z += int(stops[0])
                break
            z, step = min(z + step, end), step * 2
        h, at = _hash_piece(data[a:z], edge[a - lo : z - lo])
        hashes.append(h)
        places.append(at + a)
        a = z
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def text_column(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty texts."""
    import pyarrow as pa

    array = array.fill_null("") if array.null_count else array
    array = array.cast(pa.large_binary())
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def shingle_sets(array, width: int = 5, texts: int = 256) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles; fewer words than `width` make one shingle, none make none."""
    data, offsets = text_column(array)
    scale = powers(width, WORD)
    for a in range(0, len(offsets) - 1, texts):
        h, first = word_hashes(data, offsets[a : a + texts + 1])
        n = max(0, len(h) - width + 1)
        g = np.zeros(n, np.uint64)
        for k in range(width):
            g += h[k : k + n] * scale[k]
        g = mixed(g)
        for i in range(len(first) - 1):
            x, z = int(first[i]), int(first[i + 1])
            if z - x >= width:
                s = np.sort(g[x : z - width + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif z > x:
                yield mixed((h[x:z] * scale[: z - x]).sum(keepdims=True) + np.uint64(z - x))
            else:
                yield np.zeros(0, np.uint64)


def digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed integers."""
    import xxhash

    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
