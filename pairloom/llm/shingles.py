"""Sets of 5-word shingles of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import batches

SIZE = 5
#: Bytes of text whose words are hashed at once; texts are joined up to so many bytes.
SEGMENT, GROUP = 1 << 19, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(8)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_PLACES = _RNG.integers(1, 1 << 62, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(4) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(x: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK, prefix: int = 0) -> tuple[np.ndarray, ...]:
    """Hashes of all words, where each text's words start and, if asked for, hashes of the words' first ``prefix`` bytes.

    blank: for each byte whether it parts words. ASCII letters are lower-cased.
    """
    hashes, heads, starts_at = [], [], []
    a, n = 0, len(x)
    while a < n:
        z = min(a + SEGMENT, n)
        while z < n and not blank[x[z - 1 : z + 4096]].any():  # not within a word
            z = min(z + 4096, n)
        if z < n:
            z = min(n, z + int(np.argmax(blank[x[z - 1 : z + 4096]])))
        part = _LOWER[x[a:z]]
        word = ~blank[part]
        edge = np.zeros(len(part) + 1, bool)
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z, "right")] - a
        edge[inner] = True
        before = np.concatenate([[False], word[:-1]])
        first = np.flatnonzero(word & (~before | edge[:-1]))
        if len(first):
            places = np.flatnonzero(word)
            run = np.searchsorted(places, first)
            size = np.diff(np.concatenate([run, [len(places)]]))
            # Powers by the place in the word.
            place = np.arange(len(places)) - np.repeat(run, size)
            powers = np.cumprod(np.full(int(size.max()), _STEP, np.uint64), dtype=np.uint64)
            value = _BYTES[part[places]] * powers[place]
            hashes.append(mix(np.add.reduceat(value, run) + size.astype(np.uint64)))
            if prefix:
                value[place >= prefix] = 0
                heads.append(mix(np.add.reduceat(value, run)))
            starts_at.append(first + a)
        a = z
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets), np.concatenate(heads) if prefix else hashes[0][:0]


def _sets(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, at, _ = words(x, offsets)
    m = np.diff(at)
    count = np.where(m >= SIZE, m - SIZE + 1, np.minimum(m, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    total = int(out_at[-1])
    owner = np.repeat(np.arange(len(m)), count)
    first = at[owner] + np.arange(total) - out_at[owner]
    padded = np.concatenate([w, np.zeros(SIZE, np.uint64)])
    length = np.minimum(m, SIZE)[owner]
    value = length.astype(np.uint64) * _PLACES[2 * SIZE]
    for k in range(SIZE):
        value += np.where(k < length, mix(padded[first + k] + _PLACES[k]), np.uint64(0)) * _PLACES[SIZE + k]
    value = mix(value)
    for a, z in zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True):
        value[a:z].sort()
    keep = np.ones(total, bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(m)))]).astype(np.int64)


def sets(texts: pa.Array):
    """(first row, hashes, offsets): each text's distinct shingles, sorted, for groups of rows of about GROUP bytes.

    A-Z are lower-cased, words are parted by space and tab to carriage return. A text of fewer than five words
    is one shingle, a text without words or a null text none.
    """
    batch = pa.RecordBatch.from_arrays([texts], names=["t"])
    x, offsets = batches.text_bytes(batch, 0)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + GROUP, "right")) - 1)
        value, at = _sets(x[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
        yield start, value, at
        start = end


def digests(value: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit digest of each set, another for each seed; 0 only for the empty set."""
    start = np.uint64((int(_PLACES[0]) + seed * _STEP) & ((1 << 64) - 1))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value + start), dtype=np.uint64)])
    size = np.diff(at).astype(np.uint64)
    found = mix((total[at[1:]] - total[at[:-1]]) ^ (size * _PLACES[1]))
    return np.where(size > 0, np.maximum(found, 1), np.uint64(0))
