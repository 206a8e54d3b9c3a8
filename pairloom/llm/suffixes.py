"""Blockwise suffix sorting with a difference cover, to a bounded depth of comparison.

Every pair of positions has a shift below ``PERIOD`` that takes both into the cover. So suffixes that agree in
their first bytes are told apart by the ranks of two cover positions, computed once beforehand; no comparison
goes on for long, and only one block of suffixes is sorted at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: {0, 1, 3} mod 7: the differences of its members are all of 0..6.
PERIOD, COVER = 7, (0, 1, 3)
#: SHIFT[r, s]: the least d with (r + d) and (s + d) both in the cover, mod PERIOD.
SHIFT = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])
BLOCK = 1 << 18
_PAD = 80


def words_of(padded: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place of uint8s as one number, by unaligned view; ``big`` makes what is picked of it sort as its bytes."""
    return np.ndarray(len(padded) - 7, "<u8", buffer=padded, strides=(1,))


def big(words: np.ndarray) -> np.ndarray:
    return words.astype(np.uint64, copy=False).byteswap()


class CoverSorter:
    """Sorts suffixes of ``text`` (bytes as uint8) by at least their first ``depth`` bytes.

    Memory: the text, 8 bytes for each of its cover positions, and one block of suffixes.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.depth = depth
        self.text = np.concatenate([text, np.zeros(_PAD + 8 * (-(-depth // 8)), np.uint8)])
        self.n = len(text)
        self.words = words_of(self.text)
        sample = np.concatenate([np.arange(c, self.n + PERIOD, PERIOD) for c in COVER])
        sample.sort()
        self.rank = np.zeros(self.n + 2 * PERIOD, np.int64)
        self.rank[sample] = self._ranked(sample)

    def word(self, at: np.ndarray, k: int = 0) -> np.ndarray:
        """The k-th 8-byte word of the suffixes at these places, as numbers that sort as their bytes."""
        return big(self.words[at + 8 * k])

    def _ranked(self, at: np.ndarray) -> np.ndarray:
        """Ranks of suffixes by their first ``depth`` bytes and up to 7 more; equal ones share a rank."""
        order = np.arange(len(at))
        group = np.zeros(len(at), np.int64)
        todo = order
        # Word by word, and of each next word only what is still tied.
        for k in range(-(-self.depth // 8)):
            if not len(todo):
                break
            key, own = self.word(at[todo], k), group[todo]
            # Which of equal ones comes first doesn't matter; what is left is in the order of its groups.
            o = np.argsort(key)
            if k:
                o = o[np.argsort(own[o], kind="stable")]
            t, g, w = todo[o], own[o], key[o]
            head = np.concatenate([[True], g[1:] != g[:-1]])
            new = head | np.concatenate([[True], w[1:] != w[:-1]])
            # A group's members get its number plus how many of the group sort before them.
            first = np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
            place = np.maximum.accumulate(np.where(new, np.arange(len(t)), 0))
            group[t] = g + place - first
            start = np.flatnonzero(new)
            size = np.diff(np.concatenate([start, [len(t)]]))
            todo = t[np.repeat(size > 1, size)]
        return group

    def blocks(self, at: np.ndarray, limit: int = BLOCK) -> Iterator[np.ndarray]:
        """The suffixes in sorted order, one bucket of leading bytes at a time, each as an array of places."""
        lead = (self.text[at].astype(np.int32) << 8) | self.text[at + 1]
        count = np.bincount(lead, minlength=1)
        held, block = 0, np.zeros(len(count), np.int64)
        total = np.cumsum(count)
        # Buckets are cut where another ``limit`` suffixes are reached; a leading pair is never cut.
        edges = [0]
        while edges[-1] < len(count):
            held = total[edges[-1] - 1] if edges[-1] else 0
            edges.append(max(edges[-1] + 1, int(np.searchsorted(total, held + limit, "right"))))
        for b, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
            block[x:y] = b
        own = block[lead].astype(np.uint16)  # at most one block for each leading pair
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(len(edges)))
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                yield self.sorted(at[order[x:y]])

    def sorted(self, at: np.ndarray) -> np.ndarray:
        """One bucket: by the first 8 bytes, and ties by the ranks of cover positions."""
        key = self.word(at)
        order = np.argsort(key)
        at, key = at[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(at)]]))
        tied = np.flatnonzero(np.repeat(size > 1, size))
        if len(tied):
            group = (np.cumsum(new) - 1)[tied]
            at[tied] = self._untied(at[tied], group)
        return at

    def _untied(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Suffixes that agree in 8 bytes within each group (groups are in order): sorted within their groups.

        Suffixes of one residue sort by the rank at one shift. For two residues the ranks at their common
        shift compare them, so a suffix's place is the sum over all residues of how many come before it.
        """
        residue = at % PERIOD
        spread = np.int64(len(self.rank) + 1)
        members = [np.flatnonzero(residue == r) for r in range(PERIOD)]
        before = np.zeros(len(at), np.int64)
        for s in range(PERIOD):
            if not len(members[s]):
                continue
            for r in range(PERIOD):
                if not len(members[r]):
                    continue
                d = SHIFT[r, s]
                there = np.sort(group[members[s]] * spread + self.rank[at[members[s]] + d])
                before[members[r]] += np.searchsorted(there, group[members[r]] * spread + self.rank[at[members[r]] + d])
        # What stands in earlier groups is counted too, so the sums order all at once.
        return at[np.argsort(before, kind="stable")]

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b agree in their first ``depth`` bytes."""
        same = np.ones(len(a), bool)
        for k in range(self.depth // 8):
            same &= self.word(a, k) == self.word(b, k)
        if rest := self.depth % 8:
            shift = np.uint64(64 - 8 * rest)
            k = self.depth // 8
            same &= (self.word(a, k) >> shift) == (self.word(b, k) >> shift)
        return same
