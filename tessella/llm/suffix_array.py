"""Blockwise suffix sorting with a difference cover, in numpy.

The suffixes asked for are sorted one bucket (a range of first bytes) at a time, so
working memory follows the bucket, not the text. A bucket is sorted by the first
PERIOD bytes; longer ties are resolved by ranks of a sample: positions whose residue
modulo PERIOD lies in a difference cover. For any two suffixes i, j there is a shift
below PERIOD that takes both to sample positions, so one look at two ranks decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Residues repeat after so many bytes; sample ranks look at 4 periods.
PERIOD = 32
#: Suffixes sorted at once, about.
BUCKET = 1 << 19


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues whose pairwise differences modulo v are all of 0..v-1, chosen greedily."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max((r for r in range(v) if r not in cover), key=lambda r: (len(missing & {d for c in cover for d in ((r - c) % v, (c - r) % v)}), -r))
        missing -= {d for c in cover for d in ((best - c) % v, (c - best) % v)}
        cover.append(best)
    return tuple(sorted(cover))


@cache
def shift_table(v: int) -> np.ndarray:
    """[a, b]: the least shift that takes residues a and b both into the cover."""
    member = np.zeros(v, bool)
    member[list(difference_cover(v))] = True
    a, b, d = np.ogrid[:v, :v, :v]
    return (member[(a + d) % v] & member[(b + d) % v]).argmax(axis=2).astype(np.int64)


class CoverSorter:
    """Sorts chosen suffixes of a text (bytes); beyond its end the text counts as zeros."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        whole = -(-self.n // PERIOD) * PERIOD
        self.text = np.concatenate([text, np.zeros(whole - self.n + 8 * PERIOD, np.uint8)])
        self.eight = np.lib.stride_tricks.sliding_window_view(self.text, 8)
        cover = np.array(difference_cover(PERIOD))
        self.slot = np.full(PERIOD, -1)
        self.slot[cover] = np.arange(len(cover))
        self.width = len(cover)
        sample = (np.arange(0, whole + PERIOD, PERIOD)[:, None] + cover).ravel()
        self.rank = self._ranked(sample)

    def word(self, at: np.ndarray) -> np.ndarray:
        """The 8 bytes from each place, as numbers that sort like them."""
        return self.eight[at].view(">u8").ravel().astype(np.uint64)

    def _ranked(self, sample: np.ndarray) -> np.ndarray:
        """Ranks of the sample by PERIOD bytes, then doubled twice by the ranks one and two periods on."""
        words = [self.word(sample + 8 * k) for k in range(PERIOD // 8)]
        order = np.lexsort(words[::-1])
        new = np.zeros(len(sample), bool)
        for w in words:
            sorted_w = w[order]
            new[1:] |= sorted_w[1:] != sorted_w[:-1]
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.cumsum(new)
        for periods in (1, 2):
            ahead = np.zeros(len(rank), np.int64)
            ahead[: len(rank) - periods * self.width] = rank[periods * self.width :] + 1
            key = rank * (len(rank) + 2) + ahead
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], np.diff(key[order]) != 0])
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(new)
        return rank

    def sample_rank(self, at: np.ndarray) -> np.ndarray:
        return self.rank[at // PERIOD * self.width + self.slot[at % PERIOD]]

    def buckets(self, suffixes: np.ndarray) -> Iterator[np.ndarray]:
        """Suffixes in ranges of their first two bytes, of about BUCKET suffixes."""
        first = self.text[suffixes].astype(np.int32) << 8 | self.text[suffixes + 1]
        counts = np.bincount(first, minlength=1 << 16)
        part = (np.cumsum(counts) - counts) // BUCKET
        order = np.argsort(part[first], kind="stable")
        cuts = np.flatnonzero(np.diff(part[first][order])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
            if b > a:
                yield suffixes[order[a:b]]

    def sort_bucket(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes in order, number of each one's group of equal first PERIOD bytes)."""
        words = [self.word(suffixes + 8 * k) for k in range(PERIOD // 8)]
        order = np.lexsort(words[::-1])
        new = np.zeros(len(order), bool)
        for w in words:
            sorted_w = w[order]
            new[1:] |= sorted_w[1:] != sorted_w[:-1]
        now, tie = suffixes[order], np.cumsum(new)
        self._resolve(now, tie.copy())
        return now, tie

    def _resolve(self, now: np.ndarray, group: np.ndarray) -> None:
        """Orders `now` within the groups in place, all groups at once: each round compares a group
        with one of its suffixes by sample ranks and parts it in three; the middle is done."""
        shift = shift_table(PERIOD)
        open_ = np.arange(len(now))
        while True:
            starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(group) else np.zeros(0, int)
            sizes = np.diff(np.append(starts, len(group)))
            keep = np.repeat(sizes > 1, sizes)
            open_, group = open_[keep], group[keep]
            if not len(open_):
                return
            starts = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
            sizes = np.diff(np.append(starts, len(group)))
            mine = now[open_]
            pivot = np.repeat(mine[starts + sizes // 2], sizes)
            d = shift[mine % PERIOD, pivot % PERIOD]
            side = np.sign(self.sample_rank(mine + d) - self.sample_rank(pivot + d))
            key = np.repeat(np.arange(len(starts)), sizes) * 3 + side + 1
            order = np.argsort(key, kind="stable")
            now[open_] = mine[order]
            key = key[order]
            keep = key % 3 != 1
            open_, group = open_[keep], key[keep]

    def repeats(self, suffixes: np.ndarray, length: int) -> np.ndarray:
        """Of each suffix, the first (in text) of those asked for with the same `length` bytes.

        length is at most 4 * PERIOD. Equal ones are neighbours in suffix order.
        """
        first = np.empty(len(suffixes), np.int64)
        where = np.argsort(suffixes, kind="stable")
        ordered = suffixes[where]
        for bucket in self.buckets(ordered):
            now, tie = self.sort_bucket(bucket)
            same = np.zeros(len(now), bool)
            pairs = np.flatnonzero(tie[1:] == tie[:-1]) + 1
            for at in [*range(PERIOD, length - 8, 8), length - 8]:
                pairs = pairs[self.word(now[pairs] + at) == self.word(now[pairs - 1] + at)]
            same[pairs] = True
            starts = np.flatnonzero(~same)
            low = np.minimum.reduceat(now, starts)
            first[where[np.searchsorted(ordered, now)]] = np.repeat(low, np.diff(np.append(starts, len(now))))
        return first
