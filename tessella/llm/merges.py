"""Byte-pair merges of very many pieces at once, in numpy.

All pieces lie behind one another as symbols. In each round every piece that still can
merges its pair of lowest rank, the leftmost if there are several, as BPE does one piece
at a time; pieces that can't are done and leave.
"""

from __future__ import annotations

import numpy as np

from tessella.llm.words import gather_ranges

_NONE = np.int64(np.iinfo(np.int64).max)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Numbers from pairs of symbols to numbers: open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)  # one key a slot
            put = left[free][first]
            self.keys[slots], self.values[slots] = keys[put], values[put]
            stay = self.keys[at] != keys[left]
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where there is none."""
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        at = at[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            go = ~hit & (held >= 0)
            rest, at = rest[go], at[go]
        return out


class Merges:
    """The merges of a byte-level BPE model (a tokenizer's JSON, field model)."""

    #: Bytes of pieces that are merged at once, about.
    GROUP = 1 << 20

    def __init__(self, model: dict, letters: dict[int, str]):
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        plain = {k: model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")}
        if any(plain.values()) or any(letters[b] + e not in ids for b in range(256) for e in {"", suffix}):
            raise ValueError(f"not a plain byte-level BPE model: {plain}")
        self.first = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[letters[b] + suffix] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64).reshape(-1)
        _, once = np.unique(keys, return_index=True)
        made = np.array([ids[a + b] for a, b in pairs], np.int64).reshape(-1)
        self.table = PairTable(keys[once], once << 32 | made[once])  # rank and result

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece raw[offsets[i]:offsets[i + 1]], all ids in order)."""
        counts, flat, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], 0
        while at < len(offsets) - 1:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.GROUP, "right")) - 1)
            n, ids = self._group(raw[offsets[at] : offsets[end]], np.diff(offsets[at : end + 1]))
            counts.append(n)
            flat.append(ids)
            at = end
        return np.concatenate(counts), np.concatenate(flat)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.table(left << 32 | right)
        return np.where(found < 0, _NONE, found)

    def _group(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = self.first[raw]
        full = np.flatnonzero(sizes > 0)
        ends = np.cumsum(sizes[full])
        symbols[ends - 1] = self.last[raw[ends - 1]]
        counts, done = sizes.copy(), []
        # For each symbol of the open pieces: its number, and the merge with the next one (rank << 32 | result).
        piece, size = full, sizes[full]
        merge = np.full(len(symbols), _NONE)
        if len(symbols) > 1:
            merge[:-1] = self._pairs(symbols[:-1], symbols[1:])
        merge[ends - 1] = _NONE
        while len(piece):
            ends = np.cumsum(size)
            starts = ends - size
            best = np.minimum.reduceat(merge, starts)
            stop = best == _NONE
            if stop.any():
                done.append((piece[stop], size[stop], symbols[gather_ranges(starts[stop], size[stop])]))
                counts[piece[stop]] = size[stop]
                keep = np.repeat(~stop, size)
                symbols, merge, piece, size, best = symbols[keep], merge[keep], piece[~stop], size[~stop], best[~stop]
                if not len(piece):
                    break
                ends = np.cumsum(size)
                starts = ends - size
            hits = np.flatnonzero(merge == np.repeat(best, size))
            owner = np.searchsorted(ends, hits, "right")
            at = hits[np.concatenate([[True], np.diff(owner) != 0])]  # the leftmost of each piece
            symbols[at] = best & 0xFFFFFFFF
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            merge[at] = _NONE
            after = np.flatnonzero(at + 2 < ends)
            merge[at[after]] = self._pairs(symbols[at[after]], symbols[at[after] + 2])
            before = np.flatnonzero(at > starts)
            merge[at[before] - 1] = self._pairs(symbols[at[before] - 1], symbols[at[before]])
            symbols, merge, size = symbols[~gone], merge[~gone], size - 1
        out = np.empty(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        for piece, size, found in done:
            out[gather_ranges(begin[piece], size)] = found
        return counts, out
