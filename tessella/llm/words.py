"""Texts as codes into a table of their distinct words, over Arrow and numpy arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: From so many bytes on, an array has pages of its own, which go back to the system when it is freed.
OWN_PAGES = 4 << 20
_MMAP_THRESHOLD = -3  # mallopt's name for it in the GNU C library


@cache
def _c_library() -> ctypes.CDLL | None:
    """The C library of a worker, told once that large arrays get pages of their own: workers live on
    between stages, and the library would else raise this bound and keep what arrays leave."""
    library = ctypes.CDLL(None)
    if not (hasattr(library, "mallopt") and hasattr(library, "malloc_trim")):
        return None
    library.mallopt(_MMAP_THRESHOLD, OWN_PAGES)
    return library


def give_back() -> None:
    """For workers: returns memory that is free by now to the system."""
    library = _c_library()
    pa.default_memory_pool().release_unused()
    if library:
        library.malloc_trim(0)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, offsets of the texts' words); a null text has none.

    Words are the runs of anything but ASCII white space, in text order.
    """
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    encoded = lists.flatten().dictionary_encode()
    words, codes = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    empty = pc.index(words, pa.scalar("", pa.large_string())).as_py() if len(words) else -1
    if empty >= 0:  # around leading and trailing white space
        kept = codes != empty
        before = np.concatenate([[0], np.cumsum(kept)])
        codes, bounds = codes[kept], before[bounds]
    return words, codes, bounds


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 for an empty segment."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]))
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
    return out


def segment_max(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Largest of values[bounds[i]:bounds[i + 1]]; 0 for an empty segment."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, bounds[:-1][full])
    return out


_P = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i below n."""
    while len(_POWERS["p"]) < n:
        for key, base in (("p", int(_P)), ("q", pow(int(_P), -1, 1 << 64))):
            have = _POWERS[key]
            _POWERS[key] = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    return _POWERS["p"], _POWERS["q"]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of raw[starts[i]:ends[i]]; slices are in order and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + group, "right")))
        a, b = int(starts[at]), int(ends[end - 1])
        p, q = _powers(b - a + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw[a:b].astype(np.uint64) + np.uint64(1)) * p[: b - a])])
        s, e = starts[at:end] - a, ends[at:end] - a
        out[at:end] = mix64((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))
        at = end
    return out


def string_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of large strings without nulls."""
    raw, offsets = bytes_of(strings)
    return slice_hashes(raw, offsets[:-1], offsets[1:])


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each, as Arrow holds them; null is empty."""
    strings = strings.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8) if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def strings_from(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each range in turn."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of each text's distinct shingles, ascending; offsets of the texts).

    Shingles are k words in a row, A-Z lower-cased; a text of fewer words has its
    whole sequence as one, and one without words has none.
    """
    words, codes, bounds = split_words(texts)
    raw, offsets = bytes_of(words)
    low = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    ids = slice_hashes(low, offsets[:-1], offsets[1:])[codes]
    n = np.diff(bounds)
    rolled = np.zeros(max(len(ids) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = rolled * _P + ids[j : len(rolled) + j]
    rolled = mix64(rolled)
    found = np.zeros(int(np.where(n >= k, n - k + 1, n > 0).sum()), np.uint64)
    ends = np.cumsum(np.where(n >= k, n - k + 1, n > 0))
    starts = ends - np.where(n >= k, n - k + 1, n > 0)
    full = n >= k
    found[gather_ranges(starts[full], n[full] - k + 1)] = rolled[gather_ranges(bounds[:-1][full], n[full] - k + 1)]
    for i in np.flatnonzero((n > 0) & ~full):
        h = np.uint64(n[i])
        for x in ids[bounds[i] : bounds[i + 1]].tolist():
            h = np.uint64((int(h) * int(_P) + x) & 0xFFFFFFFFFFFFFFFF)
        found[starts[i]] = mix64(np.array([h], np.uint64))[0]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[starts[ends > starts]] = True
    return found[new], np.concatenate([[0], np.cumsum(segment_sum(new.astype(np.int32), np.append(starts, len(found)) if len(starts) else np.zeros(1, int)))]).astype(np.int64)


#: Bytes of a batch that are worked on at once, about: what arrays a task holds follows this, not the batch.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in stretches of about `size` bytes, the same ones whenever it is read."""
    give_back()
    for batch in batches:
        step = max(1, len(batch) * size // max(batch.nbytes, 1))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)
            give_back()


def array_slices(values: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """An array in stretches of about `size` bytes."""
    step = max(1, len(values) * size // max(values.nbytes, 1))
    for at in range(0, len(values), step):
        yield values.slice(at, step)
        give_back()
