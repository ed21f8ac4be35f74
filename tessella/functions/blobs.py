"""Packed blocks of numbers, which go through a shuffle as one row instead of very many."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard

#: A block's row: its number, the bucket it is dealt to (below 0: it stays for the block itself), its arrays.
BLOB = "block long, bucket int, payload binary"
KINDS = {"block": pa.int64(), "bucket": pa.int32(), "payload": pa.binary()}
OWN = -1


def packed(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return len(head).to_bytes(4, "little") + head + zstandard.ZstdCompressor(level=1).compress(body)


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + n :]), 0, []
    for kind, count in json.loads(blob[4 : 4 + n]):
        out.append(np.frombuffer(body, kind, count, at))
        at += out[-1].nbytes
    return out


def blob_row(block: int, bucket: int, *arrays: np.ndarray) -> pa.RecordBatch:
    values = {"block": block, "bucket": bucket, "payload": packed(*arrays)}
    return pa.RecordBatch.from_arrays([pa.array([v], KINDS[k]) for k, v in values.items()], list(values))


def blob_table(blocks: list, buckets: list, payloads: list) -> pa.Table:
    return pa.table([pa.array(v, k) for v, k in zip((blocks, buckets, payloads), KINDS.values(), strict=True)], list(KINDS))


def dealt(tokens: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the tokens by bucket and fingerprint, where buckets begin in it)."""
    bucket = (tokens % np.uint64(n_buckets)).astype(np.int32)
    order = np.lexsort((tokens >> np.uint64(32), bucket))
    return order, np.searchsorted(bucket[order], np.arange(n_buckets + 1))


def fingerprints(tokens: np.ndarray) -> np.ndarray:
    """32 bits of each hash; with its bucket they preselect, and never decide."""
    return (tokens >> np.uint64(32)).astype(np.uint32)


def deltas(ascending: np.ndarray) -> list[np.ndarray]:
    """Steps between 32-bit numbers as four planes of bytes, which compress well."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype(np.uint32)
    return [(steps >> np.uint32(8 * b)).astype(np.uint8) for b in range(4)]


def undeltas(planes: list[np.ndarray]) -> np.ndarray:
    return np.cumsum(sum(p.astype(np.uint64) << np.uint64(8 * b) for b, p in enumerate(planes))).astype(np.uint32)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    top = int(numbers.max(initial=0))
    return numbers.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
