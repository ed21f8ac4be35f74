"""Token ids in shard files, each one wavelet matrix.

A wavelet matrix stores ids as bit-planes, from the highest bit down; after each
plane, ids are dealt stably by that bit. Planes are cut into blocks that are compressed
one by one, and the ones before each block stand in the file beside them. So rank and
select on a plane open a block each, and together they give the id at a place, how often
an id occurs in a stretch, and where its k-th occurrence is, straight from the compressed
file. The document index (ids and lengths) stands in the same file.

Shards are ranges of documents in ascending order. A shard is one row (name, counts,
bytes) of a Parquet table, so Spark's committers write it, whatever the store, and a
lost executor's half-written files never count.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.bpe import PieceEncoder
from tessella.llm.common import Workspace, parts, settings
from tessella.llm.words import gather_ranges, give_back, segment_sum, split_words

MAGIC = b"WVM2"
#: Bits of a block, and tokens of a shard, about.
BLOCK_BITS, SHARD_TOKENS = 1 << 16, 4_000_000
BLOCK_BYTES = BLOCK_BITS // 8
#: Shards (rows) in an Arrow batch.
SHARDS_AT_ONCE = 4
#: Opened blocks that a reader keeps.
HELD_BLOCKS = 64
#: Bytes of text that are encoded at once, about.
BATCH_BYTES = 16_000_000


NAMES = ["shard", "first_doc", "last_doc", "n_docs", "n_tokens", "payload"]
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


class WaveletMatrix:
    """Ids below 2^bits in a compressed file (bytes), with rank and select on every plane.

    File: MAGIC, length of a JSON head, head, a directory of 64-bit numbers, and the
    compressed blocks. The directory holds, level by level, the ones before each block
    (and in all), then where each block ends; behind the planes' blocks come document ids
    and document lengths, each one block.
    """

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size = int.from_bytes(blob[4:8], "little")
        head = json.loads(blob[8 : 8 + size])
        self.n, self.bits, self.n_blocks = head["n"], head["bits"], head["blocks"]
        at = 8 + size
        directory = np.frombuffer(blob, "<i8", self.bits * (self.n_blocks + 1) + self.bits * self.n_blocks + 2, at)
        self.ones = directory[: self.bits * (self.n_blocks + 1)].reshape(self.bits, self.n_blocks + 1)
        self.zeros = [self.n - int(c[-1]) for c in self.ones]
        self.ends = directory[self.ones.size :]
        self.body = memoryview(blob)[at + directory.nbytes :]
        self.opened = 0
        self._block = lru_cache(HELD_BLOCKS)(self._open)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int, doc_ids: np.ndarray, doc_lengths: np.ndarray) -> WaveletMatrix:
        """From ids in order; doc_lengths cut them into documents."""
        now, n_blocks = np.ascontiguousarray(ids, np.uint32 if bits > 16 else np.uint16), -(-len(ids) // BLOCK_BITS)
        pack, parts, counts = zstandard.ZstdCompressor(level=1).compress, [], []
        for bit in reversed(range(bits)):
            ones = (now & now.dtype.type(1 << bit)).astype(bool)
            plane = np.zeros(n_blocks * BLOCK_BYTES, np.uint8)
            bytes_ = np.packbits(ones, bitorder="little")
            plane[: len(bytes_)] = bytes_
            per_block = np.bitwise_count(plane.view(np.uint64)).reshape(n_blocks, BLOCK_BITS // 64).sum(axis=1, dtype=np.int64)
            counts.append(np.concatenate([[0], np.cumsum(per_block)]))
            parts += [pack(plane[at : at + BLOCK_BYTES].tobytes()) for at in range(0, len(plane), BLOCK_BYTES)]
            now = np.concatenate([now[~ones], now[ones]])
        parts += [pack(doc_ids.astype("<i8").tobytes()), pack(doc_lengths.astype("<i8").tobytes())]
        directory = np.concatenate([*counts, np.cumsum([len(p) for p in parts])]).astype("<i8")
        head = json.dumps({"n": len(ids), "bits": bits, "blocks": n_blocks}).encode()
        return cls(MAGIC + len(head).to_bytes(4, "little") + head + directory.tobytes() + b"".join(parts))

    def to_bytes(self) -> bytes:
        return bytes(self.body.obj)

    def _open(self, k: int) -> np.ndarray:
        """The k-th part of the file, decompressed."""
        self.opened += 1
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self.body[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])]), np.uint8)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._block(self.bits * self.n_blocks).view("<i8")

    @property
    def doc_lengths(self) -> np.ndarray:
        return self._block(self.bits * self.n_blocks + 1).view("<i8")

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK_BITS)
        count = int(self.ones[level, k])
        if rest:
            block = self._block(level * self.n_blocks + k)
            count += int(np.bitwise_count(block[: rest // 8]).sum())
            count += (int(block[rest // 8]) & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0
        return count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self.ones[level]
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._block(level * self.n_blocks + block), bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            k, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(level * self.n_blocks + k)[rest // 8]) >> rest % 8 & 1
            value = value << 1 | bit
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        """Where the id's occurrences within [low, high) stand after the last plane."""
        if not 0 <= symbol < 1 << self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """How often the id occurs in places low to high."""
        a, b = self._range(symbol, low, self.n if high is None else high)
        return b - a

    def occurrence(self, symbol: int, k: int) -> int:
        """Place of the id's k-th occurrence, from 0; -1 if there are fewer."""
        a, b = self._range(symbol, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order: planes from the last to the first, each undoing one deal."""
        now = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            plane = [self._open(level * self.n_blocks + k) for k in range(self.n_blocks)]
            bits = np.unpackbits(np.concatenate(plane) if plane else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)
            zeros, back = self.zeros[level], np.empty_like(now)
            back[~bits] = now[:zeros]
            back[bits] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = back
        return now


class BatchEncoder:
    """Ids of whole texts for vocabularies that drop white space; each distinct word of a batch
    is encoded once, and pieces met before not at all."""

    def __init__(self, vocabulary: str):
        self.encoder = PieceEncoder(vocabulary)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        words, codes, bounds = split_words(texts)
        n_ids, flat = self.encoder.many(words)
        per_text = segment_sum(n_ids[codes], bounds).astype(np.int64)
        return per_text, flat[gather_ranges((np.cumsum(n_ids) - n_ids)[codes], n_ids[codes])]


def write_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes docs in ascending id order, appends end_id to each, and writes shards to path.

    A null text counts as empty: its document is end_id alone. Rows with equal ids
    follow one another, shorter texts first; null ids come first. No rows, no shard.
    A shard closes once it holds shard_tokens; one document is never cut.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = max(json.loads(vocabulary)["model"]["vocab"].values())
    bits = int(max([size, end_id, *(t["id"] for t in json.loads(vocabulary)["added_tokens"])])).bit_length()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = BatchEncoder(held.value)
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting, made, part_no = 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            names, lengths, ids = (np.concatenate(x) for x in zip(*rows, strict=True))
            blob = WaveletMatrix.build(ids, bits, names, lengths).to_bytes()
            columns = [f"{part_no:08d}-{made:06d}"], [int(names[0])], [int(names[-1])], [len(names)], [len(ids)], [blob]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)

        for batch in batches:
            step = max(1, len(batch) * BATCH_BYTES // max(batch.nbytes, 1))
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                lengths, ids = encode(part.column(1))
                out = np.full(len(ids) + len(lengths), end_id, np.uint32)
                ends = np.cumsum(lengths + 1) - 1
                inside = np.ones(len(out), bool)
                inside[ends] = False
                out[inside] = ids
                names = part.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                rows.append((names, lengths + 1, out))
                waiting += len(out)
                if waiting >= shard_tokens:
                    yield close()
                    rows, waiting, made = [], 0, made + 1
        if rows:
            yield close()

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = docs.repartitionByRange(parts(docs, 12.0), "doc_id").sortWithinPartitions("doc_id", F.octet_length("text"), "text")
    with settings(docs.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        ordered.mapInArrow(shards, "shard string, first_doc long, last_doc long, n_docs long, n_tokens long, payload binary").write.parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens and
    ids_crc32 (unsigned, of its ids as little-endian unsigned 32-bit integers).

    Each shard is decoded by itself; starts add the tokens of earlier shards, a running
    sum over a table with a row per shard.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                matrix = WaveletMatrix(blob.as_py())
                ids = matrix.decode().astype("<u4")
                doc_ids, lengths = matrix.doc_ids, matrix.doc_lengths
                ends = np.cumsum(lengths)
                starts = ends - lengths
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                names = pa.array(doc_ids, pa.int64(), mask=doc_ids == np.iinfo(np.int64).min)
                give_back()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(sums), pa.string()), names, pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())], ["shard", "doc_id", "within", "n_tokens", "ids_crc32"])

    before = Window.orderBy("first_doc", "last_doc", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = shards.select("shard", "first_doc", "last_doc", "n_tokens").select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    found = shards.select("shard", "payload").mapInArrow(decode, "shard string, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(offsets, F.col("shard") == F.col("_shard")).select("doc_id", (F.col("within") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes docs to fresh shards in the shared folder and reads them back. The shards go when
    Spark ends; write_shards leaves files that stay."""
    space = Workspace(docs.sparkSession, "token-shards")
    path = f"{space.path}/shards"
    write_shards(docs, path, vocabulary, end_id, shard_tokens)
    return space.write(read_documents(docs.sparkSession.read.parquet(path)), "documents", SHARDS_AT_ONCE)
