"""Alignment of two tokenizers' tokens through the bytes at which they end.

Both tokenizers cut the same bytes. Each byte gets a label: no token ends here, one of the
first (a), one of the second (b), one of both (c). A regular expression scans the label
string for spans up to each c; a span is a group, the labels in it say how many tokens of
either side it holds, and each labelled byte is one link: the two tokens that overlap there.

No token of either side crosses a blank behind a solid character, so a text is a row of
words whose labels are the same wherever they stand. Each block of texts aligns its
distinct words once. How many documents hold a link's two ids is counted over the
corpus: blocks deal out their distinct id pairs by the first id, so a part has all that
an id is linked with, and what it counts goes back to the blocks that asked.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blobs import BLOB, OWN, blob_row, blob_table, narrow, packed, unpacked
from tessella.llm.bpe import PieceEncoder, _flat, pieces, word_borders
from tessella.llm.common import Workspace, parts
from tessella.llm.ngram_join import NO_ID, block_numbers, checked
from tessella.llm.words import bytes_of, gather_ranges, give_back, slices, strings_from

#: Bytes of text in a block, about, and texts in an Arrow batch at most.
BLOCK_BYTES, BATCH_ROWS = 5_000_000, 5_000
BLANK, MARK = 0x20, "▁"
#: A group: the labels up to the next byte at which both sides end.
LABELS, SPAN = b".abc", re.compile(rb"[.ab]*c")
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def piece_model(path: str | None, name: str) -> bytes:
    """A piece tokenizer's model, from path or by name from the installed vocabulary files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_bytes()


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]] in 64-bit integers."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def ends_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


class PlainEncoder(PieceEncoder):
    """Special tokens' strings inside texts are plain text."""

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.marks = ()


class MarkedPieces:
    """A piece tokenizer that puts a blank before the text and writes blanks as U+2581."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("pieces that go on behind a blank can't be encoded word by word")
        spelled = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.raw, self.offsets = np.frombuffer(b"".join(spelled), np.uint8), ends_of([len(p) for p in spelled])

    def many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order); each word begins with the blank that the model adds."""
        return _flat(self.model.encode(pc.utf8_slice_codeunits(words, 1).to_pylist(), num_threads=1))


def spelled(n: np.ndarray, ids: np.ndarray, piece_raw: np.ndarray, piece_off: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the pieces of each word, joined, are the word's own bytes."""
    lengths = piece_off[ids + 1] - piece_off[ids]
    right = sums(lengths, ends_of(n)) == np.diff(offsets)
    some = np.repeat(right, n)
    joined = piece_raw[gather_ranges(piece_off[ids[some]], lengths[some])]
    mine = np.diff(offsets)[right]
    wrong = joined != raw[gather_ranges(offsets[:-1][right], mine)]
    right[right] = sums(wrong, ends_of(mine)) == 0
    return right


@dataclass
class Words:
    """Aligned words: by word whether both sides spell it, and counts that are 0 where they don't;
    then all links in order, and by word the text of its groups, each group closed by `;`."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    texts: list[bytes]


class Aligner:
    def __init__(self, vocabulary_a: str, model_b: bytes):
        self.a, self.b = PlainEncoder(vocabulary_a), MarkedPieces(model_b)
        self.a_raw, self.a_off = pieces(vocabulary_a)
        names = [str(i).encode() for i in range(max(len(self.a_off), len(self.b.offsets)))]
        self.digits, self.digit_off = np.frombuffer(b"".join(names), np.uint8), ends_of([len(x) for x in names])

    def words(self, words: pa.Array) -> Words:
        """Words, each with the blank before it, as the two tokenizers cut them."""
        raw, offsets = bytes_of(words)
        n_a, a = self.a.many(words)
        n_b, b = self.b.many(words)
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = spelled(n_a, a, self.a_raw, self.a_off, raw, offsets) & spelled(n_b, b, self.b.raw, self.b.offsets, raw, offsets)
        a, b, n_a, n_b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)], n_a * ok, n_b * ok
        # Where tokens end in the words behind one another.
        bounds = ends_of(np.diff(offsets) * ok)
        mark = np.zeros(int(bounds[-1]), np.uint8)
        mark[np.cumsum(self.a_off[a + 1] - self.a_off[a]) - 1] = 1
        mark[np.cumsum(self.b.offsets[b + 1] - self.b.offsets[b]) - 1] |= 2
        labels = np.frombuffer(LABELS, np.uint8)[mark].tobytes()
        groups = np.concatenate([[0], np.fromiter((m.end() for m in SPAN.finditer(labels)), np.int64)])
        ends_a, ends_b = mark & 1, mark >> 1
        per_group_a, per_group_b = sums(ends_a, groups), sums(ends_b, groups)
        linked = np.flatnonzero(mark)
        link_a = a[np.cumsum(ends_a, dtype=np.int64)[linked] - ends_a[linked]]
        link_b = b[np.cumsum(ends_b, dtype=np.int64)[linked] - ends_b[linked]]
        texts = self._texts(a, b, per_group_a, per_group_b, ends_of(n_a + n_b))
        return Words(ok, n_a, n_b, np.diff(np.searchsorted(groups[1:], bounds, "right")), sums(mark > 0, bounds), link_a, link_b, texts)

    def _texts(self, a: np.ndarray, b: np.ndarray, per_group_a: np.ndarray, per_group_b: np.ndarray, word_tokens: np.ndarray) -> list[bytes]:
        """`a1,a2|b1;` for each group, cut into words."""
        before_a, before_b = ends_of(per_group_a), ends_of(per_group_b)
        n = len(a) + len(b)
        ids, sign = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[np.arange(len(a)) + np.repeat(before_b[:-1], per_group_a)] = a
        ids[np.arange(len(b)) + np.repeat(before_a[1:], per_group_b)] = b
        sign[before_a[1:] + before_b[:-1] - 1] = ord("|")
        sign[before_a[1:] + before_b[1:] - 1] = ord(";")
        size = self.digit_off[ids + 1] - self.digit_off[ids]
        at = ends_of(size + 1)
        out = np.empty(int(at[-1]), np.uint8)
        out[gather_ranges(at[:-1], size)] = self.digits[gather_ranges(self.digit_off[ids], size)]
        out[at[1:] - 1] = sign
        whole, cuts = out.tobytes(), at[word_tokens].tolist()
        return [whole[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


@cache
def aligner(vocabulary_a: str, model_b: bytes) -> Aligner:
    """One for each worker; loading the vocabularies takes longer than a small block."""
    return Aligner(vocabulary_a, model_b)


def blank_words(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at each text's start, and at blanks behind a solid character, but for
    a text's last byte."""
    begins = word_borders(raw, offsets)
    text = np.searchsorted(offsets, begins, "right") - 1
    first = offsets[text] == begins
    return begins[first | ((raw[begins] == BLANK) & (begins < offsets[text + 1] - 1))]


def align(docs: DataFrame, vocabulary_a: str, model_b: bytes, n_parts: int | None = None, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_a, n_b (tokens of each side), n_groups, n_links, n_best,
    count_sum, groups_sha256; with_groups adds groups, the text that is hashed: token ids of
    either side by group, as `a1,a2|b1;a3|b2,b3`.

    Side a encodes a blank and the text by a byte-level vocabulary (a tokenizer's JSON), side b
    the text by a piece model that puts the blank there itself. A link is a pair of tokens whose
    bytes overlap. A pair of ids counts the rows that hold it linked; n_best: links whose count
    is the highest of all pairs with that id of side a, ties included; count_sum: the counts
    of all links.

    Null and empty texts, and those that the tokens of a side don't spell byte for byte, have
    no tokens: all counts are 0 and the digest is ''. Repeated rows count each; a null id
    stays null; no rows give none. Texts are taken whole.

    Shuffled are the distinct id pairs of blocks, the counts that go back, and what stays
    behind for each block: codes of its words. Blocks are written once, and a missing reply
    is an error.
    """
    n = parts(docs, 8.0) if n_parts is None else n_parts
    spaced = F.when(F.col(text_col) != "", F.concat(F.lit(" "), F.col(text_col)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(spaced, F.lit("")).alias("text"))
    space = Workspace(docs.sparkSession, "alignment")
    held_a, held_b = (docs.sparkSession.sparkContext.broadcast(x) for x in (vocabulary_a, model_b))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, work = block_numbers(), aligner(held_a.value, held_b.value)
        for batch in slices(batches, BLOCK_BYTES):
            block = next(numbers)
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            raw, offsets = bytes_of(batch.column(1))
            begins = blank_words(raw, offsets)
            of_text = np.searchsorted(begins, offsets)
            coded = strings_from(raw, np.append(begins, len(raw))).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = work.words(coded.dictionary)
            ok = (np.diff(of_text) > 0) & (sums(~found.ok[codes], of_text) == 0)
            digests, groups = [], []
            for a, b, right in zip(of_text[:-1].tolist(), of_text[1:].tolist(), ok.tolist(), strict=True):
                text = b"".join(map(found.texts.__getitem__, codes[a:b].tolist()))[:-1] if right else b""
                digests.append(hashlib.sha256(text).digest() if right else bytes(32))
                if with_groups:
                    groups.append(text)
            pairs, pair = np.unique(found.link_a << 32 | found.link_b, return_inverse=True)
            bucket = (pairs >> 32) % n
            order = np.lexsort((pairs, bucket))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pair, links = place[pair], ends_of(found.n_links)
            counts = document_counts(codes, of_text, ok, pair, links, len(pairs))
            cuts = np.searchsorted(bucket[order], np.arange(n + 1))
            asked = np.flatnonzero(np.diff(cuts))
            per_text = [(sums(x[codes], of_text) * ok) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            kept = [narrow(codes), narrow(of_text), ok, narrow(pair), narrow(links), *map(narrow, per_text), np.frombuffer(b"".join(digests), np.uint8)]
            text = [np.frombuffer(b"".join(groups), np.uint8), ends_of([len(x) for x in groups])] if with_groups else []
            yield blob_row(block, OWN, ids, np.array([len(asked)]), *(x.view(np.uint8) if x.dtype == bool else x for x in kept), *text)
            for k in asked.tolist():
                mine = order[cuts[k] : cuts[k + 1]]
                yield blob_row(block, k, (pairs[mine] >> 32).astype(np.uint32), (pairs[mine] & 0xFFFFFFFF).astype(np.uint32), narrow(counts[cuts[k] : cuts[k + 1]]))

    def count(blobs: pa.Table) -> pa.Table:
        give_back()
        opened = [unpacked(p) for p in blobs["payload"].to_pylist()]
        pairs = np.concatenate([a.astype(np.int64) << 32 | b for a, b, _ in opened])
        names, back = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, back, np.concatenate([c for _, _, c in opened]).astype(np.int64))
        first = np.flatnonzero(np.diff(names >> 32, prepend=-1))  # all pairs with an id of side a
        best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.append(first, len(names))))
        total, best, at, replies = total[back], best[back], 0, []
        for a, _, _ in opened:
            mine = slice(at, at := at + len(a))
            replies.append(packed(narrow(total[mine]), np.packbits(best[mine])))
        return blob_table(blobs["block"], blobs["bucket"], replies)

    fields = [(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in OUT.split(", ")] + [("groups", pa.string())] * with_groups

    def gather(own: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        ids, n_blobs, codes, of_text, ok, pair, links, n_a, n_b, n_groups, n_links, digests, *text = unpacked(own["payload"][0].as_py())
        got = checked(int(n_blobs[0]), replies.sort_by("bucket"))
        total = np.concatenate([np.zeros(0, np.int64), *(x[0].astype(np.int64) for x in got)])
        best = np.concatenate([np.zeros(0, np.uint8), *(np.unpackbits(x[1], count=len(x[0])) for x in got)])
        links, of_text = links.astype(np.int64), of_text.astype(np.int64)
        of_word = [sums(x[pair], links) for x in (best, total)]
        n_best, count_sum = (sums(x[codes], of_text) * ok for x in of_word)
        shas = [digests[32 * i : 32 * i + 32].tobytes().hex() if right else "" for i, right in enumerate(ok.tolist())]
        columns = [pa.array(ids, pa.int64(), mask=ids == NO_ID), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links, n_best, count_sum)), pa.array(shas, pa.string())]
        if with_groups:
            columns.append(strings_from(*text).cast(pa.string()))
        return pa.Table.from_arrays(columns, schema=pa.schema(fields))

    blocks = space.write(rows.mapInArrow(cut, BLOB), "blocks", BATCH_ROWS)
    replies = blocks.where(F.col("bucket") != OWN).groupBy("bucket").applyInArrow(count, BLOB)
    own = blocks.where(F.col("bucket") == OWN).groupBy("block")
    return own.cogroup(replies.groupBy("block")).applyInArrow(gather, OUT + ", groups string" * with_groups)


def document_counts(codes: np.ndarray, of_text: np.ndarray, ok: np.ndarray, pair: np.ndarray, links: np.ndarray, n_pairs: int) -> np.ndarray:
    """How many of the block's documents hold each pair linked."""
    n_words = len(links) - 1
    held = np.unique(np.repeat(np.arange(len(links) - 1), np.diff(links)) * max(n_pairs, 1) + pair)  # each word's pairs once
    word, pair = held // max(n_pairs, 1), held % max(n_pairs, 1)
    bounds = np.searchsorted(word, np.arange(n_words + 1))
    counts, step = np.zeros(n_pairs, np.int64), max(1, len(ok) // 8)
    for a in range(0, len(ok), step):  # an eighth of the documents at a time, for memory
        b = min(a + step, len(ok))
        doc = np.repeat(np.arange(a, b), np.diff(of_text[a : b + 1]))
        mine = np.unique((doc * max(n_words, 1) + codes[of_text[a] : of_text[b]])[ok[doc]])
        doc, w = mine // max(n_words, 1), mine % max(n_words, 1)
        n = np.diff(bounds)[w]
        both = np.unique(np.repeat(doc, n) * max(n_pairs, 1) + pair[gather_ranges(bounds[:-1][w], n)])
        counts += np.bincount(both % max(n_pairs, 1), minlength=n_pairs)[:n_pairs]
    return counts
