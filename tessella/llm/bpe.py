"""BPE encoding and decoding through a table of distinct words.

Each batch of documents is a block: its texts become codes into the block's own
distinct words. The blocks' words are dealt out by hash, each distinct word of the
corpus is encoded once, the ids return to the blocks that hold the word, and
documents are put together by position. Decoding joins each id with its piece.

A word here is white space and the run after it, so words in order spell the text.
The byte-level pattern never matches across such a border, so a word's ids are the
same alone as in its text; where a border is in doubt (white space beyond ASCII),
none is set and the word is longer.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import chain
from os.path import commonprefix
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.blobs import packed, unpacked
from tessella.llm.common import Workspace, parts
from tessella.llm.merges import Merges
from tessella.llm.words import bytes_of, gather_ranges, give_back, segment_sum, slice_hashes, strings_from

DOCS, WORDS = 0, 1


def vocabulary_file(path: str | None, name: str) -> str:
    """The tokenizer's JSON, from path or by name from the installed vocabulary files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_text(encoding="utf-8")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: printable ones stand for
    themselves, the others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class PieceEncoder:
    """Ids of single words as the tokenizers library gives them for the words alone.

    The usual words are cut by a pattern compiled once and merged all at once (merges);
    whatever holds other characters or a special token takes the whole tokenizer.
    """

    #: Latin letters whose normal forms and lower cases are single characters.
    USUAL = regex.compile(r"[\t\n\r !-~À-ÖØ-öø-įıĲ-ſ]*+\Z")
    CUTS = {
        True: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?+[A-Za-zÀ-ÖØ-öø-ſ]++| ?+[0-9]++| ?+[!-/:-@\[-`{-~]++|\s+(?!\S)|\s+"),
        False: regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ſ]++|[0-9]|[!-/:-@\[-`{-~]++"),
    }

    #: Words that need no pattern: letters whose cases are single letters, and at most one sign.
    SIMPLE = {True: "^ ?[A-Za-zÀ-ÖØ-öø-įıĲ-ſ]+[.,;:!?]?$", False: "^[A-Za-zÀ-ÖØ-öø-įıĲ-ſ]+[.,;:!?]?$"}

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        kinds = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"] or {"type": ""}])]
        self.spaced = kinds == ["ByteLevel"] and spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"]["add_prefix_space"]
        norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.lowered = kinds == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]
        self.cut = self.CUTS[bool(self.spaced)] if self.spaced or self.lowered else None
        specials = [t["content"] for t in spec["added_tokens"]]
        self.marks = (commonprefix(specials),) if commonprefix(specials) else tuple(specials)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.merges = Merges(spec["model"], byte_letters()) if self.cut else None

    def cuts(self, word: str) -> list[str] | None:
        """The pieces of a word that the pattern may cut; None if it takes the whole tokenizer."""
        if self.cut is None or not self.USUAL.match(word) or any(m in word for m in self.marks):
            return None
        return self.cut.findall(word.lower() if self.lowered else word)

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids in order); each distinct piece is merged once."""
        encoded = pieces.dictionary_encode()
        codes = encoded.indices.to_numpy(zero_copy_only=False)
        n, flat = self.merges(*bytes_of(encoded.dictionary))
        return n[codes], flat[gather_ranges((np.cumsum(n) - n)[codes], n[codes])]

    def rest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order) of words with whatever characters."""
        cuts = [self.cuts(w) for w in words]
        odd = [self.tokenizer.encode(w, add_special_tokens=False).ids for w, c in zip(words, cuts, strict=True) if c is None]
        odd_n, odd_flat = _flat(odd)
        is_odd = np.fromiter((c is None for c in cuts), bool, len(cuts))
        n_pieces = np.fromiter((len(c) for c in cuts if c is not None), np.int64, len(cuts) - len(odd))
        lengths = np.zeros(len(words), np.int64)
        lengths[is_odd] = odd_n
        flat = np.zeros(0, np.uint32)
        if n_pieces.sum():
            n, flat = self.pieces(pa.array([p for c in cuts if c for p in c], pa.large_string()))
            lengths[~is_odd] = segment_sum(n, np.concatenate([[0], np.cumsum(n_pieces)])).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = np.empty(int(lengths.sum()), np.uint32)
        ids[gather_ranges(starts[is_odd], odd_n)] = odd_flat
        ids[gather_ranges(starts[~is_odd], lengths[~is_odd])] = flat
        return lengths, ids

    def many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids in order).

        Letters with at most one sign behind them are told apart over Arrow arrays, and
        each distinct run of letters is encoded once, whatever its case where that is
        dropped and whatever sign follows.
        """
        words = words.cast(pa.large_string())
        simple = np.zeros(len(words), bool)
        if self.cut is not None and len(words):
            simple = pc.match_substring_regex(words, self.SIMPLE[bool(self.spaced)]).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(simple))
        plain = pc.utf8_lower(plain) if self.lowered else plain
        signed = pc.match_substring_regex(plain, "[.,;:!?]$").to_numpy(zero_copy_only=False)
        cores = pc.replace_substring_regex(plain, "[.,;:!?]$", "").dictionary_encode()
        signs = pc.utf8_slice_codeunits(plain.filter(pa.array(signed)), -1)
        core_n, core_flat = self.merges(*bytes_of(cores.dictionary)) if len(cores) else _flat([])
        with without_collection():
            rest_n, rest_flat = self.rest(words.filter(pa.array(~simple)).to_pylist())
        codes = cores.indices.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(words), np.int64)
        lengths[simple] = core_n[codes] + signed * 1  # a sign is one id in any vocabulary that has all bytes
        lengths[~simple] = rest_n
        ends = np.cumsum(lengths)
        starts = ends - lengths
        ids = np.empty(int(lengths.sum()), np.uint32)
        ids[gather_ranges(starts[simple], core_n[codes])] = core_flat[gather_ranges((np.cumsum(core_n) - core_n)[codes], core_n[codes])]
        if len(signs):
            of_sign = np.zeros(128, np.uint32)
            of_sign[list(b".,;:!?")] = self.pieces(pa.array(list(".,;:!?"), pa.large_string()))[1]  # one id each
            ids[ends[simple][signed] - 1] = of_sign[bytes_of(signs)[0]]
        ids[gather_ranges(starts[~simple], rest_n)] = rest_flat
        return lengths, ids


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lengths, np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum()))


@contextmanager
def without_collection() -> Iterator[None]:
    """Very many small lists are made, none in a cycle; scanning them again and again would cost most of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@cache
def pieces(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all pieces behind one another, offsets by id): the table decoding joins with."""
    spec = json.loads(vocabulary)
    back = {c: b for b, c in byte_letters().items()}
    table = {i: bytes(back[c] for c in p) for p, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    found = [table.get(i, b"") for i in range(max(table) + 1)]
    return np.frombuffer(b"".join(found), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in found])])


def word_borders(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at each text's start, and at ASCII white space after a byte that
    surely ends no white space."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    solid = np.zeros(256, bool)
    solid[33:127] = True
    lead = np.zeros(256, bool)
    lead[0xC3:0xE0] = True  # two-byte letters from U+00C0 on
    if len(raw) < 3:
        return np.unique(offsets[:-1][offsets[:-1] < len(raw)])
    sure = solid[raw[:-1]]
    sure[1:] |= (raw[1:-1] >= 0x80) & lead[raw[:-2]]
    begins = np.zeros(len(raw), bool)
    begins[1:] = space[raw[1:]] & sure
    begins[offsets[:-1][offsets[:-1] < len(raw)]] = True
    return np.flatnonzero(begins)


def _blocks(batches: Iterator[pa.RecordBatch], n_buckets: int, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, bucket, payload): of kind DOCS one for each batch, of kind WORDS one for each
    bucket of its distinct words. A block's name is a digest of its documents."""
    for batch in batches:
        give_back()
        ids, texts = batch.column(0), batch.column(1)
        raw, offsets = bytes_of(texts)
        begins = word_borders(raw, offsets)
        ends = np.append(begins[1:], len(raw))
        words = strings_from(raw, np.append(begins, len(raw))).dictionary_encode()
        codes, distinct = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        w_raw, w_off = bytes_of(distinct)
        hashes = slice_hashes(w_raw, w_off[:-1], w_off[1:])
        known = pa.array(ids).is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = hashlib.sha256(numbers.tobytes() + known.tobytes() + offsets.tobytes() + slice_hashes(raw, offsets[:-1], offsets[1:]).tobytes()).hexdigest()[:24]
        bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((hashes, bucket))  # by bucket: the order replies come back in
        if kind == DOCS:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            use = np.argsort(-np.bincount(codes, minlength=len(order)), kind="stable")  # frequent words get small codes
            rank = np.empty(len(order), np.uint32)
            rank[use] = np.arange(len(order), dtype=np.uint32)
            small = rank[codes]
            planes = [(small >> np.uint32(8 * k)).astype(np.uint8) for k in range(3 if len(order) < 1 << 24 else 4)]
            per_text = np.searchsorted(begins, offsets)
            payload = packed(numbers, known.astype(np.uint8), per_text.astype(np.int64), place[use].astype(np.uint32), *planes)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), pa.array([payload], pa.binary())], ["block", "bucket", "payload"])
        else:
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[b] : cuts[b + 1]]
                lengths = w_off[mine + 1] - w_off[mine]
                payload = packed(lengths.astype(np.uint32), w_raw[gather_ranges(w_off[mine], lengths)])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(b)], pa.int32()), pa.array([payload], pa.binary())], ["block", "bucket", "payload"])


SCHEMA = "block string, bucket int, payload binary"


def encode(docs: DataFrame, vocabulary: str, n_buckets: int | None = None, with_ids: bool = False, with_decoded: bool = False, block_rows: int = 5_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the real thing
    where asked for: ids (array of int) with with_ids, decoded (string) with with_decoded.

    A block has at most block_rows documents: the more, the fewer words are sent twice, and
    the more memory a task takes.

    The result is computed here, once, and read from the shared folder.

    Null and empty texts have no tokens and decode to the empty text. Texts are encoded
    whole; repeated rows each give a row; a null id stays null; no rows give none.
    vocabulary is a tokenizer's JSON; its size bounds what is broadcast.

    Shuffled are a block's distinct words, their ids, and the codes of its texts, never a
    row per word. Blocks are named by content, so a recomputed block meets its replies;
    if the input itself changed in between, the missing reply is an error, not a gap.
    """
    n = parts(docs, 8.0) if n_buckets is None else n_buckets
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode_words(key: tuple, words: pa.Table) -> pa.Table:
        give_back()
        encoder = PieceEncoder(held.value)
        lists = [unpacked(p) for p in words["payload"].to_pylist()]
        lengths = np.concatenate([x[0] for x in lists]).astype(np.int64)
        distinct = strings_from(np.concatenate([x[1] for x in lists]), np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode()
        n_ids, ids = encoder.many(distinct.dictionary)
        starts = np.cumsum(n_ids) - n_ids
        codes, at, replies = distinct.indices.to_numpy(zero_copy_only=False), 0, []
        for part in lists:
            mine = codes[at : at + len(part[0])]
            at += len(mine)
            flat = ids[gather_ranges(starts[mine], n_ids[mine])]
            replies.append(packed(n_ids[mine].astype(np.uint16 if n_ids[mine].max(initial=0) < 1 << 16 else np.uint32), flat.astype(np.uint16 if encoder.size <= 1 << 16 else np.uint32)))
        return pa.table({"block": words["block"], "bucket": words["bucket"], "payload": pa.array(replies, pa.binary())})

    def put_together(texts: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        piece_raw, piece_off = pieces(held.value)
        fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
        fields += [pa.field("ids", pa.list_(pa.int32()))] * with_ids + [pa.field("decoded", pa.string())] * with_decoded
        found: list[list] = [[] for _ in fields]
        order = np.unique(replies["bucket"].to_numpy(), return_index=True)[1]  # blocks of equal content get equal replies
        answers = [unpacked(replies["payload"][int(i)].as_py()) for i in order]
        n_ids = np.concatenate([a[0] for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        ids = np.concatenate([a[1] for a in answers]).astype(np.int64) if answers else np.zeros(0, np.int64)
        starts = np.cumsum(n_ids) - n_ids
        for blob in texts["payload"].to_pylist():
            numbers, known, per_text, place, *planes = unpacked(blob)
            if len(place) != len(n_ids):
                raise RuntimeError("a block's words came back incomplete: the input changed while it was read")
            codes = place[sum(p.astype(np.uint32) << np.uint32(8 * k) for k, p in enumerate(planes))]
            for i, (a, b) in enumerate(zip(per_text[:-1], per_text[1:], strict=True)):
                mine = codes[a:b]
                tokens = ids[gather_ranges(starts[mine], n_ids[mine])]
                text = piece_raw[gather_ranges(piece_off[tokens], piece_off[tokens + 1] - piece_off[tokens])].tobytes().decode("utf-8", "replace")
                row = [int(numbers[i]) if known[i] else None, len(tokens), hashlib.sha256(tokens.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                for column, value in zip(found, [*row, *[tokens.astype(np.int32)] * with_ids, *[text] * with_decoded], strict=True):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, fields, strict=True)], schema=pa.schema(fields))

    words = rows.mapInArrow(lambda it: _blocks(it, n, WORDS), SCHEMA)
    replies = words.groupBy("bucket").applyInArrow(encode_words, SCHEMA)
    texts = rows.mapInArrow(lambda it: _blocks(it, n, DOCS), SCHEMA)
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_decoded
    whole = texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(put_together, out)
    return Workspace(docs.sparkSession, "bpe").write(whole, "encoded", block_rows)
