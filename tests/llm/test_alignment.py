"""Cross-tokenizer alignment against all pairs of token ranges."""

import hashlib
import os
import random
from collections import defaultdict

import pytest

from tessella.llm import alignment, bpe, queries
from tests.llm.corpus import empty, frame, prose, rows

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files():
    return bpe.vocabulary_file(None, "byte_bpe_50k.json"), alignment.piece_model(None, "piece_bpe_32k.model")


def all_pairs(ra, rb):
    return [(i, j) for i, s, e in ra for j, u, v in rb if s < v and u < e]


def by_ends(ra, rb):
    """The same for longer texts: whichever token ends first is left next."""
    links, x, y = [], 0, 0
    while x < len(ra) and y < len(rb):
        links.append((ra[x][0], rb[y][0]))
        end_a, end_b = ra[x][2], rb[y][2]
        x, y = x + (end_a <= end_b), y + (end_b <= end_a)
    return links


def brute(texts, files, linked=all_pairs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(files[0])
    t.encode_special_tokens = True
    t.no_truncation()
    t.no_padding()
    sp = SentencePieceProcessor(model_proto=files[1])
    back = {c: b for b, c in bpe.byte_letters().items()}
    docs, counts = [], defaultdict(int)
    for text in texts:
        a = b = ()
        if text:
            a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = ()

        def ranges(side):
            at = 0
            for i, x in side:
                yield i, at, at + len(x)
                at += len(x)

        ra, rb = list(ranges(a)), list(ranges(b))
        links = linked(ra, rb)
        both, groups = {e for *_, e in ra} & {e for *_, e in rb}, []
        for side, r in enumerate((ra, rb)):
            k = 0
            for i, _, e in r:
                if k == len(groups):
                    groups.append(([], []))
                groups[k][side].append(str(i))
                k += e in both
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in groups]
        docs.append((len(ra), len(rb), len(groups), links, ";".join(groups)))
        for pair in set(links):
            counts[pair] += 1
    top = defaultdict(int)
    for (i, _), n in counts.items():
        top[i] = max(top[i], n)
    return [(a, b, g, len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "", text) for a, b, g, links, text in docs]


ODD = ["", None, " ", "  ", "x ", " x", "x  y", "a\tb", "\n\nx\n y", "tab\t two", "no break space", "wide　 space", "<|endoftext|> x <s></s><unk>", "under▁score", "ﬁne ½ é é", "😀 x😀😀 y", "it's we'll 12 345,6", "a" * 300 + " " * 40 + "b", "\x00 zero \x1f", "漢字かな 漢字 mixed漢x", "x  y\u0085 z", "trailing  ", "́ x", "é" * 50 + " ñ"]


def test_alignment_against_all_pairs(spark, files):
    texts = [t for _, t, *_ in rows()] + ODD + ["repeated text here"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(alignment.align(docs, *files, n_parts=5, with_groups=True).collect())
    for r, w, text in zip(got, brute(texts, files), texts, strict=True):
        assert tuple(r)[1:] == w, text
    assert sum(r.n_a == 0 for r in got) == sum(not t or "▁" in t for t in texts)
    assert any(r.n_groups < min(r.n_a, r.n_b) for r in got)


def test_random_strings(spark, files):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["a", "B", " ", "  ", "\n", "\t", "é", "́", " ", "　", "1", ".", "'s", "the", "ing", "漢", "😀", "_", "<s>"]) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    got = sorted(alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *files, with_groups=True).collect())
    for r, w, text in zip(got, brute(texts, files), texts, strict=True):
        assert tuple(r)[1:] == w, repr(text)


def test_counts_go_over_all_blocks(spark, files, monkeypatch):
    texts = [prose(random.Random(i % 7), 40) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, files)
    for size in (300, 10_000_000):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        assert [tuple(r)[1:] for r in sorted(alignment.align(docs, *files, n_parts=3, with_groups=True).collect())] == want


def test_rows_are_kept_as_they_are(spark, files):
    assert alignment.align(empty(spark), *files).count() == 0
    data = [(None, None, None, None, None), (1, "same row", "en", "s", 1), (1, "same row", "en", "s", 1), (None, "a null id", None, None, None)]
    got = sorted(((r.doc_id, r.n_links, r.count_sum) for r in alignment.align(frame(spark, data), *files).collect()), key=str)
    one = brute([t for _, t, *_ in data], files)
    assert got == sorted([(i, w[3], w[5]) for (i, *_), w in zip(data, one, strict=True)], key=str)


def test_a_long_text_without_blanks(spark, files):
    text = "".join(random.Random(2).choice("abcdefghij") for _ in range(60_000))
    (r,) = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), *files, with_groups=True).collect()
    ids = [side.split(",") for g in r.groups.split(";") for side in g.split("|")]
    assert r.n_a == sum(map(len, ids[::2])) and r.n_b == sum(map(len, ids[1::2])) and r.n_links == r.n_a + r.n_b - r.n_groups


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
def test_query_over_whole_documents(spark, files):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs], files, by_ends)
    assert brute([r.text for r in docs if len(r.text or "") < 300], files) == brute([r.text for r in docs if len(r.text or "") < 300], files, by_ends)
    got = sorted(map(tuple, queries.op12_token_alignment(spark, DIR).collect()))
    assert got == sorted((r.doc_id, *w[:-1]) for r, w in zip(docs, want, strict=True))
