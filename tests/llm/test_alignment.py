"""Token alignment against a plain walk over both tilings."""

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@functools.cache
def libraries():
    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=B), {v: k for k, v in left.get_vocab().items()}


def tokens(text):
    """Ids and bytes of both sides, by the libraries."""
    left, right, names = libraries()
    letters = byte_letters()
    a, b = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
    raw_a = [bytes(letters[c] for c in names[i]) for i in a]
    raw_b = [bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, raw_a, b, raw_b


def brute(rows):
    seen, out, count = {}, [], Counter()
    for i, text in rows:
        if text not in seen:
            a, raw_a, b, raw_b = tokens(text or "")
            raw = (" " + (text or "")).encode()
            links, groups = [], []
            if not text or b"".join(raw_a) != raw or b"".join(raw_b) != raw:
                a = b = []
            else:
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                x = y = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    left, right = x, y
                    while x < len(a) and ends_a[x] <= end:
                        x += 1
                    while y < len(b) and ends_b[y] <= end:
                        y += 1
                    groups.append(",".join(map(str, a[left:x])) + "|" + ",".join(map(str, b[right:y])))
                    for m in range(left, x):
                        for n in range(right, y):
                            if ends_a[m] - len(raw_a[m]) < ends_b[n] and ends_b[n] - len(raw_b[n]) < ends_a[m]:
                                links.append((a[m], b[n]))
            seen[text] = a, b, links, groups
        a, b, links, groups = seen[text]
        count.update(links)
        out.append((i, a, b, links, groups))
    best = {}
    for (_, right), n in count.items():
        best[right] = max(best.get(right, 0), n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(a), len(b), len(g), len(l), sum(count[x] == best[x[1]] for x in l), sum(count[x] for x in l), sha(g)) for i, a, b, l, g in out]


def order(row):
    return tuple((v is not None, v or 0) if not isinstance(v, str) else v for v in row)


def aligned(table, **sizes):
    return sorted((tuple(r[c] for c in COLUMNS) for r in alignment.align_corpus(table, A, B, **sizes).collect()), key=order)


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 20_000}])
def test_given_table(spark, data, sizes):
    table = spark.read.parquet(f"{data}/documents.parquet").where("n_chars < 6000")
    want = brute([(r.doc_id, r.text) for r in table.collect()])
    assert len(want) > 100 and aligned(table, **sizes) == sorted(want, key=order)


def test_odd_texts(spark):
    rows = [
        (1, None), (2, ""), (3, " "), (4, "▁x"), (5, "a\0b <|endoftext|> <s> é漢🎉 \r\n"), (6, " " * 1_100_000), (7, "word " * 3000), (8, "x"), (8, "x"),
        (None, "x"), (9, "ab\u0085 \u2003  c "), (10, "  two  spaces  "), (11, "tab\tand\n\n  lines\n"),
    ]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, block string, n_a int").repartition(2)
    want = brute([r for r in rows if r[0] != 6])
    got = aligned(table)
    assert [r for r in got if r[0] == 6][0][1] > 1000
    # The blanks of row 6 count towards pairs of blanks in other rows; without it all must be equal.
    assert aligned(table.where("doc_id IS NULL OR doc_id <> 6")) == sorted(want, key=order)
    assert aligned(table.where("false")) == []


def test_runs_encode_as_whole_texts():
    side = alignment.PieceSide(B)
    assert side.by_runs
    texts = ["a b", " a", "a ", "  a   b  ", " ", "\n \n", "x" * 500 + " y", "é 漢字 🎉 \t z", "1 2  3   4    5"]
    assert [x.tolist() for x in side.encode(texts)] == side.encoder.encode(texts)


def test_all_overlaps_come_once():
    sizes = np.array([0, 1, 2, 3, 4])
    got = alignment.align([np.array([2, 2, 1], np.uint32), np.array([4], np.uint32)], [np.array([1, 3, 1], np.uint32), np.array([1, 3], np.uint32)], sizes, sizes)
    assert got["n_links"].tolist() == [4, 2] and got["n_groups"].tolist() == [2, 1]
    links = [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in got["pairs"][got["links"]]]
    assert sorted(links[:4]) == [(1, 1), (2, 1), (2, 3), (2, 3)] and sorted(links[4:]) == [(4, 1), (4, 3)]
    assert got["groups_sha256"] == [hashlib.sha256(s).hexdigest() for s in (b"2,2|1,3;1|1", b"4|1,3")]
