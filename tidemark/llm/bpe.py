"""Byte-level BPE by a dynamic program over prefixes, exact to the library that owns the vocabulary.

The BPE encoding of every prefix of a word ends in one token only.  A sequence of tokens is the encoding of its bytes
exactly if each neighbouring pair is the encoding of its own bytes.  So a prefix's last token is the longest vocabulary
entry that ends there and is compatible with the last token of the prefix before it.  All entries ending at a position
come from one pass of a suffix-linked automaton; the pair test undoes merges from the outside in and memoises.
Following the back-pointers from the end gives the ids.

Cases: null and empty texts give no ids; special tokens in a text become their ids, as in the library; rows are
independent, so repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import per_process, pieces, text_or_empty

#: Fixed value: the split pattern of byte-level pre-tokenisation.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a worker process; the memory is emptied when full.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(k): v for k, v in model["model"]["vocab"].items()}
        self.bytes_of = {v: k for k, v in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.bytes_of |= {v: k.encode() for k, v in self.special.items()}
        # Order of birth: single bytes first, then merges by rank.
        self.birth = {vocab[bytes([b])]: -1 for b in range(256) if bytes([b]) in vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = raw(left), raw(right)
            whole = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = whole
            if whole not in self.birth:
                self.birth[whole] = rank
                self.parts[whole] = vocab[a], vocab[b]
        self.suffixes = ahocorasick.Automaton()
        for token, number in vocab.items():
            if number in self.birth:
                self.suffixes.add_word(token.decode("latin-1"), (len(token), number))
        self.suffixes.make_automaton()
        self.splitter = regex.compile(SPLIT)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.stable: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are.

        Undoes the later-born of the two along the seam, step by step; if at some step the facing parts would merge
        before the tokens they belong to were born, the seam does not hold.
        """
        known = self.stable.get((left, right))
        if known is not None:
            return known
        a, b, birth = left, right, self.birth
        before_a = before_b = 1 << 60  # rank of the merge that consumed the facing part on each side
        holds = True
        while True:
            whole = self.merged.get((a, b))
            if whole is not None:
                rank = birth[whole]
                # Equal ranks: merges run from the left, so the left neighbour's merge comes first.
                if rank < before_a and rank <= before_b:
                    holds = False
                    break
            if birth[a] > birth[b] or (birth[a] == birth[b] and a in self.parts):
                before_a, a = birth[a], self.parts[a][1]
            elif b in self.parts:
                before_b, b = birth[b], self.parts[b][0]
            elif a in self.parts:
                before_a, a = birth[a], self.parts[a][1]
            else:
                break
        if len(self.stable) >= 4 * REMEMBERED:
            self.stable.clear()
        self.stable[left, right] = holds
        return holds

    def word(self, raw: bytes) -> list[int]:
        """Ids of one word: the unique last token of each prefix, then back-pointers from the end."""
        n = len(raw)
        last = [-1] * (n + 1)
        back = [0] * (n + 1)
        stable, compatible = self.stable, self.compatible
        # Entries ending at one position come longest first; the first that fits is the only one that does.
        for position, (size, token) in self.suffixes.iter(raw.decode("latin-1")):
            end = position + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                holds = stable.get((before, token))
                if not (compatible(before, token) if holds is None else holds):
                    continue
            last[end] = token
            back[end] = start
        ids, end = [], n
        while end > 0:
            if last[end] < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            ids.append(last[end])
            end = back[end]
        ids.reverse()
        return ids

    def words(self, text: str) -> Iterator[str | int]:
        """Words of a text in order; a special token comes as its id."""
        if self.specials is None or not any(s in text for s in self.special):
            yield from self.splitter.findall(text)
            return
        for part in self.specials.split(text):
            if part in self.special:
                yield self.special[part]
            else:
                yield from self.splitter.findall(part)


class Remembered(dict):
    """word -> (number of ids, ids as b"1,2,", bytes the ids decode to)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word):
        ids = [word] if isinstance(word, int) else self.vocabulary.word(word.encode())
        value = len(ids), "".join(f"{i}," for i in ids), b"".join(self.vocabulary.bytes_of[i] for i in ids)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def load(path: str) -> Vocabulary:
    return per_process(f"vocabulary:{path}", lambda: Vocabulary(path))


def encode(text: str, path: str) -> list[int]:
    """Ids of one text."""
    v = load(path)
    return [i for w in v.words(text) for i in ([w] if isinstance(w, int) else v.word(w.encode()))]


def decode(ids: list[int], path: str) -> str:
    """Text of a list of ids; bytes that are no UTF-8 become U+FFFD."""
    v = load(path)
    return b"".join(v.bytes_of[i] for i in ids).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, ``n_tokens``, ``ids`` (decimal, comma-joined) and ``decoded`` of every row: one pass, no exchange."""
    types = {f.name: f for f in docs.schema}
    out = ", ".join(f"`{k}` {types[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        memory = per_process(f"bpe-words:{path}", lambda: Remembered(load(path)))
        words = memory.vocabulary.words
        for batch in batches:
            for part in pieces(batch, "_text"):
                counts, ids, decoded = [], [], []
                for t in part.column("_text").to_pylist():
                    got = [memory[w] for w in words(t)]
                    counts.append(sum([g[0] for g in got]))
                    ids.append("".join([g[1] for g in got])[:-1])
                    decoded.append(b"".join([g[2] for g in got]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keys), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    [*keys, "n_tokens", "ids", "decoded"],
                )

    return docs.select(*keys, text_or_empty(text).alias("_text")).mapInArrow(run, f"{out}, n_tokens long, ids string, decoded string")


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens and SHA-256 of ids and decoded text, hashed where they are made."""

    def run(batches):
        memory = per_process(f"bpe-words:{path}", lambda: Remembered(load(path)))
        words, sha = memory.vocabulary.words, hashlib.sha256
        for batch in batches:
            for part in pieces(batch, "_text"):
                counts, ids, decoded = [], [], []
                for t in part.column("_text").to_pylist():
                    got = [memory[w] for w in words(t)]
                    counts.append(sum([g[0] for g in got]))
                    ids.append(sha("".join([g[1] for g in got])[:-1].encode()).hexdigest())
                    back = b"".join([g[2] for g in got]).decode("utf-8", "replace")
                    decoded.append(sha(back.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
