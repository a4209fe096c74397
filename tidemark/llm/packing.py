"""Bounded-space online best-fit packing of token sequences.

A task keeps a fixed number of open bins.  Their free space is a bitset (bit f: an open bin has f free places), so the
tightest bin that takes a piece is one shift and one lowest-bit away.  When no bin fits and all are open, the fullest
closes first.  Pieces are placed in blocks of ``lookahead``, longest first, which leaves fewer gaps than arrival order
and holds a bounded number of pieces.  Every task packs what it reads: there is no exchange, a sequence never spans
tasks, and a repeated task gives the same sequences again.  What is lost is at most the open bins of each task.

Cases: a null or empty text is the end token alone; a document longer than a sequence is cut, its first piece taking
the remainder; a run of white space may be of any length; repeated rows are packed each for itself; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bpe
from tidemark.llm.bpe import SPLIT, byte_letters
from tidemark.llm.common import per_process, pieces, text_or_empty

CAPACITY = 1024
END = 2
OPEN_BINS = 512
LOOKAHEAD = 8192


def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file in a faster encoder; ids are birth ranks, so results are equal."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks={k: v for k, v in ranks.items() if v not in special.values()}, special_tokens=special)


def token_ids(encoder: tiktoken.Encoding, path: str, text: str) -> np.ndarray:
    """Ids of a text; one on which the faster encoder gives up (a very long run of white space) goes to the exact one."""
    try:
        return encoder.encode_to_numpy(text, allowed_special=encoder.special_tokens_set)
    except ValueError:
        return np.array(bpe.encode(text, path), np.uint32)


class OpenBins:
    """Best fit over at most ``limit`` open bins of ``capacity`` places."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f: by_free[f] holds a bin
        self.open = 0
        self.used = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return number

    def place(self, size: int) -> tuple[int, int]:
        """Bin number and offset for a piece of 1 to ``capacity`` tokens."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
                self.open -= 1
            number, free = self.used, self.capacity
            self.used += 1
            self.open += 1
        left = free - size
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, open_bins: int = OPEN_BINS, lookahead: int = LOOKAHEAD, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``ids`` too if asked for."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids + [("sequence_id", pa.int64()), ("offset", pa.int64())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"

    def run(batches):
        encoder = per_process(f"encoder:{path}", lambda: tokenizer(path))
        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        waiting: list[tuple] = []

        def placed():
            waiting.sort(key=lambda r: -r[3])
            spots = [bins.place(r[3]) for r in waiting]
            columns = [*zip(*waiting), [base + n for n, _ in spots], [o for _, o in spots]]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

        for batch in batches:
            for part in pieces(batch, "_text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("_text").to_pylist()):
                    ids = np.append(token_ids(encoder, path, text), np.uint32(end)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        waiting.append((doc_id, k, start, length, zlib.crc32(own), *([own.astype(np.int32)] * with_ids)))
                    if len(waiting) >= lookahead:
                        yield placed()
        if waiting:
            yield placed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(run, schema)
