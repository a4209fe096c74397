"""Alignment of two tokenizers over the same bytes: which tokens overlap, and which runs of tokens cover equal bytes.

Tokens of both sides tile the bytes of a text.  A task lays the texts of a block end to end and runs ``pandas.merge_asof``
by document in both directions: each token start finds the other side's covering token.  The union of both directions is
every overlapping pair; offsets at which tokens of both sides end cut the text into groups.

How often an id pair is linked in the whole corpus is counted from each block's distinct pairs, so what is exchanged is a
block's dictionary and never its links.  The links wait in the shared folder as positions in that dictionary; the counts
come back to their block by a join on the pair and a cogroup by block.  A frequent pair is one row for a block.

Cases: a null or empty text has no tokens, as has one whose tokens on either side don't join to its bytes (a normalising
tokenizer, or U+2581 in the text): counts are zero and the digest is empty; texts of any length are encoded whole; rows
are judged each for itself, so repeated ids and rows keep all their rows; extra columns are not read; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm import bpe
from tidemark.llm.common import per_process, text_or_empty, written
from tidemark.llm.packing import tokenizer

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: A pair of ids as one number: left * PAIR + right.
PAIR = 1 << 32
#: Bytes of runs remembered by a worker process; the memory is emptied between blocks when full.
REMEMBERED_BYTES = 1 << 26


def same_bytes(ids: list[np.ndarray], of: dict[int, bytes], raw: list[bytes]) -> np.ndarray:
    return np.array([b"".join([of[i] for i in row.tolist()]) == r for row, r in zip(ids, raw)], bool)


class ByteSide:
    """Byte-level BPE; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.path, self.encoder = path, tokenizer(path)
        self.bytes_of = {i: self.encoder.decode_single_token_bytes(i) for i in range(self.encoder.n_vocab)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            try:
                out.append(self.encoder.encode_to_numpy(" " + t, disallowed_special=()))
            except ValueError:  # a very long run of white space: the exact encoder takes it
                v = bpe.load(self.path)
                out.append(np.array([i for w in v.splitter.findall(" " + t) for i in v.word(w.encode())], np.uint32))
        return out


class PieceSide:
    """SentencePiece BPE, which puts a space before the text itself.

    Where no entry of the vocabulary has a space behind another letter and nothing is normalised, no merge crosses the
    start of a run of spaces: the text is encoded run by run, and runs are remembered.
    """

    def __init__(self, path: str):
        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, crossing = {}, False
        for i in range(self.encoder.get_piece_size()):
            piece = self.encoder.id_to_piece(i)
            self.bytes_of[i] = bytes([int(piece[3:5], 16)]) if self.encoder.is_byte(i) else piece.replace("▁", " ").encode()
            crossing |= "▁" in piece.lstrip("▁")
        model = sentencepiece_model_pb2.ModelProto.FromString(self.encoder.serialized_model_proto())
        plain = model.normalizer_spec
        self.by_runs = not (crossing or plain.precompiled_charsmap or plain.remove_extra_whitespaces) and plain.add_dummy_prefix and plain.escape_whitespaces
        self.runs = re.compile(" *[^ ]+| +")
        self.space = np.array([self.encoder.piece_to_id("▁")], np.uint32).tobytes()
        self.remembered, self.held = {" ": self.space}, 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_runs:
            return [np.array(ids, np.uint32) for ids in self.encoder.encode(texts, num_threads=1)]
        if self.held > REMEMBERED_BYTES:
            self.remembered, self.held = {" ": self.space}, 0
        runs = [self.runs.findall(" " + t) for t in texts]
        fresh = list({r for row in runs for r in row if r not in self.remembered})
        for r, ids in zip(fresh, self.encoder.encode([r[1:] for r in fresh], num_threads=1)):
            self.remembered[r] = np.array(ids, np.uint32).tobytes()
            self.held += 200 + 5 * len(r)
        of = self.remembered
        return [np.frombuffer(b"".join([of[r] for r in row]), np.uint32) for row in runs]


class Side:
    """What a block needs of a tokenizer: encoded texts, token lengths."""

    def __init__(self, tokens):
        self.tokens = tokens
        n = max(tokens.bytes_of) + 1
        self.sizes = np.array([len(tokens.bytes_of.get(i, b"")) for i in range(n)], np.int64)

    def encode(self, texts: list[str], raw: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of every text, and whether their bytes are the text's."""
        ids = self.tokens.encode(texts)
        return ids, same_bytes(ids, self.tokens.bytes_of, raw)


def covering(starts: np.ndarray, docs: np.ndarray, other_starts: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each start the position of the other side's token that covers it."""
    own = pd.DataFrame({"start": starts, "doc": docs})
    other = pd.DataFrame({"start": other_starts, "doc": other_docs, "token": np.arange(len(other_starts), dtype=np.int32)})
    return pd.merge_asof(own, other, on="start", by="doc")["token"].to_numpy()


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal letters of 0 to n - 1 from the left, one place to spare, and how many each has."""
    width = len(str(n))
    return np.array([str(i).ljust(width + 1) for i in range(n)], f"S{width + 1}").view(np.uint8).reshape(n, width + 1), np.array([len(str(i)) for i in range(n)])


def decimal_run(ids: np.ndarray, after: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids each followed by a letter, end to end, and the offset behind each."""
    table, sizes = per_process(f"decimals:{most}", lambda: decimals(most))
    letters, size = table[ids], sizes[ids]
    letters[np.arange(len(ids)), size] = after
    return letters[np.arange(table.shape[1]) <= size[:, None]], np.cumsum(size + 1)


def align(a: list[np.ndarray], b: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> dict[str, np.ndarray | list[str]]:
    """Links and groups of the documents of a block, whose sides have equal bytes document by document."""
    n = len(a)
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ids_a, ids_b = (np.concatenate([np.zeros(0, np.uint32), *x]).astype(np.int64) for x in (a, b))
    doc_a, doc_b = np.repeat(np.arange(n, dtype=np.int32), n_a), np.repeat(np.arange(n, dtype=np.int32), n_b)
    end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    start_a, start_b = end_a - size_a[ids_a], end_b - size_b[ids_b]
    over_b, over_a = covering(start_a, doc_a, start_b, doc_b), covering(start_b, doc_b, start_a, doc_a)
    # A pair that starts together is found from both sides; it counts once.
    late = np.flatnonzero(start_a[over_a] != start_b)
    n_late = np.bincount(doc_b[late], minlength=n)
    # Links document by document: those found from the left side first.
    at_left = np.arange(len(ids_a)) + np.repeat(np.cumsum(n_late) - n_late, n_a)
    at_late = np.arange(len(late)) + np.repeat(np.cumsum(n_a), n_late)
    keys = np.zeros(len(ids_a) + len(late), np.int64)
    keys[at_left] = ids_a * PAIR + ids_b[over_b]
    keys[at_late] = ids_a[over_a[late]] * PAIR + ids_b[late]
    place, pairs = pd.factorize(keys)
    place = place.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
    counts = np.bincount(place, minlength=len(pairs))
    del keys, at_left, at_late, over_a, over_b, start_a, start_b
    # Groups end where tokens of both sides end.
    total = int(end_a[-1]) if len(end_a) else 0
    marks = np.zeros(total + 1, np.int8)
    marks[end_a] += 1
    marks[end_b] += 1
    before = np.cumsum(marks == 2, dtype=np.int32)
    last_a, last_b = marks[end_a] == 2, marks[end_b] == 2
    group_a, group_b = before[end_a] - last_a, before[end_b] - last_b
    # In the written form a group's left ids come before its right ids.
    n_groups = int(before[-1])
    left, right = np.cumsum(np.bincount(group_a, minlength=n_groups)), np.cumsum(np.bincount(group_b, minlength=n_groups))
    at_a, at_b = np.arange(len(ids_a)) + np.append(0, right)[group_a], np.arange(len(ids_b)) + left[group_b]
    del before, marks, end_a, end_b, group_a, group_b
    ids, after = np.zeros(len(ids_a) + len(ids_b), np.int32), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = ids_a, ids_b
    after[at_a[last_a]], after[at_b[last_b]] = ord("|"), ord(";")
    letters, ends = decimal_run(ids, after, max(len(size_a), len(size_b)))
    stop = np.append(0, ends)[np.cumsum(n_a + n_b)]
    begin = np.append(0, stop[:-1])
    body = memoryview(letters)
    digests = [hashlib.sha256(body[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(begin.tolist(), stop.tolist())]
    return {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": np.bincount(doc_a[last_a], minlength=n),
        "n_links": n_a + n_late,
        "groups_sha256": digests,
        "pairs": pairs,
        "counts": counts,
        "links": place,
    }


BLOCK_SCHEMA = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, counts array<long>, links binary"
)


def blocks(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for a block of documents: their counts and digests, the block's distinct id pairs, links as positions there."""

    def run(batches):
        a = per_process(f"side:{path_a}", lambda: Side(ByteSide(path_a)))
        b = per_process(f"side:{path_b}", lambda: Side(PieceSide(path_b)))
        number = TaskContext.get().partitionId() << 32
        waiting: list[tuple[int | None, str]] = []
        size = 0

        def block():
            texts = [t for _, t in waiting]
            raw = [b" " + t.encode() for t in texts]
            (left, whole_a), (right, whole_b) = a.encode(texts, raw), b.encode(texts, raw)
            fine = whole_a & whole_b & np.array([len(t) > 0 for t in texts], bool)
            none = np.zeros(0, np.uint32)
            left, right = [x if f else none for x, f in zip(left, fine)], [x if f else none for x, f in zip(right, fine)]
            got = align(left, right, a.sizes, b.sizes)
            row = {"block": number, "doc_id": [i for i, _ in waiting], **{k: v if isinstance(v, list) else v.tolist() for k, v in got.items() if k not in ("pairs", "counts", "links")}}
            row |= {"pairs": got["pairs"], "counts": got["counts"], "links": got["links"].tobytes()}
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), *((k, pa.list_(pa.int64())) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("links", pa.binary())]))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("_text")):
                text = text.as_py()
                if waiting and size + len(text) > block_bytes:
                    yield block()
                    waiting.clear()
                    number, size = number + 1, 0
                waiting.append((doc_id, text))
                size += len(text.encode()) if not text.isascii() else len(text)
        if waiting:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text")).mapInArrow(run, BLOCK_SCHEMA)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, count, best): links of an id pair in the whole corpus, and whether no other left id has more with its right id."""
    pairs = table.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    pairs = written(pairs.withColumn("right", F.col("pair") % PAIR), "pairs")
    most = pairs.groupBy("right").agg(F.max("count").alias("most"))
    return pairs.join(most, "right").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    table = written(blocks(docs, path_a, path_b, block_bytes), "alignment")
    facts = table.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(pair_counts(table), "pair").select("of", "place", "count", "best")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        row = left.to_pylist()[0]
        links = np.frombuffer(row["links"], np.uint16 if n <= 1 << 16 else np.uint32)
        ends = np.cumsum(row["n_links"])
        ahead = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x[links]))[ends]))
        columns = {k: row[k] for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        types = pa.schema([(k, pa.int64()) for k in (*columns, "n_best", "count_sum")] + [("groups_sha256", pa.string())])
        return pa.table({**columns, "n_best": ahead(best), "count_sum": ahead(count), "groups_sha256": row["groups_sha256"]}, types)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return table.drop("pairs", "counts").groupBy("block").cogroup(facts.groupBy("of")).applyInArrow(finish, schema)
