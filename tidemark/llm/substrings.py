"""Substring dedup over words by level-wise doubling.

Windows of a short length that occur once are done with.  Those that repeat are extended to twice the length: a window
of 2n words is the pair of the names of its halves, and only where both halves repeat can it repeat.  Levels go on until
the wanted length; what still repeats there is ordered by (document, start), and all but the first go.

Only the first level reads text.  Later levels work on the survivors, in the chunk that found them, and the exchange
carries a key once for each chunk.  Names are hashes of some 48 bits, more with more buckets; at the last level those
of both halves are compared, 96 bits.

Cases: a null or empty text has no words; a text shorter than the window keeps all; rows of equal doc_id are ordered by
start alone, so exact repeats of a row don't remove each other; a null doc_id comes after all others; extra columns are
not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import exchange as X
from tidemark.llm.common import discard, free_shuffles, pieces, raw_bytes, written
from tidemark.llm.hashing import WHITE, combine, mix, runs, word_hashes

WINDOW = 20
START = 5


def _windows(word: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all windows of n words within one row."""
    many = len(word) - n + 1
    if many <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(row[:many] == row[n - 1 :])
    h = word[at]
    for k in range(1, n):
        h = combine(h, word[at + k])
    return at, h


def _repeated(chunk: int, bits: int, keys, prints, first, position, name):
    """Rows of a level: names go to the buckets; of a name that crowds the chunk one entry goes, all are known to repeat."""
    many = np.flatnonzero(X.crowded(name))
    order, start, size = X.groups(name[many])
    lone, local = many[order[start]], np.sort(many[order[np.repeat(size > 1, size)]])
    full = name >> np.uint64(24 - bits)  # what a bucket knows of a name: its own number and 40 bits
    yield X.own_row(chunk, bits, keys=keys, prints=prints, first=first, name=full[local], **X.planes("position", position[local]))
    goes, known = np.ones(len(name), bool), np.zeros(len(name), np.uint8)
    goes[many] = False
    goes[lone] = True
    known[lone[size > 1]] = 1
    go = np.flatnonzero(goes)
    yield from X.to_buckets(chunk, name[go], bits, {"position": position[go]}, known=known[go], **X.short_names(name[go], bits))


def _answer_repeated(bucket, chunks, entries):
    """Positions whose name has other entries, and of which their chunk does not know that."""
    name = X.from_short(entries)
    shared = X.shared_names(name)
    name |= np.uint64(bucket << 40)
    at = 0
    for chunk, e in zip(chunks, entries):
        n = len(e["top"])
        wanted = np.flatnonzero(shared[at : at + n] & (e["known"] == 0))
        if len(wanted):
            arrays = {"name": name[at + wanted]} | X.planes("position", X.from_planes(e, "position")[wanted])
            yield chunk, X.pack(list(arrays), list(arrays.values()))
        at += n


def _survivors(own, answers):
    position = np.concatenate([X.from_planes(a, "position") for a in (own, *answers)])
    name = np.concatenate([a["name"] for a in (own, *answers)])
    order = np.argsort(position)
    return position[order], name[order]


def _halves(own, position, name, n):
    """(position, name of the first half, name of the second) where both halves of a window of 2n words survive."""
    second = np.searchsorted(position, position + n)
    second[second == len(position)] = 0
    doc = np.searchsorted(own["first"], position, "right")
    both = (position[second] == position + n) & (doc[second] == doc) if len(position) else np.zeros(0, bool)
    at = np.flatnonzero(both)
    return position[at], name[at], name[second[at]]


def marks(docs: DataFrame, window: int = WINDOW, start: int = START, text: str = "text") -> DataFrame:
    """(_key, _print, marks): starts of windows that also start earlier, as packed 32-bit word numbers."""
    levels = [start]
    while levels[-1] < window:
        levels.append(2 * levels[-1])
    if levels[-1] != window or start < 1:
        raise ValueError("the window must be the start length doubled a number of times")
    spark = docs.sparkSession
    bits = X.bucket_bits(spark)

    def read(batches):
        for chunk, keys, prints, body, at in X.read_chunks(batches):
            begin, end, first = runs(~WHITE[body], at)
            word = word_hashes(body, begin, end)
            row = np.repeat(np.arange(len(at) - 1), np.diff(first))
            yield X.build_rows(list(_repeated(chunk, bits, keys, prints, first.astype(np.int32), *_windows(word, row, start))))

    def double(n, last):
        def step(chunk, own, answers):
            position, left, right = _halves(own, *_survivors(own, answers), n)
            keys, prints, first = own["keys"], own["prints"], own["first"]
            if not last:
                yield from _repeated(chunk, bits, keys, prints, first, position, combine(left, right))
            else:
                yield from _ordered(chunk, bits, keys, prints, first, position, left, right)

        return step

    exchanged = X.keyed(docs, text).mapInArrow(read, X.SCHEMA)
    stored = None
    if len(levels) == 1:
        raise ValueError("the start length must be shorter than the window")
    for n in levels[:-1]:
        answered = written(X.through_buckets(exchanged, _answer_repeated), "repeats")
        discard(stored)
        stored = answered
        free_shuffles()
        exchanged = X.at_chunks(answered, double(n, 2 * n == window), X.SCHEMA, X.build_rows)
    last = written(X.through_buckets(exchanged, _answer_ordered), "repeats")
    discard(stored)
    free_shuffles()

    def final(chunk, own, answers):
        position = np.sort(np.concatenate([X.from_planes(a, "position") for a in (own, *answers)]))
        yield from X.per_document(own["keys"], own["prints"], own["first"].astype(np.int64), position)

    out = written(X.at_chunks(last, final, X.SPANS, X.span_rows), "marks")
    discard(last)
    free_shuffles()
    return out


def _later(key, left, doc, word):
    """Which entries come after the first (document, start) of their key; ``left`` tells equal keys apart."""
    order, start, size = X.groups(key)
    if len(order) and (np.minimum.reduceat(left[order], start) != np.maximum.reduceat(left[order], start)).any():
        order = np.lexsort((left, key))
        k, l = key[order], left[order]
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (l[1:] != l[:-1])]))
        size = np.diff(np.append(start, len(k)))
    out = np.zeros(len(order), bool)
    if len(order):
        d, w = doc[order], word[order]
        least = np.repeat(np.minimum.reduceat(d, start), size)
        begin = np.repeat(np.minimum.reduceat(np.where(d == least, w, np.iinfo(w.dtype).max), start), size)
        out[order] = (d > least) | (w > begin)
    return out


def _ordered(chunk, bits, keys, prints, first, position, left, right):
    """The last level: of windows that crowd a chunk the first by (document, start) goes on, the others are marked."""
    doc = np.searchsorted(first, position, "right") - 1
    key, word = keys[doc], (position - first[doc]).astype(np.int32)
    whole = mix(left ^ mix(right))
    marked = np.zeros(len(position), bool)
    many = np.flatnonzero(X.crowded(whole))
    marked[many] = _later(whole[many], left[many], key[many], word[many])
    yield X.own_row(chunk, bits, keys=keys, prints=prints, first=first, **X.planes("position", position[marked]))
    go = np.flatnonzero(~marked)
    yield from X.to_buckets(chunk, whole[go], bits, {"position": position[go], "doc": key[go]}, key=whole[go], left=left[go].astype(np.uint32), word=word[go])


def _answer_ordered(bucket, chunks, entries):
    """Positions of entries that are not the first of their window."""
    key, left, word = (np.concatenate([e[c] for e in entries]) for c in ("key", "left", "word"))
    later = _later(key, left, np.concatenate([X.from_planes(e, "doc") for e in entries]), word)
    at = 0
    for chunk, e in zip(chunks, entries):
        n = len(e["key"])
        own = later[at : at + n]
        at += n
        if own.any():
            arrays = X.planes("position", X.from_planes(e, "position")[own])
            yield chunk, X.pack(list(arrays), list(arrays.values()))


def remove(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by one space)."""
    # Rows alike in id and text have equal marks.
    found = marks(docs, window, start).groupBy("_key", "_print").agg(F.first("marks").alias("_marks"))
    joined = X.keyed(docs, "text", doc_id=F.col("doc_id").cast("long")).join(found, ["_key", "_print"], "left")
    sha = hashlib.sha256

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                body, at = raw_bytes(part.column("_text"))
                begin, end, first = runs(~WHITE[body], at)
                raw, n_removed, digest = body.tobytes(), [], []
                for d, m in enumerate(part.column("_marks").to_pylist()):
                    a, b = begin[first[d] : first[d + 1]], end[first[d] : first[d + 1]]
                    if m:
                        kept = ~X.covered(np.frombuffer(m, np.int32), window, len(a))
                        n_removed.append(int(len(a) - kept.sum()))
                        a, b = a[kept], b[kept]
                    else:
                        n_removed.append(0)
                    digest.append(sha(b" ".join([raw[i:j] for i, j in zip(a.tolist(), b.tolist())])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(first)), pa.array(n_removed, pa.int64()), pa.array(digest)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return joined.select("doc_id", "_text", "_marks").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS j FROM dup, (SELECT unnest(range(0, 20)) AS o)
), word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM t
), kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.j = gone.j GROUP BY word.doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
