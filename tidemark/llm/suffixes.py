"""Dedup of byte strings: suffixes grouped by hash behind a difference-cover filter, one bucket at a time.

Suffixes that share their first ``width`` bytes are grouped; the first document among equals keeps the string.  No
suffix order is built: only equality over ``width`` bytes decides here, and equal suffixes meet by hash as they would
by order.

1. *Cover sample.*  Positions p with p mod ``PERIOD`` in ``COVER``, a difference cover: for any two positions i and j
   there is a shift d < PERIOD that brings both into the sample.  So if two suffixes agree on ``width`` bytes, two of
   their sample suffixes agree on ``width - PERIOD + 1``.  Sample suffixes are grouped by the name of that many
   bytes, and those whose name a second document shares are kept.  They give intervals of places; no rank goes on.
2. *Suffix buckets.*  Only suffixes with a kept sample within PERIOD bytes can be long ties.  They go to buckets by a
   hash of all ``width`` bytes, made anew from the text, and are grouped by 96 bits; equal ones are ordered by document.

Both steps go through the buckets in ``rounds``, so that only one share of all positions is exchanged or held at a
time; names are 64-bit hashes, the final comparison takes 96 bits.  A chunk of text sends each key
once (see ``exchange``), so a string that a third of all documents hold stays small.

Cases: a null or empty text has nothing to remove; shorter texts than ``width`` keep all; rows of equal doc_id never
remove each other; a null doc_id comes after all others; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import exchange as X
from tidemark.llm.common import discard, free_shuffles, pieces, raw_bytes, written
from tidemark.llm.hashing import RunHashes, mix

WIDTH = 50
# The perfect difference set modulo 21; every shift is a difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Shares of the buckets, powers of two, that are worked on one after the other: sample, suffixes.
ROUNDS = (2, 4)
#: Bytes of segments worked on at once: all their positions count, not a sample.
SEGMENTS = 2 << 20


def _mine(name: np.ndarray, rounds: int, number: int) -> np.ndarray:
    """Entries of a round: it follows from the last bits of a name, its bucket from the first."""
    return np.flatnonzero((name & np.uint64(rounds - 1)) == np.uint64(number))


def _cover_positions(at: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a chunk that are in the sample and have ``depth`` bytes of their row behind them."""
    starts = np.maximum(np.diff(at) - depth + 1, 0)
    sampled = np.zeros(int(at[-1]), bool)
    for c in COVER:
        count = (starts - c + PERIOD - 1).clip(0) // PERIOD
        before = np.cumsum(count) - count
        sampled[np.repeat(at[:-1] + c - PERIOD * before, count) + PERIOD * np.arange(count.sum())] = True
    return np.flatnonzero(sampled)


def _interval_rows(own: dict, position: np.ndarray, before: int):
    """(key, fingerprint, packed 32-bit pairs): the merged intervals [p - before, p] of sorted positions, by document."""
    if not len(position):
        return
    first = own["first"].astype(np.int64)
    doc = np.searchsorted(first, position, "right") - 1
    start = np.maximum(position - before, first[doc]) - first[doc]
    end = position - first[doc] + 1
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(position)) - 1
    pairs = np.stack([start[head], end[tail]], 1).astype(np.int32)
    owner = doc[head]
    cut = np.flatnonzero(np.diff(owner)) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(owner))):
        yield int(own["keys"][owner[a]]), int(own["prints"][owner[a]]), pairs[a:b].tobytes()


def _start_rows(own: dict, position: np.ndarray):
    """(key, fingerprint, packed starts): sorted positions in segments, by document and counted from its start.

    The starts of one round lie a few bytes apart, so they are packed by their differences.
    """
    if not len(position):
        return
    segment = np.searchsorted(own["first"], position, "right") - 1
    start = position - own["first"][segment] + own["offset"][segment]
    keys, prints = own["keys"][segment], own["prints"][segment]
    cut = np.flatnonzero((keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])) + 1
    for a, b in zip(np.append(0, cut), np.append(cut, len(start))):
        arrays = X.planes("start", start[a:b])
        yield int(keys[a]), int(prints[a]), X.pack(list(arrays), list(arrays.values()))


# -- cover sample --------------------------------------------------------------------------------------------------


def _sample_rows(chunk, bits, keys, prints, body, at, depth, rounds, number):
    """Names of the sample suffixes of a chunk; of a name that crowds the chunk one entry goes, all are known as shared."""
    position = _cover_positions(at, depth)
    name = RunHashes(body, at).of(position, position + depth)
    mine = _mine(name, rounds, number)
    position, name = position[mine], name[mine]
    many = np.flatnonzero(X.crowded(name))
    order, start, size = X.groups(name[many])
    lone, local = many[order[start]], many[order[np.repeat(size > 1, size)]]
    yield X.own_row(chunk, bits, keys=keys, prints=prints, first=at.astype(np.int32), **X.planes("position", np.sort(position[local])))
    goes, known = np.ones(len(name), bool), np.zeros(len(name), np.uint8)
    goes[many] = False
    goes[lone] = True
    known[lone[size > 1]] = 1
    go = np.flatnonzero(goes)
    yield from X.to_buckets(chunk, name[go], bits, {"position": position[go]}, known=known[go], **X.short_names(name[go], bits))


def _answer(entries, chunks, wanted):
    """Positions of the wanted entries, back to their chunks."""
    at = 0
    for chunk, e in zip(chunks, entries):
        position = X.from_planes(e, "position")
        own = position[wanted[at : at + len(position)]]
        at += len(position)
        if len(own):
            arrays = X.planes("position", own)
            yield chunk, X.pack(list(arrays), list(arrays.values()))


def _answer_sample(bucket, chunks, entries):
    """Positions whose name has other entries, and of which their chunk does not know that."""
    yield from _answer(entries, chunks, X.shared_names(X.from_short(entries)) & (np.concatenate([e["known"] for e in entries]) == 0))


# -- suffixes ------------------------------------------------------------------------------------------------------


def _after_first(key, rest, doc):
    """Which suffixes tie over the whole width with one of an earlier document."""
    order, start, size = X.groups(key)
    if len(order) and (np.minimum.reduceat(rest[order], start) != np.maximum.reduceat(rest[order], start)).any():
        order = np.lexsort((rest, key))
        k, r = key[order], rest[order]
        start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])]))
        size = np.diff(np.append(start, len(k)))
    out = np.zeros(len(order), bool)
    if len(order):
        d = doc[order]
        out[order] = d > np.repeat(np.minimum.reduceat(d, start), size)
    return out


def _segments(marks: list[bytes], n: int, width: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that hold all strings starting in any of the packed intervals."""
    last = n - width
    pairs = np.concatenate([np.frombuffer(m, np.int32).reshape(-1, 2) for m in marks])
    out: list[tuple[int, int]] = []
    for a, b in pairs[np.argsort(pairs[:, 0])].tolist():
        b = min(b, last + 1)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return [(a, b + width - 1) for a, b in out]


def _suffix_rows(chunk, bits, keys, prints, offset, body, at, width, rounds, number):
    """Possible long ties of a chunk; of suffixes that crowd the chunk the first document goes on, later ones are marked."""
    starts = np.diff(at) - width + 1  # of each segment
    place = np.repeat(at[:-1] - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    lead = RunHashes(body, at, 0).of(place, place + PERIOD)
    mine = _mine(lead, rounds, number)  # the first bytes decide the round: the rest is hashed in its own round only
    place, lead = place[mine], lead[mine]
    rest = RunHashes(body, at, 1).of(place + PERIOD, place + width)
    whole = mix(lead ^ mix(rest))
    rest = (rest >> np.uint64(32)).astype(np.uint32)
    del lead
    key = keys[np.searchsorted(at, place, "right") - 1]
    marked = np.zeros(len(place), bool)
    many = np.flatnonzero(X.crowded(whole))
    marked[many] = _after_first(whole[many], rest[many], key[many])
    yield X.own_row(chunk, bits, keys=keys, prints=prints, offset=offset, first=at.astype(np.int32), **X.planes("position", place[marked]))
    go = np.flatnonzero(~marked)
    yield from X.to_buckets(chunk, whole[go], bits, {"position": place[go], "doc": key[go]}, key=whole[go], rest=rest[go])


def _answer_suffix(bucket, chunks, entries):
    key, rest = (np.concatenate([e[c] for e in entries]) for c in ("key", "rest"))
    yield from _answer(entries, chunks, _after_first(key, rest, np.concatenate([X.from_planes(e, "doc") for e in entries])))


# -- both ----------------------------------------------------------------------------------------------------------


def _by_document(answered: DataFrame, rows) -> DataFrame:
    """The positions of each chunk, its own and those answered, as rows of documents: ``rows(own, positions)``."""

    def step(chunk, own, answers):
        yield from rows(own, np.sort(np.concatenate([X.from_planes(a, "position") for a in (own, *answers)])))

    return X.at_chunks(answered, step, X.SPANS, X.span_rows)


def _all(parts: list[DataFrame]) -> DataFrame:
    """One row for each document with the marks of all rounds; rows alike in id and text have equal marks."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("_key", "_print").agg(F.collect_set("marks").alias("_marks"))


def marks(docs: DataFrame, width: int = WIDTH, rounds: tuple[int, int] = ROUNDS, text: str = "text") -> DataFrame:
    """(_key, _print, _marks): packed starts of strings that an earlier document has too, an entry for each round."""
    depth = width - PERIOD + 1
    if depth < 1:
        raise ValueError(f"strings must have at least {PERIOD} bytes")
    bits = X.bucket_bits(docs.sparkSession)
    rows = X.keyed(docs, text)

    def sample(number):
        def run(batches):
            for chunk, keys, prints, body, at in X.read_chunks(batches):
                yield X.build_rows(list(_sample_rows(chunk, bits, keys, prints, body, at, depth, rounds[0], number)))

        return rows.mapInArrow(run, X.SCHEMA)

    def intervals(own, position):
        yield from _interval_rows(own, position, PERIOD - 1)

    ranks = []
    for number in range(rounds[0]):
        ranks.append(written(_by_document(X.through_buckets(sample(number), _answer_sample), intervals), "sample"))
        free_shuffles()

    def cut_out(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                body, at = raw_bytes(part.column("_text"))
                keys, prints = part.column("_key").to_pylist(), part.column("_print").to_pylist()
                found = []
                for d, m in enumerate(part.column("_marks").to_pylist()):
                    own = body[at[d] : at[d + 1]]
                    found += [(keys[d], prints[d], a, own[a:b].tobytes()) for a, b in _segments(m, len(own), width)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["_key", "_print", "_offset", "_text"])

    # Only the parts of texts around kept samples go on.
    segments = written(rows.join(_all(ranks), ["_key", "_print"]).mapInArrow(cut_out, "_key long, _print long, _offset int, _text binary"), "segments")
    free_shuffles()
    for r in ranks:
        discard(r)

    def suffixes(number):
        def run(batches):
            for chunk, keys, prints, body, at, offset in X.read_chunks(batches, SEGMENTS, "_offset"):
                yield X.build_rows(list(_suffix_rows(chunk, bits, keys, prints, offset, body, at, width, rounds[1], number)))

        return segments.mapInArrow(run, X.SCHEMA)

    found = []
    for number in range(rounds[1]):
        found.append(written(_by_document(X.through_buckets(suffixes(number), _answer_suffix), _start_rows), "suffixes"))
        free_shuffles()
    discard(segments)
    return _all(found)


def removed(marked: list[bytes], width: int, n: int) -> np.ndarray:
    """Which of n bytes a marked string covers."""
    edge = np.zeros(n + 1, np.int32)
    for m in marked:  # no start is marked twice
        starts = X.from_planes(X.thaw(m), "start")
        edge[starts] += 1
        edge[starts + width] -= 1
    return np.cumsum(edge[:n]) > 0


def dedup(docs: DataFrame, width: int = WIDTH, rounds: tuple[int, int] = ROUNDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    joined = X.keyed(docs, "text", doc_id=F.col("doc_id").cast("long")).join(marks(docs, width, rounds), ["_key", "_print"], "left")
    sha = hashlib.sha256

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                body, at = raw_bytes(part.column("_text"))
                n_removed, n_spans, digest = [], [], []
                for d, m in enumerate(part.column("_marks").to_pylist()):
                    own = body[at[d] : at[d + 1]]
                    if m:
                        gone = removed(m, width, len(own))
                        n_removed.append(int(gone.sum()))
                        n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                        own = own[~gone]
                    else:
                        n_removed.append(0)
                        n_spans.append(0)
                    digest.append(sha(own.tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return joined.select("doc_id", "_text", "_marks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip(docs: DataFrame, width: int = WIDTH, rounds: tuple[int, int] = ROUNDS, text: str = "text") -> DataFrame:
    """All columns as they are, but ``text`` without the repeated bytes; a character that loses a byte goes whole.

    A null text stays null.
    """
    names = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    kept = [k for c, k in names.items() if c != text] + ["_null"]
    carried = {k: F.col(f"`{c}`") for c, k in names.items() if c != text} | {"_null": F.col(f"`{text}`").isNull()}
    inner = X.keyed(docs, text, **carried).join(marks(docs, width, rounds, text), ["_key", "_print"], "left").select(*kept, "_text", "_marks")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                body, at = raw_bytes(part.column("_text"))
                texts = []
                for d, m in enumerate(part.column("_marks").to_pylist()):
                    own = body[at[d] : at[d + 1]]
                    if m:
                        gone = removed(m, width, len(own))
                        char = np.cumsum((own & 0xC0) != 0x80) - 1  # which character each byte belongs to
                        own = own[np.bincount(char, gone)[char] == 0]
                    texts.append(own.tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(texts, pa.string())], [*kept, "_stripped"])

    done = inner.mapInArrow(run, inner.select(*kept).schema.add("_stripped", "string"))
    return done.select(*((F.col(k) if c != text else F.when(~F.col("_null"), F.col("_stripped"))).alias(c) for c, k in names.items()))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), win AS (
  SELECT doc_id, i, h[2 * i + 1 : 2 * i + 100] AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50)
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE doc_id > m
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g
    FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM gone)
  ) GROUP BY doc_id, g
), edge AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span
), kept AS (
  SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(h[2 * before + 1 : 2 * a], '' ORDER BY a) AS head
  FROM edge e JOIN t ON e.doc_id = t.doc_id GROUP BY e.doc_id
)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || h[2 * coalesce(last, 0) + 1 :])) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
