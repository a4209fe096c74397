"""Packed key exchange: positions of a text meet by key without a row for each.

A task reads text in chunks.  Of each chunk, keys go to buckets (the leading bits of the key) as packed arrays, one row
for a chunk and bucket; what only the chunk itself needs is its own row.  Buckets answer with positions, and answers of
a chunk meet its own row again.  A key appears once for a chunk, however often the chunk repeats it, so a key that
holds a third of all positions has one entry for each chunk and no more; buckets follow ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import pieces, raw_bytes, text_or_empty

SCHEMA = "bucket int, chunk long, own boolean, payload binary"
#: Bytes of text in a chunk.
CHUNK = 4 << 20
LAST = (1 << 63) - 1


def bucket_bits(spark: SparkSession) -> int:
    """Bits of a key that name its bucket: two to four buckets for each shuffle partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(20, max(6, (2 * parts - 1).bit_length()))


def doc_key() -> Column:
    """doc_id as the order of documents; null comes last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def keyed(docs: DataFrame, text: str = "text", **carried: Column) -> DataFrame:
    """_key, _print (a fingerprint that tells rows of equal doc_id apart), _text, and other columns under own names."""
    t = text_or_empty(text)
    return docs.select(doc_key().alias("_key"), F.xxhash64(t).alias("_print"), t.alias("_text"), *(c.alias(n) for n, c in carried.items()))


def pack(names: list[str], arrays: list[np.ndarray]) -> bytes:
    """Named arrays as bytes: a line of names, types and lengths, then the numbers."""
    head = ";".join(f"{n}:{a.dtype.str}:{len(a)}" for n, a in zip(names, arrays)).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def thaw(payload: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(payload[:4], "little")
    at, out = 4 + size, {}
    for entry in bytes(payload[4:at]).decode().split(";"):
        name, kind, n = entry.split(":")
        dtype = np.dtype(kind)
        out[name] = np.frombuffer(payload, dtype, int(n), at)
        at += dtype.itemsize * int(n)
    return out


def rows(buckets: list[int], chunks: list[int], own: list[bool], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(chunks, pa.int64()), pa.array(own, pa.bool_()), pa.array(payloads, pa.binary())],
        ["bucket", "chunk", "own", "payload"],
    )


def planes(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Differences of neighbouring numbers, one array for each of their bytes: ascending numbers leave mostly zeros."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0)).view(np.uint64)
    size = (int(d.max()).bit_length() + 7) // 8 if len(d) else 0
    raw = d.view(np.uint8).reshape(-1, 8)
    return {f"{name}.{k}": raw[:, k] for k in range(max(1, size))}


def from_planes(entry: dict[str, np.ndarray], name: str) -> np.ndarray:
    raw = np.zeros((len(entry[f"{name}.0"]), 8), np.uint8)
    k = 0
    while f"{name}.{k}" in entry:
        raw[:, k] = entry[f"{name}.{k}"]
        k += 1
    return np.cumsum(raw.view(np.uint64).ravel()).view(np.int64)


def to_buckets(chunk: int, by: np.ndarray, bits: int, rising: dict[str, np.ndarray], **columns: np.ndarray) -> Iterator[tuple[int, int, bool, bytes]]:
    """One packed row for each bucket that has entries; order within a bucket is kept.

    ``rising`` holds columns that mostly ascend; they are packed as planes.
    """
    bucket = (by >> np.uint64(64 - bits)).astype(np.uint32)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        arrays = {n: c[part] for n, c in columns.items()}
        for n, c in rising.items():
            arrays |= planes(n, c[part])
        yield int(bucket[part[0]]), chunk, False, pack(list(arrays), list(arrays.values()))


def short_names(name: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    """The 40 bits of a name behind those that name its bucket, in five bytes."""
    rest = name << np.uint64(bits)
    return {"top": (rest >> np.uint64(32)).astype(np.uint32), "more": (rest >> np.uint64(24)).astype(np.uint8)}


def from_short(entries: list[dict[str, np.ndarray]]) -> np.ndarray:
    return np.concatenate([e["top"] for e in entries]).astype(np.uint64) << np.uint64(8) | np.concatenate([e["more"] for e in entries])


def own_row(chunk: int, bits: int, **columns: np.ndarray) -> tuple[int, int, bool, bytes]:
    """The row that waits for the answers; dealt to any bucket, which hands it on."""
    return int(chunk * 0x9E3779B1 >> 8) & ((1 << bits) - 1), chunk, True, pack(list(columns), list(columns.values()))


def read_chunks(batches, size: int = CHUNK, *more: str) -> Iterator[tuple]:
    """(chunk number, document keys, fingerprints, bytes, offsets, further columns) of what a task reads.

    Numbers follow from the partition and the order in it, so a repeated task gives the same ones.
    """
    base, count, held = TaskContext.get().partitionId() << 32, 0, 0
    bodies: list[np.ndarray] = []
    sizes: list[np.ndarray] = [np.zeros(1, np.int64)]
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("_key", "_print", *more)}

    def chunk():
        nonlocal count, held
        number, held = base + count, 0
        count += 1
        keys, prints, *rest = (np.concatenate(c) for c in columns.values())
        out = number, keys, prints, np.concatenate(bodies), np.cumsum(np.concatenate(sizes)), *rest
        bodies.clear()
        del sizes[1:]
        for c in columns.values():
            c.clear()
        return out

    for batch in batches:
        for part in pieces(batch, "_text", size // 4):
            body, at = raw_bytes(part.column("_text"))
            bodies.append(body)
            sizes.append(np.diff(at))
            for name, c in columns.items():
                c.append(part.column(name).to_numpy())
            held += len(body)
            if held >= size:
                yield chunk()
    if bodies:
        yield chunk()


def through_buckets(exchanged: DataFrame, answer: Callable[[int, list[int], list[dict]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Each bucket's entries at once: ``answer(bucket, chunks, entries)`` gives (chunk, payload) rows; own rows pass."""

    def run(table: pa.Table) -> pa.Table:
        chunks, own, payloads = table.column("chunk").to_pylist(), table.column("own").to_pylist(), table.column("payload")
        entries = [(c, thaw(payloads[i].as_py())) for i, (c, o) in enumerate(zip(chunks, own)) if not o]
        kept = [(c, True, payloads[i].as_py()) for i, (c, o) in enumerate(zip(chunks, own)) if o]
        out = kept + [(c, False, p) for c, p in (answer(table.column("bucket")[0].as_py(), [c for c, _ in entries], [e for _, e in entries]) if entries else [])]
        return pa.Table.from_batches([rows([0] * len(out), [c for c, _, _ in out], [o for _, o, _ in out], [p for _, _, p in out])])

    return exchanged.groupBy("bucket").applyInArrow(run, SCHEMA)


def at_chunks(answered: DataFrame, step: Callable[[int, dict, list[dict]], Iterator], schema: str, build: Callable) -> DataFrame:
    """Each chunk's own row with its answers: ``step(chunk, own, answers)`` gives rows, ``build`` makes them a batch."""

    def run(table: pa.Table) -> pa.Table:
        own, answers = None, []
        for o, p in zip(table.column("own").to_pylist(), table.column("payload")):
            if o:
                own = thaw(p.as_py())
            else:
                answers.append(thaw(p.as_py()))
        return pa.Table.from_batches([build(list(step(table.column("chunk")[0].as_py(), own, answers)))])

    return answered.groupBy("chunk").applyInArrow(run, schema)


def build_rows(out: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
    return rows([r[0] for r in out], [r[1] for r in out], [r[2] for r in out], [r[3] for r in out])


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, the start of each key's group in it, and the sizes of the groups."""
    order = np.argsort(key)
    k = key[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(k)))


def crowded(key: np.ndarray, most: int = 16) -> np.ndarray:
    """Which entries of a chunk may belong to a key that has more than ``most`` of them: only those need grouping."""
    slot = (key >> np.uint64(8) & np.uint64((1 << 20) - 1)).astype(np.int32)
    return np.bincount(slot, minlength=1 << 20)[slot] > most


def shared_names(name: np.ndarray) -> np.ndarray:
    """Which of the names, numbers below 2^40, occur more than once."""
    out = np.zeros(len(name), bool)
    if len(name) < 1 << 24:  # name and place fit one number, and numbers sort fastest
        packed = np.sort(name << np.uint64(24) | np.arange(len(name), dtype=np.uint64))
        twin = (packed[1:] >> np.uint64(24)) == (packed[:-1] >> np.uint64(24))
        place = (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
        out[place[1:][twin]] = out[place[:-1][twin]] = True
    else:
        order, _, size = groups(name)
        out[order] = np.repeat(size > 1, size)
    return out


SPANS = "_key long, _print long, marks binary"


def span_rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())],
        ["_key", "_print", "marks"],
    )


def per_document(keys: np.ndarray, prints: np.ndarray, first: np.ndarray, position: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Sorted positions of a chunk as rows of their documents, counted from each document's start."""
    doc = np.searchsorted(first, position, "right") - 1
    cut = np.searchsorted(position, first)
    for d in np.unique(doc):
        own = position[cut[d] : cut[d + 1]] - first[d]
        yield int(keys[d]), int(prints[d]), own.astype(np.int32).tobytes()


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places a window of the given width covers, from its starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
