"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its words, word pairs and pairs with one word between, hashed to 2^20 places.  Training sees a
bounded sample of labelled rows (``sample_rows``, the smallest hashes of doc_id), so one task can hold it; per-coordinate
rates adapt to rare words and the L1 term leaves few weights, at most 2^20 numbers by construction, which are broadcast.
Scoring is one pass over whole texts without an exchange.

Cases: null and empty texts get the score of the intercept; labels other than 0 and 1 are not learnt from; a null doc_id
is neither held out nor learnt from; without usable labels every score is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import pieces, raw_bytes, text_or_empty
from tidemark.llm.hashing import RunHashes, combine, lower_ascii, mix, runs

BITS = 20
SAMPLE_ROWS = 12_000
EPOCHS = 3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every n-gram and skip-gram of a block, repeats included."""
    start, end, first = runs(_WORD[body], at)
    word = RunHashes(lower_ascii(body), at).of(start, end)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    rows, places = [row], [mix(word) >> shift]
    for gap, salt in ((1, 0x51), (2, 0x52)):
        if len(word) > gap:
            same = row[:-gap] == row[gap:]
            rows.append(row[:-gap][same])
            places.append((combine(word[:-gap][same], word[gap:][same]) ^ mix(np.full(1, salt, np.uint64))) >> shift)
    return np.concatenate(rows), np.concatenate(places).astype(np.int32)


class Ftrl:
    """FTRL-proximal for features of value 1; the last place is the intercept, which L1 leaves alone."""

    def __init__(self, places: int, alpha: float = 0.15, beta: float = 1.0, l1: float = 1.0, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(places + 1), np.zeros(places + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        sigma = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] = n + gradient * gradient


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of all places and, last, the intercept, from at most ``sample_rows`` labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = usable.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    sample = usable.withColumn("_order", F.xxhash64("doc_id", F.lit(4))).orderBy("_order", "doc_id", "toxic").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("_text"))
    rows = texts.join(F.broadcast(sample), "doc_id").select("_order", "toxic", "_text")  # at most sample_rows numbers

    def extract(batches):
        for batch in batches:
            for part in pieces(batch, "_text"):
                row, place = features(*raw_bytes(part.column("_text")))
                key = np.unique(row * (1 << BITS) + place)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) << BITS).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cut), pa.array((key & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("_order"), part.column("toxic"), lists], ["_order", "toxic", "places"])

    def fit(batches):
        seen = [(p, y) for b in batches for p, y in zip(b.column("places"), b.column("toxic").to_pylist())]
        model = Ftrl(1 << BITS)
        for _ in range(epochs):
            for places, label in seen:
                model.learn(places.values.to_numpy().astype(np.int64), label)
        w = model.weights(np.arange((1 << BITS) + 1)) if seen else np.zeros(0)
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), pa.array(w[kept])], ["place", "weight"])

    hashed = rows.mapInArrow(extract, "_order long, toxic int, places array<int>")
    fitted = hashed.repartition(1).sortWithinPartitions("_order", "toxic", F.hash("places")).mapInArrow(fit, "place int, weight double")
    out = np.zeros((1 << BITS) + 1)
    for place, weight in fitted.collect():  # at most 2^20 + 1 rows by construction, few after L1
        out[place] = weight
    return out


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights), weights[np.flatnonzero(weights)]))

    def run(batches):
        at, values = shared.value
        table = np.zeros((1 << BITS) + 1)
        table[at] = values
        for batch in batches:
            for part in pieces(batch, "_text"):
                row, place = features(*raw_bytes(part.column("_text")))
                live = np.flatnonzero(table[place])
                key = np.unique(row[live] * (1 << BITS) + place[live])
                total = np.bincount(key >> BITS, table[key & ((1 << BITS) - 1)], part.num_rows) + table[-1]
                p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("_text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
