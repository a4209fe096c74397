"""Embedding near-dedup by sorted projection passes.

Equal vectors are one class from the start.  A pass gives each vector the signs of its products with random directions,
joined to one number, and sorts all vectors by it: near vectors share their leading signs and land side by side.
Vectors of one pass with the same leading signs are a run, and a run is compared in full, cosine in double precision;
pairs at or above the threshold are united.  Short runs are compared where they are sorted, with a window of neighbours
besides; a run never spans tasks.  Runs are counted first: those above ``RUN`` (a dense topic, whose vectors share
their signs whether they link or not) are dealt out by blocks.  Passes use independent directions; their number follows
from the row count so that a pair just at the threshold shares no run with a probability below ``miss``, however the
vectors are spread.  What density costs is time: a dense run is compared with the square of its size.  A task hands on a
spanning forest of its pairs, never all pairs of a group, and components come from joins.  Links inside a component are
then counted in full, by products of blocks, so a large group counts all its links.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
lengths never link; repeated rows are vectors of their own that link; a null vec_id links with nothing; extra columns
are not read; an empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import free_shuffles, written
from tidemark.llm.graph import components

LEAST = 0.95
WINDOW = 64
MISS = 0.002
SIGNS = 60
BLOCK = 512
#: Longest run compared where it is sorted, and numbers (rows times length) in a block of a longer one.
RUN = 256
BLOCK_NUMBERS = 1 << 18


def bits_for(n: int, window: int = WINDOW) -> int:
    """Leading signs that make a run: evenly spread, a run has half a window to a window of vectors."""
    return min(SIGNS, max(1, math.floor(math.log2(max(2, n) / window) + 1)))


def passes_for(n: int, least: float = LEAST, window: int = WINDOW, miss: float = MISS) -> int:
    """Passes so that a pair at the threshold is in one run in one of them."""
    same = 1 - math.acos(least) / math.pi
    return max(4, math.ceil(math.log(miss) / math.log(1 - same ** bits_for(n, window))))


def directions(number: int, dimension: int, seed: int = 6) -> np.ndarray:
    return np.random.default_rng([seed, number, dimension]).standard_normal((dimension, SIGNS))


def _unit(flat: np.ndarray, dimension: int) -> np.ndarray:
    x = flat.reshape(-1, dimension).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(a: list[int], b: list[int], parent: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs that join two groups of this task not yet joined."""

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    out = []
    for x, y in zip(a, b):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _usable() -> Column:
    e = F.col("e")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col("vec_id").isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False)) & fine & F.exists(e, lambda x: x != 0)


def keyed(vectors: DataFrame, passes: int, bits: int, with_e: bool = True) -> DataFrame:
    """(pass, dim, run, key, node) of every vector and pass, and ``e`` if asked for."""

    def project(batches):
        for batch in batches:
            e = batch.column("e")
            for start in range(0, batch.num_rows, 4096):
                part = e.slice(start, 4096)
                dims = part.value_lengths().to_numpy()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    x = _unit(part.take(pa.array(at)).flatten().to_numpy(), d)
                    node = batch.column("node").slice(start, 4096).take(pa.array(at))
                    own = part.take(pa.array(at))
                    for p in range(passes):
                        signs = (x @ directions(p, d) > 0).astype(np.int64)
                        key = signs @ (1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))
                        columns = [pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), d, np.int32)), pa.array(key >> (SIGNS - bits)), pa.array(key), node, *([own] * with_e)]
                        yield pa.RecordBatch.from_arrays(columns, ["pass", "dim", "run", "key", "node", *(["e"] * with_e)])

    return vectors.select("node", "e").mapInArrow(project, "pass int, dim int, run long, key long, node long" + ", e array<double>" * with_e)


def dense_pairs(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b) of spanning forests of the pairs in long runs, over (pass, dim, run, n, node, e): all blocks meet."""
    blocks = F.ceil(F.col("n") * F.col("dim") / BLOCK_NUMBERS).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("pass", "dim", "run", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "e")

    def link(table: pa.Table) -> pa.Table:
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        node = table.column("node").to_numpy()
        x = _unit(table.column("e").combine_chunks().flatten().to_numpy(), table.column("dim")[0].as_py())
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        y = x[right]
        root = np.arange(len(node))
        a, b = [], []
        for s in range(0, len(left), 256):
            some = left[s : s + 256]
            near = x[some] @ y.T >= least
            for k in np.flatnonzero(near.any(1)):
                at, own_root = right[near[k]], root[some[k]]
                fresh, first = np.unique(root[at], return_index=True)
                far = fresh != own_root
                if far.any():
                    a.append(np.full(far.sum(), node[some[k]]))
                    b.append(node[at[first[far]]])
                    root[np.isin(root, fresh[far])] = own_root
        none = [np.zeros(0, np.int64)]
        return pa.table({"a": pa.array(np.concatenate(a or none)), "b": pa.array(np.concatenate(b or none))})

    return rows.groupBy("pass", "dim", "run", "i", "j").applyInArrow(link, "a long, b long")


def pairs(vectors: DataFrame, passes: int, bits: int, least: float = LEAST, window: int = WINDOW, longest: int = RUN) -> DataFrame:
    """(a, b) of spanning forests of the pairs found, over (node, size, e)."""

    def compare(batches):
        parent: dict[int, int] = {}
        held = None  # (pass, dim, nodes, units, runs) of the last rows: the window, and the last run as far as it came
        for batch in batches:
            which, dims = batch.column("pass").to_numpy(), batch.column("dim").to_numpy()
            nodes, runs, e = batch.column("node").to_numpy(), batch.column("run").to_numpy(), batch.column("e")
            edge = np.flatnonzero((np.diff(which) != 0) | (np.diff(dims) != 0)) + 1
            found: list[tuple[int, int]] = []
            for a, b in zip(np.append(0, edge), np.append(edge, len(which))):
                for s in range(a, b, 256):
                    t = min(b, s + 256)
                    x = _unit(e.slice(s, t - s).flatten().to_numpy(), dims[s])
                    ids, run = nodes[s:t], runs[s:t]
                    before, units, former = ids, x, run
                    if held is not None and held[:2] == (which[s], dims[s]):
                        before, units, former = (np.concatenate(p) for p in zip(held[2:], (ids, x, run)))
                    lead = len(before) - len(ids)
                    i, j = np.nonzero(x @ units.T >= least)
                    near = (j < i + lead) & ((j >= i + lead - window) | (former[j] == run[i]))
                    found += _forest(before[j[near]].tolist(), ids[i[near]].tolist(), parent)
                    keep = min(max(0, len(before) - window), int(np.searchsorted(former, run[-1])))
                    held = (which[s], dims[s], before[keep:], units[keep:], former[keep:])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    of = ["pass", "dim", "run"]
    dense = written(keyed(vectors, passes, bits, False).groupBy(*of).agg(F.count("*").alias("n")).where(F.col("n") > longest), "dense")
    rows = keyed(vectors, passes, bits)
    if dense.isEmpty():
        return rows.repartitionByRange(*of).sortWithinPartitions("pass", "dim", "key", "node").mapInArrow(compare, "a long, b long")
    rows = rows.join(dense, of, "left")
    short = rows.where("n IS NULL").drop("n").repartitionByRange(*of).sortWithinPartitions("pass", "dim", "key", "node")
    return short.mapInArrow(compare, "a long, b long").unionAll(dense_pairs(rows.where("n IS NOT NULL"), least))


def link_counts(vectors: DataFrame, comps: DataFrame, least: float = LEAST) -> DataFrame:
    """(node, n): vectors, copies included, that each class links to in its component; all pairs of blocks are compared."""
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = vectors.join(comps, "node").join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("component", "own", "node", "size", "e", other.alias("other"))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "size", "e")

    def count(table: pa.Table) -> pa.Table:
        own, i = table.column("own").to_numpy(), table.column("i")[0].as_py()
        node, size = table.column("node").to_numpy(), table.column("size").to_numpy()
        e = table.column("e").combine_chunks()
        dims = e.value_lengths().to_numpy()
        total = np.zeros(len(node), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = _unit(e.take(pa.array(at)).flatten().to_numpy(), d)
            a, b = np.flatnonzero(own[at] == i), np.flatnonzero(own[at] != i)
            if table.column("j")[0].as_py() == i:
                near = x @ x.T >= least
                np.fill_diagonal(near, False)
                total[at] += near @ size[at]
            else:
                near = x[a] @ x[b].T >= least
                total[at[a]] += near @ size[at[b]]
                total[at[b]] += near.T @ size[at[a]]
        return pa.table({"node": pa.array(node), "n": pa.array(total)})

    return rows.groupBy("component", "i", "j").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(embeddings: DataFrame, least: float = LEAST, window: int = WINDOW, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    marked = rows.withColumn("fine", F.coalesce(_usable(), F.lit(False)))
    print_ = [F.xxhash64("e").alias("p"), F.xxhash64(F.lit(1), F.reverse("e")).alias("q")]
    fine = marked.where("fine").select("vec_id", "e", *print_)
    classes = written(fine.groupBy("p", "q").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"), F.first("e").alias("e")), "vectors")
    n = classes.count()
    links = written(pairs(classes, passes_for(n, least, window, miss), bits_for(n, window), least, window).distinct(), "pairs")
    free_shuffles()
    comps = written(components(links), "components")
    counts = written(link_counts(classes, comps, least), "counts")
    per_class = classes.drop("e").join(comps, "node", "left").join(counts, "node", "left").select(
        "p", "q", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    linked = fine.drop("e").join(per_class, ["p", "q"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = marked.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
