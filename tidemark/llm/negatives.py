"""Hard negatives by inner product, from cover trees over norm-augmented candidates.

A candidate c becomes (c, sqrt(M^2 - |c|^2)) with M the largest norm, an anchor q becomes (q, 0): the inner product is then
a falling function of the distance, and a ball of candidates with centre p and covering radius r has products between
those at distances d(q, p) + r and d(q, p) - r.  The top of the tree is a net of centres from a bounded sample
(``SAMPLE``); every row goes to its nearest centre, and a centre's rows are dealt over blocks of bounded size.  Below, each
block has a tree of its own: covering radii halve level by level; centres with few points of their own leave them in one
leaf beside the others.  Anchors travel in packs; a pack goes to the blocks of the groups whose bounds its anchors need.  Inside a
block an anchor descends best first: nodes outside its window, or below its worst hit so far, are skipped, leaves are
verified exactly.  Positives come first; their scores are the windows of the negatives.  A block and a pack meet once,
each with a bounded number of numbers; what a task hands on is a few hits for an anchor.

Scores are integers: products of floor(256 x).  Rows too large for exact products of doubles (``wide``) skip the bounds
and are multiplied as Python numbers; a score beyond a long is the nearest long.

Cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; vectors of
different lengths have no score; ties go to the smaller id; "other rows" are rows of another id, repeated candidates count
as often as they occur, an anchor repeated with equal label and vector answers once; an anchor without positives or a
positive without negatives in its window gives no row; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import written

SCALE = 256
ANCHORS, SHIFTED, LABELS = 100, 7, 10
POSITIVES = NEGATIVES = 5
#: A negative's score is at least so many hundredths of the positive's, and at most the positive's.
LEAST = 80
#: Rows of the sample that the top net comes from, and centres at most.
SAMPLE = 4096
CENTRES = 64
#: Numbers (rows times length) of a block of candidates and of a pack of anchors.
BLOCK_NUMBERS = 1 << 19
PACK_NUMBERS = 1 << 17
#: Points of a node that is not split further, and points that make a node of a centre's own.
LEAF = 64
CROWD = 16
LARGEST = (1 << 63) - 1


def whole(e: np.ndarray) -> np.ndarray:
    """floor(256 x) of doubles; Python numbers where doubles can't hold it."""
    if len(e) and np.abs(e).max() >= 2.0**52:
        return np.array([math.floor(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE) for x in e.tolist()], object)
    return np.floor(e.astype(np.float64) * SCALE)


def augmented(v: np.ndarray, top: float) -> np.ndarray:
    """Points of one norm: the vectors with the missing part of ``top`` (a squared norm) as one more component."""
    return np.concatenate([v, np.sqrt(np.maximum(0.0, top - (v * v).sum(1)))[:, None]], 1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def net(x: np.ndarray, radius: float, most: int | None = None, step: int = 256) -> np.ndarray | None:
    """Rows no two of which are within the radius and which cover all others; None if more than ``most`` are needed."""
    chosen: list[int] = []
    left = np.arange(len(x))
    while len(left):
        some = left[:step]
        near = distances(x[some], x[some]) <= radius
        kept: list[int] = []
        for i in range(len(some)):
            if not near[i, kept].any():
                kept.append(i)
        chosen += some[kept].tolist()
        if most is not None and len(chosen) > most:
            return None
        rest = left[step:]
        left = rest[distances(x[rest], x[some[kept]]).min(1) > radius] if len(rest) else rest
    return np.array(chosen)


def crowds(x: np.ndarray, radius: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray, float]]]:
    """Points left over, and (centre, its points, covering radius) of the centres of finer nets that hold a crowd.

    Radii halve while one centre covers everything; a net without crowds has none below either.
    """
    while radius > 1:
        radius /= 2
        chosen = net(x, radius)
        if len(chosen) == 1:
            continue
        nearest, reach = np.zeros(len(x), np.int64), np.full(len(x), math.inf)
        for k in range(0, len(chosen), 512):
            d = distances(x, x[chosen[k : k + 512]])
            at = d.argmin(1)
            low = d[np.arange(len(x)), at]
            nearest, reach = np.where(low < reach, at + k, nearest), np.minimum(low, reach)
        crowded = np.flatnonzero(np.bincount(nearest, minlength=len(chosen)) >= CROWD)
        out = []
        for k in crowded:
            own = np.flatnonzero(nearest == k)
            out.append((int(chosen[k]), own, float(reach[own].max())))
        return np.flatnonzero(~np.isin(nearest, crowded)), out
    return np.arange(len(x)), []


def cover_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of a cover tree over points: a permutation, and of each node its centre, radius, range and children's range."""
    order = np.arange(len(x))
    centre, radius, start, end, first, last = [0], [float(distances(x, x[:1]).max())], [0], [len(x)], [0], [0]
    leaf = [False]
    node = 0
    while node < len(centre):  # level by level: children come behind all nodes of their parent's level
        a, b = start[node], end[node]
        first[node] = last[node] = len(centre)
        if b - a > LEAF and not leaf[node]:
            own = order[a:b].copy()
            rest, found = crowds(x[own], radius[node])
            if found:
                at = a
                parts = [(own[c], own[m], r, False) for c, m, r in found]
                if len(rest):
                    parts.append((centre[node], own[rest], float(distances(x[own[rest]], x[[centre[node]]]).max()), True))
                for c, members, r, ends in parts:
                    order[at : at + len(members)] = members
                    for column, value in zip((centre, radius, start, end, first, last, leaf), (int(c), r, at, at + len(members), 0, 0, ends)):
                        column.append(value)
                    at += len(members)
                last[node] = len(centre)
        node += 1
    # Centres as places in the permutation.
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    return {"order": order, "centre": place[np.array(centre)], "radius": np.array(radius), "start": np.array(start), "end": np.array(end), "first": np.array(first), "last": np.array(last)}


def bounds(products: np.ndarray, radii: np.ndarray, q2: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of an anchor (squared norm q2) with points within the radii of centres of one norm."""
    d = np.sqrt(np.maximum(0.0, q2 + top - 2 * products))
    slack = 1e-6 * (1 + math.sqrt(q2 * top))  # rounding of the distances above; true products are whole numbers
    high = (q2 + top - np.maximum(0.0, d - radii) ** 2) / 2
    low = (q2 + top - (d + radii) ** 2) / 2
    swing = math.sqrt(q2) * radii
    return np.maximum(low, products - swing) - slack, np.minimum(high, products + swing) + slack


class Hits:
    """The first ``most`` of the candidates seen within a window, higher scores first, then smaller ids."""

    def __init__(self, most: int, low: float, high: float):
        self.most, self.low, self.high, self.rows = most, low, high, []

    def floor(self) -> float:
        return max(self.low, self.rows[-1][0]) if len(self.rows) == self.most else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.floor()) & (scores <= self.high))
        if len(at) > self.most:  # ties at the last place stay until ids decide
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.most)[len(at) - self.most]]
            at = at[np.lexsort((ids[at], -scores[at]))[: self.most]]
        self.rows = sorted(self.rows + [(int(s), int(i)) for s, i in zip(scores[at].tolist(), ids[at].tolist())], key=lambda r: (-r[0], r[1]))[: self.most]


def descend(tree: dict, q: np.ndarray, fits: np.ndarray, top: float, windows: list[Hits]) -> None:
    """Best-first descent: fills the windows with the fitting candidates of a block."""
    v, ids = tree["v"], tree["ids"]
    if "centre" not in tree:  # wide rows: no bounds
        scores = np.array([min(max(int(s), -LARGEST), LARGEST) for s in v[fits] @ q], np.int64)
        for w in windows:
            w.add(scores, ids[fits])
        return
    q2 = float(q @ q)
    centres, radius = tree["centres"], tree["radius"]
    queue = [(-math.inf, 0)]
    while queue:
        high, node = heapq.heappop(queue)
        if -high < min(w.floor() for w in windows):
            return
        a, b = tree["first"][node], tree["last"][node]
        if a == b:
            s, e = tree["start"][node], tree["end"][node]
            own = np.flatnonzero(fits[s:e]) + s
            scores = (v[s:e] @ q)[own - s]
            for w in windows:
                w.add(scores, ids[own])
            continue
        low, high = bounds(centres[a:b] @ q, radius[a:b], q2, top)
        inside = np.zeros(b - a, bool)
        for w in windows:
            inside |= (high >= w.floor()) & (low <= w.high)
        for k in np.flatnonzero(inside):
            heapq.heappush(queue, (-high[k], int(a + k)))


def usable(embeddings: DataFrame, shifted: int = SHIFTED, labels: int = LABELS) -> DataFrame:
    """vec_id, label (shifted where the id says so), e, dim, wide and norm2 of the rows that take part."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size("e") > 0) & fine, F.lit(False)))
    label = F.when(F.col("vec_id") % shifted == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # Up to here sums of products are exact in doubles.
    limit = F.floor(F.sqrt(F.lit(2.0**52) / F.size("e"))) / SCALE - 1
    norm2 = F.aggregate("e", F.lit(0.0), lambda sum_, x: sum_ + F.pow(F.floor(x.cast("double") * SCALE), F.lit(2.0)))
    wide = F.array_max(F.transform("e", F.abs)) > limit
    return rows.select("vec_id", label.alias("label"), "e", F.size("e").alias("dim"), wide.alias("wide"), F.when(~wide, norm2).alias("norm2"))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int, exact: bool = True) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    v = whole(column.flatten().to_numpy())
    if not exact:
        v = np.array([int(x) for x in v] + [None], object)[:-1]
    return v.reshape(-1, dim)


class Top:
    """The top net of each vector length, fitted on a bounded sample, whose rows also give first bounds of scores.

    ``norms`` has the largest squared norm and the number of rows of each length; centres follow the size of the table.
    """

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, block_numbers: int = BLOCK_NUMBERS):
        self.norms = {r.dim: (r.top, r.n) for r in rows.where("NOT wide").groupBy("dim").agg(F.max("norm2").alias("top"), F.count("*").alias("n")).collect()}
        most = max(64, min(sample, sample * 64 // max(self.norms, default=1)))
        known = rows.where("NOT wide").orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(most).collect()
        self.nets, self.rows = {}, {}
        for dim, (top, n) in self.norms.items():
            own = [r for r in known if r.dim == dim]
            if not own:
                self.nets[dim] = np.zeros((1, dim + 1))
                self.rows[dim] = np.zeros(0), np.zeros(0), np.zeros((0, dim))
                continue
            v = whole(np.array([x for r in own for x in r.e])).reshape(-1, dim)
            x = augmented(v, top)
            centres = min(CENTRES, max(1, n * dim // block_numbers))
            # The net's radius shrinks as long as the centres stay few.
            chosen, radius = np.array([0]), float(distances(x, x[:1]).max())
            while radius > 1:
                radius *= 0.8
                finer = net(x, radius, centres)
                if finer is None:
                    break
                chosen = finer
            self.nets[dim] = x[chosen]
            self.rows[dim] = np.array([r.vec_id for r in own]), np.array([r.label for r in own]), v


def assign(rows: DataFrame, top: Top) -> DataFrame:
    """Rows with the group of their nearest top centre, their distance to it, and a number that deals them over blocks."""
    kind = rows.schema["e"].dataType.simpleString()
    names = ["vec_id", "label", "e", "dim", "wide"]

    def run(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            dims, wide = batch.column("dim").to_numpy(), batch.column("wide").to_numpy(zero_copy_only=False)
            group, reach = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            for d in np.unique(dims[~wide]):
                at = np.flatnonzero((dims == d) & ~wide)
                x = augmented(matrix(batch.column("e").take(pa.array(at)), d), top.norms[d][0])
                far = distances(x, top.nets[d])
                group[at] = far.argmin(1)
                reach[at] = far.min(1)
            turns = pa.array(turn + np.arange(len(dims), dtype=np.int64))
            turn += len(dims)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(group), pa.array(reach), turns], [*names, "grp", "reach", "turn"])

    return rows.select(*names).mapInArrow(run, f"vec_id long, label long, e {kind}, dim int, wide boolean, grp int, reach double, turn long")


def freeze(arrays: dict[str, np.ndarray]) -> bytes:
    return json.dumps({k: a.tolist() for k, a in arrays.items()}).encode()


def index(rows: DataFrame, sizes: DataFrame, top: Top) -> DataFrame:
    """One row for a block: its candidates in the order of its cover tree, and the tree."""
    kind = rows.schema["e"].dataType.simpleString()

    def build(table: pa.Table) -> pa.Table:
        dim, wide, group, block = (table.column(c)[0].as_py() for c in ("dim", "wide", "grp", "block"))
        ids, labels, e = table.column("vec_id").to_numpy(), table.column("label").to_numpy(), table.column("e").combine_chunks()
        by, tree = np.arange(len(ids)), b""
        if not wide:
            built = cover_tree(augmented(matrix(e, dim), top.norms[dim][0]))
            by, tree = built.pop("order"), freeze(built)
        row = {"block": [f"{dim}:{group}:{block}"], "dim": [dim], "wide": [wide], "ids": [ids[by]], "labels": [labels[by]], "e": [e.take(pa.array(by)).flatten()], "tree": [tree]}
        types = [pa.string(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), e.type, pa.binary()]
        return pa.table([pa.array(v, t) for v, t in zip(row.values(), types)], list(row))

    dealt = rows.join(sizes.select("dim", "grp", "blocks"), ["dim", "grp"]).withColumn("block", F.pmod("turn", "blocks").cast("int"))
    dealt = dealt.select("dim", "grp", "block", "wide", "vec_id", "label", "e")
    return dealt.groupBy("dim", "grp", "block").applyInArrow(build, f"block string, dim int, wide boolean, ids array<long>, labels array<long>, e {kind}, tree binary")


def packs(anchors: DataFrame, sizes: DataFrame, top: Top, positives: int, pack_numbers: int = PACK_NUMBERS) -> DataFrame:
    """Anchors in packs of about equal size, those of one region together, and the groups in which they may have hits.

    ``windows`` of an anchor are its positives; an anchor that has none yet takes the scores of the sample's rows of its
    label as the first bound of its positives.
    """
    kind = anchors.schema["e"].dataType.simpleString()
    radii = {(r.dim, r.grp): r.radius for r in sizes.collect()}
    counts = anchors.groupBy("dim", "wide", "grp").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("dim", "wide").orderBy("grp")) - F.col("n"))
    place = F.col("before") + F.pmod(F.xxhash64("key"), F.col("n"))
    number = F.floor(place * F.col("dim") / pack_numbers).cast("long")
    rows = anchors.join(counts, ["dim", "wide", "grp"]).withColumn("pack", F.concat_ws(":", "dim", "wide", number))

    def make(table: pa.Table) -> pa.Table:
        dim, wide = table.column("dim")[0].as_py(), table.column("wide")[0].as_py()
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        e = table.column("e").combine_chunks()
        windows = table.column("windows").to_pylist()
        low, here = np.full(len(ids), -math.inf), sorted(g for d, g in radii if d == dim)
        high = np.full(len(ids), math.inf)
        if windows[0] is not None:
            low = np.array([least_score(min(w["score"] for w in ws)) for ws in windows], float)
            high = np.array([max(w["score"] for w in ws) for ws in windows], float)
        if not wide and dim in top.nets:
            v = matrix(e, dim)
            if windows[0] is None:
                known, known_labels, sample = top.rows[dim]
                scores = np.where((known_labels == labels[:, None]) & (known != ids[:, None]), v @ sample.T, -math.inf)
                if scores.shape[1] >= positives:
                    low = np.partition(scores, -positives, 1)[:, -positives]
            centres = top.nets[dim]
            reach = np.array([radii.get((dim, g), 0.0) for g in range(len(centres))])
            needed = np.zeros(len(centres), bool)
            for q, lo, hi in zip(v, low, high):
                least, most = bounds(centres[:, :-1] @ q, reach, float(q @ q), top.norms[dim][0])
                needed |= (most >= lo) & (least <= hi)
            here = [g for g in here if g < 0 or needed[g]]
        names = ["pack", "dim", "wide", "keys", "ids", "labels", "e", "low", "windows", "groups"]
        columns = [table.column("pack")[0].as_py(), dim, wide, table.column("key").to_numpy(), ids, labels, e.flatten(), low, windows, here]
        long = pa.list_(pa.int64())
        types = [pa.string(), pa.int32(), pa.bool_(), long, long, long, e.type, pa.list_(pa.float64()), pa.list_(ARROW_WINDOWS), pa.list_(pa.int32())]
        return pa.table([pa.array([c], t) for c, t in zip(columns, types)], names)

    schema = f"pack string, dim int, wide boolean, keys array<long>, ids array<long>, labels array<long>, e {kind}, low array<double>, windows array<{WINDOWS}>, groups array<int>"
    return rows.select("pack", "dim", "wide", "key", "vec_id", "label", "e", F.col("windows").cast(WINDOWS).alias("windows")).groupBy("pack").applyInArrow(make, schema)


WINDOWS = "array<struct<place: int, positive: long, score: long>>"
ARROW_WINDOWS = pa.list_(pa.struct([("place", pa.int32()), ("positive", pa.int64()), ("score", pa.int64())]))
HITS = "key long, place int, hit long, score long"


def least_score(positive: int) -> int:
    """The smallest whole score that is at least ``LEAST`` hundredths of a positive's."""
    return -(-LEAST * int(positive) // 100)


def searched(table: DataFrame, sizes: DataFrame, packed: DataFrame, top: Top, same: bool, most: int) -> DataFrame:
    """Hits of every anchor in every block it needs: of its own label (``same``), or of others inside its windows."""
    places = packed.select("pack", "dim", F.explode("groups").alias("grp")).join(sizes, ["dim", "grp"])
    places = places.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    places = places.select("pack", F.concat_ws(":", "dim", "grp", "block").alias("block"))
    places = written(places, "places")
    blocks = table.drop("dim").join(places, "block").withColumnRenamed("pack", "with_pack")
    anchors = packed.drop("groups").join(places, "pack").withColumnRenamed("block", "with_block")

    def search(block: pa.Table, pack: pa.Table) -> pa.Table:
        flat = lambda t, c: t.column(c).combine_chunks().flatten()
        dim = pack.column("dim")[0].as_py()
        exact = not (block.column("wide")[0].as_py() or pack.column("wide")[0].as_py())
        tree = {"ids": flat(block, "ids").to_numpy(), "labels": flat(block, "labels").to_numpy(), "v": matrix(block.column("e"), dim, exact)}
        if exact:
            tree |= {k: np.array(v) for k, v in json.loads(block.column("tree")[0].as_py()).items()}
            tree["centres"] = tree["v"][tree["centre"]]
        columns = (flat(pack, c).to_numpy().tolist() for c in ("keys", "ids", "labels", "low"))
        out: list[tuple] = []
        for key, anchor, label, low, q, ws in zip(*columns, matrix(pack.column("e"), dim, exact), pack.column("windows")[0].as_py()):
            fits = (tree["labels"] == label) & (tree["ids"] != anchor) if same else (tree["labels"] != label) & (tree["ids"] != anchor)
            if not fits.any():
                continue
            windows = [Hits(most, low, math.inf)] if same else [Hits(most, least_score(w["score"]), w["score"]) for w in ws]
            descend(tree, q, fits, top.norms[dim][0] if exact else 0.0, windows)
            for k, w in enumerate(windows):
                out += [(key, 0 if same else ws[k]["place"], hit, score) for score, hit in w.rows]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], ["key", "place", "hit", "score"])

    return blocks.groupBy("with_pack", "block").cogroup(anchors.groupBy("pack", "with_block")).applyInArrow(search, HITS)


def first(hits: DataFrame, most: int) -> DataFrame:
    """The first hits of each (key, place) with their rank."""
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "hit")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(embeddings: DataFrame, anchors: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES, sample: int = SAMPLE, block_numbers: int = BLOCK_NUMBERS, pack_numbers: int = PACK_NUMBERS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the anchors' hard negatives."""
    rows = usable(embeddings)
    top = Top(rows, sample, block_numbers)
    assigned = written(assign(rows, top), "assigned")
    sizes = assigned.groupBy("dim", "grp").agg(F.ceil(F.count("*") * F.first("dim") / block_numbers).alias("blocks"), F.max("reach").alias("radius"))
    sizes = written(sizes, "groups")
    table = written(index(assigned, sizes, top), "index")
    asked = assigned.where(F.col("vec_id") % anchors == 0).drop("reach", "turn").dropDuplicates(["vec_id", "label", "e"])
    asked = written(asked.withColumn("key", F.monotonically_increasing_id()).withColumn("windows", F.lit(None).cast(WINDOWS)), "anchors")
    packed = written(packs(asked, sizes, top, positives, pack_numbers), "packs")
    near = first(searched(table, sizes, packed, top, True, positives), positives)
    near = written(near.select("key", F.col("rank").alias("place"), F.col("hit").alias("positive"), "score"), "positives")
    windows = near.groupBy("key").agg(F.collect_list(F.struct("place", "positive", "score")).alias("windows"))
    packed = written(packs(asked.drop("windows").join(windows, "key"), sizes, top, positives, pack_numbers), "packs")
    hard = first(searched(table, sizes, packed, top, False, negatives), negatives).withColumnRenamed("score", "negative_score")
    named = near.withColumnRenamed("score", "positive_score").join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return hard.join(named, ["key", "place"]).select("anchor_id", F.col("positive").alias("positive_id"), "rank", F.col("hit").alias("negative_id"), "positive_score", "negative_score")


#: The same rows by brute force in DuckDB SQL.
ORACLE = f"""
WITH marked AS (SELECT vec_id, CAST(label AS BIGINT) AS label, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
used AS (SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM marked),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS other, c.label, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM used a JOIN used c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % {ANCHORS} = 0),
near AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}),
hard AS (SELECT n.anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY n.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM near n JOIN scored s ON s.anchor_id = n.anchor_id AND s.label <> s.own
    AND {LEAST} * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= {NEGATIVES}
"""
