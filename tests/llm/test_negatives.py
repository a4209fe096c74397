"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest

from tidemark.llm import negatives

COLUMNS = "anchor_id positive_id rank negative_id positive_score negative_score".split()
TOP = (1 << 63) - 1


def brute(rows):
    used = [
        (i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in e])
        for i, l, e in rows
        if i is not None and l is not None and e and all(x is not None and math.isfinite(x) for x in e)
    ]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -TOP), TOP)
    out = []
    for i, l, v in sorted({(i, l, tuple(v)) for i, l, v in used if i % 100 == 0}):
        all_ = sorted((-score(v, w), j, m) for j, m, w in used if j != i and len(w) == len(v))
        for s, p, _ in [x for x in all_ if x[2] == l][:5]:
            hard = [(n, q) for n, q, m in all_ if m != l and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out += [(i, p, k + 1, q, -s, -n) for k, (n, q) in enumerate(hard)]
    return sorted(out)


def mined(table, **sizes):
    return sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(table, **sizes).collect())


@pytest.mark.parametrize("sizes", [{}, {"block_numbers": 4096, "pack_numbers": 256, "sample": 256}])
def test_given_table(spark, sizes):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.label, r.embedding) for r in table.collect()])
    assert want and mined(table, **sizes) == want


def test_clusters_and_ties_over_many_blocks_and_packs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, int(rng.integers(0, 4)), [float(round(x, 2)) for x in centres[i % 12] + 0.05 * rng.normal(size=8)]) for i in range(2000)]
    rows += [(i, 1, [1.0] * 8) for i in range(2000, 2300)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<double>, key string, dim int")
    want = brute(rows)
    assert want and mined(table, block_numbers=4096, pack_numbers=64, sample=256) == want


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [
        (100, 1, [1.0, 2.0]), (1, 1, [1e300, 2.0]), (2, 2, [1e15, 1.0]), (3, 1, None), (4, None, [1.0, 1.0]), (5, 1, [nan, 1.0]), (6, 1, [inf, 0.0]),
        (8, 1, [None, 1.0]), (9, 1, []), (10, 2, [1.0, 2.0]), (10, 2, [1.0, 2.0]), (11, 1, [1.0, 2.0]), (11, 1, [1.0, 2.0]), (200, 2, [1.0, 1.0, 1.0]),
        (12, 2, [1.0, 1.0, 2.0]), (13, 3, [1.0, 1.0, 1.9]), (None, 1, [1.0, 2.0]), (-100, 1, [-1.0, 3.0]), (100, 1, [1.0, 2.0]), (300, 1, [1e10, 1.0]),
        (14, 1, [5e8, 1.0]), (15, 2, [4.5e8, 1.0]), (0, 0, [0.0, 0.0]),
    ]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute(rows)
    assert len(want) > 10 and mined(table) == want
    assert mined(table.where("false")) == []


def test_tree_covers_its_points_and_bounds_hold():
    rng = np.random.default_rng(2)
    v = np.floor(256 * np.concatenate([rng.normal(size=(400, 6)), rng.normal(size=(300, 6)) * 0.02 + 1, np.ones((200, 6))]))
    top = (v * v).sum(1).max()
    tree = negatives.cover_tree(negatives.augmented(v, top))
    x = v[tree["order"]]
    assert sorted(tree["order"].tolist()) == list(range(900)) and len(tree["centre"]) > 3
    for node in range(len(tree["centre"])):
        s, e, a, b = (tree[k][node] for k in ("start", "end", "first", "last"))
        if a < b:
            assert tree["start"][a] == s and tree["end"][b - 1] == e and (tree["end"][a : b - 1] == tree["start"][a + 1 : b]).all()
        far = negatives.distances(negatives.augmented(x[s:e], top), negatives.augmented(x[[tree["centre"][node]]], top))
        assert far.max() <= tree["radius"][node] + 1e-6
        for q in x[::97]:
            low, high = negatives.bounds(x[[tree["centre"][node]]] @ q, tree["radius"][[node]], float(q @ q), top)
            assert (x[s:e] @ q >= low).all() and (x[s:e] @ q <= high).all()


def test_descent_skips_nodes_outside_the_window():
    rng = np.random.default_rng(3)
    v = np.floor(256 * np.concatenate([c + 0.01 * rng.normal(size=(100, 4)) for c in 3 * np.eye(4)]))
    tree = negatives.cover_tree(negatives.augmented(v, (v * v).sum(1).max()))
    v, ids = v[tree["order"]], np.arange(len(v))

    class Seen(negatives.Hits):
        rows_seen = 0

        def add(self, scores, ids):
            self.rows_seen += len(scores)
            super().add(scores, ids)

    window = Seen(5, 400_000, 700_000)
    negatives.descend(tree | {"v": v, "ids": ids, "centres": v[tree["centre"]]}, v[0], np.ones(len(v), bool), (v * v).sum(1).max(), [window])
    assert len(window.rows) == 5 and window.rows_seen <= 100
