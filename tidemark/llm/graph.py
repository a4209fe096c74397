"""Connected components by DataFrame joins: links never leave the cluster's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import discard, free_shuffles, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the smallest node reachable.

    Each round links every node's larger neighbours to its smallest (large star), then its smaller ones (small star);
    rounds end when nothing changes, after a number that grows with the logarithm of the longest chain.  Rounds are
    written to the shared folder.  A hub's links are joined, not gathered: minima are pre-aggregated.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links = written(links, "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if state == before or state[0] == 0:
            return links.select(a.alias("node"), b.alias("component")).unionAll(links.select(b.alias("node"), b.alias("component"))).distinct()
        before = state
        both = links.unionAll(links.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        large = written(large, "links")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").where(a != b).distinct()
        after = written(small, "links")
        discard(links)
        discard(large)
        free_shuffles()
        links = after


def extended(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) once further links (a, b) are known: only the components they join are worked on."""
    of = lambda side: comps.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    joined = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    roots = joined.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    over = components(roots).select(F.col("node").alias("component"), F.col("component").alias("root"))
    known = comps.join(over, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    # Documents that had no link before are roots of their own.
    fresh = over.join(comps.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("root").alias("component"))
    return known.unionAll(fresh)
