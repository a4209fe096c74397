"""The pipeline, stage by stage against plain Python."""

import re

import pytest
from test_llm_queries import brute_spans

import corpus_pipeline
from tidemark.llm import quality, secrets
from tidemark.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, data), "test-stage")
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_order_and_columns(spark, data, stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "secret scans", "best-fit packing"]
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    assert all(stages[n][1].columns == columns for n in names[:-1])


def test_quality_stage(spark, data, stages):
    before, after = stages["quality rules"]
    judged = quality.judge(before, quality.learn(before, spark.read.parquet(f"{data}/labels.parquet"))).collect()
    assert set(texts(after)) == {r.doc_id for r in judged if r.kept} and len(texts(after)) > 50


def test_jaccard_stage(stages):
    before, after = (texts(t) for t in stages["n-gram Jaccard join"])
    sets = {}
    for i, t in before.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    comp, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if comp[a] > comp[b] and 100 * k >= 75 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    assert set(after) == {i for i in comp if comp[i] == i}


def test_suffix_stage(stages):
    before, after = (texts(t) for t in stages["suffix-array dedup"])
    first = {}
    for i in sorted(before):
        raw = before[i].encode()
        for k in range(len(raw) - 49):
            first.setdefault(raw[k : k + 50], i)
    for i, t in before.items():
        raw, gone = t.encode(), set()
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] != i:
                gone.update(range(k, k + 50))
        at, kept = 0, []
        for c in t:
            size = len(c.encode())
            if not gone.intersection(range(at, at + size)):
                kept.append(c)
            at += size
        assert after[i] == "".join(kept)


def test_secret_stage(stages):
    before, after = (texts(t) for t in stages["secret scans"])
    assert {i: secrets.mask(t, brute_spans(t), secrets.RULES) for i, t in before.items()} == after
    assert all(r.n_chars == len(r.text) for r in stages["secret scans"][1].collect())


def test_packing_stage_and_run(spark, data, stages):
    before, after = stages["best-fit packing"]
    assert {r.doc_id for r in after.collect()} == set(texts(before))
    key = lambda t: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in t.collect())
    assert key(corpus_pipeline.run(spark, data)) == key(after)
