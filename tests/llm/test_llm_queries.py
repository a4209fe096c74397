"""The registered queries: against SQL where SQL has them, else against plain Python on the smallest tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import connect, differences
from tokenizers import Tokenizer

from tidemark.llm import queries, secrets
from tidemark.plans.registry import Query

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def rows(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, data, name):
    assert differences(spark, connect(data), Query(name, queries.QUERIES[name], queries.ORACLES[name]), data) == ""


def test_toxicity_on_held_out_rows(spark, data):
    got = {r.doc_id: r for r in rows(spark, "/root/testdata/sf0.01", "op4_toxicity")}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    judged = [(got[x.doc_id].predicted, x.toxic) for x in labels if got[x.doc_id].held_out]
    assert len(judged) > 40
    assert sum(p == t for p, t in judged) >= 0.9 * len(judged)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def statistics(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics_and_verdicts(spark, data, docs):
    got = rows(spark, data, "op5_quality")
    assert len(got) == len(docs)
    for r in got:
        want = statistics(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_rules_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r for r in rows(spark, folder, "op5_quality")}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    judged = [(kept[x.doc_id].kept, x.quality) for x in labels if not kept[x.doc_id].base_failed]
    assert sum(k for k, q in judged if q == 1) >= 0.99 * sum(q for _, q in judged)


def test_vectors_against_all_pairs(spark):
    from pyspark.sql import functions as F

    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    # A third more rows around one vector, besides the given ones.
    near = given.where("vec_id < 700").select(F.col("vec_id") + 10_000, F.expr("transform(embedding, (x, i) -> cast(sin(i + 1) + 0.3 * x as float))"))
    table = given.unionAll(near)
    from tidemark.llm import vectors

    got = {r.vec_id: r for r in vectors.near_duplicates(table).collect()}
    pairs = sorted((r.vec_id, r.embedding) for r in table.collect())
    x = np.array([e for _, e in pairs], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [v for v, _ in pairs]
    assert sum(got[v].n_links for v in ids) >= 0.9 * (near.sum() - len(ids))
    comp = np.arange(len(ids))
    while True:
        new = np.array([comp[near[i]].min() for i in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    wrong = sum(got[v].component_id != ids[c] for v, c in zip(ids, comp))
    assert wrong <= 0.01 * len(ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_bpe_against_the_library(spark, data, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows(spark, data, "op7_bpe"):
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids)))
        assert r.decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))


def test_packing_is_gapless_and_tight(spark, data, docs):
    import zlib

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, data, "op9_packing")
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc_id, parts in by_doc.items():
        ids = np.array(lib.encode(docs[doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 1024 for r in parts[1:])
        assert len(parts) == -(-len(ids) // 1024)
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert sum(r.length for r in parts) <= 1024
    total = sum(r.length for r in got)
    assert len(by_sequence) <= 1.03 * total / 1024 + 1


def brute_spans(text, rules=secrets.RULES):
    found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in r.compiled().finditer(text) if len(m.group(r.group)) >= r.least]
    return sorted(found)


def test_secrets_against_plain_scans(spark):
    folder, total = "/root/testdata/sf0.01", 0
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows(spark, folder, "op10_secrets"):
        spans = brute_spans(docs[r.doc_id] or "")
        base = [s for s in spans if s[1] < 3]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        name = lambda ss: ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in ss)
        assert r.base_sha256 == hashlib.sha256(name(base).encode()).hexdigest()
        assert r.spans == name(spans)
        total += len(spans)
    assert total > 0
