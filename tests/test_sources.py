import json

from pyspark.sql import functions as F

from tidemark.operators import tabular
from tidemark.sources import readers, writers


def test_selectors_tsv(spark, tmp_path):
    path = tmp_path / "selectors.tsv"
    path.write_text("a\tmain#c\tnav.x|footer#f\n\nb\tbody\t\nc\n")
    rows = {r.slug: r for r in readers.scan_selectors(spark, str(path)).collect()}
    assert rows["a"].boilerplate == ["nav.x", "footer#f"] and rows["a"].article == "main#c"
    assert rows["b"].boilerplate == [] and rows["c"].article == "body" and len(rows) == 3


def test_json_docs_take_their_key_from_the_folder(spark, tmp_path):
    for name, ms in (("one", 1.5), ("two", 2.5)):
        (tmp_path / name).mkdir()
        doc = {"rows": 3, "files": 1, "reps": 5, "results_ms": {"filter": {"duckdb": ms, "pandas": 9.0}}}
        (tmp_path / name / "compare.json").write_text(json.dumps(doc, indent=2))
    docs = readers.scan_json_docs(spark, f"{tmp_path}/*/compare.json", readers.RESULTS_SCHEMA)
    rows = {(r.doc_key, r.op, r.engine): r.ms for r in readers.flatten_results(docs).collect()}
    assert rows[("two", "filter", "duckdb")] == 2.5 and len(rows) == 4


def test_rules_and_missing_rule_files(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    spec = {"page": "p1", "probes": [
        {"id": "a", "feature": "tables", "type": "table", "weight": 2, "args": {"cells": ["x", "y"], "min_rows": 2}},
        {"id": "b", "feature": "links", "type": "link", "invert_for": "extractor", "args": {"href": "/h"}},
    ]}
    (tmp_path / "p1" / "probes.json").write_text(json.dumps(spec, indent=1))
    keys = spark.createDataFrame([("p1",), ("p2",)], "page string")
    rules, warnings = readers.load_rules(spark, f"{tmp_path}/*/probes.json", keys)
    rows = {r.id: r for r in rules.collect()}
    assert rows["a"].args.cells == ["x", "y"] and rows["a"].applies_to == "all"
    assert rows["b"].weight == 1 and rows["b"].invert_for == "extractor"
    assert [r.page for r in warnings.collect()] == ["p2"]


def test_whole_files_replace_bad_utf8(spark, tmp_path):
    (tmp_path / "page1").mkdir()
    (tmp_path / "page1" / "tool-a.md").write_bytes(b"ok \xff caf\xc3\xa9\nline")
    row = readers.scan_whole_files(spark, f"{tmp_path}/*/*.md").first()
    assert (row.page, row.tool, row.text) == ("page1", "tool-a", "ok � café\nline")


def test_log_lines(spark, tmp_path):
    (tmp_path / "log").write_text("origin log:\n  11:19:06 origin answered for alice\n11:19:07 origin answered for bob\nnoise\n")
    rows = readers.scan_log_lines(spark, str(tmp_path / "log")).collect()
    assert [(r.at, r.account) for r in rows] == [("11:19:06", "alice"), ("11:19:07", "bob")]


def test_http_dump(spark, tmp_path):
    body = '{"account": "alice", "doors": [{"id": "alice-door1", "name": "alice garage 1", "status": "closed"}], "origin_time": 1.5}'
    text = "".join(
        f"### {who}: GET /v1/devices with Authorization: Bearer token-{who}\nHTTP/1.1 200 OK\r\n"
        f"content-type: application/json\r\nX-CACHE-Status: {status}\r\n\r\n{body}\n\n"
        for who, status in (("alice", "MISS"), ("bob", "HIT"))
    )
    (tmp_path / "dump.txt").write_bytes(text.encode())
    rows = {r.client: r for r in readers.scan_http_dump(spark, str(tmp_path / "dump.txt")).collect()}
    assert rows["bob"].headers["x-cache-status"] == "HIT" and rows["bob"].body.account == "alice"
    assert rows["alice"].token == "token-alice" and rows["alice"].body.doors[0].id == "alice-door1"
    assert rows["alice"].headers["content-type"] == "application/json"


def test_scores_typed(spark, tmp_path):
    head = "page,tool,lang,kind,ranked,probes_passed,probes_total,probe_pass_rate,retention,boilerplate_leakage,output_bytes\n"
    (tmp_path / "s.csv").write_text(head + "p,a (x),go,converter,True,3,4,0.75,0.9,,120\np,b,py,extractor,False,0,4,None,,None,0\n")
    a, b = readers.scan_scores_typed(spark, str(tmp_path / "s.csv")).orderBy("tool").collect()
    assert a.ranked and not b.ranked
    assert (a.probes_passed, a.retention, a.boilerplate_leakage, a.output_bytes) == (3, 0.9, None, 120)
    assert (b.probe_pass_rate, b.retention, b.boilerplate_leakage) == (None, None, None)


def test_csv_text_na_is_not_null(spark, tmp_path):
    (tmp_path / "z.csv").write_text("id,name\n1,N/A\n2,\n")
    rows = readers.scan_csv(spark, str(tmp_path / "z.csv"), "id int, name string").orderBy("id").collect()
    assert [r.name for r in rows] == ["N/A", None]


def test_per_key_text_and_table(spark, tmp_path):
    df = spark.createDataFrame([("p1", "t1", "# A\n\nb"), ("p1", "t2", "c")], "page string, tool string, md string")
    path = writers.write_per_key_text(df, str(tmp_path / "out"))
    texts = {f.parent.name: f.read_text() for f in (tmp_path / "out").rglob("part-*")}
    assert texts["tool=t1"] == "# A\n\nb\n" and path.endswith("out")
    assert writers.create_table_as(df, "tidemark_t").count() == 2
    assert writers.create_table_as(df.limit(1), "tidemark_t").count() == 1
    row = writers.nested_json(spark.createDataFrame([("a", "y", 2), ("a", "x", 1)], "o string, i string, v int"), "o", "i", "v").first()
    assert row.json == '{"x":1,"y":2}'


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, data):
    lineitem = spark.read.parquet(f"{data}/lineitem.parquet")
    plan = plan_of(tabular.selective_group(lineitem, F.col("l_extendedprice") > 20000, ["l_suppkey"], {"m": "l_extendedprice"}))
    assert "GreaterThan(l_extendedprice,20000" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double>" in plan


def test_no_query_multiplies_rows(spark, data):
    """Neither cross joins nor nested-loop joins hide in the join-heavy plans."""
    from tidemark.plans import REGISTRY

    for name in ("dim_join_agg", "rate_usage", "tiered_charge", "ttl_replay", "owner_runs", "client_runs", "probe_eval", "text_retention"):
        plan = plan_of(REGISTRY[name].run(spark, data))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_full_sort_keeps_order(spark, data):
    from tidemark.plans import REGISTRY

    df = REGISTRY["full_sort"].run(spark, data)
    keys = [(-r.l_extendedprice, -r.l_discount, r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_suppkey) for r in df.collect()]
    assert keys == sorted(keys) and len(keys) > 0


def test_positions_are_the_order(spark, data):
    from tidemark.operators import tabular

    rows = [(i % 7 if i % 11 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    order = [F.desc_nulls_last("a"), F.asc("b")]
    got = {(r.a, r.b): r.position for r in tabular.ordered_positions(df, *order).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[r] for r in want] == list(range(1, 501))
    assert tabular.ordered_positions(df.where("false"), *order).collect() == []


def test_some_conversions_fail(spark, data):
    from tidemark.plans import REGISTRY

    got = {r.tool: r.n for r in REGISTRY["conversion_errors"].run(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {"closed pages", "linked title"} and all(0 < n < 250 for n in got.values())


def test_rows_are_dealt_unless_told_otherwise(spark, data):
    from tidemark.sources.readers import Tables

    dealt, plain = (Tables(spark, data, deal=d).dealt("documents", "doc_id", "text") for d in (True, False))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt.rdd.getNumPartitions() == parts and "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in dealt.collect()) == sorted(r.doc_id for r in plain.collect())


def test_a_pack_reads_like_its_files(spark, tmp_path):
    bodies = {
        "p1": '{"page": "x", "probes": [{"id": "a", "type": "regex"}, {"id": "b", "weight": 3}]}\n',
        "p2": '{"probes": [{"id": "first"}]}\n{"probes": [{"id": "second"}]}\n',
        "p3": "{broken",
        "p4": "",
        "p5": "Ünïcode\n",
    }
    for folder, body in bodies.items():
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "page.json").write_bytes(body.encode())
    rows = [(f"{tmp_path}/in/{f}/page.json", b.encode()) for f, b in bodies.items()]
    pack = writers.write_pack(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "pack"))
    keys = spark.createDataFrame([("p1",), ("p9",)], "page string")

    def read(path, folders, glob, packed):
        rules, warnings = readers.load_rules(spark, folders, keys, packed=packed)
        files = readers.file_inventory(spark, path, packed=packed).drop("changed")
        texts = readers.scan_whole_files(spark, glob, packed=packed).where("bytes > 0")
        return [sorted(map(str, df.collect())) for df in (rules, warnings, files, texts)]

    assert read(pack, pack, pack, True) == read(str(tmp_path / "in"), f"{tmp_path}/in/*", f"{tmp_path}/in/*/*", False)


def test_corpus_of_pages_is_few_files(spark, tmp_path):
    from tidemark.plans.pages import corpus_files
    from tidemark.sources.readers import Tables

    rows = [(i, f"http://a.org/{i}", None if i == 3 else "<p>x</p>") for i in range(1, 301)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    root = corpus_files(Tables(spark, str(tmp_path)))
    sizes = {r.folder: r.bytes for r in readers.file_inventory(spark, f"{root}/pages", packed=True).collect()}
    assert len(sizes) == 300 and sizes["slug=3"] == 1 and sizes["slug=4"] == 9
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).count() < 60


def test_tasks_follow_the_rows_of_a_keyed_table(spark, tmp_path):
    from tidemark.operators import html
    from tidemark.plans.pages import results
    from tidemark.sources.readers import PAGES_A_TASK, Tables

    n = 6 * PAGES_A_TASK + 1
    rows = spark.range(n).selectExpr("id AS page_id", "'http://a.org/' AS url", "'<p>x</p>' AS html")
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    tables = Tables(spark, str(tmp_path))
    assert tables.pages.rdd.getNumPartitions() == 7
    assert html.page_profile(tables.pages).rdd.getNumPartitions() == 7
    assert tables.by_key("pages", "page_id", 10**9).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Pages and their rules meet where they are: neither is exchanged again.
    exchanges = [x for x in plan_of(results(tables)).splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and all(", 7), REPARTITION_BY_NUM" in x for x in exchanges)


def test_order_rules_follow_the_rows(spark, tmp_path, monkeypatch):
    from tidemark.plans import REGISTRY

    monkeypatch.setattr(readers, "ROWS_A_TASK", 20)
    rows = spark.range(200).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    found = REGISTRY["probe_list_nesting"].run(spark, str(tmp_path))
    assert ", 10), REPARTITION_BY_NUM" in plan_of(found)
    assert {r.page_id: r.ok for r in found.collect()} == {i: i % 2 == 0 for i in range(200)}


def test_pages_are_converted_by_slices(spark):
    import pyarrow as pa

    from tidemark.operators import converters

    registry = converters.Registry()
    registry.register("same", "converter", lambda page, url: page)
    sizes = [0, 300_000, 5_000_000, *[200_000] * 40]
    pages = [None, *("x" * n for n in sizes)]
    batch = pa.RecordBatch.from_pydict({"page_id": [None, *range(len(sizes))], "url": ["u"] * len(pages), "html": pa.array(pages, pa.string())})
    out = list(converters._stage(registry.select())(iter([batch, batch.slice(0, 0)])))
    assert [m for b in out for m in b.column("md").to_pylist()] == [p or "" for p in pages]
    assert len(out) > 8 and all(b.num_rows == 1 or b.nbytes < 3 * converters.SLICE_BYTES or "x" * 5_000_000 in b.column("md").to_pylist() for b in out)


def test_collapse_and_squeeze_over_all_characters(spark):
    import re
    import unicodedata

    from tidemark.functions import text as tx

    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = [(f"a{chr(c)}b {chr(c)}c{chr(c)}{chr(c)}d",) for c in codes]
    got = spark.createDataFrame(rows, "t string").select(
        "t", tx.collapse(F.col("t")).alias("c"), tx.squeeze(F.col("t")).alias("s"), tx.nfkc(F.col("t")).alias("n")
    ).collect()
    for r in got:
        plain = r.t.replace("\u00a0", " ").replace("\u200b", "")
        assert r.s == re.sub(r"[ \t]{2,}|\t", " ", plain), ascii(r.t)
        odd = ord(r.t[1])
        white = chr(odd) in "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85" or unicodedata.category(chr(odd)).startswith("Z")
        assert r.c == ("a b c d" if white else r.t), (ascii(r.t), ascii(r.c))
        if odd < 128:
            assert r.n == r.t
