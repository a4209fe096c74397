import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import blocks, quality, rules as rl
from tidemark.plans.pages import _schema
from tidemark.sources.readers import RULE_ARGS

OUT = "page_id bigint, tool string, kind string, md string"


def rule(kind, rule_id="r", page=None, weight=None, applies_to=None, invert_for=None, feature="structure", **args):
    return (page, rule_id, feature, kind, weight, applies_to, invert_for, {n: args.get(n) for n in RULE_ARGS.names})


def judge(spark, md, rules, kind="converter"):
    docs = spark.createDataFrame([(1, "t", kind, md)], OUT)
    rows = spark.createDataFrame([(r[0], f"r{i:02d}", *r[2:]) for i, r in enumerate(rules)], _schema())
    return [r.ok for r in rl.evaluate(docs, rows).orderBy("rule_id").collect()]


def test_headings(spark):
    md = "## [Title](#x) ¶\n\n# Other `code` ##\n#NoSpace\n   ### Indented"
    got = judge(spark, md, [
        rule("heading", level=2, text="Title"), rule("heading", level=3, text="Title"), rule("heading", level=2, text=""),
        rule("heading", level=1, text="Other code"), rule("heading", level=1, text="NoSpace"),
        rule("heading", level=3, text="Indented"),
    ])
    assert got == [True, False, False, True, False, True]


def test_tables(spark):
    md = "| A | B |\n|---|:-:|\n| 1 | x\\*y |\n|  |  |\n| 2 | z |\ntext\n| lone |\n"
    found = spark.range(1).select(blocks.tables(F.lit(md))).first()[0]
    assert found == [[["A", "B"], ["1", "x\\*y"], ["2", "z"]], [["lone"]]]
    got = judge(spark, md, [
        rule("table", cells=["A", "z"], min_rows=3), rule("table", cells=["A"], min_rows=4),
        rule("table", cells=["x*y"]), rule("table", cells=["A", "lone"]), rule("table"),
    ])
    assert got == [True, False, True, False, True]


def test_fences_and_indented_code(spark):
    md = "````py extra\na\n~~~\n  ```  \nafter\n\n    one\n\n    two\n\nend\n~~~\nopen"
    fences = spark.range(1).select(blocks.fences(F.lit(md))).first()[0]
    assert [(f.lang, f.body) for f in fences] == [("py extra", "a\n~~~"), (None, "open")]
    assert spark.range(1).select(blocks.indented(F.lit(md))).first()[0] == ["one\n\ntwo"]
    got = judge(spark, md, [
        rule("fence", body="a"), rule("fence", body="open", lang="py"), rule("fence", body="a", lang="PY extra"),
        rule("code_block", body="one two"), rule("code_block", body="open"), rule("code_block", body="after"),
    ])
    assert got == [True, False, True, True, True, False]


def test_structure_is_read_from_raw_text(spark):
    """Full-width bars and tildes are text, not structure; what is compared is normalised."""
    got = judge(spark, "| a｜b | ﬁne |\n|\t---\t|---|\n| c | d |", [
        rule("table", cells=["a|b"]), rule("table", cells=["fine", "c"]), rule("table", cells=["c"], min_rows=2), rule("table", cells=["c"], min_rows=3),
    ])
    assert got == [True, True, True, False]
    got = judge(spark, "|\t---\t|---|\n| c | d |", [rule("table", cells=["c"], min_rows=2)])
    assert got == [False]
    got = judge(spark, "～～～\nx\n～～～", [rule("fence", body="x"), rule("code_block", body="x")])
    assert got == [False, False]
    got = judge(spark, "~~~ py\nﬁ x\n~~~\n\n    ﬁ y\n", [rule("fence", body="fi x", lang="py"), rule("code_block", body="fi y")])
    assert got == [True, True]


def test_character_references(spark):
    want = {
        "&alpha;&rsaquo;&check;": "α›✓", "&#0000000065;&#x000000041;": "AA", "&amp;lt; &nosuch; & &": "&lt; &nosuch; & &",
        "&Aacute;&aacute;": "Áá", "&#0;&#xD800;": "&#0;&#xD800;", "&NotEqualTilde;": "≂̸",
    }
    rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", tx.decode_entities(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == want


def test_escapes_and_prose(spark):
    assert judge(spark, "a \\- b", [rule("contains", text="a - b"), rule("absent", text="a - b")]) == [True, True]
    for md in ("_coro_ x", "`coro` x", "coro x", "[coro](#a) x"):
        assert judge(spark, md, [rule("prose", text="coro x")]) == [True]
    md = "café  ﬁne​x"
    assert judge(spark, md, [rule("contains", text="café finex"), rule("absent", text="finex")]) == [True, False]


def test_regex_rules(spark):
    md = "one\n# two\nthree"
    got = judge(spark, md, [
        rule("regex", pattern="^# two$"), rule("regex", pattern="one.*three"), rule("not_regex", pattern="four"),
        rule("escape", pattern="^# two"), rule("escape", pattern="# two"),
    ])
    assert got == [True, True, True, False, True]


def test_links_and_images(spark):
    md = "see [A \\* b](</x/y#f> \"t\") and ![pic](/i.png)\n\n[ref]: /r\n"
    got = judge(spark, md, [
        rule("link", href="y#f"), rule("link", href="y#f", text="A * b"), rule("link", href="y#f", text="B"),
        rule("link", href="/r"), rule("link", href="/r", allow_reference=True), rule("link", href="(.*)"),
        rule("image", alt="pic"), rule("image", src="/i"), rule("image", alt="no"), rule("image"),
    ])
    assert got == [True, True, False, False, True, False, True, True, False, True]
    found = spark.range(1).select(blocks.links(F.lit(md)).alias("l"), blocks.images(F.lit(md)).alias("i")).first()
    assert [x.href for x in found.l] == ["/x/y#f"] and [x.src for x in found.i] == ["/i.png"]


def test_order(spark):
    got = judge(spark, "first then second", [
        rule("order", first="first", second="second"), rule("order", first="second", second="first"),
        rule("order", first="first", second="none"),
    ])
    assert got == [True, False, False]


def test_list_nesting(spark):
    flat = "- parent\n- other\n  - child"
    deep = "- parent\n\ntext\n  1. child"
    far = "- parent\n" + "x\n" * 11 + "  - child"
    near = "- parent\n" + "x\n" * 10 + "  - child"
    want = rule("list_nesting", parent="parent", child="child")
    assert [judge(spark, md, [want])[0] for md in (flat, deep, far, near)] == [False, True, False, True]


def test_scope_inversion_and_defaults(spark):
    rules = [
        rule("contains", text="menu", invert_for="extractor"),
        rule("contains", text="menu", applies_to="extractor"), rule("contains", text="gone", weight=3),
    ]
    assert judge(spark, "menu", rules, "converter") == [True, False]
    assert judge(spark, "menu", rules, "extractor") == [False, True, False]
    assert judge(spark, "", rules, "extractor") == [True, False, False]


def test_unknown_type_fails(spark):
    with pytest.raises(PySparkException, match="unknown rule type"):
        judge(spark, "x", [rule("smells")])
    rows = spark.createDataFrame([rule("smells", page=1), rule("regex", page=1), rule("regex", page=1)], _schema())
    pages = spark.createDataFrame([(1, "h" * 9_999), (2, "h" * 10_000)], "page_id bigint, html string")
    found = quality.corpus_problems(
        pages, rows, expected=spark.createDataFrame([(1,), (3,)], "page_id bigint"),
        meta=spark.createDataFrame([(1, "{"), (2, "{}")], "page_id bigint, json string"),
        tools=spark.createDataFrame([("a", "unknown (x)"), ("b", "1.0")], "tool string, version string"),
    )
    assert {(r.subject, r.problem) for r in found.collect()} == {
        ("1", "page is only 9999 bytes"), ("1/r", "unknown rule type smells"), ("1", "duplicate rule id r"),
        ("3", "page missing"), ("1", "metadata unreadable"), ("a", "version could not be read"),
    }


def test_weighted_rate_and_universal_failures(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x", "f", 2, True), (1, "a", "y", "f", 1, False), (1, "b", "x", "g", 2, False), (1, "b", "y", "g", 0, False)],
        "page_id bigint, tool string, rule_id string, feature string, weight int, ok boolean",
    )
    got = {r.tool: (r.passed, r.total, r.pass_rate) for r in rl.scores(rows, ["page_id", "tool"]).collect()}
    assert got == {"a": (1, 2, 0.6667), "b": (0, 2, 0.0)}
    assert [r.rule_id for r in rl.universal_failures(rows).collect()] == ["y"]
    none = rl.scores(rows.withColumn("weight", F.lit(0)), ["page_id", "tool"]).first()
    assert none.pass_rate is None


def test_recall_and_leakage(spark):
    words = "page_id bigint, word string, n bigint"
    article = spark.createDataFrame([(1, "a", 3), (1, "b", 1)], words)
    out = spark.createDataFrame([(1, "a", 2), (1, "c", 5)], words)
    assert quality.recall(article, out, ["page_id"]).first()["recall"] == 0.5
    texts = spark.createDataFrame([(1, "home home a", "a a a b"), (2, "", "x"), (3, "y", None)], "page_id bigint, t string, u string")
    vocab = quality.boilerplate_vocab(texts, ["page_id"], "t", "u")
    assert sorted(map(tuple, vocab.collect())) == [(1, "home", 2), (3, "y", 1)]
    got = quality.recall(vocab, spark.createDataFrame([(1, "home", 1)], words), ["page_id"])
    assert got.first()["recall"] == 0.5
    profile = spark.createDataFrame(
        [(1, "a a c c c", "a a", "x", " a a a b", " home home a"), (2, "x", "x", "x", "", "nav")],
        "page_id bigint, md_converter string, md_extractor string, md_plain string, text_article string, text_boiler string",
    )
    rows = {(r.page_id, r.tool): (r.retention, r.leakage) for r in quality.text_measures(profile).collect()}
    assert rows[(1, "converter")] == (0.5, 0.0) and rows[(2, "converter")] == (None, 0.0)


# Published summary per tool (passed of 273, retention, leakage, total ms, bytes, ranked).
PUBLISHED = [
    ("html-to-markdown (go)", 263, 0.9387, 0.7603, 188.814, 1006265, True),
    ("markdownify", 262, 0.9384, 0.7607, 1662.213, 857878, True),
    ("html-to-markdown (py)", 254, 0.9375, 0.4692, 82.099, 1036088, True),
    ("htmd", 251, 0.9388, 0.7656, 108.251, 1251773, True),
    ("turndown", 246, 0.9411, 0.7656, 562.094, 1310077, True),
    ("markitdown", 246, 0.9382, 0.6835, 2038.744, 881647, True),
    ("node-html-markdown", 242, 0.9380, 0.7579, 3054.253, 1071175, True),
    ("html2text", 240, 0.9384, 0.7596, 632.348, 923500, True),
    ("trafilatura", 221, 0.8789, 0.0, 1008.169, 607515, True),
    ("pandoc", 208, 0.8931, 0.1791, 4497.239, 764668, True),
    ("turndown (no gfm plugin)", 245, 0.9401, 0.7656, 473.686, 1080303, False),
    ("pandoc (default gfm)", 177, 0.9704, 0.1806, 6118.348, 2071819, False),
]


def test_published_league_order(spark):
    scores = spark.createDataFrame(
        [(1, n, "converter", k, p, 273, r, l, b) for n, p, r, l, _, b, k in reversed(PUBLISHED)],
        "page_id bigint, tool string, kind string, ranked boolean, passed bigint, total bigint, "
        "retention double, leakage double, output_bytes bigint",
    )
    times = spark.createDataFrame([(1, n, ms) for n, _, _, _, ms, _, _ in PUBLISHED], "page_id bigint, tool string, ms double")
    summary = quality.tool_summary(scores, times)
    order = [r.tool for r in quality.league_table(summary).orderBy("position").collect()]
    assert order == [row[0] for row in PUBLISHED if row[-1]]
    with pytest.raises(PySparkException, match="no timing for"):
        quality.tool_summary(scores, times.filter("tool <> 'htmd'")).collect()


def test_nfkc_follows_python(spark):
    """Every basic-plane character alone and after a letter, compared with the standard library."""
    import unicodedata

    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF] + [chr(0x1D400), "\U0001F600"]
    df = spark.createDataFrame([(i, "e" + c) for i, c in enumerate(chars)], "i int, s string")
    got = {r.i: r.n for r in df.select("i", tx.nfkc(F.col("s")).alias("n")).collect()}
    assert all(got[i] == unicodedata.normalize("NFKC", "e" + c) for i, c in enumerate(chars))


def test_words_follow_python(spark):
    import re
    import unicodedata

    texts = ["It's Ünïcode_1 中文 ½ x²", "A—B don''t ١٢٣ é", "", "Ⅷ ﬁn"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.words(F.col("t"))).collect()]
    assert got == [re.findall(r"[\w']+", unicodedata.normalize("NFKC", t).lower()) for t in texts]


def test_summary_details_overhead_and_unranked(spark):
    cell = "array<struct<feature: string, ok: bigint, total: bigint>>"
    scores = spark.createDataFrame(
        [(p, tool, kind, ranked, 1.0, 0.5, 10, 1, 2, features) for p, tool, kind, ranked, features in (
            (1, "a", "converter", True, [("code", 1, 1), ("links", 0, 1)]), (2, "a", "converter", True, [("code", 0, 1)]),
            (1, "b", "extractor", False, None))],
        f"page_id bigint, tool string, kind string, ranked boolean, retention double, leakage double, output_bytes bigint, passed bigint, total bigint, features {cell}",
    )
    times = spark.createDataFrame([(1, "a", 1.0), (2, "a", 4.0), (1, "b", None), (9, "a", 99.0)], "page_id bigint, tool string, ms double")
    out = quality.summary_details(quality.tool_summary(scores, times), scores, times, {"a": "why"})
    out = quality.with_overhead(out, spark.createDataFrame([(2.0,), (3.0,)], "ms double"))
    got = {r.tool: r for r in out.collect()}
    assert set(got) == {"a", "b", quality.OVERHEAD}
    assert (got["a"].median_ms, got["a"].total_ms, got["a"].notes) == (4.0, 5.0, "why")  # upper median of the scored pages
    assert [tuple(f) for f in got["a"].features] == [("code", 1, 2), ("links", 0, 1)]
    assert (got["b"].median_ms, got["b"].features, got["b"].notes) == (None, None, None)
    assert (got[quality.OVERHEAD].median_ms, got[quality.OVERHEAD].ranked, got[quality.OVERHEAD].total) == (2.5, None, None)
    assert [r.tool for r in quality.unranked_table(out).collect()] == ["b"]
    none = quality.with_overhead(out.limit(0), spark.createDataFrame([], "ms double")).collect()
    assert [(r.tool, r.median_ms) for r in none] == [(quality.OVERHEAD, None)]


def test_corpus_checks_read_files_and_all_fire(spark, data):
    from tidemark.plans import REGISTRY

    kinds = ("page is only", "page missing", "metadata unreadable", "unknown rule type", "duplicate rule id", "version could")
    rows = [r.problem for r in REGISTRY["corpus_problems"].run(spark, data).collect()]
    assert all(any(r.startswith(k) for r in rows) for k in kinds)


def test_inventory_never_reads_content(spark, tmp_path):
    from tidemark.sources.readers import file_inventory

    for folder, body in (("p1", "abc"), ("p2", "")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "page.html").write_text(body)
    files = file_inventory(spark, str(tmp_path / "in"))
    assert sorted((r.folder, r.name, r.bytes) for r in files.collect()) == [("p1", "page.html", 3)]  # empty files aren't listed
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
