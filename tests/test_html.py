import pytest
from tidemark.operators import converters, html

PAGE = "page_id bigint, html string"


def profile(spark, text, regions=None):
    return html.page_profile(spark.createDataFrame([(1, text)], PAGE), regions).first()


def md(spark, text):
    return profile(spark, text).md_converter


CASES = [
    ("<h3>A <a href='#x'>b</a></h3>", "### A [b](#x)"),
    ("<p>a <b>c <i>d</i></b> <del>e</del> <code>f</code><p>g<br>h", "a **c *d*** ~~e~~ `f`\n\ng\nh"),
    ("<p><b>open<p>next</b>", "open\n\nnext"),
    ("<ul><li>a<ol><li>b</li></ol></li><li><p>c</p></li></ul>d", "- a\n  1. b\n- c\n\nd"),
    ("<table><tr><th>A<th>B<tr><td>1<p>x</p><td>2</table>z", "| A | B |\n| --- | --- |\n| 1 x | 2 |\n\nz"),
    ("<pre class='brush: js notranslate'>\nif (a &lt; b) {\n  c\n}\n</pre>", "```js\nif (a < b) {\n  c\n}\n```"),
    ("<img src=/i.png alt='p q'> <hr>x", "![p q](/i.png)\n\n---\n\nx"),
    ("<p>&amp;amp; &#233; &#x1F600; &bogus; &nbsp;x", "&amp; é 😀 &bogus;  x"),
    ("<head><title>T</title></head><body>x<script>var t='</p>'</script>tail<!-- c > d --><style>p{}</style>", "xtail"),
    ("<math>x<annotation>\\x</annotation></math>", "x"),
    ("<dl><dt>t</dt><dd>d</dd></dl><details><summary>s</summary>b</details>", "t\n\nd\n\ns\n\nb"),
    ("a < b <p title=\"x>y\">c", "a < b\n\nc"),
    ("", ""),
    # line prefixes
    ("x<blockquote>a<p>b<br>c</p></blockquote>y", "x\n\n> a\n>\n> b\n> c\n\ny"),
    ("<blockquote>a</blockquote><blockquote>b</blockquote>", "> a\n\n> b"),
    ("<blockquote><p>a<blockquote><p>b</p></blockquote><p>c</blockquote>", "> a\n>\n> > b\n>\n> c"),
    ("<ul><li>a<blockquote>b<p>c</blockquote></li><li><blockquote>d<br>e</blockquote></ul>", "- a\n  > b\n  > c\n- > d\n  > e"),
    ("<blockquote>x<ul><li>a<ul><li>b</ul><li>c</ul></blockquote>z", "> x\n>\n> - a\n>   - b\n> - c\n\nz"),
    ("<blockquote><h2>t</h2><pre>\n1\n\n 2\n</pre><hr></blockquote>", "> ## t\n>\n> ```\n> 1\n> \n>  2\n> ```\n>\n> ---"),
    ("<blockquote><table><tr><th>a<th>b<tr><td>1<td>2</table></blockquote>", "> | a | b |\n> | --- | --- |\n> | 1 | 2 |"),
    ("<blockquote></blockquote>a<blockquote> <p> </blockquote>b", "a\n\nb"),
    ("<blockquote>open<ul><li>a</ul>", "open\n\n- a"),
    ("<blockquote><ul><li>a</blockquote>b<blockquote>c</blockquote>", "> - a\nb\n  > c"),
    # fences, languages, cells
    ('<pre><code class="hl language-py">x = 1\n</code></pre>', "```py\nx = 1\n```"),
    ("<pre>a\n```\n`<i>`</i>`</pre>b<pre>c</pre>", "````\na\n```\n```\n````\n\nb\n\n```\nc\n```"),
    ("<table><tr><th>a|b<th><code>c|d</code></table>", r"| a\|b | `c\|d` |" + "\n| --- | --- |"),
    ("<table><tr><td>1<table><tr><td>x<td>y<tr><td>z</table>2<td>3</table>w", "| 1   x y  z 2 | 3 |\n| --- | --- |\n\nw"),
    ("<table><tr><td><blockquote>q</blockquote><pre>p\nr</pre><td>s</table>", "| q  p r | s |\n| --- | --- |"),
]


@pytest.fixture(scope="module")
def converted(spark):
    """All pages in one job."""
    pages = spark.createDataFrame([(i, page) for i, (page, _) in enumerate(CASES)], PAGE)
    return {r.page_id: r.md_converter for r in html.page_profile(pages).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_markdown(converted, case):
    assert converted[case] == CASES[case][1]


def test_extractor_prefers_article_then_main_then_body(spark):
    assert profile(spark, "<body>n<main>m<article>a</article></main>f").md_extractor == "a"
    assert profile(spark, "<body>n<main>m</main>f").md_extractor == "m"
    assert profile(spark, "<body>n</body>").md_extractor == "n"
    assert profile(spark, "plain").md_extractor == "plain"


def test_regions_nest_and_close(spark):
    page = (
        "<div class='x ad'>1<div>2</div>3</div>4<div>5<div class=ad>6<div class='ad'>7</div>8</div>9</div>"
        "<nav id=n>a<p>b<script>var t=\"</nav>\"</script>c</nav>d<div role='main'>e</div>"
    )
    got = html.region_text(
        spark.createDataFrame([(1, page), (2, "none")], PAGE),
        {"ad": ["div.ad"], "nav": ["nav#n"], "main": ["div[role=main]"]},
    ).orderBy("page_id").collect()
    assert got[0].text_ad == " 123 6 78"
    assert (got[0].text_nav, got[0].text_main) == (" abc", " e")
    assert (got[1].text_ad, got[1].text_nav) == ("", "")


def test_selector_parsing():
    s = html.Selector.parse("header.vector-header")
    assert (s.tag, s.classes) == ("header", ("vector-header",))
    assert html.Selector.parse("#mw-content-text").element_id == "mw-content-text"
    assert html.Selector.parse("div[role=main]").attr == ("role", "main")


def test_one_exchange_serves_all_windows(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    plan = html.page_profile(pages, {"nav": ["nav"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Cartesian" not in plan


def test_plugged_in_converters_record_failures(spark):
    registry = converters.Registry()
    registry.register("upper", "converter", lambda page, url: page.upper())

    def broken(page, url):
        raise ValueError(f"cannot read {url}")

    registry.register("broken", "extractor", broken, ranked=False)
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id bigint, url string, html string")
    rows = {(r.page_id, r.tool): r for r in converters.convert_pages(pages, registry.select()).collect()}
    assert rows[(1, "upper")].md == "A" and rows[(1, "upper")].error is None
    assert rows[(2, "broken")].md == "" and rows[(2, "broken")].error == "ValueError: cannot read v"
    assert not rows[(2, "broken")].ranked
    assert len(converters.convert_pages(pages, registry.select("upper")).collect()) == 2
    with pytest.raises(KeyError):
        registry.select("nope")
    with pytest.raises(ValueError):
        registry.register("x", "other", broken)


def test_tokens_keep_all_text(spark):
    page = "lead<p>a</p>b<!-- c --><br/>d"
    rows = html.html_tokens(spark.createDataFrame([(1, page)], PAGE)).orderBy("pos").collect()
    assert [(r.kind, r.tag, r.text) for r in rows] == [
        ("text", None, "lead"), ("tag", "p", "a"), ("tag", "p", "b"), ("comment", None, ""), ("tag", "br", "d"),
    ]
    assert html.tag_counts(spark.createDataFrame([(1, page)], PAGE)).count() == 2
