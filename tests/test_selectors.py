"""Selectors as data: combinators, per-page sets, malformed pages."""

import pytest

from tidemark.operators import html, selectors
from tidemark.sources import readers

PAGE = "page_id bigint, html string"


def texts(spark, page, *chosen):
    """Text of each selector's region."""
    regions = {f"r{i}": [s] if isinstance(s, str) else s for i, s in enumerate(chosen)}
    row = html.region_text(spark.createDataFrame([(1, page)], PAGE), regions).first()
    return [row[f"text_r{i}"] for i in range(len(chosen))]


def test_parsing():
    (chain,) = selectors.parse("nav.x#y > ul li[role='main']")
    assert [c.tag for c in chain] == ["nav", "ul", "li"] and [c.child for c in chain] == [False, True, False]
    assert chain[0].tests == (("class", "~=", "x"), ("id", "=", "y")) and chain[2].tests == (("role", "=", "main"),)
    assert len(selectors.parse("a, b[t='x,y']")) == 2
    for bad in ("", "a +b", "a:hover", "> a", "a >", "a ~ b", "[", "a[]", "a,,b"):
        assert selectors.parse(bad) == (), bad


def test_combinators(spark):
    page = "<body><div class=a>1<p>2<b>3</b></p><div><p>4</p></div></div><p>5</p><nav><ul><li>6<ul><li>7</ul><li>8</ul></nav>"
    got = texts(spark, page, "div.a p", "div.a > p", "body > p", "nav > ul > li", "nav li li", "p, b", "div div", "*.a > div", "div > span", ["p b", "nav"])
    assert got == [" 23 4", " 23", " 5", " 67 8", " 7", " 2 3 4 5", " 4", " 4", "", " 3 678"]


def test_attribute_tests(spark):
    page = """<p lang=en-US>1</p><p data-x="a b">2</p><p DATA-X='ab'>3</p><p hidden>4</p><p id="k">5</p>"""
    assert texts(spark, page, "[lang|=en]", "[data-x~=b]", "[data-x^=a]", "[hidden]", "#k", "p[data-x='ab']", "[data-x*=b]", "[data-x$=b]") == [
        " 1", " 2", " 2 3", " 4", " 5", " 3", " 2 3", " 2 3",
    ]


def test_malformed_pages(spark):
    assert texts(spark, "<div><p>1<p>2<div>3</div>4</div>5", "p", "div") == [" 1 2", " 12 34"]
    assert texts(spark, "<b><p>1</b>2</p>3", "p", "b") == [" 12", " 1"]
    assert texts(spark, "<ul><li>1<li>2<ul><li>3</ul>4</ul></p></div>5", "li", "ul") == [" 1 2 34", " 12 34"]
    assert texts(spark, "<table><tr><td>1<td>2<tr><td>3</table>4", "td", "tr") == [" 1 2 3", " 12 3"]
    assert texts(spark, "<nav>1<br>2<img>3<script>var t='</nav>'</script>4", "nav", "img") == [" 1234", ""]
    # A body that is only implied, and text behind its end.
    for page in ("x<p>y</p>", "<title>t</title>x<p>y</p>", "<html><head><title>t</title></head>x<p>y</p></html>", "<html><body>x<p>y</p></body></html>"):
        assert texts(spark, page, "body", "body > p")[1] == " y" and texts(spark, page, "body")[0].strip() in ("xy", "txy")
    assert texts(spark, "", "body") == [""] and texts(spark, "<body>1</body>2</html>3", "body") == [" 123"]


def test_one_set_a_page(spark, tmp_path):
    path = tmp_path / "selectors.tsv"
    path.write_text("one\tdiv.a p\tnav > ul|footer\ntwo\tarticle\n\ntwo\tarticle\t\nbad\tp:first\t\n")
    sets = readers.scan_selectors(spark, str(path))
    page = "<body><nav>n<ul>u</ul></nav><div class=a><p>p</p>q</div><article>r</article><footer>f</footer>"
    pages = spark.createDataFrame([(1, "one", page), (2, "two", page), (3, "none", page), (4, None, page), (5, "one", None), (6, "bad", page)], "page_id bigint, site string, html string")
    got = {r.page_id: (r.text_article, r.text_boiler) for r in html.region_text_by_set(pages, sets, "site").collect()}
    assert got == {1: (" p", " u f"), 2: (" r", ""), 3: (" nupqrf", ""), 4: (" nupqrf", ""), 5: ("", ""), 6: ("", "")}


def test_compound_selectors_are_not_read_as_simple():
    with pytest.raises(ValueError):
        html.Selector.parse("div.a p")
    assert html.Selector.parse("div.a").classes == ("a",)
