"""Web pages as a table of tag tokens, and Markdown built from it.

``html_tokens`` turns a page into rows ``(page_id, pos, tag, closing, attrs,
text)``: one row per tag together with the text that follows it.  Structure
(open containers, list depth, table rows, matched pairs) comes from windows
over the page, so everything after the scan needs a single exchange, on
``page_id``.  One page is one input row, so a window never exceeds one page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import text as tx
from tidemark.operators import selectors

# Comments and raw elements are one token each: their bodies may hold tags.
_RAW = "script|style|template|noscript|annotation"
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TOKEN = (
    r"(?si)((?:<!--.*?(?:-->|\z)"
    rf"|<(script|style|template|noscript|annotation)\b{_ATTRS}>.*?(?:</\2\s*>|\z)"
    rf"|</?[a-z]{_ATTRS}>"
    r"|<[!?][^>]*>"
    r"|<)[^<]*|\A[^<]+)"
)
# Splits one token into its tag and the text after it.
HEAD = (
    r"(?si)^(<!--.*?(?:-->|\z)"
    rf"|<(script|style|template|noscript|annotation)\b{_ATTRS}>.*?(?:</\2\s*>|\z)"
    rf"|</?[a-z]{_ATTRS}>"
    r"|<[!?][^>]*>)"
)

# Marks used while pieces are joined; removed from page text first.
MARKS = "\u0002\u0003\u0004\u0005\u0006\u0007\u0010\u000e\u000f\u0011\u0012\u0013\u0014\u0015"
PARA, LINE, INDENT, GLUE, BREAK, CLOSE, CELL, QUOTE, QUOTED, LEAD, LED, UNQUOTE, FENCE, TRIM = MARKS
# A stack of line prefixes is a bit set in a long; deeper levels are indented, but not marked as quotes.
MOST_LEVELS = 62

BLOCK_TAGS = (
    "p div section article main header footer nav aside body html ul ol li dl dt dd "
    "table thead tbody tfoot tr td th caption blockquote pre hr br h1 h2 h3 h4 h5 h6 "
    "figure figcaption details summary form fieldset address title head"
).split()
LIST_TAGS = ["ul", "ol"]
ROW_TAGS = ["tr", "table", "thead", "tbody", "tfoot"]
# Inline families: tags that share one piece of markup.
FAMILIES = {
    "strong": (["b", "strong"], "**"),
    "emph": (["i", "em"], "*"),
    "strike": (["del", "s", "strike"], "~~"),
    "code": (["code"], "`"),
    "link": (["a"], ""),
}


def attribute(attrs: Column, name: str) -> Column:
    """Attribute value, or null when the attribute is absent."""
    lead = rf"(?si)(?:^|[\s\"'/]){name}\s*=\s*"
    found = lambda p: F.nullif(F.regexp_extract(attrs, lead + p, 1), F.lit(""))
    value = F.coalesce(found(r'"([^"]*)"'), found(r"'([^']*)'"), found(r"([^\s\"'>]+)"))
    return F.when(attrs.rlike(lead), F.coalesce(value, F.lit("")))


def html_tokens(pages: DataFrame) -> DataFrame:
    """Pages to ordered rows ``page_id, pos, kind, tag, closing, attrs, text``.

    ``kind`` is ``tag``, ``raw`` (script, style, template, noscript,
    annotation), ``comment`` (also doctype) or ``text`` (text before any tag).
    """
    clean = F.regexp_replace("html", f"[{MARKS}]", "")
    # The outer form keeps empty pages: they get one empty text token.
    cut = pages.select(
        "page_id", F.posexplode_outer(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(1))).alias("pos", "_t")
    ).withColumns({"pos": F.coalesce("pos", F.lit(0)), "_t": F.coalesce("_t", F.lit(""))}).withColumn("_h", F.regexp_extract("_t", HEAD, 1))
    name = F.lower(F.regexp_extract("_h", r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    kind = (
        F.when(F.col("_h") == "", F.lit("text"))
        .when(F.col("_h").rlike("^<[!?]"), F.lit("comment"))
        .when(name.isin(_RAW.split("|")) & ~F.col("_h").startswith("</"), F.lit("raw"))
        .otherwise(F.lit("tag"))
    )
    return cut.select(
        "page_id",
        "pos",
        kind.alias("kind"),
        F.nullif(name, F.lit("")).alias("tag"),
        F.col("_h").startswith("</").alias("closing"),
        F.regexp_extract("_h", r"(?s)^<[a-zA-Z][a-zA-Z0-9:-]*(.*?)/?>$", 1).alias("attrs"),
        F.substr("_t", F.length("_h") + 1).alias("text"),
    )


def tag_counts(pages: DataFrame) -> DataFrame:
    tokens = html_tokens(pages).filter("kind IN ('tag', 'raw') AND NOT closing")
    return tokens.groupBy("tag").agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")
    )


@dataclass(frozen=True)
class Selector:
    """A simple selector: tag, id, classes and one attribute test."""

    tag: str | None = None
    element_id: str | None = None
    classes: tuple[str, ...] = ()
    attr: tuple[str, str] | None = None

    @classmethod
    def parse(cls, text: str) -> "Selector":
        if len(selectors.parse(text)) != 1 or len(selectors.parse(text)[0]) != 1:
            raise ValueError(f"{text!r} is no simple selector; region_text takes combinators")
        tag = re.match(r"[a-zA-Z][\w-]*", text)
        ident = re.search(r"#([\w-]+)", text)
        attr = re.search(r"\[([\w-]+)=[\"']?([^\"'\]]+)[\"']?\]", text)
        return cls(
            tag.group(0).lower() if tag else None,
            ident.group(1) if ident else None,
            tuple(re.findall(r"\.([\w-]+)", text)),
            (attr.group(1), attr.group(2)) if attr else None,
        )

    def matches(self) -> Column:
        ok = (F.col("kind") == "tag") & ~F.col("closing")
        if self.tag:
            ok = ok & (F.col("tag") == self.tag)
        if self.element_id:
            ok = ok & attribute(F.col("attrs"), "id").eqNullSafe(F.lit(self.element_id))
        for name in self.classes:
            ok = ok & F.coalesce(
                F.array_contains(F.split(attribute(F.col("attrs"), "class"), r"\s+"), name), F.lit(False)
            )
        if self.attr:
            ok = ok & attribute(F.col("attrs"), self.attr[0]).eqNullSafe(F.lit(self.attr[1]))
        return ok


VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def _one_of(tags: list[str]) -> Column:
    return F.coalesce(F.col("tag").isin(tags), F.lit(False)) & (F.col("kind") == "tag")


def _move(tags: list[str]) -> Column:
    return F.when(~_one_of(tags), 0).when(F.col("closing"), -1).otherwise(1)


def _inline_family() -> Column:
    fam = F.lit(None).cast("string")
    for name, (tags, _) in FAMILIES.items():
        fam = F.when(_one_of(tags), F.lit(name)).otherwise(fam)
    return fam


def annotate(tokens: DataFrame, regions: dict[str, list[str]]) -> DataFrame:
    """Everything known about a token's surroundings, after one exchange.

    Per region ``in_<name>`` (inside it) and ``at_<name>`` (it opens here), plus
    the columns the Markdown rules read.  Tags are grouped into families: inline
    tags per block, lists with their items, any other tag by its own name.  In a
    family every tag gets its nesting level; at one level opens and closes
    alternate, which pairs each element with its end.  Four sorts within the
    page partitions serve all windows.
    """
    names = list(regions)
    opens = (F.col("kind") == "tag") & ~F.col("closing")
    along = Window.partitionBy("page_id").orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)

    t = tokens.withColumns(
        {
            **{
                f"at_{n}": F.coalesce(
                    _any([Selector.parse(s).matches() for s in regions[n]]), F.lit(False)
                )
                for n in names
            },
            "_family": _inline_family(),
            "_block": F.sum(_one_of(BLOCK_TAGS).cast("int")).over(along),
            "_s_list": F.sum(_move(LIST_TAGS)).over(along),
        }
    )
    t = t.withColumn("list_depth", F.col("_s_list") - F.least(F.lit(0), F.min("_s_list").over(along)))
    listed = _one_of([*LIST_TAGS, "li"])
    group = (
        F.when(F.col("_family").isNotNull(), F.concat_ws("#", "_family", "_block"))
        .when(listed, F.lit("#list"))
        .otherwise(F.col("tag"))
    )
    nests = (F.col("kind") == "tag") & ~F.col("tag").isin([*VOID_TAGS, "li"])
    step = F.when(~nests, 0).when(F.col("closing"), -1).otherwise(1)
    t = t.withColumns({"_group": group, "_step": step})
    by_group = Window.partitionBy("page_id", "_group").orderBy("pos")
    t = t.withColumn("_sum", F.sum("_step").over(by_group))
    t = t.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(by_group)))
    t = t.withColumn(
        "_level", F.col("_sum") - F.col("_low") + F.when(F.col("_step") < 0, 1).otherwise(0)
    )

    at_level = Window.partitionBy("page_id", "_group", "_level").orderBy("pos")
    earlier = at_level.rowsBetween(Window.unboundedPreceding, -1)
    href = F.when(F.col("_family") == "link", attribute(F.col("attrs"), "href"))
    mate = F.when(F.col("closing"), F.lag("closing").over(at_level).eqNullSafe(F.lit(False))).otherwise(
        F.lead("closing").over(at_level).eqNullSafe(F.lit(True))
    )
    list_kind = F.when(_one_of(LIST_TAGS) & ~F.col("closing"), F.col("tag"))
    # Quotes that have an end push a bit onto the stack of line prefixes, at their place among the open lists and quotes.
    place = F.col("list_depth") + F.col("_level")
    bit = F.when(place <= MOST_LEVELS, F.pow(F.lit(2.0), place - 1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    moved = F.when(F.col("closing"), -F.lag(bit).over(at_level)).otherwise(bit)

    def edge(name: str) -> Column:
        starts = F.when(F.col("_step") != 0, F.col(f"at_{name}"))
        ends = (F.col("_step") < 0) & F.coalesce(
            F.last(starts, ignorenulls=True).over(earlier), F.lit(False)
        )
        return F.when(F.col(f"at_{name}") & (F.col("_step") > 0), 1).when(ends, -1).otherwise(0)

    t = t.withColumns(
        {
            **{f"_d_{n}": edge(n) for n in names},
            "paired": F.col("_family").isNotNull() & mate,
            "_push": F.when(_one_of(["blockquote"]) & mate, moved),
            "_table": F.when(_one_of(["table"]) & mate, F.col("_step")).otherwise(0),
            "_href": F.when(F.col("closing"), F.lag(href).over(at_level)).otherwise(href),
            "_list": F.last(list_kind, ignorenulls=True).over(at_level),
        }
    )

    # A table in a table is text of the outer cell.
    t = t.withColumn("_tables", F.sum("_table").over(along))
    inner = F.col("_tables") + F.when(F.col("_table") < 0, 1).otherwise(0) > 1
    t = t.withColumn("_nested", inner & _one_of([*ROW_TAGS, "td", "th", "caption"]))
    outer = lambda tags: _one_of(tags) & ~F.col("_nested")

    row_edge = F.when(
        outer(ROW_TAGS), F.when((F.col("tag") == "tr") & ~F.col("closing"), "row").otherwise("end")
    )
    head_edge = F.when(
        _one_of(["head"]), F.when(F.col("closing"), "body").otherwise("head")
    ).when(_one_of(["body", "article", "main", "nav", "header", "p", "div"]) & opens, "body")
    row_opens = outer(["tr"]) & opens
    code = F.lead(F.when(_one_of(["code"]) & ~F.col("closing"), F.col("attrs"))).over(along)
    t = t.withColumns(
        {
            **{f"in_{n}": F.sum(f"_d_{n}").over(along) > 0 for n in names},
            "_s_pre": F.sum(_move(["pre"])).over(along),
            "_bits": F.coalesce(F.sum("_push").over(along), F.lit(0)),
            "_code": F.when(_one_of(["pre"]), code),
            "_row_now": F.last(row_edge, ignorenulls=True).over(along),
            "_row_was": F.last(row_edge, ignorenulls=True).over(before),
            "_n_rows": F.sum(row_opens.cast("int")).over(along),
            "_n_cells": F.sum((outer(["td", "th"]) & opens).cast("int")).over(along),
            "_head": F.coalesce(F.last(head_edge, ignorenulls=True).over(along), F.lit("body")),
            "_is_edge": row_edge.isNotNull(),
        }
    )
    table_opens = outer(["table"]) & opens
    t = t.withColumns(
        {
            "pre_depth": F.col("_s_pre") - F.least(F.lit(0), F.min("_s_pre").over(along)),
            "_cells": F.col("_n_cells")
            - F.coalesce(F.last(F.when(row_opens, F.col("_n_cells")), ignorenulls=True).over(along), F.lit(0)),
            "_rows": F.col("_n_rows")
            - F.coalesce(F.last(F.when(table_opens, F.col("_n_rows")), ignorenulls=True).over(along), F.lit(0)),
        }
    )
    return t.withColumns(
        {
            "_rows_was": F.coalesce(F.lag("_rows").over(along), F.lit(0)),
            "_cells_was": F.coalesce(F.lag("_cells").over(along), F.lit(0)),
        }
    )


def _prefix(bits: Column, above: int = 0) -> Column:
    """The line prefix of a stack: ``> `` for every quote, an indent for every list, without the ``above`` top levels."""
    depth = F.greatest(F.length(F.bin(bits)).cast("bigint"), F.col("list_depth") + F.bit_count(bits)) - above
    levels = F.sequence(F.lit(1), F.least(depth, F.lit(MOST_LEVELS)).cast("int"))
    marks = F.transform(levels, lambda i: F.when(F.getbit(bits, i - 1) == 1, F.lit("> ")).otherwise(F.lit(INDENT)))
    return F.when((bits == 0) | (depth < 1), F.lit("")).otherwise(F.array_join(marks, ""))


def _with_leads(piece: Column) -> Column:
    """Inside a quote, the line prefix before whatever may start a line; ``tidy`` keeps those that do."""
    own_level = _one_of(["li"]) & ~F.col("closing")
    lead = F.concat(F.lit(LEAD), F.when(own_level, _prefix(F.col("_bits"), 1)).otherwise(_prefix(F.col("_bits"))), F.lit(LED))
    shown = f"[^ {PARA}{LINE}{GLUE}{BREAK}{CLOSE}{CELL}{QUOTE}{UNQUOTE}]"
    led = F.regexp_replace(piece, F.lit(f"(^|[{PARA}{LINE}{BREAK}{CLOSE}{QUOTED}{UNQUOTE}])( *)(?={shown})"), F.concat(F.lit("$1$2"), lead))
    return F.when(F.col("_bits") == 0, piece).otherwise(F.replace(led, F.lit("\n"), F.concat(F.lit("\n"), lead)))


def _markup() -> Column:
    """The Markdown a tag stands for, before its own text."""
    tag, closing, attrs = F.col("tag"), F.col("closing"), F.col("attrs")
    is_tag = F.col("kind") == "tag"
    in_cell = F.col("_row_now").eqNullSafe(F.lit("row"))
    row_ends = F.col("_is_edge") & F.col("_row_was").eqNullSafe(F.lit("row"))
    separator = F.when(
        F.col("_rows_was") == 1,
        F.concat(F.lit(LINE + "|"), F.repeat(F.lit(" --- |"), F.col("_cells_was").cast("int"))),
    ).otherwise("")
    end_row = F.when(row_ends, F.concat(F.lit(CELL), separator)).otherwise("")
    indent = F.when(F.col("_bits") != 0, F.lit("")).otherwise(
        F.repeat(F.lit(INDENT), F.greatest(F.col("list_depth") - 1, F.lit(0)).cast("int"))
    )
    bullet = F.when(F.col("_list") == "ol", F.lit("1. ")).otherwise(F.lit("- "))
    named = [F.nullif(F.regexp_extract(a, p, 1), F.lit("")) for a in (attrs, F.col("_code"))
             for p in (r"lang(?:uage)?-([\w+#.-]+)", r"brush:\s*([\w+#.-]+)")]
    language = F.coalesce(*named, F.lit(""))
    para = F.when(in_cell, F.lit(" ")).when(
        F.col("list_depth") > 0, F.lit(LINE)
    ).otherwise(F.lit(PARA))
    inline = F.lit("")
    for name, (_, mark) in FAMILIES.items():
        if name == "link":
            piece = F.when(closing, F.concat(F.lit("]("), F.coalesce("_href", F.lit("")), F.lit(")"))).otherwise("[")
        else:
            piece = F.lit(mark)
        inline = F.when(F.col("_family") == name, piece).otherwise(inline)
    is_heading = tag.isin([f"h{i}" for i in range(1, 7)])
    heading = F.when(closing, F.lit(PARA)).otherwise(
        F.concat(F.lit(PARA), F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" " + GLUE))
    )
    image = F.concat(
        F.lit("!["), F.coalesce(attribute(attrs, "alt"), F.lit("")),
        F.lit("]("), F.coalesce(attribute(attrs, "src"), F.lit("")), F.lit(")"),
    )
    pre = F.when(
        closing, F.lit(CLOSE + FENCE + PARA)
    ).otherwise(F.concat(F.lit(PARA + FENCE), language, F.lit("\n")))
    quote = F.when(F.col("_push") > 0, F.concat(para, F.lit(QUOTE), _prefix(F.col("_bits") - F.col("_push")), F.lit(QUOTED))).otherwise(
        F.concat(F.lit(UNQUOTE), para)
    )
    list_edge = F.when(F.col("list_depth") + F.when(closing, 1).otherwise(0) <= 1, F.lit(PARA)).otherwise("")
    markup = (
        F.when(~is_tag, F.lit(""))
        .when(F.col("paired"), F.when(F.col("pre_depth") > 0, F.lit("")).otherwise(inline))
        .when(F.col("_family").isNotNull(), F.lit(""))
        .when(is_heading, F.when(in_cell, F.lit(" ")).otherwise(heading))
        .when(tag == "br", F.when(in_cell, F.lit(" ")).otherwise(F.lit(BREAK)))
        .when(tag == "hr", F.lit(PARA + "---" + PARA))
        .when(tag == "img", image)
        .when(tag == "pre", F.when(in_cell, F.lit(" ")).otherwise(pre))
        .when(F.col("_nested"), F.lit(" "))
        .when(F.col("_push").isNotNull() & ~in_cell, quote)
        .when(tag.isin(LIST_TAGS), F.when(in_cell, F.lit(" ")).otherwise(list_edge))
        .when(
            tag == "li",
            F.when(in_cell, F.lit(" ")).when(closing, F.lit(LINE)).otherwise(
                F.concat(F.lit(LINE), indent, bullet, F.lit(GLUE))
            ),
        )
        .when(tag == "tr", F.when(closing, F.lit("")).otherwise(F.lit(LINE)))
        .when(tag.isin("td", "th"), F.when(closing, F.lit("")).when(
            F.col("_cells") == 1, F.lit("| " + GLUE)).otherwise(F.lit(CELL + GLUE)))
        .when(tag == "table", F.lit(PARA))
        .when(tag.isin([t for t in BLOCK_TAGS if t not in ("tbody", "thead", "tfoot")]), para)
        .otherwise(F.lit(""))
    )
    return F.concat(end_row, markup)


def _piece_text(t: Column) -> Column:
    spaced = F.regexp_replace(t, r"[ \t\r\n\f]+", " ")
    first = F.regexp_replace(t, r"\A\r?\n", "")  # HTML ignores a newline right after <pre>
    in_cell = F.col("_row_now").eqNullSafe(F.lit("row"))
    return (
        F.when(in_cell, F.replace(spaced, F.lit("|"), F.lit(r"\|")))
        .when(F.col("pre_depth") > 0, F.when(F.col("tag") == "pre", first).otherwise(t))
        .otherwise(spaced)
    )


def tidy(joined: Column) -> Column:
    """Break marks to newlines, one blank line at most between blocks, line prefixes where a line starts, fences.

    ``joined`` should be a column, not an expression: it is read twice.
    """
    quoted = F.contains(joined, F.lit(QUOTE)) | F.contains(joined, F.lit(LEAD))
    c = F.when(quoted, _tidy(joined, True)).otherwise(_tidy(joined, False))
    return F.when(F.contains(joined, F.lit(FENCE)), _fenced(c)).otherwise(c)


def _fenced(c: Column) -> Column:
    """Fence marks to back-ticks, three at least and one more than the longest run inside."""
    parts = F.split(c, FENCE)
    longest = lambda p: F.aggregate(F.regexp_extract_all(p, F.lit("`+"), F.lit(0)), F.lit(0), lambda m, x: F.greatest(m, F.length(x)))
    fence = lambda p: F.repeat(F.lit("`"), F.greatest(longest(p) + 1, F.lit(3)))
    last = F.size(parts) - 1
    return F.array_join(
        F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(
            F.concat(fence(p), p, F.when(i < last, fence(p)).otherwise(F.lit("")))
        )), ""
    )


def _tidy(c: Column, quotes: bool) -> Column:
    gaps = f"[ {PARA}{LINE}{BREAK}]"
    opened, led = f"{QUOTE}[^{QUOTED}]*{QUOTED}", f"{LEAD}[^{LED}]*{LED}"
    if quotes:
        # A quote right after a bullet starts on its line; one without content leaves nothing.
        c = F.regexp_replace(c, f"{opened}{gaps}*{UNQUOTE}", PARA)
        c = F.replace(c, F.lit(UNQUOTE), F.lit(""))
        c = F.regexp_replace(c, rf"(?:{GLUE}|\G(?!\A))[ {PARA}{LINE}{GLUE}{BREAK}]*{opened}", f"> {GLUE}")
    c = F.regexp_replace(c, f"{GLUE}[ {PARA}{LINE}{GLUE}{BREAK}]*", "")
    c = F.regexp_replace(c, f" *{CELL} *", " | ")
    c = F.regexp_replace(c, f" +(?=[{PARA}{LINE}{BREAK}])", "")
    if quotes:
        # Between blocks the blank line has the prefix that both sides share: of the first quote that opens there, else the next line's.
        c = F.regexp_replace(c, rf"({opened}|\G(?!\A))({gaps}*){opened}", "$1$2")
        c = F.regexp_replace(
            c, f"(?=[ {LINE}{BREAK}]*(?:{opened})?[ {LINE}{BREAK}]*{PARA}){gaps}*{QUOTE}([^{QUOTED}]*){QUOTED}{gaps}*", f"\n$1{TRIM}\n"
        )
        c = F.regexp_replace(c, f"{gaps}*{opened}{gaps}*", "\n")
        c = F.regexp_replace(c, f"[ {LINE}{BREAK}]*{PARA}{gaps}*{LEAD}([^{LED}]*){LED}", f"\n$1{TRIM}\n{LEAD}$1{LED}")
    c = F.regexp_replace(c, f"[{LINE}{BREAK}]*{PARA}[ {PARA}{LINE}{BREAK}]*", "\n\n")
    c = F.regexp_replace(c, f"{LINE}[ {LINE}]*", "\n")
    c = F.regexp_replace(c, f"{BREAK} *", "\n")
    c = F.regexp_replace(c, f"(?:\n(?:{led})?)?{CLOSE}" if quotes else f"\n?{CLOSE}", "\n")
    if quotes:
        c = F.regexp_replace(c, rf"(\A|\n){LEAD}([^{LED}]*){LED}", "$1$2")
        c = F.regexp_replace(c, led, "")
        c = F.regexp_replace(c, f"[ {INDENT}]*{TRIM}", "")
    c = F.replace(c, F.lit(INDENT), F.lit("  "))
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def _field(name: str):
    return lambda row: row[name]


# Regions that mark the main content, best first.
MAIN_REGIONS = {"article": ["article"], "main": ["main"], "body": ["body"]}


def page_profile(pages: DataFrame, regions: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per page: Markdown in both modes, plain text and region texts.

    Columns: ``page_id, md_converter, md_extractor, md_plain`` and
    ``text_<region>`` for every requested region.  All outputs share the one
    exchange on ``page_id``; it also serves later groupings by page and word.
    """
    regions = dict(regions or {})
    marks = {**{f"x_{n}": s for n, s in MAIN_REGIONS.items()}, **regions}
    tokens = html_tokens(pages).withColumn("text", tx.decode_entities(F.col("text")))
    shaped = annotate(tokens, marks)
    dropped = F.col("_head") == "head"
    body = F.col("text")
    piece = F.when(dropped, F.lit("")).otherwise(_with_leads(F.concat(_markup(), _piece_text(body))))
    spaced = F.when(_one_of(BLOCK_TAGS), F.concat(F.lit(" "), body)).otherwise(body)
    fields = [F.col("pos"), piece.alias("piece"), F.when(dropped, F.lit("")).otherwise(spaced).alias("body")]
    fields += [F.col(f"in_x_{n}").alias(f"x_{n}") for n in MAIN_REGIONS]
    for name in regions:
        lead = F.when(F.col(f"at_{name}"), F.lit(" ")).otherwise("")
        fields.append(F.when(F.col(f"in_{name}"), F.concat(lead, body)).alias(f"r_{name}"))
    rows = shaped.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")
    )

    def joined(field: str, keep=None) -> Column:
        items = F.col("rows") if keep is None else F.filter("rows", keep)
        return F.array_join(F.transform(items, _field(field)), "")

    def has(name: str) -> Column:
        return F.exists("rows", _field(f"x_{name}"))

    main = joined("piece")
    for name in reversed(MAIN_REGIONS):
        main = F.when(has(name), joined("piece", _field(f"x_{name}"))).otherwise(main)
    texts = [joined(f"r_{name}").alias(f"text_{name}") for name in regions]
    whole = rows.select("page_id", joined("piece").alias("_all"), main.alias("_main"), joined("body").alias("_body"), *texts)
    return whole.select(
        "page_id", tidy(F.col("_all")).alias("md_converter"), tidy(F.col("_main")).alias("md_extractor"),
        tx.collapse(F.col("_body")).alias("md_plain"), *[f"text_{name}" for name in regions],
    )


def token_arrays(pages: DataFrame, *carry: str) -> DataFrame:
    """``page_id, marks, texts`` and carried columns: a page's tags and the texts after them, as arrays in the row."""
    clean = F.regexp_replace("html", f"[{MARKS}]", "")
    cut = pages.select("page_id", *carry, F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(1)).alias("_t"))
    split = F.transform("_t", lambda t: F.struct(F.regexp_extract(t, HEAD, 1).alias("h"), t.alias("t")))
    cut = cut.select("page_id", *carry, F.coalesce(split, F.array().cast("array<struct<h: string, t: string>>")).alias("_t"))

    def mark(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p["h"], r"^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
        attrs = F.regexp_extract(p["h"], r"(?s)^<[a-zA-Z][a-zA-Z0-9:-]*(.*?)/?>$", 1)
        return (
            F.when((p["h"] == "") & (F.trim(p["t"]) != ""), F.lit("#"))
            .when((name == "") | (name.isin(_RAW.split("|")) & ~F.startswith(p["h"], F.lit("</"))), F.lit(""))
            .when(F.startswith(p["h"], F.lit("</")), F.concat(F.lit("/"), name, F.when(F.trim(F.substr(p["t"], F.length(p["h"]) + 1)) == "", F.lit("")).otherwise(F.lit("\n"))))
            .otherwise(F.concat(name, F.lit("\n"), attrs))
        )

    text = lambda p: tx.decode_entities(F.substr(p["t"], F.length(p["h"]) + 1))
    return cut.select("page_id", *carry, F.transform("_t", mark).alias("marks"), F.transform("_t", text).alias("texts"))


def region_text(pages: DataFrame, regions: dict[str, list[str]]) -> DataFrame:
    """Visible text of page regions: ``page_id, text_<region>...``; one set of selectors for all pages.

    Text of one element is joined without separators, several elements with one
    space.  Script, style, template and noscript bodies never count.
    """
    sets = F.array(*[F.array(*[F.lit(s) for s in chosen]).cast("array<string>") for chosen in regions.values()])
    return selectors.region_texts(token_arrays(pages).withColumn("sets", sets), list(regions), "sets", "page_id")


def region_text_by_set(pages: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """``page_id, text_article, text_boiler``: every page by the selectors of its own key, ``body`` without any."""
    joined = selectors.with_sets(pages, sets, key)
    return selectors.region_texts(token_arrays(joined, "sets"), ["article", "boiler"], "sets", "page_id")
