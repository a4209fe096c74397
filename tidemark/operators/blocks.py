"""Markdown structure as array Columns: headings, tables, code, list items.

Each function maps one text Column to an array Column, inside the row.  A text
is cut at lines that end a block (a sentinel takes their place), so one pass
finds all blocks and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text as tx

_CUT = "\u0001"
# What counts as a heading and as a list item.
_HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
_ITEM = r"^(\s*)([-*+]|\d+[.)])\s+(.*)$"


def heading_words(c: Column) -> Column:
    """Heading text as compared: links to text, marks and pilcrows removed."""
    plain = F.regexp_replace(tx.content_of(tx.link_text(c)), "[`*_]", "")
    return F.regexp_replace(plain, "^[¶ ]+|[¶ ]+$", "")


def headings(norm: Column) -> Column:
    """ATX headings: ``array<struct<level, text>>``."""
    found = F.filter(
        F.transform(tx.lines(norm), lambda line: F.trim(line)), lambda line: line.rlike(_HEADING)
    )
    return F.transform(
        found,
        lambda line: F.struct(
            F.length(F.regexp_extract(line, _HEADING, 1)).alias("level"),
            heading_words(F.regexp_extract(line, _HEADING, 2)).alias("text"),
        ),
    )


def _segments(marked: Column) -> Column:
    """Lines with sentinels to arrays of consecutive lines."""
    return F.filter(F.split(F.array_join(marked, "\n"), f"\n?{_CUT}\n?"), lambda s: s != "")


def tables(md: Column) -> Column:
    """Pipe tables as ``array<array<array<string>>>``: table, row, cell.

    Separator rows (and rows of empty cells) are dropped without ending a table.
    """
    stripped = F.transform(tx.lines(md), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    marked = F.transform(
        stripped, lambda s: F.when(s.rlike(r"^\|[^|]*\|") | s.rlike(r"^\|\|"), s).otherwise(F.lit(_CUT))
    )

    def rows(segment: Column) -> Column:
        cells = F.transform(
            F.split(segment, "\n"),
            lambda r: F.transform(
                F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
            ),
        )
        return F.filter(cells, lambda row: F.exists(row, lambda c: (c != "") & ~c.rlike(r"^:?-+:?$")))

    return F.filter(F.transform(_segments(marked), rows), lambda t: F.size(t) > 0)


# Opening run of back-ticks or tildes, language, body, closing run of the same
# character on its own line; an unclosed block reaches the end of the text.
_FENCE = (
    r"(?ms)^[ \t]*(?:(`)`{2,}|(~)~{2,})([^\n]*)(?:\n|\z)"
    r"(.*?)(?:^[ \t]*(?:(?:\1){3,}|(?:\2){3,})[ \t]*$|\z)"
)


def fences(md: Column) -> Column:
    """Fenced blocks: ``array<struct<lang, body>>``."""
    unix = F.regexp_replace(md, "\r\n?", "\n")
    lang = F.regexp_extract_all(unix, F.lit(_FENCE), F.lit(3))
    body = F.regexp_extract_all(unix, F.lit(_FENCE), F.lit(4))
    return F.zip_with(
        lang, body,
        lambda a, b: F.struct(
            F.nullif(F.trim(a), F.lit("")).alias("lang"), F.regexp_replace(b, r"\n\z", "").alias("body")
        ),
    )


def indented(md: Column) -> Column:
    """Four-space blocks; blank lines inside are kept, those at the ends are not."""
    marked = F.transform(
        tx.lines(md),
        lambda line: F.when(line.rlike(r"^\s*$"), F.lit(""))
        .when(line.startswith("    "), F.substring(line, 5, 2147483647))
        .otherwise(F.lit(_CUT)),
    )
    trimmed = F.transform(_segments(marked), lambda s: F.regexp_replace(s, r"\A\n+|\n+\z", ""))
    return F.filter(trimmed, lambda s: s != "")


def items(norm: Column) -> Column:
    """All lines as ``array<struct<line, indent, text>>``; indent is null off lists."""
    return F.transform(
        tx.lines(norm),
        lambda line, i: F.struct(
            i.alias("line"),
            F.when(line.rlike(_ITEM), F.length(F.regexp_extract(line, _ITEM, 1))).alias("indent"),
            tx.content_of(F.regexp_extract(line, _ITEM, 3)).alias("text"),
        ),
    )


LOOK_AHEAD = 11


def nested(all_lines: Column, parent: Column, child: Column) -> Column:
    """Is ``child`` an item deeper than ``parent`` within the next lines?

    The search below one parent stops at an item that is not deeper.
    """

    def below(p: Column) -> Column:
        window = F.slice(all_lines, p["line"] + 2, LOOK_AHEAD)
        stop = F.array_min(
            F.transform(F.filter(window, lambda x: x["indent"] <= p["indent"]), lambda x: x["line"])
        )
        return F.exists(
            window,
            lambda x: (x["indent"] > p["indent"])
            & F.contains(x["text"], child)
            & (stop.isNull() | (x["line"] < stop)),
        )

    parents = F.filter(
        all_lines, lambda x: x["indent"].isNotNull() & F.contains(x["text"], parent)
    )
    return F.exists(parents, lambda p: F.coalesce(below(p), F.lit(False)))


def links(md: Column) -> Column:
    """Inline links: ``array<struct<text, href>>``."""
    pattern = r"(?<!!)\[([^\]]*)\]\(\s*<?([^)\s>]*)"
    return _pairs(md, pattern, "text", "href")


def images(md: Column) -> Column:
    return _pairs(md, r"!\[([^\]]*)\]\(\s*<?([^)\s>]*)", "alt", "src")


def _pairs(md: Column, pattern: str, first: str, second: str) -> Column:
    return F.zip_with(
        F.regexp_extract_all(md, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(md, F.lit(pattern), F.lit(2)),
        lambda a, b: F.struct(a.alias(first), b.alias(second)),
    )


def block_rows(docs: DataFrame, keys: list[str], blocks: Column, alias: str) -> DataFrame:
    """One row per block with its position."""
    return docs.select(*keys, F.posexplode(blocks).alias("pos", alias))
