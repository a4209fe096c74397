"""Regions of pages by selectors that come as data: every page may have its own set.

A selector is a chain of compounds (``nav ul > li.x[role=main]``).  All chains of a page's set are one automaton: each open
element carries the chain steps that it matches and those that it or an element around it matches, so an opening tag
needs its parent's entry only, and a closing tag pops entries.  The automaton reads the page's tags in the row and answers
with spans of tokens; texts stay in the JVM, where the spans cut them out.  No exchange, no window.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What may stand before the body.
_HEAD = frozenset("html head title meta link base style script noscript template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag ends open elements of the first set, unless one of the second lies between.
_P = frozenset(["p"]), frozenset("table td th caption button object template".split())
_ENDS = {t: _P for t in _BLOCKS - {"html", "body", "li", "dd", "dt", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}} | {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])) for t in ("thead", "tbody", "tfoot")},
}

_NAME = r"[\w-]+"
_COMPOUND = re.compile(rf"(?:\*|[A-Za-z]{_NAME}|[A-Za-z])?(?:[#.]{_NAME}|\[[^\]]*\])*")
_PART = re.compile(rf"([#.])({_NAME})|\[\s*({_NAME})\s*(?:([~|^$*]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'\]]+))\s*)?\]")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass(frozen=True)
class Compound:
    """What one element must be; ``child``: its parent, not any element around it, matches the step before."""

    tag: str | None
    tests: tuple[tuple[str, str, str], ...]  # (attribute, operator, value)
    child: bool

    def matches(self, attrs: dict[str, str]) -> bool:
        return all(name in attrs and _holds(attrs[name], how, value) for name, how, value in self.tests)


def _holds(have: str, how: str, want: str) -> bool:
    if how == "~=":
        return want in have.split()
    if how == "|=":
        return have == want or have.startswith(want + "-")
    if how in ("^=", "$=", "*="):
        return bool(want) and {"^=": have.startswith, "$=": have.endswith, "*=": have.__contains__}[how](want)
    return how == "" or have == want


@lru_cache(maxsize=4096)
def parse(selector: str) -> tuple[tuple[Compound, ...], ...]:
    """Chains of a selector, one for each alternative; none for a selector beyond this grammar, which selects nothing."""
    chains = []
    for text in re.split(r",(?![^\[]*\])", selector):
        text, at, chain, child = text.strip(), 0, [], False
        while at < len(text):
            m = _COMPOUND.match(text, at)
            if not m.group():
                return ()
            tag = re.match(r"[A-Za-z][\w-]*", m.group())
            tests = []
            for p in _PART.finditer(m.group()):
                if p[1]:
                    tests.append(("id", "=", p[2]) if p[1] == "#" else ("class", "~=", p[2]))
                else:
                    tests.append((p[3].lower(), p[4] or "", next((v for v in p.groups()[4:] if v is not None), "")))
            if len(_PART.sub("", m.group())) > len(tag.group() if tag else "*"):
                return ()  # a bracket that is no attribute test
            chain.append(Compound(tag and tag.group().lower(), tuple(tests), child))
            gap = re.compile(r"\s*(>)?\s*").match(text, m.end())
            at, child = gap.end(), gap[1] is not None
            if at == m.end() < len(text) or (child and at == len(text)):
                return ()
        if not chain:
            return ()
        chains.append(tuple(chain))
    return tuple(chains)


@dataclass
class Entry:
    tag: str
    here: frozenset = frozenset()  # steps that this element matches
    around: frozenset = frozenset()  # steps that it or an element around it matches
    regions: frozenset = frozenset()  # regions that open with it


@dataclass
class Automaton:
    """All selectors of a set of regions."""

    regions: tuple[tuple[str, ...], ...]
    by_tag: dict[str | None, list] = field(default_factory=dict)

    def __post_init__(self):
        number = 0
        for region, selectors in enumerate(self.regions):
            for chain in (c for s in selectors for c in parse(s)):
                for k, step in enumerate(chain):
                    last = region if k == len(chain) - 1 else None
                    self.by_tag.setdefault(step.tag, []).append((number, step, k == 0, last))
                    number += 1

    def entry(self, tag: str, attrs: str, parent: Entry) -> Entry:
        steps = self.by_tag.get(tag, []) + self.by_tag.get(None, [])
        if not steps:
            return Entry(tag, around=parent.around)
        known = None
        here, opened = set(), set()
        for number, step, is_first, region in steps:
            if not (is_first or number - 1 in (parent.here if step.child else parent.around)):
                continue
            if step.tests and known is None:
                known = {}
                for name, *values in _ATTR.findall(attrs):
                    known.setdefault(name.lower(), next((v for v in values if v), ""))
            if step.matches(known or {}):
                here.add(number)
                if region is not None:
                    opened.add(region)
        return Entry(tag, frozenset(here), parent.around | here, frozenset(opened))

    def spans(self, marks: list[str]) -> list[tuple[int, int, int]]:
        """(region, first token, token behind the last) of each element's text up to the next one of its region.

        A mark is a tag name, a newline and its attributes; ``/name`` for a closing tag, with a newline if text follows;
        ``#`` for text before any tag; else empty.
        """
        root = Entry("")
        stack: list[Entry] = [root]
        depth, begun = [0] * len(self.regions), [0] * len(self.regions)
        out: list[tuple[int, int, int]] = []
        explicit = any(m.startswith("body\n") for m in marks)
        body = explicit

        def close(at: int, entry: Entry):
            for r in entry.regions:
                depth[r] -= 1
                if not depth[r]:
                    out.append((r, begun[r], at))

        def cut(at: int, size: int):
            while len(stack) > size:
                close(at, stack.pop())

        def push(at: int, tag: str, attrs: str):
            entry = self.entry(tag, attrs, stack[-1])
            for r in entry.regions:
                if depth[r] and begun[r] < at:
                    out.append((r, begun[r], at))
                depth[r] += 1
                begun[r] = at
            stack.append(entry)

        for at, mark in enumerate(marks):
            if not mark:
                continue
            if mark[0] == "/":
                tag, followed, _ = mark[1:].partition("\n")
                if tag in ("body", "html"):  # what follows still belongs to the body
                    continue
                place = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if place and tag not in _BLOCKS and any(e.tag in _BLOCKS for e in stack[place + 1 :]):
                    close(at, stack.pop(place))  # an inline element ends alone
                elif place:
                    cut(at, place)
                if followed and not body:
                    body = True
                    cut(at, 1 + (len(stack) > 1 and stack[1].tag == "html"))
                    push(at, "body", "")
                continue
            tag, _, attrs = mark.partition("\n")
            if not body and tag not in _HEAD:
                body = True
                cut(at, 1 + (len(stack) > 1 and stack[1].tag == "html"))
                push(at, "body", "")
            if mark == "#":
                continue
            if tag == "body":
                cut(at, 1 + (len(stack) > 1 and stack[1].tag == "html"))
            if tag in _ENDS:
                ended, scope = _ENDS[tag]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        cut(at, k)
                        break
                    if stack[k].tag in scope:
                        break
            if tag not in VOID:
                push(at, tag, attrs)
        cut(len(marks), 1)
        return sorted(out, key=lambda s: (s[1], s[0]))


@lru_cache(maxsize=1024)
def automaton(regions: tuple[tuple[str, ...], ...]) -> Automaton:
    return Automaton(regions)


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("region", "first", "behind")]))


@F.arrow_udf(SPANS)
def region_spans(marks: pa.Array, sets: pa.Array) -> pa.Array:
    rows = []
    for page, regions in zip(marks, sets):
        machine = automaton(tuple(tuple(s for s in r or () if s) for r in regions.as_py() or ()))
        rows.append([{"region": r, "first": a, "behind": b} for r, a, b in machine.spans(page.as_py() or [])])
    return pa.array(rows, pa.list_(pa.struct([("region", pa.int32()), ("first", pa.int32()), ("behind", pa.int32())])))


def region_texts(tokens: DataFrame, names: list[str], sets: str, *carry: str) -> DataFrame:
    """``text_<name>`` of every region over rows with ``marks``, ``texts`` and an array of selector arrays."""
    cut = tokens.select(*carry, "texts", region_spans("marks", sets).alias("spans"))

    def text(region: int) -> Column:
        own = F.filter("spans", lambda s: s["region"] == region)
        piece = lambda s: F.concat(F.lit(" "), F.array_join(F.slice("texts", s["first"] + 1, s["behind"] - s["first"]), ""))
        return F.array_join(F.transform(own, piece), "")

    return cut.select(*carry, *[text(i).alias(f"text_{n}") for i, n in enumerate(names)])


def with_sets(pages: DataFrame, selectors: DataFrame, key: str) -> DataFrame:
    """Pages joined to the selectors of their key (``slug, article, boilerplate``); ``body`` and nothing by default.

    A key that is listed more than once counts once, with its greatest row; null keys take the default.
    """
    once = selectors.groupBy(F.col("slug").alias(key)).agg(F.max(F.struct("article", "boilerplate")).alias("_set"))
    article = F.array(F.coalesce("_set.article", F.lit("body")))
    boiler = F.coalesce("_set.boilerplate", F.array().cast("array<string>"))
    return pages.join(once, key, "left").withColumn("sets", F.array(article, boiler)).drop("_set")
