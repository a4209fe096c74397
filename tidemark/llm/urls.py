"""URL rules, and block decisions that reach a page through its aliases: redirects and canonical links.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest fitting rule decides.
A url that no rule fits is judged by its aliases: urls joined by redirects or canonical links are one component, found by
rounds of joins, and a block decision about any url of a component reaches every member without a rule of its own.  An
explicit allow stands: it is neither overruled nor handed on.  What nothing blocks is allowed.

Links come from the pages themselves (``<link rel=canonical>``, ``<meta http-equiv=refresh>``, outside comments, scripts
and styles) and from a table of observed redirects, if there is one.  Targets need not be pages.  Everything is
DataFrame expressions.  Keys with a large share of all rows are found by counting, at most ``1 / HOT_SHARE`` of them, and
their rows are dealt over ``SALTS`` partitions.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule, has no alias and is allowed; a null html
has no links; rows are judged each for itself, so repeated ids and urls keep all their rows; extra columns are not read;
an empty table gives no row.  Fragments are no part of an alias, dot segments stay as written.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import discard, written

#: A key with more than this share of the rows is dealt over so many salts.
HOT_SHARE = 1 / 500
SALTS = 64


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_LINK_TAGS = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(?:link|meta)\b[^>]*>"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def split_url(rows: DataFrame, url: str, *names: str) -> DataFrame:
    """Rows with scheme, host, and path with query of a url column under three names; all empty without ``://``."""
    at = F.locate("://", F.col(url))
    rows = rows.withColumn("_at", F.coalesce(at, F.lit(0))).withColumn("_rest", F.when(F.col("_at") > 0, F.substr(F.col(url), F.col("_at") + 3)).otherwise(F.lit("")))
    scheme, host, tail = names
    return rows.select(
        *(c for c in rows.columns if c not in ("_at", "_rest")),
        F.when(F.col("_at") > 0, ascii_lower(F.substr(F.col(url), F.lit(1), F.col("_at") - 1))).otherwise(F.lit("")).alias(scheme),
        ascii_lower(F.regexp_extract("_rest", r"^[^/?#]*", 0)).alias(host),
        F.regexp_extract("_rest", r"^[^/?#]*([^#]*)", 1).alias(tail),
    )


def path_only(tail: Column) -> Column:
    return F.regexp_extract(tail, r"^[^?]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, null without one: one conditional expression, longest rules first."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def alias_key(scheme: str, host: str, tail: str) -> Column:
    """The url by which aliases meet: scheme and host in lower case, no fragment; null for what is no url."""
    root = F.concat(F.col(scheme), F.lit("://"), F.col(host))
    return F.when(F.col(host) != "", F.concat(root, F.when(F.startswith(F.col(tail), F.lit("/")), F.lit("")).otherwise(F.lit("/")), F.col(tail)))


def keyed(rows: DataFrame, url: str, key: str) -> DataFrame:
    """Rows with the alias key of a url column in its place."""
    rows = split_url(rows, url, "_s", "_h", "_t")
    return rows.select(*(c for c in rows.columns if c not in (url, "_s", "_h", "_t")), alias_key("_s", "_h", "_t").alias(key))


def resolved(link: Column) -> Column:
    """A link as it stands in a page, as a full url: absolute, of the same scheme, from the root, or beside the page.

    The page's own url is in columns scheme, host and tail.
    """
    root = F.concat(F.col("scheme"), F.lit("://"), F.col("host"))
    folder = F.regexp_extract("tail", r"^[^?]*/", 0)
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.col("scheme"), F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path_only(F.col("tail")), link))
        .when((link != "") & ~F.startswith(link, F.lit("#")), F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def _attribute(tag: Column, name: str) -> Column:
    found = lambda group: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", group)
    return F.concat(found(1), found(2), found(3))


def declared_links(pages: DataFrame) -> DataFrame:
    """(a, b): alias keys of pages and of the canonical or refresh target that their html names."""
    tags = F.regexp_extract_all("html", F.lit(_LINK_TAGS), F.lit(0))
    rows = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull()).select("url", F.explode(tags).alias("tag"))
    tag = F.col("tag")
    rows = rows.where(F.rlike(tag, F.lit(r"(?i)^<(link\b[\s\S]*canonical|meta\b[\s\S]*refresh)")))
    rel = F.rlike(F.lower(_attribute(tag, "rel")), F.lit(r"(^|\s)canonical(\s|$)"))
    canonical = F.when(F.rlike(tag, F.lit(r"(?i)^<link")) & rel, _attribute(tag, "href"))
    refresh = F.rlike(tag, F.lit(r"(?i)^<meta")) & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
    moved = F.when(refresh, F.regexp_extract(_attribute(tag, "content"), r"""(?is)^[\s\d.]*[;,\s]\s*url\s*=\s*["']?([^"']*)""", 1))
    named = written(rows.select("url", F.coalesce(canonical, moved).alias("link")), "named")
    named = named.where("link IS NOT NULL").withColumn("link", F.replace(F.trim("link"), F.lit("&amp;"), F.lit("&")))
    based = split_url(named, "url", "scheme", "host", "tail")
    return keyed(based.select(alias_key("scheme", "host", "tail").alias("a"), resolved(F.col("link")).alias("link")), "link", "b")


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has each key once and the number of its rows in ``many`` as ``n``.

    Keys above the share are at most 1 / share, so their list is small by construction; their rows are dealt by ``spread``.
    """
    total = one.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(max(1, int(total * HOT_SHARE)))
    names = one.where(hot).select(key, F.lit(True).alias("_hot"))
    left = many.join(F.broadcast(names), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = one.withColumn("_salt", F.explode(copies)).drop("n")
    return left.join(right, [key, "_salt"], how).drop("_salt", "_hot")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest key reachable.

    Rounds of large and small stars, each written; a hub's links are dealt over salts.
    """
    a, b = F.col("a"), F.col("b")
    tidy = lambda e: e.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, before = written(tidy(edges), "aliases"), None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if state == before or not state[0]:
            return links.select(a.alias("node"), b.alias("component")).unionAll(links.select(b.alias("node"), b.alias("component"))).distinct()
        before = state
        both = links.unionAll(links.select(b.alias("a"), a.alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m")), "lowest")
        large = written(salted_join(both, low, "a", F.xxhash64("b")).where(b > a).select(b.alias("a"), F.col("m").alias("b")).where(a != b), "aliases")
        root = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "lowest")
        small = salted_join(large, root, "a", F.xxhash64("b"))
        small = small.select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")), F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e"))
        after = written(tidy(small.select("e.a", "e.b")), "aliases")
        for done in (links, low, large, root):
            discard(done)
        links = after


def blocked_aliases(edges: DataFrame, rules=RULES) -> DataFrame:
    """(node): urls of components in which some url is blocked by a rule of its own."""
    comps = written(components(edges), "components")
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = split_url(comps, "node", "scheme", "host", "tail").withColumn("path", path_only(F.col("tail")))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(verdict == "block", F.lit(False))).alias("bad"))
    sizes = written(sizes.where("bad").drop("bad"), "blocked")
    return salted_join(comps, sizes, "component", F.xxhash64("node")).select("node")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; ``redirects`` (from_url, to_url) adds observed redirects."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = declared_links(rows)
    if redirects is not None:
        moved = redirects.select(F.col("from_url").cast("string").alias("from_url"), F.col("to_url").cast("string").alias("to_url"))
        edges = edges.unionByName(keyed(keyed(moved, "from_url", "a"), "to_url", "b"))
    edges = written(edges, "links").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    judged = split_url(rows.drop("html"), "url", "scheme", "host", "tail")
    judged = judged.select("page_id", "host", path_only(F.col("tail")).alias("path"), alias_key("scheme", "host", "tail").alias("node"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "node")
    out = ["page_id", "host", "path", "rule"]
    if edges.isEmpty():
        return judged.select(*out, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    bad = written(blocked_aliases(edges, rules), "blocked")
    open_ = judged.where("verdict IS NULL").withColumn("node", F.coalesce("node", F.lit("")))
    known = open_.groupBy("node").agg(F.count("*").alias("n")).join(bad.withColumn("bad", F.lit(True)), "node", "left")
    reached = salted_join(open_, written(known, "known"), "node", F.xxhash64("page_id"))
    reached = reached.select(*out, F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return judged.where("verdict IS NOT NULL").select(*out, "verdict").unionAll(reached)


def _oracle(rules=RULES) -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    order = sorted(rules, key=lambda r: -len(r.name))
    name = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in order) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in order) + " END"
    split = lambda u: f"""CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*'),
      '{string.ascii_uppercase}', '{string.ascii_lowercase}') ELSE '' END AS host,
      CASE WHEN strpos({u}, '://') > 0 THEN regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path"""  # noqa: E731
    tags = "regexp_extract_all(html, '(?is)<link\\b[^>]*\\srel=\"canonical\"[^>]*>')"
    return f"""WITH RECURSIVE cut AS (SELECT page_id, regexp_extract(url, '(?s)^[^#]*') AS node, {split('url')} FROM pages),
    ruled AS (SELECT page_id, host, path, node, {name} AS rule, {verdict} AS decided FROM cut),
    found AS (SELECT regexp_extract(url, '(?s)^[^#]*') AS a, regexp_extract(unnest({tags}), '(?is)\\shref="([^"#]*)', 1) AS b FROM pages WHERE html LIKE '%canonical%'),
    edges AS (SELECT a, b FROM found WHERE strpos(b, '://') > 0 UNION SELECT b, a FROM found WHERE strpos(b, '://') > 0),
    targets AS (SELECT n, {split('n')} FROM (SELECT DISTINCT a AS n FROM edges)),
    reach(n) AS (SELECT n FROM targets WHERE {verdict} = 'block' UNION SELECT edges.b FROM reach JOIN edges ON edges.a = reach.n)
    SELECT page_id, host, path, rule, CASE WHEN decided IS NOT NULL THEN decided WHEN node IN (SELECT n FROM reach) THEN 'block' ELSE 'allow' END AS verdict
    FROM ruled"""


#: The same rows in DuckDB SQL, for absolute canonical links in double quotes.
ORACLE = _oracle()
