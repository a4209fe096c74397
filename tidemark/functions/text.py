"""Text normalisation as Column expressions.

Everything runs inside the JVM, Unicode NFKC included.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

# Characters a backslash may escape in Markdown.
ESCAPABLE = "\\`*_{}[]()#+-.!|<>~=\"'"

# The ordered clean-up that turns Markdown into plain words.
# Flags: m = per line, d = only \n ends a line, U = Unicode classes.
MARKDOWN_STRIP = [
    (r"(?mdU)^\s{0,3}(#{1,6})\s+", ""),
    (r"(?mdU)^\s{0,3}>\s?", ""),
    (r"(?mdU)^\s*([-*+]|\d+[.)])\s+", ""),
    (r"(?mdU)^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$", ""),
    (r"`{1,3}", " "),
    (r"[*_~|]", " "),
    (r"!?\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"</?[a-zA-Z][^>]*>", " "),
    (r"(?U)https?://\S+", " "),
]

WORD = r"([\p{L}\p{N}_']+)"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Python's \s, spelled out: Java's \s is ASCII only.
_SPACES = r"\s\x1c-\x1f\x85\p{Z}"
# Runs of white space that are not yet a single plain space.  Leaving single
# spaces alone keeps the number of replacements small.  What comes first turns
# most letters away at once: no white space is among them.
UNEVEN_SPACE = rf"(?![!-~\xc0-\u167f])(?:[{_SPACES}]{{2,}}|[{_SPACES}&&[^ ]])"


def _escape_class() -> str:
    return "".join("\\" + ch for ch in ESCAPABLE)


def nfkc(c: Column) -> Column:
    """Unicode NFKC, through the ICU library that ships with Spark.

    Staying in the JVM keeps the row's partitioning: a Python UDF here would
    cost one more exchange of whole documents.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    ascii_only = F.length(c) == F.octet_length(c)
    return F.when(ascii_only, c).when(c.isNotNull(), composed)


def nfkc_array(c: Column) -> Column:
    """NFKC of every element; control marks keep elements and nulls apart."""
    parts = F.split(nfkc(F.array_join(c, "\u0001", "\u0002")), "\u0001")
    done = F.transform(parts, lambda x: F.nullif(x, F.lit("\u0002")))
    return F.when(F.size(c) > 0, done).otherwise(c)


def squeeze(c: Column) -> Column:
    """Runs of spaces and tabs become one space; U+00A0 and U+200B handled."""
    plain = F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    # The test holds for the very texts in which the pattern finds something.
    runs = F.contains(plain, F.lit("  ")) | F.contains(plain, F.lit("\t"))
    return F.when(runs, F.regexp_replace(plain, r"[ \t]{2,}|\t", " ")).otherwise(plain)


def normalize(c: Column, compat: bool = True) -> Column:
    return squeeze(nfkc(c) if compat else c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, UNEVEN_SPACE, " "))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([" + _escape_class() + "])", "$1")


# The ``*_of`` forms take text that is already normalised, so that one NFKC pass
# per document serves every rule.
def flat_of(norm: Column) -> Column:
    return collapse(norm)


def content_of(norm: Column) -> Column:
    return collapse(unescape(norm))


def link_text(c: Column) -> Column:
    """Inline links and images replaced by the text between the brackets."""
    # Fixed value: what counts as a link.
    return F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")


def prose_of(norm: Column) -> Column:
    # Fixed value: marks that prose drops.
    return collapse(F.regexp_replace(link_text(unescape(norm)), "[`*_~]", ""))


def flat(c: Column, compat: bool = True) -> Column:
    return flat_of(normalize(c, compat))


def content(c: Column, compat: bool = True) -> Column:
    return content_of(normalize(c, compat))


def prose(c: Column, compat: bool = True) -> Column:
    return prose_of(normalize(c, compat))


def strip_markdown(c: Column) -> Column:
    for pattern, replacement in MARKDOWN_STRIP:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def words(c: Column, compat: bool = True) -> Column:
    """Lower-cased word array."""
    return F.regexp_extract_all(F.lower(nfkc(c) if compat else c), F.lit(WORD), F.lit(1))


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def quote_literal(c: Column) -> Column:
    """A regex that matches the string itself."""
    return F.concat(
        F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")
    )


def slugify(c: Column) -> Column:
    return F.lower(F.translate(c, "/ ()", "--"))


def strip_version_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^v(?=\d)", "")


def version_number(c: Column) -> Column:
    """First version-like run, or null."""
    found = F.regexp_extract(c, r"(\d+[\w.+-]*)", 1)
    return F.when(found != "", found)


def byte_length(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def code_point_sum(c: Column) -> Column:
    """Sum of the characters' code points."""
    points = F.transform(
        F.split(c, ""),
        lambda ch: F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("bigint"),
    )
    return F.aggregate(points, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))


# Named references that pages use most; looked up first.
_COMMON = "amp lt gt quot apos nbsp copy reg trade middot bull hellip ndash mdash lsquo rsquo ldquo rdquo laquo raquo times".split()


def _entities() -> dict[str, str]:
    """All named character references of HTML5 that end in a semicolon, common ones first."""
    named = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    return {k: named[k] for k in _COMMON} | named


def _numeric_reference(ref: Column) -> Column:
    hexa = F.regexp_extract(ref, r"^&#[xX]0*([0-9a-fA-F]{1,6});", 1)
    deci = F.regexp_extract(ref, r"^&#0*([0-9]{1,7});", 1)
    code = F.when(hexa != "", hexa).when(deci != "", F.hex(deci.cast("bigint")))
    point = F.conv(code, 16, 10).cast("bigint")
    valid = (point > 0) & (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
    return F.when(valid, char).otherwise(ref)


def decode_entities(c: Column) -> Column:
    """HTML character references to characters, each decoded once."""
    named = _entities()
    table = F.map_from_arrays(F.lit([f"&{name};" for name in named]), F.lit(list(named.values())))
    pieces = F.regexp_extract_all(
        c, F.lit(r"(?s)(&#?[0-9a-zA-Z]+;|[^&]+|&)"), F.lit(1)
    )
    decoded = F.transform(
        pieces,
        lambda p: F.when(p.startswith("&#"), _numeric_reference(p))
        .when(p.startswith("&"), F.coalesce(F.try_element_at(table, p), p))
        .otherwise(p),
    )
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)
