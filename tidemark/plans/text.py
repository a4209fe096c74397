"""Text functions on documents."""

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import quality
from tidemark.plans.registry import query

# The characters and, in ``prose_sql`` and ``strip_sql``, the patterns of ``functions.text``, as SQL.
_ESC = r"\\([\\`*_{}\[\]()#+\-.!|<>~=\"''])"
SPACES_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def norm_sql(c):
    return (f"regexp_replace(replace(replace({c}, chr(160), ' '), chr(8203), ''), '[ \\t]+', ' ', 'g')")


def collapse_sql(c):
    return f"regexp_replace(regexp_replace({c}, '{SPACES_SQL}', ' ', 'g'), '^ | $', '', 'g')"


def unescape_sql(c):
    return f"regexp_replace({c}, '{_ESC}', '\\1', 'g')"


def content_sql(c):
    return collapse_sql(unescape_sql(norm_sql(c)))


def flat_sql(c):
    return collapse_sql(norm_sql(c))


def prose_sql(c):
    linked = f"regexp_replace({unescape_sql(norm_sql(c))}, '!?\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    return collapse_sql(f"regexp_replace({linked}, '[`*_~]', '', 'g')")


def strip_sql(c):
    steps = [
        (r"(?m)^\s{0,3}(#{1,6})\s+", ""),
        (r"(?m)^\s{0,3}>\s?", ""),
        (r"(?m)^\s*([-*+]|\d+[.)])\s+", ""),
        (r"(?m)^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$", ""),
        (r"`{1,3}", " "),
        (r"[*_~|]", " "),
        (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"</?[a-zA-Z][^>]*>", " "),
        (r"https?://\S+", " "),
    ]
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


WORDS_SQL = r"[\p{L}\p{N}_'']+"


@query(f"""
SELECT doc_id, md5({flat_sql('text')}) AS flat, md5({content_sql('text')}) AS content,
       md5({prose_sql('text')}) AS prose, md5({strip_sql('text')}) AS stripped
FROM documents
""")
def text_clean(t):
    norm = tx.squeeze(F.col("nfkc"))
    docs = t.dealt("documents", "doc_id", "text").select("doc_id", "text", tx.nfkc(F.col("text")).alias("nfkc"))
    return docs.select(
        "doc_id",
        F.md5(tx.flat_of(norm)).alias("flat"),
        F.md5(tx.content_of(norm)).alias("content"),
        F.md5(tx.prose_of(norm)).alias("prose"),
        F.md5(tx.strip_markdown(F.col("text"))).alias("stripped"),
    )


@query(f"""
SELECT doc_id, word, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS_SQL}')) AS word FROM documents)
GROUP BY doc_id, word
""")
def term_counts(t):
    return quality.term_counts(t.dealt("documents", "doc_id", "text"), "doc_id", "text")


@query("""
SELECT p_partkey, lower(replace(replace(replace(replace(p_name, '/', '-'), ' ', '-'), '(', ''), ')', '')) AS slug
FROM part
""")
def slugs(t):
    return t.part.select("p_partkey", tx.slugify(F.col("p_name")).alias("slug"))


@query("""
SELECT doc_id, octet_length(encode(text)) AS bytes, octet_length(encode(text)) // 1024 AS kb, length(text) AS chars
FROM documents
""")
def text_sizes(t):
    size = tx.byte_length(F.col("text"))
    return t.documents.select(
        "doc_id", size.alias("bytes"), F.floor(size / 1024).alias("kb"),
        F.length("text").cast("bigint").alias("chars"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       'v' || l_linenumber || '.' || l_suppkey AS raw,
       l_linenumber || '.' || l_suppkey AS bare, l_linenumber || '.' || l_suppkey AS version
FROM lineitem
""")
def version_parts(t):
    raw = F.concat(F.lit("v"), F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))
    return rows.withColumns(
        {"bare": tx.strip_version_prefix(F.col("raw")), "version": tx.version_number(F.col("raw"))}
    )
