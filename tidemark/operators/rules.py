"""Rule predicates over documents: ``(text, args) -> boolean``.

Rules are rows (see ``sources.readers.RULE``) with an optional ``page_id``; a
null page means the rule holds for every page.  A document meets its rules by
an equi-join on the page, as one array per page, so a document crosses the
network at most once whatever the number of rules.  Shared forms of the text
are computed once per document, and the rules are judged inside the row: only
the small verdicts are unfolded, never the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text as tx
from tidemark.operators import blocks

# Rule features in report order.
FEATURES = [
    "headings", "tables", "code", "lists", "links", "images", "inline",
    "escaping", "footnotes", "math", "entities", "structure", "boilerplate",
]

# Argument strings that are compared as text; normalised once per rule.
_TEXT_ARGS = ["text", "body", "alt", "first", "second", "parent", "child"]


def _arg(rule: Column, name: str) -> Column:
    return rule["args"][name]


def _wanted(rule: Column, name: str) -> Column:
    """An argument in its ``content`` form, prepared per rule."""
    return rule["want"][name]


def _contains(rule: Column) -> Column:
    return F.contains(F.col("content"), _wanted(rule, "text"))


def _prose(rule: Column) -> Column:
    return F.contains(F.col("prose"), rule["want_prose"])


def _absent(rule: Column) -> Column:
    return ~F.contains(F.col("flat"), rule["want_flat"])


def _regex(rule: Column) -> Column:
    return F.rlike(F.col("norm"), F.concat(F.lit("(?msdU)"), _arg(rule, "pattern")))


def _escape(rule: Column) -> Column:
    return F.rlike(F.col("norm"), F.concat(F.lit("(?dU)"), _arg(rule, "pattern")))


def _heading(rule: Column) -> Column:
    want = F.regexp_replace(_wanted(rule, "text"), "[`*_]", "")
    return (want != "") & F.exists(
        F.col("headings"),
        lambda h: (h["level"] == _arg(rule, "level")) & F.contains(h["text"], want),
    )


def _table(rule: Column) -> Column:
    want = F.coalesce(rule["want_cells"], F.array().cast("array<string>"))

    def fits(table: Column) -> Column:
        return (table["rows"] >= F.coalesce(_arg(rule, "min_rows"), F.lit(1))) & F.forall(
            want, lambda w: F.exists(table["cells"], lambda c: (w == c) | ((w != "") & F.contains(c, w)))
        )

    return F.exists(F.col("tables"), fits)


def _fence(rule: Column) -> Column:
    lang = F.lower(_arg(rule, "lang"))
    return F.exists(
        F.col("fences"),
        lambda b: F.contains(b["body"], _wanted(rule, "body"))
        & (F.coalesce(lang, F.lit("")).eqNullSafe("") | F.lower(b["lang"]).eqNullSafe(lang)),
    )


def _code_block(rule: Column) -> Column:
    body = _wanted(rule, "body")
    return F.exists(F.col("fences"), lambda b: F.contains(b["body"], body)) | F.exists(
        F.col("indented"), lambda b: F.contains(b, body)
    )


def _or_any(given: Column, wanted: Column, anything: str) -> Column:
    given = F.coalesce(given, F.lit("")) != ""
    return F.when(given, tx.quote_literal(wanted)).otherwise(F.lit(anything))


def _link(rule: Column) -> Column:
    href = tx.quote_literal(_arg(rule, "href"))
    inline = F.concat(
        F.lit(r"\["), _or_any(_arg(rule, "text"), _wanted(rule, "text"), r"[^\]]*"), F.lit(r"\]\(\s*<?[^)\s]*"), href
    )
    reference = F.concat(F.lit(r"\]:\s*<?"), href)
    return F.rlike(F.col("content"), inline) | (
        F.coalesce(_arg(rule, "allow_reference"), F.lit(False)) & F.rlike(F.col("raw"), reference)
    )


def _image(rule: Column) -> Column:
    pattern = F.concat(
        F.lit(r"!\["), _or_any(_arg(rule, "alt"), _wanted(rule, "alt"), r"[^\]]*"), F.lit(r"\]\(\s*<?[^)\s]*"),
        _or_any(_arg(rule, "src"), _arg(rule, "src"), ""),
    )
    return F.rlike(F.col("content"), pattern)


def _order(rule: Column) -> Column:
    first = F.position(_wanted(rule, "first"), F.col("content"))
    second = F.position(_wanted(rule, "second"), F.col("content"))
    return (first > 0) & (second > 0) & (first < second)


def _list_nesting(rule: Column) -> Column:
    return blocks.nested(F.col("items"), _wanted(rule, "parent"), _wanted(rule, "child"))


# Forms of a document that rules read, parsed once per document, and the rule types that read them.  Structure is found
# in the raw text: normalisation turns other characters into bars, tildes and back-ticks.  What is compared is normalised.
FORMS = {
    "flat": ("absent",),
    "prose": ("prose",),
    "headings": ("heading",),
    "tables": ("table",),
    "fences": ("fence", "code_block"),
    "indented": ("code_block",),
    "items": ("list_nesting",),
}


def _bodies(c: Column) -> Column:
    return F.transform(tx.nfkc_array(c), lambda b: tx.content(b, compat=False))


def with_forms(docs: DataFrame, types: list[str]) -> DataFrame:
    """Adds ``raw``, ``norm``, ``content`` and the forms that the rule types in use read, to rows with ``md``."""
    docs = docs.withColumn("raw", F.coalesce("md", F.lit("")))
    docs = docs.withColumn("norm", tx.squeeze(tx.nfkc(F.col("raw"))))
    used = [form for form, kinds in FORMS.items() if set(kinds) & set(types)]
    raw, norm = F.col("raw"), F.col("norm")
    found = {"tables": blocks.tables(raw), "fences": blocks.fences(raw)}
    docs = docs.withColumns({f"_{form}": c for form, c in found.items() if form in used})
    # All cells of a document pass through one normalisation; marks keep tables and cells apart.
    marked = F.array_join(F.transform(F.col("_tables"), lambda t: F.array_join(F.flatten(t), "\u0001")), "\u0003")
    cells = F.transform(F.split(tx.nfkc(marked), "\u0003"), lambda t: F.transform(F.split(t, "\u0001"), lambda c: tx.content(c, compat=False)))
    table = F.zip_with(F.transform(F.col("_tables"), F.size), cells, lambda n, c: F.struct(n.alias("rows"), c.alias("cells")))
    fence = F.zip_with(
        F.transform(F.col("_fences"), lambda b: b["lang"]), _bodies(F.transform(F.col("_fences"), lambda b: b["body"])),
        lambda lang, body: F.struct(lang.alias("lang"), body.alias("body")),
    )
    forms = {
        "flat": tx.flat_of(norm), "prose": tx.prose_of(norm), "headings": blocks.headings(norm),
        "tables": F.when(F.size("_tables") > 0, table), "fences": F.when(F.size("_fences") > 0, fence),
        "indented": _bodies(blocks.indented(raw)), "items": blocks.items(norm),
    }
    docs = docs.withColumns({"content": tx.content_of(norm)} | {form: forms[form] for form in used})
    return docs.drop("_tables", "_fences")


RULE_TYPES: dict[str, Callable[[Column], Column]] = {
    "contains": _contains,
    "prose": _prose,
    "absent": _absent,
    "regex": _regex,
    "not_regex": lambda rule: ~_regex(rule),
    "heading": _heading,
    "table": _table,
    "fence": _fence,
    "code_block": _code_block,
    "link": _link,
    "image": _image,
    "escape": _escape,
    "order": _order,
    "list_nesting": _list_nesting,
}


def unknown_rule_types(rules: DataFrame) -> DataFrame:
    known = list(RULE_TYPES)
    return rules.filter(~F.coalesce(F.col("type").isin(known), F.lit(False)))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Adds the normalised forms of the arguments; ``page_id, rule``."""
    texts = F.array(*[F.col(f"args.{a}") for a in _TEXT_ARGS])
    prepared = rules.withColumns(
        {"_t": tx.nfkc_array(texts), "_cells": tx.nfkc_array(F.col("args.cells"))}
    )
    norm = {a: tx.squeeze(F.col("_t")[i]) for i, a in enumerate(_TEXT_ARGS)}
    rule = F.struct(
        "id", "feature", "type",
        F.coalesce("weight", F.lit(1)).alias("weight"),
        F.coalesce("applies_to", F.lit("all")).alias("applies_to"),
        "invert_for",
        "args",
        F.struct(*[tx.content_of(c).alias(a) for a, c in norm.items()]).alias("want"),
        tx.prose_of(norm["text"]).alias("want_prose"),
        tx.flat_of(norm["text"]).alias("want_flat"),
        F.transform("_cells", lambda c: tx.content(c, compat=False)).alias("want_cells"),
    )
    return prepared.select("page_id", rule.alias("rule"))


def evaluate(outputs: DataFrame, rules: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Every rule of a page on every output of the page.

    ``outputs``: ``page_id, tool, kind, md``.  Result: one row per (page, tool,
    rule) with ``ok``, the inversion for the tool's kind already applied.
    ``types`` may name the rule types in use; the plan then holds only those.
    An unknown type fails the job.
    """
    types = types or list(RULE_TYPES)
    # Chosen before they are prepared: no filter passes the normalisation, which Spark takes for non-deterministic.
    general = (
        prepare_rules(rules.filter("page_id IS NULL"))
        .agg(F.collect_list("rule").alias("general"))
    )
    # Rules for all pages: one array, a scalar of the rule file's size.
    own = (
        prepare_rules(rules.filter("page_id IS NOT NULL"))
        .groupBy("page_id").agg(F.collect_list("rule").alias("own"))
    )
    docs = with_forms(outputs, types).join(own, "page_id", "left")
    docs = docs.withColumn(
        "_rules",
        F.concat(
            F.coalesce("own", F.array().cast(own.schema["own"].dataType)),
            general.select("general").scalar(),
        ),
    )
    in_scope = F.filter(
        "_rules", lambda r: (r["applies_to"] == "all") | (r["applies_to"] == F.col("kind"))
    )

    def judged(r: Column) -> Column:
        ok = F.raise_error(F.concat(F.lit("unknown rule type: "), F.coalesce(r["type"], F.lit("null")))).cast("boolean")
        for name in reversed(types):
            ok = F.when(r["type"] == name, RULE_TYPES[name](r)).otherwise(ok)
        inverted = r["invert_for"].eqNullSafe(F.col("kind"))
        return F.struct(
            r["id"].alias("rule_id"), r["feature"].alias("feature"), r["type"].alias("type"),
            r["weight"].alias("weight"), (F.coalesce(ok, F.lit(False)) != inverted).alias("ok"),
        )

    # The null test names every shared form a second time: a column used once
    # would be folded into the lambda and computed again for each rule.
    forms = ["raw", "norm", "content", *(form for form, kinds in FORMS.items() if set(kinds) & set(types))]
    text = {"raw", "norm", "content", "flat", "prose"}
    shared = F.coalesce(*[F.length(c) if c in text else F.size(c) for c in forms])
    verdicts = F.when(shared.isNotNull(), F.transform(in_scope, judged))
    return docs.select("page_id", "tool", "kind", F.inline(verdicts))


def scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """Passed, total and weighted rate; the rate is null when the weights sum to 0."""
    won = F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0))
    return results.groupBy(*keys).agg(
        F.count_if("ok").alias("passed"),
        F.count("*").alias("total"),
        F.round(won / F.nullif(F.sum("weight"), F.lit(0)), 4).alias("pass_rate"),
    )


def scores_by_feature(results: DataFrame, keys: list[str]) -> DataFrame:
    """``scores`` with ``features``: ``feature, ok, total`` of every feature, in order; both from one grouping of the verdicts."""
    won = F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0))
    counted = results.groupBy(*keys, "feature").agg(
        F.count_if("ok").alias("_ok"), F.count("*").alias("_n"), won.alias("_won"), F.sum("weight").alias("_weight")
    )
    cell = F.struct("feature", F.col("_ok").alias("ok"), F.col("_n").alias("total"))
    return counted.groupBy(*keys).agg(
        F.sum("_ok").alias("passed"),
        F.sum("_n").alias("total"),
        F.round(F.sum("_won") / F.nullif(F.sum("_weight"), F.lit(0)), 4).alias("pass_rate"),
        F.array_sort(F.collect_list(cell)).alias("features"),
    )


def feature_counts(results: DataFrame) -> DataFrame:
    """``[ok, total]`` per tool and feature."""
    return results.groupBy("tool", "feature").agg(
        F.count_if("ok").alias("ok"), F.count("*").alias("total")
    )


def universal_failures(results: DataFrame) -> DataFrame:
    """Rules of a page that no tool passes."""
    return (
        results.groupBy("page_id", "rule_id").agg(F.bool_or("ok").alias("_any"))
        .filter("NOT _any").select("page_id", "rule_id")
    )
