"""Document quality: term counts, retention, leakage, score and league tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import text as tx
from tidemark.operators import html, rules as rl, samples
from tidemark.operators.tabular import strict_lookup

# The native conversions; ``ranked`` decides whether a tool enters the league.
TOOLS = [
    ("converter", "converter", True, "whole page"),
    ("extractor", "extractor", True, "main content only"),
    ("plain text", "converter", False, "no markup at all"),
]
_MD_OF = {"converter": "md_converter", "extractor": "md_extractor", "plain text": "md_plain"}

# Regions of a page: its article and its boilerplate.
REGIONS = {"article": ["article"], "boiler": ["nav", "header", "footer", "div.ad"]}


def term_counts(docs: DataFrame, key: str, text: str, compat: bool = True) -> DataFrame:
    """Word -> count per document.

    A document's words are exploded and counted in one task first (partial
    aggregation), so only distinct words are exchanged.
    """
    return (
        docs.select(key, F.explode(tx.words(F.col(text), compat)).alias("word"))
        .groupBy(key, "word").agg(F.count("*").alias("n"))
    )


def boilerplate_vocab(texts: DataFrame, keys: list[str], boiler: str, article: str, compat: bool = True) -> DataFrame:
    """Boilerplate terms that do not occur in the same page's article: counts of both regions side by side, one grouping."""
    marked = lambda c, side: F.transform(tx.words(F.coalesce(F.col(c), F.lit("")), compat), lambda w: F.struct(w.alias("word"), F.lit(side).alias("boiler")))
    terms = texts.select(*keys, F.inline(F.concat(marked(boiler, True), marked(article, False))))
    counted = terms.groupBy(*keys, "word").agg(F.count_if("boiler").alias("n"), F.count_if(~F.col("boiler")).alias("_own"))
    return counted.where("_own = 0").drop("_own")


def recall(reference: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset recall of ``(keys, word, n)`` tables; null for an empty reference."""
    joined = reference.join(
        produced.select(*keys, "word", F.col("n").alias("got")), [*keys, "word"], "left"
    )
    return joined.groupBy(*keys).agg(
        (F.sum(F.least("n", F.coalesce("got", F.lit(0)))) / F.nullif(F.sum("n"), F.lit(0))).alias("recall")
    )


def outputs_of(profile: DataFrame, *carry: str) -> DataFrame:
    """Profile rows to ``page_id, tool, kind, ranked, md`` rows, in the row."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("tool"), F.lit(kind).alias("kind"), F.lit(ranked).alias("ranked"),
                F.col(_MD_OF[name]).alias("md"),
            )
            for name, kind, ranked, _ in TOOLS
        ]
    )
    return profile.select("page_id", *carry, F.inline(cells))


def text_measures(profile: DataFrame, compat: bool = True) -> DataFrame:
    """Retention and leakage per (page, tool).

    Needs ``text_article`` and ``text_boiler`` in the profile.  Terms of the two
    regions and of all outputs are counted side by side under (page, word), so
    the multiset comparisons are sums over aligned counts: no join, and the
    page partitioning of the profile serves every grouping.
    """
    tools = [name for name, *_ in TOOLS]
    sources = [F.struct(F.lit(0).alias("src"), F.col("text_article").alias("t")),
               F.struct(F.lit(1).alias("src"), F.col("text_boiler").alias("t"))]
    sources += [
        F.struct(F.lit(i + 2).alias("src"), tx.strip_markdown(F.col(_MD_OF[name])).alias("t"))
        for i, name in enumerate(tools)
    ]
    texts = profile.select("page_id", F.inline(F.array(*sources)))
    terms = texts.select("page_id", "src", F.explode_outer(tx.words(F.col("t"), compat)).alias("word"))
    counted = terms.groupBy("page_id", "word").agg(
        *[
            F.count_if((F.col("src") == i) & F.col("word").isNotNull()).alias(f"n{i}")
            for i in range(len(tools) + 2)
        ]
    )
    foreign = F.when(F.col("n0") == 0, F.col("n1")).otherwise(0)
    sums = [F.sum("n0").alias("_a"), F.sum(foreign).alias("_b")]
    for i in range(len(tools)):
        sums.append(F.sum(F.least("n0", f"n{i + 2}")).alias(f"_ra{i}"))
        sums.append(F.sum(F.least(foreign, F.col(f"n{i + 2}"))).alias(f"_rb{i}"))
    per_page = counted.groupBy("page_id").agg(*sums)
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("tool"),
                (F.col(f"_ra{i}") / F.nullif(F.col("_a"), F.lit(0))).alias("retention"),
                (F.col(f"_rb{i}") / F.nullif(F.col("_b"), F.lit(0))).alias("leakage"),
            )
            for i, name in enumerate(tools)
        ]
    )
    return per_page.select("page_id", F.inline(cells))


def score_rows(profile: DataFrame, rules: DataFrame, types: list[str] | None = None, features: bool = False) -> DataFrame:
    """Per (page, tool): rule scores, retention, leakage and output bytes; on demand the counts of every feature."""
    outputs = outputs_of(profile)
    judge = rl.scores_by_feature if features else rl.scores
    judged = judge(rl.evaluate(outputs, rules, types), ["page_id", "tool"])
    sizes = outputs.select(
        "page_id", "tool", "kind", "ranked", tx.byte_length(F.col("md")).alias("output_bytes")
    )
    measures = text_measures(profile).select(
        "page_id", "tool", F.round("retention", 4).alias("retention"), F.round("leakage", 4).alias("leakage")
    )
    return (
        sizes.join(measures, ["page_id", "tool"], "left")
        .join(judged, ["page_id", "tool"], "left")
        .withColumns({"passed": F.coalesce("passed", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    )


def tool_summary(scores: DataFrame, timings: DataFrame) -> DataFrame:
    """Per tool: pass rate, mean retention and leakage, time, bytes.

    ``scores`` has one row per (page, tool); every row must find its timing.
    """
    timed = strict_lookup(scores, timings.select("page_id", "tool", "ms"), ["page_id", "tool"], "timing")
    by_tool = timed.groupBy("tool", "kind", "ranked").agg(
        F.sum("passed").alias("passed"),
        F.sum("total").alias("total"),
        F.avg("retention").alias("retention"),
        F.avg("leakage").alias("leakage"),
        F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms"),
        F.sum("output_bytes").alias("bytes"),
    )
    return by_tool.withColumn("pass_share", F.col("passed") / F.nullif(F.col("total"), F.lit(0)))


def summary_details(summary: DataFrame, scores: DataFrame, timings: DataFrame, notes: dict[str, str]) -> DataFrame:
    """The summary with each tool's upper median time, its counts per feature and its note.

    ``scores`` needs ``features`` and is read twice, so it should be a written table.  A tool without a time, feature
    or note has null there.
    """
    timed = scores.select("page_id", "tool").join(timings.select("page_id", "tool", "ms"), ["page_id", "tool"])
    middle = samples.medians(timed, ["tool"], "ms").select("tool", F.col("upper_median").alias("median_ms"))
    counted = scores.select("tool", F.inline("features")).groupBy("tool", "feature").agg(F.sum("ok").alias("ok"), F.sum("total").alias("total"))
    features = counted.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("feature", "ok", "total"))).alias("features"))
    known = F.create_map(*[F.lit(x) for pair in notes.items() for x in pair]) if notes else F.create_map().cast("map<string,string>")
    out = summary.join(middle, "tool", "left").join(features, "tool", "left")
    return out.withColumn("notes", F.try_element_at(known, F.col("tool")))


OVERHEAD = "(overhead)"


def with_overhead(summary: DataFrame, empty: DataFrame) -> DataFrame:
    """A row of its own for the constant overhead, the median of the samples ``empty(ms)`` of runs that do nothing.

    It stands beside the tools and is not taken off their times; without samples its median is null.
    """
    times = samples.medians(empty.select("ms").withColumn("tool", F.lit(OVERHEAD)), ["tool"], "ms")
    row = empty.sparkSession.range(1).select(F.lit(OVERHEAD).alias("tool"))
    row = row.join(times.select("tool", F.col("median").alias("median_ms")), "tool", "left")
    return summary.unionByName(row, allowMissingColumns=True)


def unranked_table(summary: DataFrame) -> DataFrame:
    """Tools that are scored but not ranked, with the reason; rows without a rank flag are neither."""
    return summary.filter("NOT ranked").select("tool", "passed", "total", "pass_share", "retention", "total_ms", "notes")


def league_table(summary: DataFrame) -> DataFrame:
    """Ranked tools by pass rate, then retention, then total time.

    The window has no partition on purpose: its input is one row per tool.
    """
    order = Window.orderBy(
        F.coalesce("pass_share", F.lit(0.0)).desc(),
        F.coalesce("retention", F.lit(0.0)).desc(),
        F.col("total_ms").asc(),
        F.col("tool").asc(),
    )
    return summary.filter("ranked").withColumn("position", F.row_number().over(order))


def speed_order(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.asc_nulls_last("total_ms"), "tool")


def per_page_report(scores: DataFrame, league: DataFrame, timings: DataFrame) -> DataFrame:
    """Per page, the ranked tools in league order."""
    placed = scores.join(league.select("tool", "position"), "tool")
    return placed.join(timings.select("page_id", "tool", "ms"), ["page_id", "tool"], "left").select(
        "page_id", "position", "tool", "pass_rate", "retention", "leakage", "ms"
    ).orderBy("page_id", "position")


MIN_PAGE_BYTES = 10_000


def corpus_problems(
    pages: DataFrame, rules: DataFrame, expected: DataFrame | None = None,
    meta: DataFrame | None = None, tools: DataFrame | None = None,
) -> DataFrame:
    """All findings of the corpus checks as ``subject, problem`` rows.

    ``pages`` has ``page_id`` and either ``html`` or, from a file inventory, ``bytes``.
    ``expected(page_id)`` lists pages that must exist, ``meta(page_id, json)``
    their metadata text, ``tools(tool, version)`` the versions read.
    """
    page = F.col("page_id").cast("string")
    size = F.col("bytes") if "bytes" in pages.columns else tx.byte_length(F.col("html"))
    found = [
        pages.filter(F.coalesce(size, F.lit(0)) < MIN_PAGE_BYTES).select(
            page.alias("subject"),
            F.concat(F.lit("page is only "), F.coalesce(size, F.lit(0)).cast("string"), F.lit(" bytes")).alias("problem"),
        ),
        rl.unknown_rule_types(rules).select(
            F.concat_ws("/", page, "id").alias("subject"),
            F.concat(F.lit("unknown rule type "), F.coalesce("type", F.lit("null"))).alias("problem"),
        ),
        rules.groupBy("page_id", "id").agg(F.count("*").alias("n")).filter("n > 1").select(
            F.coalesce(page, F.lit("all pages")).alias("subject"),
            F.concat(F.lit("duplicate rule id "), F.col("id")).alias("problem"),
        ),
    ]
    if expected is not None:
        found.append(
            expected.join(pages.select("page_id"), "page_id", "left_anti").select(
                page.alias("subject"), F.lit("page missing").alias("problem")
            )
        )
    if meta is not None:
        found.append(
            meta.filter(F.try_parse_json("json").isNull()).select(
                page.alias("subject"), F.lit("metadata unreadable").alias("problem")
            )
        )
    if tools is not None:
        found.append(
            tools.filter(F.col("version").startswith("unknown")).select(
                F.col("tool").alias("subject"), F.lit("version could not be read").alias("problem")
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
