"""Quality rules: text statistics in Spark expressions, and decision lists learned from labelled statistics.

Statistics are built-in functions over each row: no exchange, no Python.  The learner is sequential covering.  A rule
grows by the threshold condition of the best information gain, counted by Spark per feature and quantile bin on two
thirds of a bounded labelled sample; it is pruned on the other third, and kept if it is precise there.  What it covers
is set aside, and the next rule grows.  Only counts reach the driver: features x bins rows a step.  The list becomes
one ordered CASE expression.

Cases: a null text has no words; texts without words fail the base rules; labels other than 0 and 1 are not learnt
from; without usable labels the list is empty and the base rules decide; repeated rows get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_or_empty, written

# The white space of the word rule and the counted symbols.
WHITE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Labelled rows that the learner sees at most, the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
BINS = 32
MAX_RULES, MAX_CONDITIONS = 8, 3
#: What a rule must reach on the rows it was not grown on.
PRECISION, COVER = 0.97, 8

FEATURES = ("n_words", "word_length", "symbol_share", "repeat_share", "dup_lines", "line_words", "distinct_share", "longest_word")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambda variables are bound, columns may be inlined."""
    return F.transform(F.array(value), body)[0]


def _covered(d: Column) -> Column:
    """Places covered by 3-wide windows at ascending starts d."""
    steps = F.zip_with(d, F.slice(d, 2, F.greatest(F.size(d), F.lit(1))), lambda x, y: F.coalesce(F.least(y - x, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def _repeats(w: Column) -> Column:
    """Words within 3-word windows that occur twice or more, first ones included."""

    def of_sorted(s: Column) -> Column:
        gram = lambda j: s[j]["g"]
        last = F.size(s) - 1
        twin = lambda j: ((j > 0) & (gram(F.greatest(j - 1, F.lit(0))) == gram(j))) | ((j < last) & (gram(F.least(j + 1, last)) == gram(j)))
        starts = F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda j: s[j]["i"])
        return let(F.sort_array(starts), _covered)

    def of_grams(g: Column) -> Column:
        pairs = F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(F.sort_array(pairs), of_sorted))

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, of_grams))


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the statistics of the whole text: the five of the base rules and what the learner may use besides."""
    t = F.col("_t")
    words = F.filter(F.split(t, WHITE, -1), lambda w: w != "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeats(w).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("distinct_words"),
        F.aggregate(w, F.lit(0), lambda m, x: F.greatest(m, F.length(x))).cast("long").alias("longest"),
    ))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    counted = docs.select(*keep, text_or_empty(text).alias("_t")).select(
        *keep,
        of_words.alias("_w"),
        of_lines.alias("_l"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.col("_w.n_words")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    failed = (n < 50) | (100 * F.col("_w.n_repeat_words") > 50 * n)
    return counted.select(
        *keep, n.alias("n_words"), "word_chars", "n_symbols", F.col("_l.dup").alias("n_dup_lines"), F.col("_w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
        share(F.col("word_chars"), n).alias("word_length"),
        share(F.col("n_symbols"), n).alias("symbol_share"),
        share(F.col("_w.n_repeat_words"), n).alias("repeat_share"),
        share(F.col("_l.dup"), F.col("_l.n")).alias("dup_lines"),
        share(n, F.col("_l.n")).alias("line_words"),
        share(F.col("_w.distinct_words"), n).alias("distinct_share"),
        F.col("_w.longest").cast("double").alias("longest_word"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


def _holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gain of narrowing (p0, n0) to (p, n)."""
    if p <= 0:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _best(rows: DataFrame, grid: dict[str, list[float]]) -> tuple[Condition, float, float] | None:
    """The condition of the highest gain over the rows, from counts per feature and bin."""
    if not any(grid.values()):
        return None

    def bin_of(f: str) -> Column:
        value = F.col(f).cast("double")
        return F.size(F.filter(F.array(*map(F.lit, grid[f])), lambda t: t <= value))

    bins = F.array(*(F.struct(F.lit(f).alias("f"), bin_of(f).alias("b")) for f in FEATURES if grid[f]))
    counts = rows.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    table: dict[str, dict[int, tuple[int, int]]] = {}
    for f, b, p, n in counts.collect():  # features x (bins + 1) rows at most
        table.setdefault(f, {})[b] = p, n
    best, most = None, 0.0
    for f in FEATURES:
        if f not in table:
            continue
        p0, n0 = (sum(x[k] for x in table[f].values()) for k in (0, 1))
        if not p0 or not n0:
            return None
        below_p = below_n = 0
        for b, t in enumerate(grid[f]):
            p, n = table[f].get(b, (0, 0))
            below_p, below_n = below_p + p, below_n + n
            for at_least, (p, n) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                if p >= COVER and (g := _gain(p, n, p0, n0)) > most:
                    best, most = (Condition(f, at_least, t), p, n), g
    return best


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[list[Condition]]:
    """An ordered list of rules; a text that one of them covers is of low quality."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = usable.withColumn("_order", F.xxhash64("doc_id", F.lit(5))).orderBy("_order", "doc_id", "quality").limit(sample_rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # sample_rows pairs at most
    rows = statistics(found, ["_order", "quality"])
    rows = written(rows.select("base_failed", (1 - F.col("quality")).alias("bad"), (F.pmod(F.col("_order"), F.lit(3)) == 0).alias("prune"), *FEATURES), "labelled")
    rows = rows.where(~F.col("base_failed"))  # of the written numbers: above the statistics it would be computed with them

    points = [(k + 0.5) / BINS for k in range(BINS)]
    quantiles = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in FEATURES)).first()
    grid = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}

    rules: list[list[Condition]] = []
    left = rows
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            step = _best(left.where(~F.col("prune") & _holds(rule)), grid)
            if step is None:
                break
            rule.append(step[0])
            if step[2] == 0:
                break
        if not rule:
            break
        # Prune: the shortest beginning of the rule that is most precise on rows it was not grown on.
        counts = left.where("prune").agg(*(F.struct(F.count_if(_holds(rule[:k]) & (F.col("bad") == 1)).alias("p"), F.count_if(_holds(rule[:k]) & (F.col("bad") == 0)).alias("n")).alias(f"k{k}") for k in range(1, len(rule) + 1))).first()
        worth = [((c.p - c.n) / (c.p + c.n + 1e-9), -k) for k, c in enumerate(counts, 1)]
        keep = -max(worth)[1]
        p, n = counts[keep - 1].p, counts[keep - 1].n
        if p < COVER or p < PRECISION * (p + n):
            break
        rules.append(rule[:keep])
        left = left.where(~_holds(rule[:keep]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as an ordered conditional: base rules, learned rules, then kept."""
    out = F.when(F.col("base_failed"), F.lit(False))
    for rule in rules:
        out = out.when(_holds(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the base statistics, base_failed and kept of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return statistics(rows, ["doc_id"]).withColumn("kept", verdict(rules)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, rules: list[list[Condition]], text: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns as they are.

    Kept rows come out of a generator: a filter would move below the statistics and compute them once for each use.
    """
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{text}`").alias("_of"))
    judged = statistics(held, ["_row"], "_of").select("_row", verdict(rules).alias("_kept"))
    return judged.select(F.inline(F.when(F.col("_kept"), F.array("_row"))))
