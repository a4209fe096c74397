"""Statistics over timing samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.writers import materialise


def drop_warm_up(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Removes the first sample of every group.

    The first samples are one row a group, written, so that the planner knows
    their size: few groups are broadcast and no sample is exchanged.
    """
    first = samples.groupBy(F.struct(*keys).alias("_g")).agg(F.min(F.struct(*order)).alias("_first"))
    joined = samples.withColumn("_g", F.struct(*keys)).join(materialise(first, "first"), "_g")
    return joined.filter(F.struct(*order) > F.col("_first")).select(*samples.columns)


#: Parts of a doubling that the first histogram tells apart, and buckets of a later one.
DOUBLING = 256
BUCKETS = 1 << 16


def _magnitude(v: Column) -> Column:
    """A bucket that never falls as the value grows: sign, power of two and its part; one for NaN, above all."""
    x = v.cast("double")
    size = F.floor(F.log2(F.abs(x)) * DOUBLING) + 1200 * DOUBLING
    return (
        F.when(F.isnan(x), F.lit(1 << 62)).when(x == 0, F.lit(0)).when(F.abs(x) == float("inf"), F.signum(x).cast("bigint") * (1 << 61))
        .otherwise(F.signum(x).cast("bigint") * size)
    )


def _with_ranks(buckets: DataFrame) -> DataFrame:
    """Buckets that hold a wanted rank: ``_g, _rank, _before, _c, _lo, _hi`` and the group's facts.

    ``_before`` of the input is what lies below all its buckets.
    """
    along = Window.partitionBy("_g", "_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_c").over(along), F.lit(0))
    placed = buckets.withColumn("_before", below)
    return placed.filter((F.col("_before") < F.col("_rank")) & (F.col("_before") + F.col("_c") >= F.col("_rank"))).drop("_b")


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact lower, upper and interpolated median, count, min and max.

    Selection by histograms: buckets of magnitude are counted with partial
    aggregation, the bucket of each middle rank is cut into even buckets, and so
    on; once the buckets left hold at most ``BUCKETS`` rows each, their values
    are counted themselves.  One scan a level: doubles of one magnitude are
    evenly spaced, so a handful at most.  What a level learns is a row or two a
    group; samples are never exchanged as long as the groups fit a broadcast.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.col(value).alias("_v"))
    of_bucket = [F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    first = rows.groupBy("_g", _magnitude(F.col("_v")).alias("_b")).agg(*of_bucket)
    whole = Window.partitionBy("_g")
    facts = {"n": F.sum("_c").over(whole), "min_value": F.min("_lo").over(whole), "max_value": F.max("_hi").over(whole)}
    n = F.col("n")
    first = first.withColumns(facts).withColumn("_before", F.lit(0).cast("bigint"))
    first = first.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1))))
    picked = materialise(_with_ranks(first), "picked")
    carried = ["_g", "_rank", "_before", "n", "min_value", "max_value"]
    inside = (F.col("_v") >= F.col("_from")) & (F.col("_v") <= F.col("_to"))

    def cut(bucket: Column) -> DataFrame:
        open_ = picked.filter("_lo < _hi").select(*carried, F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        return rows.join(open_, "_g").filter(inside).groupBy(*carried, bucket.alias("_b")).agg(*of_bucket)

    while picked.filter(f"_lo < _hi AND _c > {BUCKETS}").limit(1).count():
        part = (F.col("_v") - F.col("_from")).cast("double") / (F.col("_to") - F.col("_from")).cast("double")
        finer = _with_ranks(cut(F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1))))
        picked = materialise(finer.unionByName(picked.filter("_lo >= _hi")), "picked")
    found = _with_ranks(cut(F.col("_v"))).unionByName(picked.filter("_lo >= _hi"))
    out = found.groupBy("_g", "n", "min_value", "max_value").agg(F.min("_lo").alias("lower_median"), F.max("_lo").alias("upper_median"))
    names = ["n", "min_value", "max_value", "lower_median", "upper_median"]
    out = out.select(*[F.col(f"_g.{k}").alias(k) for k in keys], *names)
    return out.withColumn("median", (F.col("lower_median") + F.col("upper_median")) / 2)


def sample_stats(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Warm-up dropped, then median and best of the rest."""
    return medians(drop_warm_up(samples, keys, order), keys, value)


def speedup(results: DataFrame, op: str, engine: str, ms: str, baseline: str) -> DataFrame:
    """Baseline time over engine time within every operation."""
    base = F.max(F.when(F.col(engine) == baseline, F.col(ms))).over(Window.partitionBy(op))
    return results.filter(F.col(op).isNotNull()).withColumn("base_ms", base).withColumn("speedup", F.col("base_ms") / F.col(ms))


def saturation_check(runs: DataFrame, keys: list[str], pair: Column, single: Column) -> DataFrame:
    """Flags two clients that together exceed one client by over 15 percent."""
    return (
        runs.groupBy(*keys)
        .agg(F.sum(pair).alias("combined"), F.sum(single).alias("single"))
        .withColumn("saturated", F.col("combined") > F.floor(F.col("single") * 115 / 100))
    )


def pass_mean(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Integer mean, rounded down."""
    return df.groupBy(*keys).agg(F.floor(F.avg(value)).alias("mean"))


def outcome_share(df: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """Failures per group and a warning flag where success is not complete."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("errors"),
        F.round(F.count_if(failed) / F.count("*"), 6).alias("error_share"),
        (F.count_if(failed) > 0).alias("warn"),
    )


def kind_grid(df: DataFrame, row: str, kind: str, kinds: list[str]) -> DataFrame:
    """Counts per (row, kind), zero where nothing was seen."""
    return df.groupBy(row).pivot(kind, kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


def format_sizes(files: DataFrame) -> DataFrame:
    """Bytes per format and the ratio to the smallest format.

    ``files`` has ``format, bytes`` with one row per file.
    """
    sizes = files.groupBy("format").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    least = sizes.agg(F.min("bytes").alias("least"))
    return sizes.select(
        "format", "files", "bytes", F.round(F.col("bytes") / least.select("least").scalar(), 2).alias("ratio")
    )
