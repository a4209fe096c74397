import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import labels, text as tx
from tidemark.operators import rating, samples, tabular

USAGE = "workload string, stored_gb double, egress_gb double, million_writes double, million_reads double"
WORKLOADS = [("Early-stage", 20.0, 50.0, 0.1, 1.0), ("Document", 200.0, 300.0, 1.0, 10.0), ("Media", 1000.0, 10000.0, 2.0, 50.0)]
# The published monthly cost table.
COSTS = {
    "Cloudflare R2": ("$0.15", "$2.85", "$33.75"),
    "Backblaze B2": ("$0.07", "$1.32", "$76.88"),
    "Hetzner": ("$7.99", "$7.99", "$18.79"),
    "Wasabi": ("$7.99, over egress rule", "$7.99, over egress rule", "$7.99, over egress rule"),
    "Tigris": ("$1.20", "$13.80", "$54.80"),
    "Upstash Blob": ("$2.15", "$17.50", "$244.00"),
    "Vercel Blob": ("$4.48", "$31.20", "$719.00"),
    "AWS S3": ("$1.36", "$31.60", "$944.00"),
}


def test_published_costs(spark):
    rated = rating.rate_usage(spark.createDataFrame(WORKLOADS, USAGE))
    grid = rating.cost_matrix(rated, "workload", [w[0] for w in WORKLOADS], text=True)
    assert {r.provider: tuple(r)[1:] for r in grid.collect()} == COSTS


def test_tiers(spark):
    usage = spark.createDataFrame([("a", 60_000.0), ("b", 0.0), ("c", 200_000.0)], "k string, q double")
    rows = rating.tiered_charge(usage, F.col("q")).orderBy("k", "tier").collect()
    a = [(r.tier_gb, round(r.tier_usd, 2)) for r in rows if r.k == "a"]
    assert a == [(10240.0, 921.6), (40960.0, 3481.6), (8800.0, 616.0)]
    assert sum(r.tier_gb for r in rows if r.k == "c") == 200_000.0
    assert not [r for r in rows if r.k == "b"]


def test_medians_of_the_fixture(spark):
    df = spark.createDataFrame([(0, 99.0), (1, 1.0), (2, 2.0), (3, 3.0), (4, 10.0)], "run int, ms double").withColumn("k", F.lit("x"))
    r = samples.sample_stats(df, ["k"], ["run"], "ms").first()
    assert (r.median, r.lower_median, r.upper_median, r.min_value, r.n) == (2.5, 2.0, 3.0, 1.0, 4)


@pytest.mark.parametrize("n,spread", [(1, 10), (2, 10), (20_000, 10**9), (20_001, 7), (5_000, 1)])
def test_medians_equal_sorted_lists(spark, n, spread):
    rnd = random.Random(n)
    rows = [("hot" if i % 3 else None, float(rnd.randrange(spread))) for i in range(n)]
    got = {r.k: r for r in samples.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        r = got[key]
        assert r.n == len(values) and r.median == statistics.median(values)
        assert r.lower_median == statistics.median_low(values) and r.upper_median == values[len(values) // 2]


@pytest.mark.parametrize("buckets", [4, 1 << 16])
def test_medians_of_odd_numbers_level_by_level(spark, monkeypatch, buckets):
    """Few buckets force many levels; signs, zeros, infinities, NaN, subnormal and neighbouring doubles keep their order."""
    import math

    monkeypatch.setattr(samples, "BUCKETS", buckets)
    rnd = random.Random(buckets)
    near = [1.0]
    for _ in range(30):
        near.append(math.nextafter(near[-1], 2))
    groups = {
        "near": near * 3, "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randrange(-300, 300) for _ in range(301)],
        "odd": [-math.inf, -1.0, -0.0, 0.0, 5e-324, 1e-310, math.inf, math.nan, math.nan], "signs": [rnd.gauss(0, 1) for _ in range(500)], "one": [7.5] * 50,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("near", None)]
    got = {r.k: r for r in samples.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, vs in groups.items():
        vs = sorted(vs, key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        assert (got[k].n, got[k].lower_median, got[k].upper_median) == (len(vs), vs[(len(vs) - 1) // 2], vs[len(vs) // 2])


def test_medians_take_whole_numbers_and_several_keys(spark):
    rows = [(1, None, 1 << 60), (1, None, (1 << 60) + 1), (1, None, (1 << 60) + 3), (1, "x", 5), (None, "x", 7), (None, "x", 8)]
    got = {(r.a, r.b): (r.n, r.lower_median, r.upper_median) for r in samples.medians(spark.createDataFrame(rows, "a int, b string, v long"), ["a", "b"], "v").collect()}
    assert got == {(1, None): (3, (1 << 60) + 1, (1 << 60) + 1), (1, "x"): (1, 5, 5), (None, "x"): (2, 7, 8)}
    assert samples.medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").collect() == []


def test_speedups_and_winners(spark):
    # Published milliseconds.
    ms = {"filter": (127.2, 22.5, 156.9), "group-by": (893.0, 20.1, 272.2), "join": (6795.5, 20.3, 1316.2)}
    rows = [(op, e, v) for op, vs in ms.items() for e, v in zip(("pandas", "duckdb", "polars"), vs)]
    df = spark.createDataFrame(rows, "op string, engine string, ms double")
    got = {(r.op, r.engine): r.speedup for r in samples.speedup(df, "op", "engine", "ms", "pandas").collect()}
    assert [round(got[(op, "duckdb")], 2) for op in ms] == [5.65, 44.43, 334.75]
    best = tabular.best_per_row(df, "op", "engine", "ms", F.lit(True)).collect()
    assert {r.best for r in best} == {"duckdb"}
    slow = {r.op: r.best for r in tabular.best_per_row(df, "op", "engine", "ms", F.lit(False)).collect()}
    assert slow == {"filter": "polars", "group-by": "pandas", "join": "pandas"}


def test_saturation_and_pass_mean(spark):
    runs = spark.createDataFrame([("bun", 124_523, 122_170), ("x", 141, 122)], "rt string, pair bigint, one bigint")
    got = {r.rt: r.saturated for r in samples.saturation_check(runs, ["rt"], F.col("pair"), F.col("one")).collect()}
    assert got == {"bun": False, "x": True}
    passes = spark.createDataFrame([("node", 48071), ("node", 47398)], "rt string, rps bigint")
    assert samples.pass_mean(passes, ["rt"], F.col("rps")).first()["mean"] == 47734


def test_number_text_follows_python(spark):
    rnd = random.Random(1)
    values = [rnd.random() * 10 ** rnd.randrange(-2, 5) for _ in range(500)] + [0.125, 0.375, 2.5, 0.5, 7.05, 1.005, 999.5, 1000.0, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    v = F.col("v")
    rows = df.select(
        "v", labels.pct_text(v).alias("p"), labels.usd_text(v).alias("u"), labels.ms_text(v).alias("m"), labels.ratio_text(v).alias("r")
    ).collect()
    for r in rows:
        x = r.v
        assert r.p == f"{100 * x:.0f}%"
        assert r.u == f"${x:.2f}"
        assert r.m == (f"{x / 1000:.1f}s" if x >= 1000 else f"{round(x)}ms")
        assert r.r == (f"{x:.0f}×" if x >= 10 else f"{x:.1f}×")
    assert spark.range(1).select(labels.pct_text(F.lit(None).cast("double"))).first()[0] == "-"


def test_small_text_functions(spark):
    row = spark.range(1).select(
        tx.slugify(F.lit("html/To md (Go)")).alias("slug"),
        tx.strip_version_prefix(F.lit("v1.2")).alias("bare"),
        tx.strip_version_prefix(F.lit("vite")).alias("kept"),
        tx.version_number(F.lit("tool version 3.1.4-rc1, built")).alias("v"),
        tx.version_number(F.lit("none")).alias("no"),
        tx.code_point_sum(F.lit("alice")).alias("sum"),
        tx.byte_length(F.lit("é€")).alias("bytes"),
        tx.strip_markdown(F.lit("# H\n> q\n- a\n1. b\n|--|--|\n`c` *d* [e](f) <b>g</b> https://h.i/j k")).alias("s"),
    ).first()
    assert (row.slug, row.bare, row.kept, row.v, row.no) == ("html-to-md-go", "1.2", "vite", "3.1.4-rc1", None)
    assert (row["sum"], row.bytes) == (sum(map(ord, "alice")), 5)
    assert row.s.split() == "H q a b c d e g k".split()


def test_strict_lookup_and_helpers(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(PySparkException, match="no price for 2"):
        tabular.strict_lookup(left, right, ["k"], "price").collect()
    assert [r.k for r in tabular.missing_matches(left, right, ["k"]).collect()] == [2]
    a = spark.createDataFrame([("x", 3), ("y", 1)], "k string, n bigint")
    b = spark.createDataFrame([("x", 2), ("z", 9)], "k string, n bigint")
    assert tabular.multiset_intersect_size(a, b, "k").first()["shared"] == 2


def test_null_keys_form_a_group_and_never_join(spark):
    fact = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "k int, v double")
    assert tabular.group_agg(fact, ["k"], {"m": "v"}).count() == 2
    dim = spark.createDataFrame([(None, "n"), (1, "one")], "d int, name string")
    got = tabular.dim_join_agg(fact, dim, "k", "d", "name", {"m": "v"}).collect()
    assert [(r.name, r.n, r.m) for r in got] == [("one", 1, 5.0)]
