"""Timing-sample statistics on ``events.value`` (milliseconds)."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import samples as op
from tidemark.operators.tabular import best_per_row
from tidemark.plans.registry import query

KINDS = ["click", "error", "purchase", "signup", "view"]

SAMPLES_SQL = """
samples AS (SELECT CAST(user_id % 3 AS BIGINT) AS op, event_type AS engine, epoch_us(ts) AS us, event_id AS id,
                   value AS ms FROM events),
timed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op, engine ORDER BY us, id) AS run FROM samples)
          WHERE run > 1),
stats AS (SELECT op, engine, count(*) AS n, min(ms) AS min_value, max(ms) AS max_value,
                 percentile_disc(0.5) WITHIN GROUP (ORDER BY ms) AS lower_median,
                 percentile_disc(0.5) WITHIN GROUP (ORDER BY ms DESC) AS upper_median,
                 round(median(ms), 6) AS median
          FROM timed GROUP BY op, engine)
"""


def samples(t):
    return t.events.select(
        (F.col("user_id") % 3).alias("op"),
        F.col("event_type").alias("engine"),
        labels.epoch_us(F.col("ts")).alias("us"),
        F.col("event_id").alias("id"),
        F.col("value").alias("ms"),
    )


def stats(t):
    return op.sample_stats(samples(t), ["op", "engine"], ["us", "id"], "ms").withColumn(
        "median", F.round("median", 6)
    )


@query(f"WITH {SAMPLES_SQL} SELECT * FROM stats")
def sample_medians(t):
    return stats(t)


@query("""
SELECT event_type, count(*) AS n, min(value) AS min_value, max(value) AS max_value,
       percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS lower_median,
       percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC) AS upper_median,
       round(median(value), 6) AS median
FROM events GROUP BY event_type
""")
def group_medians(t):
    return op.medians(t.events, ["event_type"], "value").withColumn("median", F.round("median", 6))


@query(f"""
WITH {SAMPLES_SQL}, base AS (SELECT op, median AS base_ms FROM stats WHERE engine = 'view')
SELECT op, engine, median, base_ms, round(base_ms / median, 6) AS speedup FROM stats JOIN base USING (op)
""")
def speedup_vs_baseline(t):
    fast = op.speedup(stats(t), "op", "engine", "median", "view")
    return fast.select("op", "engine", "median", "base_ms", F.round("speedup", 6).alias("speedup"))


@query(f"""
WITH {SAMPLES_SQL}
SELECT op, arg_min(engine, {{'m': median, 'e': engine}}) AS best, min(median) AS best_value FROM stats GROUP BY op
""")
def best_engine(t):
    return best_per_row(stats(t), "op", "engine", "median", F.lit(True))


@query("""
WITH r AS (SELECT user_id, count(*) FILTER (event_type IN ('click', 'error')) AS combined,
                  count(*) FILTER (event_type = 'view') AS single FROM events GROUP BY user_id)
SELECT user_id, combined, single, combined > single * 115 // 100 AS saturated FROM r
""")
def saturation_check(t):
    pair = F.col("event_type").isin("click", "error").cast("bigint")
    single = (F.col("event_type") == "view").cast("bigint")
    return op.saturation_check(t.events, ["user_id"], pair, single)


@query("""
SELECT event_type, CAST(floor(avg(CAST(floor(value) AS BIGINT))) AS BIGINT) AS mean FROM events GROUP BY event_type
""")
def throughput_avg(t):
    return op.pass_mean(t.events, ["event_type"], F.floor("value"))


@query("""
SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
       round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_share,
       count(*) FILTER (event_type = 'error') > 0 AS warn
FROM events GROUP BY user_id
""")
def error_share(t):
    return op.outcome_share(t.events, ["user_id"], F.col("event_type") == "error")


@query("SELECT user_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in KINDS
) + " FROM events GROUP BY user_id")
def event_kind_grid(t):
    return op.kind_grid(t.events, "user_id", "event_type", KINDS)


@query("""
SELECT event_id,
       CASE WHEN value * 100 >= 1000 THEN printf('%.1fs', value * 100 / 1000)
            ELSE printf('%.0fms', value * 100) END AS took,
       '$' || printf('%.2f', value) AS usd
FROM events
""")
def text_labels(t):
    ms = F.col("value") * 100
    return t.events.select(
        "event_id",
        labels.ms_text(ms).alias("took"),
        labels.usd_text(F.col("value")).alias("usd"),
    )
