"""Usage rating on a usage view per customer."""

from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.operators import rating as op
from tidemark.plans.registry import query

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

USAGE_SQL = """
usage AS (SELECT o_custkey AS customer, CAST(sum(q) AS DOUBLE) AS stored_gb, CAST(sum(cents) AS DOUBLE) / 2000 AS egress_gb,
                 CAST(count(*) AS DOUBLE) / 10 AS million_writes, CAST(sum(coalesce(lines, 0)) AS DOUBLE) / 4 AS million_reads
          FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q,
                                   CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines
                            FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
          GROUP BY o_custkey)
"""


_TIERS = (
    "least(b, 10240) * 0.09 + least(greatest(b - 10240, 0), 40960) * 0.085"
    " + least(greatest(b - 51200, 0), 102400) * 0.07 + greatest(b - 153600, 0) * 0.05"
).replace("b", "greatest(0, egress_gb - 100)")
FORMULAS = {
    "Cloudflare R2": "ceil(greatest(0, stored_gb - 10)) * 0.015 + ceil(greatest(0, million_writes - 1)) * 4.5"
                     " + ceil(greatest(0, million_reads - 10)) * 0.36",
    "Backblaze B2": "greatest(0, stored_gb - 10) / 1000 * 6.95 + greatest(0, egress_gb - 3 * stored_gb) * 0.01",
    "Hetzner": "7.99 + greatest(0, egress_gb - 1000) / 1000 * 1.2",
    "Wasabi": "greatest(1, stored_gb / 1000) * 7.99",
    "Tigris": "greatest(0, stored_gb - 5) * 0.02 + greatest(0, million_writes - 0.01) * 5"
              " + greatest(0, million_reads - 0.1) * 0.5",
    "Upstash Blob": "stored_gb * 0.02 + egress_gb * 0.02 + million_writes * 4.5 + million_reads * 0.3",
    "Vercel Blob": "stored_gb * 0.023 + egress_gb * 0.05 + egress_gb * 0.3 * 0.06 + million_writes * 5"
                   " + million_reads * 0.3 * 0.4",
    "AWS S3": f"stored_gb * 0.023 + ({_TIERS}) + million_writes * 5 + million_reads * 0.4",
}
RATED_SQL = USAGE_SQL + ", rated AS (" + " UNION ALL ".join(
    f"SELECT *, '{name}' AS provider, CAST({text} AS DOUBLE) AS usd FROM usage" for name, text in FORMULAS.items()
) + ")"


def usage(t):
    """Per customer: stored, egress, writes, reads.

    Lines are summed per order before the join, orders per customer after it.
    Cents keep the sums exact.
    """
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.round("l_quantity").cast("bigint")).alias("q"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"),
        F.count("*").alias("lines"),
    )
    joined = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer")).join(per_order, "o_orderkey")
    return joined.groupBy("customer").agg(
        F.sum("q").cast("double").alias("stored_gb"),
        (F.sum("cents").cast("double") / 2000).alias("egress_gb"),
        (F.count("*").cast("double") / 10).alias("million_writes"),
        (F.sum("lines").cast("double") / 4).alias("million_reads"),
    )


@query(f"""
WITH {RATED_SQL}
SELECT customer, provider, round(usd, 8) AS usd,
       CASE WHEN provider = 'Wasabi' AND egress_gb > stored_gb THEN 'over egress rule' END AS policy
FROM rated
""")
def rate_usage(t):
    return op.rate_usage(usage(t)).select("customer", "provider", F.round("usd", 8).alias("usd"), "policy")


@query(f"""
WITH {USAGE_SQL}, b AS (SELECT customer, greatest(0, egress_gb - 100) AS q FROM usage),
tiers(tier, lo, hi, price) AS (VALUES (1, 0, 10240, 0.09), (2, 10240, 51200, 0.085),
                                      (3, 51200, 153600, 0.07), (4, 153600, NULL, 0.05))
SELECT customer, tier, round(least(q, coalesce(hi, q)) - lo, 6) AS tier_gb,
       round(CAST((least(q, coalesce(hi, q)) - lo) * price AS DOUBLE), 6) AS tier_usd
FROM b JOIN tiers ON q > lo
""")
def tiered_charge(t):
    billable = labels.over(F.col("egress_gb"), float(op.FREE_EGRESS_GB))
    return op.tiered_charge(usage(t), billable).select(
        "customer", "tier", F.round("tier_gb", 6).alias("tier_gb"), F.round("tier_usd", 6).alias("tier_usd")
    )


@query(f"""
WITH {RATED_SQL}
SELECT provider, """ + ", ".join(
    f"sum(CAST(round(usd, 8) AS DECIMAL(28, 8))) FILTER (c_mktsegment = '{s}')::DOUBLE AS \"{s}\"" for s in SEGMENTS
) + """
FROM rated JOIN customer ON customer = c_custkey GROUP BY provider
""")
def cost_matrix(t):
    priced = op.rate_usage(usage(t)).join(
        t.customer.select(F.col("c_custkey").alias("customer"), "c_mktsegment"), "customer"
    )
    money = F.round("usd", 8).cast("decimal(28,8)")
    return priced.groupBy("provider").pivot("c_mktsegment", SEGMENTS).agg(F.sum(money).cast("double"))


@query(f"""
WITH {RATED_SQL}
SELECT customer, arg_min(provider, {{'u': round(usd, 8), 'p': provider}}) AS provider, min(round(usd, 8)) AS usd
FROM rated GROUP BY customer
""")
def cheapest_provider(t):
    rated = op.rate_usage(usage(t)).withColumn("usd", F.round("usd", 8))
    return op.cheapest_provider(rated, "customer")
