"""Usage rating: one usage row in, one charge per provider out.

A rate card is data.  Every charge line says which quantity it prices, what is
free, whether it is rounded up, the minimum, a scale and a unit price.  The
cards are fixed-size literals, so charges are an in-row ``explode`` of an array
of structs: no join and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.labels import over, round_up_units, usd_text

GB_PER_TB = 1_000


@dataclass(frozen=True)
class Line:
    """One charge line of a rate card."""

    dim: str
    price: float
    free: float = 0.0
    free_per_stored: float = 0.0
    unit: float = 1.0
    minimum: float = 0.0
    scale: float = 1.0
    round_up: bool = False


@dataclass(frozen=True)
class Card:
    provider: str
    lines: tuple[Line, ...]
    base: float = 0.0
    tiered: bool = False


# Fixed values: (size in GB, USD per GB); the last tier has no upper bound.
EGRESS_TIERS = [
    (10_240, 0.09),
    (40_960, 0.085),
    (102_400, 0.07),
    (None, 0.05),
]
FREE_EGRESS_GB = 100

# The eight public rate cards.
RATE_CARDS = [
    Card("Cloudflare R2", (
        Line("stored_gb", 0.015, free=10, round_up=True),
        Line("million_writes", 4.50, free=1, round_up=True),
        Line("million_reads", 0.36, free=10, round_up=True),
    )),
    Card("Backblaze B2", (
        Line("stored_gb", 6.95, free=10, unit=GB_PER_TB),
        Line("egress_gb", 0.01, free_per_stored=3),
    )),
    Card("Hetzner", (
        Line("egress_gb", 1.20, free=1_000, unit=GB_PER_TB),
    ), base=7.99),
    Card("Wasabi", (
        Line("stored_gb", 7.99, unit=GB_PER_TB, minimum=1),
    )),
    Card("Tigris", (
        Line("stored_gb", 0.02, free=5),
        Line("million_writes", 5.00, free=0.01),
        Line("million_reads", 0.50, free=0.1),
    )),
    Card("Upstash Blob", (
        Line("stored_gb", 0.02),
        Line("egress_gb", 0.02),
        Line("million_writes", 4.50),
        Line("million_reads", 0.30),
    )),
    Card("Vercel Blob", (
        Line("stored_gb", 0.023),
        Line("egress_gb", 0.05),
        Line("egress_gb", 0.06, scale=0.30),
        Line("million_writes", 5.00),
        Line("million_reads", 0.40, scale=0.30),
    )),
    Card("AWS S3", (
        Line("stored_gb", 0.023),
        Line("million_writes", 5.00),
        Line("million_reads", 0.40),
    ), tiered=True),
]
PROVIDERS = [card.provider for card in RATE_CARDS]


def line_charge(line: Line) -> Column:
    amount = F.col(line.dim).cast("double")
    if line.free_per_stored:
        amount = over(amount, F.col("stored_gb") * F.lit(line.free_per_stored))
    elif line.free:
        amount = over(amount, float(line.free))
    if line.unit != 1.0:
        amount = amount / F.lit(float(line.unit))
    if line.round_up:
        amount = round_up_units(amount)
    if line.minimum:
        amount = F.greatest(F.lit(float(line.minimum)), amount)
    if line.scale != 1.0:
        amount = amount * F.lit(line.scale)
    return amount * F.lit(line.price)


def tier_rows(tiers=EGRESS_TIERS) -> list[tuple[int, float | None, float | None, float]]:
    """Tier sizes to ``(tier, lo, hi, unit_price)`` bounds; no upper bound is None."""
    rows, lo = [], 0.0
    for number, (size, price) in enumerate(tiers, 1):
        hi = None if size is None else lo + size
        rows.append((number, lo, hi, price))
        lo = hi
    return rows


def tier_quantity(quantity: Column, lo: float, hi: float | None) -> Column:
    top = quantity if hi is None else F.least(quantity, F.lit(hi))
    return F.greatest(F.lit(0.0), top - F.lit(lo))


def tiered_total(quantity: Column, tiers=EGRESS_TIERS) -> Column:
    total = F.lit(0.0)
    for _, lo, hi, price in tier_rows(tiers):
        total = total + tier_quantity(quantity, lo, hi) * F.lit(price)
    return total


def tiered_charge(usage: DataFrame, quantity: Column, tiers=EGRESS_TIERS) -> DataFrame:
    """Quantity split over the price tiers: one row per tier that is reached."""
    cells = [
        F.struct(
            F.lit(number).alias("tier"),
            tier_quantity(quantity, lo, hi).alias("tier_gb"),
            (tier_quantity(quantity, lo, hi) * F.lit(price)).alias("tier_usd"),
        )
        for number, lo, hi, price in tier_rows(tiers)
    ]
    return usage.select("*", F.inline(F.array(*cells))).filter("tier_gb > 0")


def card_total(card: Card) -> Column:
    total = F.lit(float(card.base))
    for line in card.lines:
        total = total + line_charge(line)
    if card.tiered:
        total = total + tiered_total(over(F.col("egress_gb").cast("double"), float(FREE_EGRESS_GB)))
    return total


def rate_usage(usage: DataFrame, cards: list[Card] = RATE_CARDS) -> DataFrame:
    """Every usage row priced with every card, plus the policy flag."""
    charges = F.array(
        *[F.struct(F.lit(c.provider).alias("provider"), card_total(c).alias("usd")) for c in cards]
    )
    flagged = (F.col("provider") == "Wasabi") & (F.col("egress_gb") > F.col("stored_gb"))
    return usage.select("*", F.inline(charges)).withColumn(
        "policy", F.when(flagged, F.lit("over egress rule"))
    )


def cost_matrix(rated: DataFrame, workload: str, workloads: list[str], text: bool = False) -> DataFrame:
    """Provider x workload grid, as numbers or as price text."""
    value = usd_text(F.first("usd"), F.first("policy")) if text else F.first("usd")
    return rated.groupBy("provider").pivot(workload, workloads).agg(value)


def cheapest_provider(rated: DataFrame, key: str) -> DataFrame:
    best = F.struct(F.col("usd"), F.col("provider"))
    return rated.groupBy(key).agg(F.min(best).alias("b")).select(
        key, F.col("b.provider").alias("provider"), F.col("b.usd").alias("usd")
    )
