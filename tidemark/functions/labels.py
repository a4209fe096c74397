"""Number and time labels, cast helpers and money text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _fixed(c: Column, digits: int) -> Column:
    """Fixed-point text of the exact binary value, ties to even.

    ``scaled`` is the rounded product and ``rest`` its exact error (the factor
    is split so that both partial products are exact), which settles ties that
    exist only in the decimal notation.
    """
    x = c.cast("double")
    scale = float(10**digits)
    scaled = x * F.lit(scale)
    carrier = x * F.lit(134217729.0)
    high = carrier - (carrier - x)
    rest = (high * F.lit(scale) - scaled) + (x - high) * F.lit(scale)
    down = F.floor(scaled).cast("double")
    part = scaled - down
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (F.pmod(down, F.lit(2.0)) == 1))))
    return F.format_string(f"%.{digits}f", F.when(up, down + 1).otherwise(down) / F.lit(scale))


def pct_text(share: Column) -> Column:
    """``97%`` for 0.97 and ``-`` for null."""
    return F.when(share.isNull(), F.lit("-")).otherwise(F.concat(_fixed(share * 100, 0), F.lit("%")))


def ms_text(ms: Column) -> Column:
    """``23ms`` below one second, ``1.3s`` from there on."""
    return F.when(ms >= 1000, F.concat(_fixed(ms / 1000, 1), F.lit("s"))).otherwise(
        F.concat(_fixed(ms, 0), F.lit("ms"))
    )


def ratio_text(ratio: Column) -> Column:
    """``45×``, with one decimal below ten."""
    digits = F.when(ratio >= 10, _fixed(ratio, 0)).otherwise(_fixed(ratio, 1))
    return F.concat(digits, F.lit("\u00d7"))


def usd_text(amount: Column, note: Column | None = None) -> Column:
    text = F.concat(F.lit("$"), _fixed(amount, 2))
    if note is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit(", "), note), F.lit("")))


def over(amount: Column, free) -> Column:
    """The part of ``amount`` above the free allowance."""
    return F.greatest(F.lit(0.0), amount - (free if isinstance(free, Column) else F.lit(free)))


def round_up_units(amount: Column) -> Column:
    return F.ceil(amount).cast("double")


def epoch_us(ts: Column) -> Column:
    """Microseconds since the epoch (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(c: Column, width: int) -> Column:
    """Integer floor division that stays in 64-bit arithmetic."""
    return ((c - F.pmod(c, F.lit(width).cast("bigint"))) / F.lit(width)).cast("bigint")


def time_of_day(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def header_map(block: Column) -> Column:
    """Header lines to a map with lower-cased names; later duplicates win."""
    pairs = F.transform(
        F.filter(F.split(block, r"\r?\n"), lambda h: h.rlike(r"^[A-Za-z0-9-]+:")),
        lambda h: F.struct(
            F.lower(F.substring_index(h, ":", 1)).alias("name"),
            F.trim(F.regexp_extract(h, r"^[^:]+:(.*)$", 1)).alias("value"),
        ),
    )
    # Last one wins without relying on a session-wide map policy.
    kept = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: ~F.exists(
            F.slice(pairs, x["i"] + 2, F.size(pairs)), lambda q: q["name"] == x["p"]["name"]
        ),
    )
    return F.map_from_entries(F.transform(kept, lambda x: x["p"]))
