"""Relational operators: filter, group, dimension join, sort, top-k, pivot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.writers import materialise


def count_where(df: DataFrame, *predicates: Column) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, predicates)).agg(F.count("*").alias("n"))


def group_agg(df: DataFrame, keys: list[str], averages: dict[str, str], digits: int = 4) -> DataFrame:
    """Row count and rounded averages by key; ``averages`` maps alias -> column."""
    aggs = [F.count("*").alias("n")]
    aggs += [F.round(F.avg(c), digits).alias(a) for a, c in averages.items()]
    return df.groupBy(*keys).agg(*aggs)


def selective_group(df: DataFrame, predicate: Column, keys: list[str], averages: dict[str, str]) -> DataFrame:
    """Filter first: the predicate and the few columns reach the file scan."""
    return group_agg(df.filter(predicate), keys, averages)


def group_topk(df: DataFrame, keys: list[str], averages: dict[str, str], k: int) -> DataFrame:
    """The ``k`` largest groups; ties are settled by the keys."""
    order = [F.desc("n")] + [F.asc_nulls_last(c) for c in keys]
    return group_agg(df, keys, averages).orderBy(*order).limit(k)


def dim_join_agg(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, attr: str, averages: dict[str, str]
) -> DataFrame:
    """Inner equi-join to a dimension, then count and averages by an attribute.

    The fact side is aggregated by the join key before it meets the dimension,
    so a hot key costs one row per task and the join input no longer grows with
    the fact table.  The join strategy is left to AQE, which sees the real
    sizes and broadcasts the dimension only when it is small.
    """
    key = F.col(fact_key).cast("bigint").alias("_key")
    parts = [F.count("*").alias("_n")]
    for alias, column in averages.items():
        parts += [F.sum(column).alias(f"_s_{alias}"), F.count(column).alias(f"_c_{alias}")]
    partial = fact.groupBy(key).agg(*parts)
    joined = partial.join(
        dim.select(F.col(dim_key).cast("bigint").alias("_key"), F.col(attr)), "_key"
    )
    final = [F.sum("_n").alias("n")]
    final += [
        F.round(F.sum(f"_s_{a}") / F.sum(f"_c_{a}"), 4).alias(a) for a in averages
    ]
    return joined.groupBy(attr).agg(*final)


def full_sort(df: DataFrame, *order: Column) -> DataFrame:
    """Every row and column in order: a range shuffle with spilling sorts."""
    return df.orderBy(*order)


def ordered_positions(df: DataFrame, *order: Column) -> DataFrame:
    """Every row and column with its ``position`` in the order, from 1.

    The range shuffle of the sort deals out consecutive ranges; a row's place in
    its range plus the rows of the ranges before is its position.  The sorted
    ranges are written, because a second run of the sort may draw other bounds.
    """
    shift = 33  # bits that ``monotonically_increasing_id`` keeps for the place within a partition
    placed = materialise(full_sort(df, *order).withColumn("_place", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_place", shift)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    joined = placed.withColumn("_part", part).join(starts, "_part")
    return joined.select(*df.columns, (F.col("_before") + F.col("_place").bitwiseAND((1 << shift) - 1) + 1).alias("position"))


def pivot_grid(df: DataFrame, row: str, col: str, value: Column, columns: list[str], empty: str | None = None) -> DataFrame:
    """Grid with the named columns; optionally text with ``empty`` in the gaps."""
    grid = df.groupBy(row).pivot(col, columns).agg(value)
    if empty is None:
        return grid
    return grid.select(row, *[F.coalesce(F.col(c).cast("string"), F.lit(empty)).alias(c) for c in columns])


def best_per_row(df: DataFrame, row: str, name: str, value: str, lower_wins: Column) -> DataFrame:
    """Winner of every row, smallest or largest by direction; ties by name."""
    signed = F.when(lower_wins, F.col(value)).otherwise(-F.col(value))
    return df.groupBy(row).agg(
        F.min_by(name, F.struct(signed, F.col(name))).alias("best"),
        F.min_by(value, F.struct(signed, F.col(name))).alias("best_value"),
    )


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def strict_lookup(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Left join in which a missing match is an error, not a null."""
    probe = right.withColumn("_found", F.lit(True))
    joined = left.join(probe, keys, "left")
    return joined.filter(
        F.coalesce(
            F.col("_found"),
            F.raise_error(F.concat(F.lit(f"no {what} for "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("boolean"),
        )
    ).drop("_found")


def missing_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The rows ``strict_lookup`` would fail on."""
    return left.join(right, keys, "left_anti")


def multiset_intersect_size(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Size of the multiset intersection of two ``(key, n)`` tables."""
    sides = left.select(key, F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(
        right.select(key, F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))
    )
    merged = sides.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return merged.agg(F.coalesce(F.sum(F.least("a", "b")), F.lit(0)).alias("shared"))
