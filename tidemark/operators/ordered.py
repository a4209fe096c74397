"""Neighbour and running operators that do not put a whole key in one task.

A plain window over a hot key would sort that key in a single task.  Here the
timeline of a key is cut into buckets; windows run inside (key, bucket) and the
bucket edges, one row per bucket, are stitched with a small second window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_US = 86_400_000_000


def placed(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column,
    before: dict[str, list[str]] | None = None, after: dict[str, list[str]] | None = None, number: str | None = None,
) -> DataFrame:
    """Structs of the previous and next row's values and the row number, in one pass.

    ``before`` and ``after`` map a new column to the values it holds; ``bucket``
    must never decrease along ``order``.  One exchange on (keys, bucket) serves
    the windows and the join with the stitched bucket edges; the edges are
    pre-aggregated.  Null keys are a key of their own: keys travel as a struct,
    whose equality takes nulls as equal.
    """
    before, after = before or {}, after or {}
    rows = df.withColumns({"_keys": F.struct(*keys), "_bucket": bucket})
    by = F.struct(*order)
    edge = rows.groupBy("_keys", "_bucket").agg(
        F.count("*").alias("_count"),
        *[F.max_by(F.struct(*v), by).alias(f"_last_{c}") for c, v in before.items()],
        *[F.min_by(F.struct(*v), by).alias(f"_first_{c}") for c, v in after.items()],
    )
    along = Window.partitionBy("_keys").orderBy("_bucket")
    edges = edge.select(
        "_keys", "_bucket",
        F.coalesce(F.sum("_count").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{c}").over(along).alias(f"_edge_{c}") for c in before],
        *[F.lead(f"_first_{c}").over(along).alias(f"_edge_{c}") for c in after],
    )
    inside = Window.partitionBy("_keys", "_bucket").orderBy(*order)
    near = rows.withColumns(
        {f"_near_{c}": F.lag(F.struct(*v)).over(inside) for c, v in before.items()}
        | {f"_near_{c}": F.lead(F.struct(*v)).over(inside) for c, v in after.items()}
        | ({"_place": F.row_number().over(inside).cast("bigint")} if number else {})
    )
    new = {c: F.coalesce(f"_near_{c}", f"_edge_{c}") for c in [*before, *after]}
    if number:
        new[number] = F.col("_place") + F.col("_before")
    joined = near.join(edges, ["_keys", "_bucket"], "left").withColumns(new)
    return joined.select(*df.columns, *new)


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[str],
    alias: str, ahead: bool = False,
) -> DataFrame:
    """Adds struct ``alias`` holding ``values`` of the previous (or next) row."""
    side = {alias: values}
    return placed(df, keys, order, bucket, **({"after": side} if ahead else {"before": side}))


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, alias: str) -> DataFrame:
    """Adds the row number along ``order`` within the keys, from 1."""
    return placed(df, keys, order, bucket, number=alias)
