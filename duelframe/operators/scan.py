"""Ordered running computations that never put a whole key into one task.

A plain window partitioned by a key sends every row of a hot key through one task.  Here the key is cut
into order-preserving blocks (for contests: calendar days).  Rows are windowed inside (key, block), block
totals come from a partial aggregation, and only the short block table is windowed over the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


IDS_PER_BLOCK = 10_000


def day_block(df: DataFrame, day: str = "date", key: str = "game_id") -> Column:
    """An order-preserving block for rows ordered by (day, key): the day and a range of keys, so that a day with very
    many rows is several blocks.  Text keys are cut by their leading characters."""
    kind = df.schema[key].dataType.typeName()
    part = F.substring(F.col(key), 1, 7) if kind == "string" else F.floor(F.col(key) / IDS_PER_BLOCK)
    return F.struct(F.col(day).alias("day"), part.alias("part"))


def blocked_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    *,
    position: str | None = None,
    sums_before: Mapping[str, Column] | None = None,
    last_known: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running columns over ``keys`` ordered by (``block``, ``order``).

    ``position``: 1-based row number.  ``sums_before``: sum over strictly earlier rows (0 if none).
    ``last_known`` / ``last_before``: last non-null value up to and including / strictly before the row.
    """
    sums_before, last_known, last_before = sums_before or {}, last_known or {}, last_before or {}
    cells = [*keys, block]
    inside = W.partitionBy(*cells).orderBy(*order)
    earlier = inside.rowsBetween(W.unboundedPreceding, -1)
    so_far = inside.rowsBetween(W.unboundedPreceding, 0)
    carried = {**last_known, **last_before}

    local: dict[str, Column] = {}
    totals: list[Column] = []
    if position:
        local[f"__p_{position}"] = F.row_number().over(inside)
        totals.append(F.count(F.lit(1)).alias("__n"))
    for name, value in sums_before.items():
        local[f"__s_{name}"] = F.coalesce(F.sum(value).over(earlier), F.lit(0))
        totals.append(F.sum(value).alias(f"__t_{name}"))
    for name, value in last_known.items():
        local[f"__c_{name}"] = F.last(value, ignorenulls=True).over(so_far)
    for name, value in last_before.items():
        local[f"__c_{name}"] = F.last(value, ignorenulls=True).over(earlier)
    for name, value in carried.items():
        totals.append(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"__l_{name}"))

    previous = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    offsets = [F.col(c).alias(f"__k_{c}") for c in cells]
    if position:
        offsets.append(F.coalesce(F.sum("__n").over(previous), F.lit(0)).alias("__o_n"))
    for name in sums_before:
        offsets.append(F.coalesce(F.sum(f"__t_{name}").over(previous), F.lit(0)).alias(f"__o_{name}"))
    for name in carried:
        offsets.append(F.last(f"__l_{name}", ignorenulls=True).over(previous).alias(f"__o_{name}"))
    blocks = df.groupBy(*cells).agg(*totals).select(*offsets)

    joined = df.withColumns(local).join(blocks, [F.col(c) == F.col(f"__k_{c}") for c in cells], "inner")
    out = [F.col(c) for c in df.columns]
    if position:
        out.append((F.col(f"__p_{position}") + F.col("__o_n")).cast("bigint").alias(position))
    for name in sums_before:
        out.append((F.col(f"__s_{name}") + F.col(f"__o_{name}")).alias(name))
    for name in carried:
        out.append(F.coalesce(F.col(f"__c_{name}"), F.col(f"__o_{name}")).alias(name))
    return joined.select(*out)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """Keep the first ``n`` rows per key; Spark prunes to ``n`` per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")
