"""Shards of near-equal bytes through sampled splitters.

A size-weighted sample of keys gives quantile boundaries, and rows fall into the ranges between them.  Ranges that turn
out overfull by exact totals are subdivided at further keys.  Ranges then go to shards by their exact bytes, largest
first, each to the shard that has least.  The key is a hash of the text, so equal texts share a range and a shard; only a
text whose rows together are larger than a shard is subdivided by rows.

Everything on the driver has a fixed bound: about ``sample`` keys, and at most about ``4 * shards * fine`` ranges.

Places come from the data alone: a row's number is a hash of its id, its text and which of its exact repeats it is, so
reruns over other partitions give the same rows.  In ``write_shards``, whose rows carry further columns, the rows of a
subdivided text are spread by their place in the input.

Defined results: size is the text's UTF-8 bytes (a null text has none) plus ``overhead``.  Every row gets a shard from 0
to ``shards - 1`` and a gapless slot in it; with few rows some shards stay empty.  Repeated rows are rows of their own.
Null ids are allowed, extra columns pass through ``write_shards``, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .base import free_name, text_of, utf8_bytes

OVERHEAD = 16
SAMPLE = 65_536  # keys drawn, on average at most
FINE = 64  # ranges for each shard
CELL_ROWS = 4096  # rows numbered together, on average
SEED = 2017


@dataclass(frozen=True)
class ShardPlan:
    """Ranges start at ``splitters``; range r has ``parts[r]`` parts by rows, units from ``first[r]`` on, each with a shard."""

    splitters: np.ndarray
    parts: np.ndarray
    shards: np.ndarray

    @classmethod
    def of(cls, splitters: np.ndarray, parts: np.ndarray | None = None, shards: np.ndarray | None = None) -> ShardPlan:
        parts = np.ones(len(splitters) + 1, np.int64) if parts is None else parts
        return cls(splitters, parts, np.zeros(int(parts.sum()), np.int32) if shards is None else shards)

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.parts) - self.parts

    def units(self, key: np.ndarray, row: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.splitters, key, side="right")
        return self.first[at] + (row.view(np.uint64) >> np.uint64(33)).astype(np.int64) % self.parts[at]

    def shard(self, key: Column, row: Column) -> Column:
        plan = self

        @F.pandas_udf("int")
        def of(key: pd.Series, row: pd.Series) -> pd.Series:
            return pd.Series(plan.shards[plan.units(key.to_numpy(np.int64), row.to_numpy(np.int64))])

        return of(key, row)


def _keyed(docs: DataFrame, id_col: str, text: str, overhead: int) -> DataFrame:
    """Narrow rows; exact repeats are counted first and then numbered, so that no group goes through one task."""
    content = text_of(text)
    rows = docs.select(
        F.col(id_col).alias("_id"), (utf8_bytes(content) + overhead).alias("_size"), F.crc32(content).alias("_crc"),
        F.xxhash64(content).alias("_key"))
    times = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_times"))
    starts = times.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1, F.lit(CELL_ROWS).cast("long"))))
    starts = starts.repartition("_id", "_key", "_start")
    last = F.least(F.col("_times"), F.col("_start") + CELL_ROWS) - 1
    return starts.withColumn("_nth", F.explode(F.sequence("_start", last))).select(
        *rows.columns, F.xxhash64(F.lit(SEED), "_id", "_key", "_nth").alias("_row"))


def _totals(rows: DataFrame, plan: ShardPlan) -> np.ndarray:
    """Exact bytes of each unit."""

    @F.pandas_udf("long")
    def unit(key: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(plan.units(key.to_numpy(np.int64), row.to_numpy(np.int64)))

    out = np.zeros(int(plan.parts.sum()), np.int64)
    for r in rows.groupBy(unit("_key", "_row").alias("_unit")).agg(F.sum("_size").alias("_bytes")).collect():
        out[r._unit] = r._bytes
    return out


def plan_shards(rows: DataFrame, shards: int, sample: int = SAMPLE, fine: int = FINE) -> ShardPlan:
    """Sample, split, subdivide and cut.  ``rows``: columns of ``_keyed``."""
    # Chance in proportion to size, by a hash; a row larger than total / sample is drawn for certain, with its size as weight.
    total = rows.agg(F.sum("_size")).first()[0] or 1
    u = F.pmod(F.xxhash64(F.lit(SEED + 1), "_key", "_row"), F.lit(1 << 52)) / float(1 << 52)
    drawn = rows.where(u < F.col("_size") * F.lit(sample / total)).select("_key", "_size").collect()
    keys = np.array([r._key for r in drawn], np.int64)
    weight = np.maximum(1.0, np.array([r._size for r in drawn], np.float64) * sample / total)
    order = np.argsort(keys, kind="stable")
    keys, reach = keys[order], np.cumsum(weight[order])
    ranges = shards * fine
    quantiles = keys[np.searchsorted(reach, np.arange(1, ranges) * reach[-1] / ranges)] if len(keys) else keys
    values, times = np.unique(quantiles, return_counts=True)
    frequent = values[(times > 1) & (values < np.iinfo(np.int64).max)]
    splitters = np.unique(np.concatenate([values, frequent + 1]))  # a frequent key has a range of its own
    allowed = max(1.0, total / ranges)
    size = _totals(rows, ShardPlan.of(splitters))
    splitters = np.unique(np.concatenate([splitters, _inner(splitters, np.ceil(size / allowed), frequent)]))
    size = _totals(rows, ShardPlan.of(splitters))
    alone = np.concatenate([[False], np.isin(splitters, frequent)]).astype(bool)
    parts = np.where(alone & (size > total / shards), np.ceil(size / allowed), 1).astype(np.int64)
    if parts.max() > 1:
        size = _totals(rows, ShardPlan.of(splitters, parts))
    filled, place = [(0, k) for k in range(shards)], np.zeros(len(size), np.int32)
    for unit in np.argsort(-size, kind="stable"):  # largest first, each to the shard that has least
        has, shard = heapq.heappop(filled)
        place[unit] = shard
        heapq.heappush(filled, (has + int(size[unit]), shard))
    return ShardPlan.of(splitters, parts, place)


def _inner(splitters: np.ndarray, parts: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Keys that cut each overfull range of several texts into even intervals; keys are hashes, so even in rows too."""
    edges = [-(1 << 63), *splitters.tolist(), 1 << 63]
    found, single = [], set(frequent.tolist())
    for lo, hi, n in zip(edges, edges[1:], parts.astype(int).tolist()):
        if n > 2 and lo not in single and hi - lo > n:
            found += [lo + (hi - lo) * k // n for k in range(1, n)]
    return np.array(found, np.int64)


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text",
                  overhead: int = OVERHEAD, sample: int = SAMPLE, fine: int = FINE) -> DataFrame:
    """``id_col``, ``size``, ``text_crc32``, ``shard`` and ``slot`` for each row of ``docs``."""
    rows = materialize(_keyed(docs, id_col, text, overhead))  # narrow: the texts are read once
    plan = plan_shards(rows, shards, sample, fine)
    placed = rows.select("_id", "_size", "_crc", "_row", plan.shard(F.col("_key"), F.col("_row")).alias("shard"))
    # Slots: cells of a few thousand rows are numbered each on its own, after the rows of the shard's earlier cells.
    cells = int(max(1, -(-rows.count() // (shards * CELL_ROWS))))
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("_row", F.lit(SEED + 2)), F.lit(cells)))
    earlier = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n")).select(
        "shard", "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_row", "_id")) - 1
    return placed.withColumn("_nth", inside).join(starts, ["shard", "_cell"]).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        "shard", (F.col("_start") + F.col("_nth")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text: str = "text",
                 overhead: int = OVERHEAD) -> None:
    """Write the rows themselves, all columns, in one folder per shard."""
    plan = plan_shards(materialize(_keyed(docs, id_col, text, overhead)), shards)
    name = free_name(docs, "shard")
    row = F.xxhash64(F.lit(SEED), F.monotonically_increasing_id())
    (docs.withColumn(name, plan.shard(F.xxhash64(text_of(text)), row))
     .write.partitionBy(name).parquet(path))
