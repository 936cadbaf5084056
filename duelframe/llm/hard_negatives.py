"""Hard negatives by a vertical scan of the vectors (the branch-and-bound scan on columns known as BOND).

Vectors are packed once into blocks of rows of one label.  A block holds its rows column by column, with the least and
the greatest value of each dimension.  A block of anchors meets a block of rows in one task, and each anchor reads the
columns in descending order of its own components' sizes.  After every few columns the score of a row lies between its
partial sum and what the columns still unread can add at least and at most; rows whose interval can't reach the result
leave the candidate set, and those that stay are resolved exactly.

Two scans: first, over blocks of the anchor's label, its best ``positives`` other rows; then, over blocks of other
labels, for each positive the best ``negatives`` rows in its window of scores.  A task keeps the best few rows for an
anchor and block; the best of these are taken by anchor, so pairs of rows never leave a task.

Each component is multiplied by ``SCALE`` and rounded down; sizes beyond ``LARGEST`` count as that, so that scores are
exact.  A shorter vector has zeros where it ends.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part.  Where an id is
divisible by ``shifted`` its label is (label + 1) % 10.  Anchors are the rows whose id is divisible by ``every``.
Higher scores come first, then smaller ids, null ids last.  A repeated row is another row: it may be a positive of its
copy, and a repeated anchor gives its rows once for each copy.  An anchor without positives, or whose windows are empty,
gives no row.  Empty tables give empty results, and extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread
from .base import written

SCALE = 256
LARGEST = 1 << 26
EVERY = 50
SHIFTED = 7
POSITIVES = 5
NEGATIVES = 3
WINDOW = (50, 95)  # percent of the positive's score
BLOCK = 32_768  # rows
ANCHORS = 1_024  # anchors in a block
STRIDE = 8  # columns between two looks at the bounds
NONE_LAST = np.iinfo(np.int64).max

FOUND = "of long, at int, slot int, id long, score long"  # the anchor: its block and its place there


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
           shifted: int = SHIFTED) -> DataFrame:
    """``id``, ``label`` and ``v`` (whole numbers) of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                          F.col(f"`{vector}`").cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    moved = F.when(F.col("id") % shifted == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-1.0 * LARGEST), F.least(F.lit(1.0 * LARGEST), SCALE * x))).cast("int"))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & finite).select(
        "id", moved.cast("int").alias("label"), whole.alias("v"))


def _chunks(frames: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[int, list, list]]:
    """(label, ids, vectors) of at most ``most`` rows of one label; rows come ordered by label."""
    label, ids, rows = None, [], []
    for frame in frames:
        for i, k, v in zip(frame["id"], frame["label"], frame["v"]):
            if rows and (k != label or len(rows) == most):
                yield label, ids, rows
                ids, rows = [], []
            label = k
            ids.append(i)
            rows.append(v)
    if rows:
        yield label, ids, rows


def pack(rows: DataFrame, most: int, tag: str) -> DataFrame:
    """Written table of blocks; ids are 64-bit numbers, a null one the greatest, and vectors lie column by column."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for label, ids, vs in _chunks(frames, most):
            dims = max(map(len, vs))
            x = np.zeros((len(vs), dims), np.int32)
            for k, v in enumerate(vs):
                x[k, :len(v)] = v
            numbers = np.array([NONE_LAST if pd.isna(i) else int(i) for i in ids], np.int64)
            yield pd.DataFrame({"label": [label], "n": [len(vs)], "dims": [dims], "ids": [numbers.tobytes()],
                                "vectors": [np.ascontiguousarray(x.T).tobytes()]})

    # a null id, read as a float by pandas, would round large ones
    safe = rows.select(F.col("id").cast("string").alias("id"), "label", "v")
    dealt = safe.withColumn("_deal", F.rand(1)).repartitionByRange("label", "_deal").sortWithinPartitions("label").drop("_deal")
    blocks = dealt.mapInPandas(run, "label int, n int, dims int, ids binary, vectors binary")
    return written(blocks.select(F.monotonically_increasing_id().alias("block"), "*"), tag)


class Block:
    """Rows of one label, column by column."""

    def __init__(self, row):
        self.n = int(row.n)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.x = np.frombuffer(row.vectors, np.int32).reshape(int(row.dims), self.n)
        self.lo, self.hi = self.x.min(1).astype(np.int64), self.x.max(1).astype(np.int64)


def scan(q: np.ndarray, rows: Block, keep, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of ``rows`` and their scores for the anchor ``q``, whose columns are read by descending size.

    ``keep(low, high)`` tells, from the bounds of the scores of the candidates that are left, which stay.
    """
    dims = min(len(q), len(rows.x))
    q = q[:dims].astype(np.int64)
    order = np.argsort(-np.abs(q), kind="stable")
    order = order[:np.count_nonzero(q)]
    a, b = q[order] * rows.lo[order], q[order] * rows.hi[order]
    # what the columns from each place on can still add
    least = np.append(np.minimum(a, b)[::-1].cumsum()[::-1], 0)
    most = np.append(np.maximum(a, b)[::-1].cumsum()[::-1], 0)
    live = np.arange(rows.n)
    part = np.zeros(rows.n, np.int64)
    for start in range(0, len(order), stride):
        at = order[start:start + stride]
        columns = rows.x[at] if len(live) == rows.n else rows.x[np.ix_(at, live)]
        part = part + (q[at].astype(np.float64) @ columns if np.abs(q[at]).sum() * LARGEST < 1 << 53
                       else (q[at][:, None] * columns.astype(np.int64)).sum(0)).astype(np.int64)
        end = min(start + stride, len(order))
        stay = keep(part + least[end], part + most[end])
        live, part = live[stay], part[stay]
        if not len(live):
            break
    else:
        if not len(order):
            stay = keep(part, part)
            live, part = live[stay], part[stay]
    return live, part


def kth_largest(x: np.ndarray, k: int):
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else None


def best_rows(q: np.ndarray, rows: Block, k: int, stride: int = STRIDE) -> list[tuple[int, int]]:
    """The first ``k`` rows of the block, as (id, score)."""
    def keep(low, high):
        limit = kth_largest(low, k)
        return np.ones(len(low), bool) if limit is None else high >= limit

    live, score = scan(q, rows, keep, stride)
    first = np.lexsort((rows.ids[live], -score))[:k]
    return [(int(rows.ids[live[i]]), int(score[i])) for i in first]


def best_in_windows(q: np.ndarray, rows: Block, windows: list[tuple[int, int]], k: int, stride: int = STRIDE
                    ) -> list[list[tuple[int, int]]]:
    """For each window of scores (both ends included) the first ``k`` rows of the block in it."""
    def keep(low, high):
        stay = np.zeros(len(low), bool)
        for lo, hi in windows:
            may = (high >= lo) & (low <= hi)
            limit = kth_largest(low[(low >= lo) & (high <= hi)], k)
            stay |= may if limit is None else may & (high >= limit)
        return stay

    live, score = scan(q, rows, keep, stride)
    out = []
    for lo, hi in windows:
        inside = np.flatnonzero((score >= lo) & (score <= hi))
        first = inside[np.lexsort((rows.ids[live[inside]], -score[inside]))[:k]]
        out.append([(int(rows.ids[live[i]]), int(score[i])) for i in first])
    return out


def _pairs(blocks: DataFrame, anchors: DataFrame, same: bool) -> DataFrame:
    """Block numbers that meet: anchors' (``of``) and rows' (``block``), of one label or of different ones."""
    a, b = anchors.select(F.col("block").alias("of"), F.col("label").alias("wanted")), blocks.select("block", "label")
    match = F.col("wanted") == F.col("label") if same else F.col("wanted") != F.col("label")
    return a.join(b, match).select("of", "block")  # numbers of blocks, no rows


def _met(blocks: DataFrame, anchors: DataFrame, pairs: DataFrame, task, schema: str) -> DataFrame:
    """Run ``task(anchors, rows)`` on each pair of blocks; both sides of a pair come to one task, and no more."""
    left = pairs.join(anchors.withColumnRenamed("block", "of"), "of")
    other = pairs.select(F.col("of").alias("met"), F.col("block").alias("rows"))
    right = other.join(blocks.withColumnRenamed("block", "rows"), "rows")
    return (spread(left, "of", "block").groupBy("of", "block")
            .cogroup(spread(right, "met", "rows").groupBy("met", "rows")).applyInPandas(task, schema))


def positives_of(blocks: DataFrame, anchors: DataFrame, k: int = POSITIVES) -> DataFrame:
    """``of`` and ``at`` (the anchor), ``slot`` from 1, ``id`` and ``score`` of its first ``k`` other rows."""
    def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine, rows, out = Block(a.iloc[0]), Block(b.iloc[0]), []
        of = int(a["of"].iloc[0])
        for at in range(mine.n):
            q = mine.x[:, at]
            # a row among the first k + 1 may be the anchor itself
            own = (int(mine.ids[at]), int((q.astype(np.int64) ** 2).sum()))
            out += [(of, at, 0, i, s, (i, s) == own) for i, s in best_rows(q, rows, k + 1)]
        return pd.DataFrame(out, columns=["of", "at", "slot", "id", "score", "own"])

    found = _met(blocks, anchors, _pairs(blocks, anchors, True), task, FOUND + ", own boolean")
    order = [F.desc("score"), F.col("id")]
    nth = F.row_number().over(Window.partitionBy("of", "at").orderBy(*order))
    first = found.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    # of rows equal to the anchor one is the anchor
    itself = F.min(F.when(F.col("own"), F.col("nth"))).over(Window.partitionBy("of", "at"))
    rest = first.withColumn("itself", itself).where("itself IS NULL OR nth <> itself")
    slot = F.col("nth") - F.when(F.col("nth") > F.col("itself"), 1).otherwise(0)
    return rest.withColumn("slot", slot.cast("int")).where(F.col("slot") <= k).select("of", "at", "slot", "id", "score")


def negatives_of(blocks: DataFrame, anchors: DataFrame, positives: DataFrame, k: int = NEGATIVES,
                 window: tuple[int, int] = WINDOW) -> DataFrame:
    """``of``, ``at``, ``slot`` (of the positive), ``id`` and ``score`` of the first ``k`` rows in the positive's window."""
    low, high = window
    windows = (positives.where("score >= 0").groupBy(F.col("of").alias("block"))
               .agg(F.collect_list(F.struct("at", "slot", "score")).alias("windows")))  # those of one block of anchors
    asked = anchors.join(windows, "block")

    def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine, rows, by_anchor, out = Block(a.iloc[0]), Block(b.iloc[0]), {}, []
        of = int(a["of"].iloc[0])
        for w in a["windows"].iloc[0]:
            by_anchor.setdefault(int(w["at"]), []).append((int(w["slot"]), int(w["score"])))
        for at, own in sorted(by_anchor.items()):
            # low * p <= 100 * score <= high * p
            bounds = [(-(-low * p // 100), high * p // 100) for _, p in own]
            for (slot, _), best in zip(own, best_in_windows(mine.x[:, at], rows, bounds, k)):
                out += [(of, at, slot, i, s) for i, s in best]
        return pd.DataFrame(out, columns=["of", "at", "slot", "id", "score"])

    found = _met(blocks, asked, _pairs(blocks, asked, False), task, FOUND)
    nth = F.row_number().over(Window.partitionBy("of", "at", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def anchor_numbers(anchors: DataFrame) -> DataFrame:
    """``of``, ``at`` and ``anchor_id`` of every anchor in the packed blocks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, ids in zip(frame["block"], frame["ids"]):
                ids = np.frombuffer(ids, np.int64)
                yield pd.DataFrame({"of": int(block), "at": np.arange(len(ids)), "anchor_id": ids})

    return anchors.select("block", "ids").mapInPandas(run, "of long, at int, anchor_id long")


def mine(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY,
         positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, block: int = BLOCK,
         anchor_block: int = ANCHORS) -> DataFrame:
    """One row per anchor, positive and hard negative."""
    rows = usable(vectors, id_col, vector, label)
    blocks = pack(rows, block, "vectors")
    anchors = pack(rows.where(F.col("id") % every == 0), anchor_block, "anchors")
    near = written(positives_of(blocks, anchors, positives), "positives")
    far = negatives_of(blocks, anchors, near, negatives, window)
    shown = lambda c: F.when(F.col(c) != int(NONE_LAST), F.col(c))
    named = near.select("of", "at", "slot", shown("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["of", "at", "slot"]).join(anchor_numbers(anchors), ["of", "at"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), shown("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
