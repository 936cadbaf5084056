"""Filter interaction audit: what each of five filters removes, in every order, from one table of coalitions.

Every document gets a five-bit mask of the filters it fails.  Per part, documents are counted by mask, and from these at
most 32 counts the removals of all 32 coalitions of filters are tabulated: a coalition removes the documents that fail
one of its filters.  All the rest are differences of that table.  With P the filters before a step and f its own:

* removed = v(P + f) - v(P), kept = all - v(P + f), redundant = v(f) - removed, unique fails = v(all five) - v(without f);
* the Shapley value of f is the solution of the least squares problem that fits v by a sum over the coalition's members,
  with the kernel weight (M - 1) / (C(M, s) s (M - s)) for coalitions of s out of M filters and the sum over all filters
  held to v(all five).  Its normal equations are solved in rationals, so 120 times it is the whole number of documents
  that f removes, summed over all orders.

Filters, on words ``[^\\x20\\x09-\\x0D]+`` of the whole text: A fewer than 100 words; B distinct words below 80 percent;
C capitals A-Z above 10 percent of the code points; D one of ``#$%&*|`` in it; E equal to the text of a smaller id.

Texts are compared by SHA-256.  Groups of equal texts are combined before the shuffle, and only texts that several ids
share come back to the rows, salted, so that one text may hold any share of the rows.

Defined results: a null text counts as empty and fails A only, or A and E.  A null part is the empty string.  A null id
is neither smaller nor larger than another and has no label.  Repeated rows count each; they share an id, so none is a
copy of the other.  Several labels of one id count as good, and as toxic, if one of them is.  An empty table gives an
empty result, and extra columns don't matter.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations, permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .base import let, salted_join, text_of, words_of, written

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # percent of the words
MOST_CAPITALS = 10  # percent of the code points
SYMBOLS = "[#$%&*|]"
STEPS = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
         "good_lost long, toxic_lost long, shapley long")


def _own_fails(text: str) -> Column:
    """Bits A to D of a row's mask; ``text`` isn't null."""
    counts = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    bit = lambda condition, k: F.when(condition, F.lit(1 << k)).otherwise(0)
    few = let(counts, lambda c: bit(c["n"] < LEAST_WORDS, 0) + bit(100 * c["d"] < LEAST_DISTINCT * c["n"], 1))
    return few + bit(100 * capitals > MOST_CAPITALS * F.length(text), 2) + bit(F.col(text).rlike(SYMBOLS), 3)


def masks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``id``, ``part`` and ``mask``, the bits of the filters that it fails."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       text_of(f"`{text}`").alias("text"))
    narrow = written(rows.select("id", "part", _own_fails("text").alias("own"), F.sha2("text", 256).alias("sha")), "masks")
    firsts = (narrow.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"))
              .where("first < last").select("sha", "first"))
    both = salted_join(narrow, firsts, ["sha"], ["id"])
    return both.select("id", "part", (F.col("own") + F.when(F.col("id") > F.col("first"), F.lit(16)).otherwise(0)).alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, label_id: str = "doc_id") -> DataFrame:
    """Documents, good and toxic ones by ``part`` and ``mask``; ``labels`` has the columns ``quality`` and ``toxic``."""
    flags = labels.where(f"`{label_id}` IS NOT NULL").groupBy(F.col(f"`{label_id}`").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    marked = masked.join(flags, "id", "left")
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"),
                                              F.count_if("bad").alias("toxic"))


def coalition_values(counts: dict[int, int], players: int) -> list[int]:
    """Documents that each coalition removes: those whose mask has one of its filters."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(1 << players)]


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """Solution of linear equations, each row its coefficients and its right side, by elimination in rationals."""
    rows = [list(r) for r in rows]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i, row in enumerate(rows):
            if i != k and row[k]:
                rows[i] = [x - row[k] * y for x, y in zip(row, rows[k])]
    return [r[-1] for r in rows]


def shapley_values(values: list[int], players: int) -> list[Fraction]:
    """Least squares fit of ``values`` (by coalition) by a sum of the members' shares, all shares adding up to the whole."""
    if players == 1:
        return [Fraction(values[1])]
    left = [[Fraction(0)] * players for _ in range(players)]
    right = [Fraction(0)] * players
    for size in range(1, players):
        weight = Fraction(players - 1, comb(players, size) * size * (players - size))
        for members in combinations(range(players), size):
            v = values[sum(1 << m for m in members)]
            for i in members:
                right[i] += weight * v
                for j in members:
                    left[i][j] += weight
    one = Fraction(1)
    rows = [[*left[i], one, right[i]] for i in range(players)]  # with the multiplier of the constraint
    rows.append([*[one] * players, Fraction(0), Fraction(values[-1])])
    return solve(rows)[:players]


def audit_part(group: pd.DataFrame) -> pd.DataFrame:
    """Every order's steps for one part, from its counts by mask (at most 32 rows)."""
    m = len(FILTERS)
    removed, good, toxic = (coalition_values(dict(zip(group["mask"].tolist(), group[c].tolist())), m) for c in ("n", "good", "toxic"))
    whole, every = int(group["n"].sum()), (1 << m) - 1
    orders = 1
    for k in range(2, m + 1):
        orders *= k
    shapley = [orders * share for share in shapley_values(removed, m)]
    rows = []
    for order in permutations(range(m)):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            here = removed[after] - removed[before]
            rows.append((group["part"].iloc[0], "".join(FILTERS[k] for k in order), step, whole - removed[after], here,
                         removed[1 << f] - here, removed[every] - removed[every ^ 1 << f], good[after] - good[before],
                         toxic[after] - toxic[before], int(shapley[f])))
            before = after
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STEPS.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang",
          label_id: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = mask_counts(masks(docs, id_col, text, part), labels, label_id)
    return counts.groupBy("part").applyInPandas(audit_part, STEPS)
