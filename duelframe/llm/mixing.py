"""Mixing sources to target weights: rates from token totals, whole copies plus one seeded Bernoulli copy.

Tokens are summed per source; targets follow the weights under a cap of ``max_rate`` times the source's tokens, the excess
reshared by weight; a source's rate is target over tokens.  A document is emitted floor(rate) times, and once more when
a hash of seed, id and text, read as a number in [0, 1), is below the rate's fraction.

The cap's fixed point needs no loop.  Let r be the level at which a source reaches its cap, cap over weight.  With the
sources in order of r, a source is capped when the level left to it and the later ones is above its r, and this holds
for a first run of sources only; so exclusive running sums of caps and weights give every target.

Defined results: a null text has no words.  A source without words gets target 0 and no copies.  Null is a source of its
own, the last in code point order.  Repeated rows (same id and text) get the same number of copies.  Extra columns pass
through, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .base import n_words, running_sums, text_of, with_known_size

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
MAX_RATE = 3
SEED = "mix-1"


def uniform(id_col: str, text: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from 32 bits of MD5, the same on every engine."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.lit(seed), name, F.md5(text_of(text))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / float(1 << 32)


def source_targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS,
                   max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: ``_no_source``, ``_source`` (null as empty), ``source_size`` and ``target``."""
    sources = sizes.groupBy(F.col(source).isNull().alias("_no_source"), F.coalesce(source, F.lit("")).alias("_source")).agg(
        F.sum(size).alias("source_size"))
    ranked = running_sums(sources, [F.col("_no_source"), F.col("_source")], {"_rank": F.lit(1)})
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("_weight", weight).withColumn("_cap", max_rate * F.col("source_size"))
    level = F.col("_cap") / F.col("_weight")
    sums = running_sums(ranked, [level, F.col("_no_source"), F.col("_source")],
                        {"_caps": F.col("_cap"), "_weights": F.col("_weight")})
    whole = sums.agg(F.sum("source_size").alias("_all"), F.sum("_weight").alias("_all_weights"))
    left = sums.join(F.broadcast(whole)).withColumn(  # one row
        "_left", (F.col("_all") - F.col("_caps")) / (F.col("_all_weights") - F.col("_weights")))
    final = left.agg(F.max(F.when(F.col("_left") <= level, F.col("_left"))).alias("_level"))
    return left.join(F.broadcast(final)).select(  # one row
        "_no_source", "_source", "source_size",
        F.when(F.col("_level").isNull() | (level < F.col("_level")), F.col("_cap").cast("double"))
        .otherwise(F.col("_level") * F.col("_weight")).alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` (columns of its own) with ``_size``, ``source_size``, ``target`` and ``_copies``."""
    sized = docs.withColumn("_size", n_words(text_of(text))).withColumn("_u", uniform(id_col, text, seed))
    targets = with_known_size(materialize(source_targets(sized, source, "_size", weights, max_rate)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = sized.withColumns({"_no_source": F.col(source).isNull(), "_source": F.coalesce(source, F.lit(""))})
    return keyed.join(targets, ["_no_source", "_source"]).withColumn(
        "_copies", F.floor(rate) + (F.col("_u") < rate - F.floor(rate)).cast("long")
    ).drop("_no_source", "_source", "_u")


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, columns unchanged."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                         F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"),
                         F.col(f"`{source}`").alias("_from"))
    taken = with_copies(packed, "_id", "_text", "_from", weights, max_rate, seed)
    return (taken.where("_copies > 0").select("_row", F.explode(F.expr("sequence(1L, _copies)")))
            .select("_row.*"))
