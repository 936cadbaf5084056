"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when identical after deleting blanks (space and U+0009 to U+000D).  A group is split level by level, and
only groups that still hold several rows reach the next level: the length and a hash of the first characters are cheap
and narrow; the full SHA-256 of the text is read only for rows whose (length, prefix) is shared.

Defined results: a null text counts as empty, and all empty texts are equal.  Of equal texts the row with the most code
points in the original text stays, then the smallest ``doc_id``, a null ``doc_id`` last.  Repeated rows (same text, same
id) are one row for ``keep_best`` and all marked kept by ``duplicate_groups``, where they can't be told apart.
Extra columns pass through ``keep_best``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .base import salted_join, text_of, with_known_size, without_blanks, written

PREFIX = 64  # characters of the normalised text in the second level's hash


def _levels(docs: DataFrame, text: str, also: dict[str, Column]) -> DataFrame:
    """Length and prefix hash of the normalised text, and what ``also`` derives from it (column ``_norm``)."""
    norm = docs.withColumn("_norm", without_blanks(text_of(text)))
    return norm.withColumns({
        "_len": F.length("_norm"),
        "_prefix": F.xxhash64(F.substring("_norm", 1, PREFIX)),
        "_points": F.length(text_of(text)),
        **also,
    }).drop("_norm")


def shared_prefixes(levels: DataFrame) -> DataFrame:
    """The (length, prefix) pairs that several rows share; lengths of one row fall out first."""
    pairs = levels.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    lengths = pairs.groupBy("_len").agg(F.sum("_n").alias("_m")).where("_m > 1").select("_len")
    return pairs.where("_n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    The digest is asked for on every row, so the full hash is taken in the one scan; the refinement then works on narrow
    rows, and only groups with a shared (length, prefix) are grouped by it.
    """
    narrow = _levels(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text",
                     {"_sha": F.sha2("_norm", 256)}).drop("_text")
    best = F.struct(-F.col("_points"), F.col("_id").isNull(), F.col("_id"))
    groups = (narrow.join(shared_prefixes(narrow), ["_len", "_prefix"], "left_semi")
              .groupBy("_sha").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("_size"))
              .where("_size > 1").select("_sha", F.col("_best._id").alias("_keep"), "_size"))
    out = narrow.select("_id", "_sha").join(groups.withColumn("_grouped", F.lit(True)), "_sha", "left")
    keep = F.when(F.col("_grouped"), F.col("_keep")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"))


def keep_best(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its duplicates, columns unchanged.

    Rows are compared by narrow keys: id, length, prefix hash and a hash of the text as it is.  The full hash is taken only
    for rows whose (length, prefix) is shared.  Winners are minima, combined before the shuffle, so a group may hold any
    share of the rows.  Whole rows are joined once, with the keys of those that go.
    """
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_none": F.col(f"`{id_col}`").isNull(), "_name": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                                 "_at": F.xxhash64(text_of(f"`{text}`"))})

    key = ["_none", "_name", "_at"]
    pairs = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`"))
    narrow = written(_levels(keyed(pairs), f"`{text}`", {}).drop(text), "levels")
    shared = narrow.join(with_known_size(shared_prefixes(narrow)), ["_len", "_prefix"], "left_semi")
    shared = materialize(shared.groupBy(*key, F.col(f"`{id_col}`").alias("_id"), "_points").agg(F.count(F.lit(1)).alias("_times")))
    content = keyed(pairs).join(with_known_size(shared.select("_at").distinct()), "_at", "left_semi")
    shas = content.groupBy("_at").agg(F.first(F.sha2(without_blanks(text_of(f"`{text}`")), 256)).alias("_sha"))
    rows = materialize(salted_join(shared, shas, ["_at"], ["_name"], how="inner"))  # one text may stand in many rows
    best = rows.groupBy("_sha").agg(F.min(F.struct(-F.col("_points"), F.col("_none"), "_id", "_name", "_at")).alias("_best"))
    stay = materialize(best.select("_best._none", "_best._name", "_best._at"))
    gone = rows.join(stay, key, "left_anti").select(*key)
    twice = materialize(rows.where("_times > 1").join(stay, key, "left_semi").select(*key))  # repeated rows, of which one stays
    out = keyed(_packed(docs, id_col, text))
    rest = out.join(with_known_size(materialize(gone.union(twice))), key, "left_anti")
    once = out.join(with_known_size(twice), key, "left_semi").dropDuplicates(key)
    return rest.select("_row").unionByName(once.select("_row")).select("_row.*")


def _packed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Whole rows as ``_row`` beside their id and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`"), F.col(f"`{text}`"))
