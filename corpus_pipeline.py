"""The corpus pipeline: stages over documents, each written and reread before the next.

Every stage but the last returns the columns of documents; the last returns the pieces of the packed sequences.

A stage takes its predecessor's rows as they are written, so it begins by deleting the working tables (sketches, sets, keys)
that its predecessor left in the shared folder.  Results of two runs in one session must not be interleaved.

Defined results: null and empty texts fail the base rules and go in the first stage, so later stages see texts only; a row
with a null id is judged like any other.  Repeated rows are one row after exact dedup.  Without labels the base rules decide
in the first stage.  An empty table gives an empty result, and extra columns pass through all stages but the last.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from duelframe.llm import exact_dedup, mixing, near_dedup, packing, queries, target_rules
from duelframe.llm.base import WRITTEN, dropped, table, written

ORACLE_SQL = None  # hashed n-grams, signatures and tokens can't be expressed in SQL; tests hold the stages against brute force


WORD_TABLE = 48 << 20  # bytes of a packing worker's word table
_LEFT: list[str] = []  # working tables of the stage before


def stage(fn):
    """Delete what the stage before has left, and note what this one leaves."""
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        dropped(spark, [p for p in _LEFT if p in WRITTEN])
        before = len(WRITTEN)
        out = fn(spark, docs, sf_dir)
        _LEFT[:] = WRITTEN[before:]
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the trusted ones."""
    return target_rules.kept_rows(docs, queries.trusted_ids(spark, sf_dir))


@stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.keep_best(docs)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_first(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    # workers of the stages before are still there, and those of this one may be when the next run begins
    return packing.pack(docs, cache_bytes=WORD_TABLE, keep_words=False)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("near dedup", near_copies),
          ("mixing", source_mix), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, earlier = table(spark, sf_dir, "documents"), None
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            if earlier:
                dropped(spark, [earlier])
            earlier = WRITTEN[-1]
    return docs
