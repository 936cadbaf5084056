"""Streaming twin of game ingest: every micro-batch is appended once, readers take the newest row per game."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.clean import canonicalize


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent: a replayed batch overwrites its own folder and nothing else."""
    newest = batch.groupBy("game_id").agg(F.max_by(F.struct(*batch.columns), F.struct("completed", "date")).alias("row"))
    newest.select("row.*").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def start_ingest(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = (canonicalize(stream).writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, i: append_batch(df, i, path)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_games(spark: SparkSession, path: str) -> DataFrame:
    log = spark.read.parquet(path)
    columns = [c for c in log.columns if c != "batch_id"]
    newest = log.groupBy("game_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("row"))
    return newest.select("row.*")
