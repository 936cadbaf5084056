"""Game ingest: detect new rows, fill what is missing, detect safe leads, order the columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean, events
from ..sinks.writers import ordered_game_columns


def ingest_games(existing: DataFrame, schedule: DataFrame, team_dim: DataFrame, boxes: DataFrame | None = None,
                 log: DataFrame | None = None) -> DataFrame:
    """``existing`` and ``schedule`` are contest rows; ``boxes`` and ``log`` feed pace and safe-lead columns."""
    kept = clean.completed_games(existing)
    fresh = clean.new_rows(schedule, kept)
    if boxes is not None:
        waiting = clean.backfill_candidates(fresh, "pace").select("game_id")
        paces = events.game_paces(boxes.join(waiting, "game_id", "left_semi"))
        fresh = clean.write_back(fresh, paces, ["pace"])
    merged = clean.union_backfilled(clean.canonicalize(kept), fresh, team_dim)
    merged = clean.add_counts_flag(clean.add_playoff_flag(merged))
    if log is not None:
        merged = events.with_safe_leads(merged, events.safe_leads(log))
    return ordered_game_columns(merged)
