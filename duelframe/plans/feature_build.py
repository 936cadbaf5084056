"""Feature table for all seasons in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, history, ratings
from ..session import materialize


def build_features(games: DataFrame, totals: DataFrame, predecessors: DataFrame, alternates: DataFrame,
                   edges: DataFrame | None = None, archive: DataFrame | None = None,
                   rebuild_years: Sequence[int] | None = None, min_games: int = 20, check_teams: bool = True) -> DataFrame:
    """Contest rows to model rows.

    Seasons not in ``rebuild_years`` are taken from ``archive``.  The first season only serves as the
    prior of the second.  Ratings are materialised once because every later step reads them.
    """
    base = clean.canonicalize(games) if check_teams else games
    base = clean.keep_valid_games(base, min_games) if check_teams else base
    base = clean.margin_if_absent(clean.drop_missing_teams(base))
    end = materialize(ratings.season_end_ratings(base, edges))
    first = base.agg(F.min("year").alias("first"))
    wanted = base.join(F.broadcast(first)).filter(F.col("year") > F.col("first")).drop("first")  # one row
    if archive is not None and rebuild_years is not None:
        wanted = wanted.filter(F.col("year").isin(*rebuild_years))
    rows = history.with_prior_ratings(wanted, end, predecessors)
    rows = history.season_game_number(rows)
    point = materialize(ratings.point_in_time_ratings(wanted, edges))
    rows = materialize(ratings.attach_ratings(rows, point))
    rows = history.attach_history(rows, history.side_history(rows))
    rows = history.with_win_totals(rows, totals, alternates)
    rows = clean.completed_from_margin(rows)
    if "playoff" not in rows.columns:
        rows = clean.add_playoff_flag(rows)
    out = history.build_model_features(rows)
    if archive is not None and rebuild_years is not None:
        out = out.unionByName(archive.filter(~F.col("year").isin(*rebuild_years)), allowMissingColumns=True)
    known = edges if edges is not None else history.home_edge(out.filter("completed"), ["year"])
    return history.with_home_edge(out.drop("hca"), known)
