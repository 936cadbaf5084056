"""Scoring upcoming and past games, and model-based ratings.  Dates are arguments; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..schema import HCA_PRIOR
from .bias import correct_prediction
from .history import build_model_features, team_snapshots
from .models import Scorer, margin_of, win_prob_of
from .perspective import both_sides

REST_DEFAULT = 3


def horizon(games: DataFrame, as_of: str, days: int | None = None) -> DataFrame:
    """Open games from ``as_of`` on, optionally only the next ``days`` days (1 = that day)."""
    start = F.lit(as_of).cast("date")
    out = games.filter(~F.col("completed") & (F.to_date("date") >= start))
    return out if days is None else out.filter(F.to_date("date") < F.date_add(start, days))


def _scored(games: DataFrame, margin_model: Scorer, biases: DataFrame | None) -> DataFrame:
    out = margin_of(build_model_features(games), margin_model)
    return out if biases is None else correct_prediction(out, biases, "pred_margin")


def predict_margins(games: DataFrame, as_of: str, days: int | None, margin_model: Scorer,
                    biases: DataFrame | None = None) -> DataFrame:
    return _scored(horizon(games, as_of, days), margin_model, biases)


def margin_report(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("date").alias("Date"), F.col("team").alias("Home"), F.col("opponent").alias("Away"),
                         F.round("pred_margin", 1).alias("Predicted Home Margin")).orderBy("Date", "Home", "Away")


def predict_outcomes(games: DataFrame, as_of: str, margin_model: Scorer, win_model: Scorer,
                     biases: DataFrame | None = None) -> DataFrame:
    """All games still to come, with margin and win probability."""
    return win_prob_of(predict_margins(games, as_of, None, margin_model, biases), win_model)


def outcome_report(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("date").alias("Date"), F.col("team").alias("Home"), F.col("opponent").alias("Away"),
                         F.round("pred_margin", 1).alias("Predicted Home Margin"),
                         F.round("win_prob", 3).alias("Predicted Home Win Probability")).orderBy("Date", "Home", "Away")


def retrospective(games: DataFrame, year: int, margin_model: Scorer, win_model: Scorer) -> DataFrame:
    """Predictions for a season's completed games next to what happened."""
    done = games.filter((F.col("year") == year) & F.col("completed"))
    scored = win_prob_of(_scored(done, margin_model, None), win_model)
    return scored.select(
        F.col("date").alias("Date"), F.col("team").alias("Home"), F.col("opponent").alias("Away"),
        F.col("pred_margin").alias("Predicted_Margin"), F.col("margin").alias("Actual_Margin"),
        F.col("win_prob").alias("Predicted_Win_Prob"), S.home_win(F.col("margin")).cast("int").alias("Actual_Win"),
        (F.col("pred_margin") - F.col("margin")).alias("Margin_Error")).orderBy("Date", "Home", "Away")


def round_robin(snapshots: DataFrame, season: DataFrame, playoff: bool = False) -> DataFrame:
    """Every side of a season hosting every side of it, itself included, as model input rows.

    The output is sides squared per season by definition.  ``season``: year, hca, num_games_into_season.
    """
    names = {"rating": ("team_rating", "opponent_rating"), "last_year_rating": ("last_year_team_rating", "last_year_opp_rating"),
             **{f"last_{n}": (f"team_last_{n}_rating", f"opponent_last_{n}_rating") for n in (10, 5, 3, 1)},
             "win_total_future": ("team_win_total_future", "opponent_win_total_future"),
             "bayesian_gs": ("team_bayesian_gs", "opp_bayesian_gs")}
    home = snapshots.select("year", F.col("club").alias("team"), *[F.col(c).alias(h) for c, (h, _) in names.items()])
    away = snapshots.select("year", F.col("club").alias("opponent"), *[F.col(c).alias(a) for c, (_, a) in names.items()])
    return home.join(away, "year").join(season, "year").withColumns({
        "team_days_since_most_recent_game": F.lit(REST_DEFAULT), "opponent_days_since_most_recent_game": F.lit(REST_DEFAULT),
        "playoff": F.lit(int(playoff))})


def predictive_ratings(features: DataFrame, margin_model: Scorer, edges: DataFrame | None = None, playoff: bool = False,
                       biases: DataFrame | None = None, games: DataFrame | None = None) -> DataFrame:
    """Mean predicted margin of each side over hosting and visiting everyone, centred per season.

    A side's away margin against a rival is the rival's home margin against it, negated; so one scoring of
    the round robin serves both halves.  ``games`` are the plain rows behind ``features``; counting those spares
    a second run of the features.
    """
    season = (features if games is None else games).groupBy("year").agg(F.count_if("completed").alias("num_games_into_season"))
    known = season.select("year", F.lit(HCA_PRIOR).alias("hca")) if edges is None else edges.select("year", "hca")
    season = season.join(known, "year", "left").fillna(HCA_PRIOR, ["hca"])
    pairs = round_robin(team_snapshots(features), season, playoff)
    scored = _scored(pairs, margin_model, biases).select("year", "team", "opponent", "pred_margin")
    sides = both_sides(scored, {"year": F.col("year"), "team": F.col("team"), "m": F.col("pred_margin")},
                       {"year": F.col("year"), "team": F.col("opponent"), "m": -F.col("pred_margin")})
    mean = sides.groupBy("year", "team").agg(F.avg("m").alias("m"))
    centre = mean.groupBy("year").agg(F.avg("m").alias("c"))
    return (mean.join(centre, "year").select("year", "team", (F.col("m") - F.col("c")).alias("expected_margin"))
            .withColumn("playoff", F.lit(int(playoff))))


def linear_margin() -> Column:
    """Stand-in model: rating difference plus home edge."""
    return F.col("team_rating") - F.col("opponent_rating") + F.col("hca")


def logistic_win(scale: float = 10.0) -> Column:
    return S.sigmoid(F.col("pred_margin") / scale)
