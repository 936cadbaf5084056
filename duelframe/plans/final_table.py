"""The season table: ratings, efficiencies, records, projections and odds, one row per side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import record_text
from ..operators import ratings, records

COLUMNS = ["Rank", "Team", "Record", "EM Rating", "Predictive Rating", "Projected Record", "AdjO", "AdjD", "Pace", "RSOS",
           "Playoffs", "Conference Semis", "Conference Finals", "Finals", "Champion"]


def team_statistics(completed: DataFrame, names: DataFrame, em: DataFrame) -> DataFrame:
    """Rating, record and efficiencies.  ``names``: team, team_name.  ``em``: team, rating.  One season."""
    one = completed.withColumn("__season", F.lit(0))
    key = ["__season"]
    parts = [records.team_records(one, key), records.team_pace(one, key), records.efficiencies(one, key),
             ratings.adjusted_efficiencies(one, key)]
    out = names.join(em.withColumnRenamed("rating", "em_rating"), "team", "left")
    for part in parts:
        out = out.join(part.drop("__season"), "team", "left")
    out = out.fillna(0, ["wins", "losses"]).fillna(0.0, ["pace", "off_eff", "def_eff", "adj_off", "adj_def"])
    games = F.col("wins") + F.col("losses")
    return out.select("team", "team_name", "em_rating", "wins", "losses",
                      (F.col("wins") / F.nullif(games, F.lit(0))).alias("win_pct"), "pace", (F.col("off_eff") * 100).alias("off_eff"),
                      (F.col("def_eff") * 100).alias("def_eff"), F.col("adj_off").alias("adj_off_eff"), F.col("adj_def").alias("adj_def_eff"))


def final_table(stats: DataFrame, predictive: DataFrame, report: DataFrame, future: DataFrame) -> DataFrame:
    """``predictive``: team, predictive_rating.  ``report``: scenario report.  ``future``: open games."""
    strength = records.remaining_schedule(predictive, future)
    odds = report.select("team", F.col("wins").alias("expected_wins"), F.col("losses").alias("expected_losses"), "playoffs",
                         "second_round", "conference_finals", "finals", "champion")
    joined = stats.join(predictive, "team").join(odds, "team").join(strength, "team", "left")
    return format_table(records.ranked(joined, "predictive_rating"))


def _one_digit(value: Column) -> Column:
    return F.format_string("%.1f", F.round(value, 1))


def format_table(df: DataFrame) -> DataFrame:
    """Report names, rounding and record strings; unknown schedule strength shows 0."""
    return df.select(
        F.col("rank").alias("Rank"), F.col("team_name").alias("Team"), record_text(F.col("wins"), F.col("losses")).alias("Record"),
        F.round("em_rating", 2).alias("EM Rating"), F.round("predictive_rating", 2).alias("Predictive Rating"),
        F.concat_ws("-", _one_digit(F.col("expected_wins")), _one_digit(F.col("expected_losses"))).alias("Projected Record"),
        F.round("adj_off_eff", 2).alias("AdjO"), F.round("adj_def_eff", 2).alias("AdjD"), F.round("pace", 2).alias("Pace"),
        F.coalesce(F.round("remaining_sos", 2), F.lit(0.0)).alias("RSOS"), F.round("playoffs", 3).alias("Playoffs"),
        F.round("second_round", 3).alias("Conference Semis"), F.round("conference_finals", 3).alias("Conference Finals"),
        F.round("finals", 3).alias("Finals"), F.round("champion", 3).alias("Champion")).orderBy("Rank")
