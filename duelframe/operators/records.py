"""Win-loss records, efficiencies and schedule strength."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..schema import SEASON_GAMES
from .perspective import both_sides, team_view
from .scan import first_per_key


def counting(df: DataFrame) -> DataFrame:
    """Played games that count toward the record."""
    played = df.filter(F.col("margin").isNotNull())
    return played.filter(F.col("counts_toward_record")) if "counts_toward_record" in df.columns else played


def _result_sides(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    won = F.col("margin") > 0
    passthrough = {k: F.col(k) for k in keep}
    home = {**passthrough, "team": F.col("team"), "rival": F.col("opponent"), "win": won.cast("int")}
    away = {**passthrough, "team": F.col("opponent"), "rival": F.col("team"), "win": (~won).cast("int")}
    return both_sides(df, home, away)


def team_records(games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wins and losses; a tie is a win for the away side."""
    return (_result_sides(counting(games), keys).groupBy(*keys, "team")
            .agg(F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses")))


def capped_records(games: DataFrame, keys: Sequence[str] = (), limit: int = SEASON_GAMES) -> DataFrame:
    """Record over each side's first ``limit`` games; a tie is a loss for both."""
    df = counting(games)
    passthrough = {k: F.col(k) for k in [*keys, "date", "game_id"]}
    home = {**passthrough, "team": F.col("team"), "is_home": F.lit(True), "win": (F.col("margin") > 0).cast("int")}
    away = {**passthrough, "team": F.col("opponent"), "is_home": F.lit(False), "win": (F.col("margin") < 0).cast("int")}
    first = first_per_key(both_sides(df, home, away), [*keys, "team"],
                          [F.col("date"), F.col("game_id"), F.col("is_home")], limit)
    return first.groupBy(*keys, "team").agg(F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"))


def regular_records(games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return team_records(games.filter(F.col("playoff") == 0), keys)


def efficiencies(games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean points for and against per possession."""
    pace = S.pace_or_default(F.col("pace"))
    passthrough = {k: F.col(k) for k in keys}
    home = {**passthrough, "team": F.col("team"), "own": F.col("team_score") / pace, "other": F.col("opponent_score") / pace}
    away = {**passthrough, "team": F.col("opponent"), "own": F.col("opponent_score") / pace, "other": F.col("team_score") / pace}
    return (both_sides(games, home, away).groupBy(*keys, "team")
            .agg(F.avg("own").alias("off_eff"), F.avg("other").alias("def_eff")))


def team_pace(games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    side = F.explode(F.array("team", "opponent")).alias("team")
    return (games.select(*keys, side, S.pace_or_default(F.col("pace")).alias("pace"))
            .groupBy(*keys, "team").agg(F.avg("pace").alias("pace")))


def pace_summary(games: DataFrame) -> DataFrame:
    """League mean and sample deviation; 100 and 3 when no pace is known."""
    return games.agg(F.coalesce(F.avg("pace"), F.lit(100.0)).alias("mean_pace"),
                     F.coalesce(F.stddev_samp("pace"), F.lit(3.0)).alias("std_pace"))


def remaining_schedule(ratings: DataFrame, future: DataFrame, rating: str = "predictive_rating") -> DataFrame:
    """Mean rating of the opponents still to come; games with an unrated side are skipped."""
    dim = ratings.select("team", F.col(rating).alias("r"))
    known = future.select("team", "opponent").join(dim.select("team"), "team", "left_semi")
    sides = both_sides(known, {"club": F.col("team"), "rival": F.col("opponent")},
                       {"club": F.col("opponent"), "rival": F.col("team")})
    meetings = sides.groupBy("club", "rival").agg(F.count(F.lit(1)).alias("n"))
    rival = dim.select(F.col("team").alias("rival"), "r")
    strength = (meetings.join(rival, "rival").groupBy("club")
                .agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("remaining_sos")))
    return dim.select("team").join(strength.withColumnRenamed("club", "team"), "team", "left")


def adjusted_one_step(games: DataFrame, eff: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One opponent-adjustment step.  As in the original definition the home value subtracts the home
    side's own entry and the away value the away side's rival entry; rows without pace are skipped."""
    played = games.filter(F.col("pace").isNotNull())
    e = eff.select(*keys, "team", "off_eff", "def_eff")
    home_eff = e.select(*keys, "team", F.col("def_eff").alias("h_def"), F.col("off_eff").alias("h_off"))
    away_eff = e.select(*keys, F.col("team").alias("opponent"), F.col("def_eff").alias("a_def"),
                        F.col("off_eff").alias("a_off"))
    joined = played.join(home_eff, [*keys, "team"]).join(away_eff, [*keys, "opponent"])
    own, other = F.col("team_score") / F.col("pace"), F.col("opponent_score") / F.col("pace")
    passthrough = {k: F.col(k) for k in keys}
    sides = both_sides(
        joined,
        {**passthrough, "team": F.col("team"), "o": own - F.col("h_def"), "d": other - F.col("h_off")},
        {**passthrough, "team": F.col("opponent"), "o": other - F.col("a_def"), "d": own - F.col("a_off")},
    )
    return sides.groupBy(*keys, "team").agg(F.avg("o").alias("adj_off"), F.avg("d").alias("adj_def"))


# ---- statistics used by tie-breaks -------------------------------------------------------------


def pair_table(games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both directions of every met pair with wins, losses, games and net points: one pass over the games."""
    df = counting(games.filter(F.col("playoff") == 0))
    passthrough = {k: F.col(k) for k in keys}
    won = (F.col("margin") > 0).cast("int")
    sides = both_sides(
        df,
        {**passthrough, "team": F.col("team"), "rival": F.col("opponent"), "win": won, "net": F.col("margin")},
        {**passthrough, "team": F.col("opponent"), "rival": F.col("team"), "win": 1 - won, "net": -F.col("margin")},
    )
    return sides.groupBy(*keys, "team", "rival").agg(
        F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"),
        F.count(F.lit(1)).alias("games"), F.sum("net").alias("net"))


def head_to_head(games: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return pair_table(games, keys).drop("net")


def tiebreak_stats(pairs: DataFrame, teams: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per side: record, record inside the conference, net points.

    ``pairs`` comes from ``pair_table``; ``teams`` has team, conference, division.
    """
    own = teams.select("team", "conference", "division")
    rival = teams.select(F.col("team").alias("rival"), F.col("conference").alias("rival_conference"))
    inside = (F.col("conference") == F.col("rival_conference")).cast("int")
    return (pairs.join(own, "team").join(rival, "rival")
            .groupBy(*keys, "team", "conference", "division")
            .agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"),
                 F.sum(F.col("wins") * inside).alias("conference_wins"),
                 F.sum(F.col("losses") * inside).alias("conference_losses"),
                 F.sum("net").alias("net_points")))


def with_division_winner(stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """True when no side of the division has more wins; a division is a handful of rows."""
    w = W.partitionBy(*keys, "conference", "division")
    return stats.withColumn("division_winner", F.col("wins") == F.max("wins").over(w))


def conference_top(stats: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    return first_per_key(stats, [*keys, "conference"], [F.col("wins").desc(), F.col("team")], n)


def record_against(pairs: DataFrame, rivals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Wins and losses of every side against the listed rivals (0 when never met)."""
    listed = rivals.select(*keys, F.col("team").alias("rival"))
    met = (pairs.join(listed, [*keys, "rival"], "left_semi").groupBy(*keys, "team")
           .agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses")))
    everyone = pairs.select(*keys, "team").distinct()
    return everyone.join(met, [*keys, "team"], "left").fillna(0, ["wins", "losses"])


def balanced_groups(pairs: DataFrame, groups: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Whether all pairs inside each tied group met equally often and at least once.

    ``groups``: keys, group, team.  Compares met pairs with the number of possible pairs, so pairs that
    never met need not be generated.
    """
    member = groups.select(*keys, "group", "team")
    rival = groups.select(*keys, F.col("group").alias("rival_group"), F.col("team").alias("rival"))
    met = (pairs.join(member, [*keys, "team"]).join(rival, [*keys, "rival"])
           .filter((F.col("group") == F.col("rival_group")) & (F.col("team") < F.col("rival")))
           .groupBy(*keys, "group")
           .agg(F.count(F.lit(1)).alias("met"), F.min("games").alias("lo"), F.max("games").alias("hi")))
    size = member.groupBy(*keys, "group").agg(F.count(F.lit(1)).alias("size"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    balanced = (F.col("met") == possible) & (F.col("lo") == F.col("hi")) & (F.col("lo") > 0)
    return (size.join(met, [*keys, "group"], "left")
            .select(*keys, "group", "size", F.coalesce(balanced, F.lit(False)).alias("balanced")))


def ranked(df: DataFrame, by: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Positions by descending value.  Meant for one row per side, after aggregation."""
    w = W.partitionBy(*keys).orderBy(F.col(by).desc(), F.col("team"))
    return df.withColumn(name, F.row_number().over(w))
