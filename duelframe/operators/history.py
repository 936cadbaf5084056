"""What was known about each side before a game: recent form, rest, season position, running score.

Every job cuts a side's season into calendar days (see ``scan``).  Games are windowed inside a day, and a
table with one row per side and day, at most 366 rows per side and season, carries state from day to day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..schema import (GAME_SCORE_HCA, GAME_SCORE_PRIOR_WEIGHT, HCA_PRIOR, HCA_PRIOR_WEIGHT, REST_CAP)
from .perspective import both_sides, team_view
from .scan import blocked_scan, day_block, first_per_key

WINDOWS = (10, 5, 3, 1)


def adjusted_margin(margin: Column, rival_rating: Column, edge: float, is_home: Column) -> Column:
    """Own margin plus the opponent's rating, with the home edge taken from the home side."""
    return margin + rival_rating + F.when(is_home, F.lit(-float(edge))).otherwise(F.lit(float(edge)))


def _mean_of_last(recent: Column, n: int) -> Column:
    """Mean of the last ``n`` entries; 0 when there are fewer or one of them is null."""
    total = F.get(recent, F.size(recent) - 1)["v"]
    for i in range(2, n + 1):
        total = total + F.get(recent, F.size(recent) - i)["v"]
    return F.coalesce(total / n, F.lit(0.0))


def side_history(games: DataFrame, windows: Sequence[int] = WINDOWS, hca: float = HCA_PRIOR,
                 score_hca: float = GAME_SCORE_HCA, prior_weight: float = GAME_SCORE_PRIOR_WEIGHT,
                 rest_cap: int = REST_CAP) -> DataFrame:
    """One row per game and side: mean of the last n adjusted margins, rest days, running bayesian score."""
    side = both_sides(
        games,
        {"game_id": F.col("game_id"), "year": F.col("year"), "date": F.col("date"), "club": F.col("team"),
         "is_home": F.lit(True), "margin": F.col("margin"), "rival_rating": F.col("opponent_rating"),
         "last_rating": F.col("last_year_team_rating")},
        {"game_id": F.col("game_id"), "year": F.col("year"), "date": F.col("date"), "club": F.col("opponent"),
         "is_home": F.lit(False), "margin": -F.col("margin"), "rival_rating": F.col("team_rating"),
         "last_rating": F.col("last_year_opp_rating")},
    ).select("game_id", "year", "date", "club", "is_home", "last_rating",
             adjusted_margin(F.col("margin"), F.col("rival_rating"), hca, F.col("is_home")).alias("adj"),
             adjusted_margin(F.col("margin"), F.col("rival_rating"), score_hca, F.col("is_home")).alias("score"))
    return _history_of_sides(side, windows, prior_weight, rest_cap)


def _history_of_sides(side: DataFrame, windows: Sequence[int], prior_weight: float, rest_cap: int) -> DataFrame:
    depth = max(windows)
    cell = ["year", "club", "date"]
    side = side.dropna(subset=cell)  # on both branches below, so that they share one exchange
    order = ["game_id", "is_home"]
    day = W.partitionBy(*cell).orderBy(*order)
    entry = F.struct(F.col("adj").alias("v"))
    earlier = day.rowsBetween(W.unboundedPreceding, -1)
    local = side.withColumns({
        "k": F.row_number().over(day),
        **{f"__lag{i}": F.lag("adj", i).over(day) for i in range(1, depth + 1)},
        "s_in": F.coalesce(F.sum("score").over(earlier), F.lit(0.0)),
        "n_in": F.count("score").over(earlier),
    })
    # the day's previous entries, oldest first, without the places before its first game
    lags = F.array(*[F.struct(F.col(f"__lag{i}").alias("v")) for i in range(depth, 0, -1)])
    known = F.least(F.col("k") - 1, F.lit(depth))
    local = local.withColumn("recent", F.slice(lags, depth + 1 - known, known)).drop(*[f"__lag{i}" for i in range(1, depth + 1)])
    # the last row of a day carries that day's totals, so the day table needs no shuffle of its own
    last = local.withColumn("is_last", F.lead("k").over(day).isNull()).filter("is_last")
    whole = F.concat(F.col("recent"), F.array(entry))
    days = last.select(
        *cell,
        F.slice(whole, F.greatest(F.size(whole) - depth + 1, F.lit(1)), depth).alias("tail"),
        (F.col("s_in") + F.coalesce(F.col("score"), F.lit(0.0))).alias("s_day"),
        (F.col("n_in") + F.col("score").isNotNull().cast("int")).alias("n_day"))
    season = W.partitionBy("year", "club").orderBy("date")
    before = season.rowsBetween(W.unboundedPreceding, -1)
    past = F.flatten("__tails")
    carry = days.withColumn("__tails", F.collect_list("tail").over(season.rowsBetween(-depth, -1))).select(
        *[F.col(c).alias(f"d_{c}") for c in cell],
        F.lag("date").over(season).alias("prev_date"),
        F.coalesce(F.sum("s_day").over(before), F.lit(0.0)).alias("s_prev"),
        F.coalesce(F.sum("n_day").over(before), F.lit(0)).alias("n_prev"),
        F.slice(past, F.greatest(F.size(past) - depth + 1, F.lit(1)), depth).alias("past"))
    # prior: rating of the first home row, else of the first away row
    first_seen = F.struct((~F.col("is_home")).alias("a"), "date", "game_id")
    prior = side.groupBy("year", "club").agg(
        F.coalesce(F.min_by("last_rating", first_seen), F.lit(0.0)).alias("prior")).select(
        F.col("year").alias("p_year"), F.col("club").alias("p_club"), "prior")
    carry = (carry.join(prior, (F.col("d_year") == F.col("p_year")) & (F.col("d_club") == F.col("p_club")))
             .drop("p_year", "p_club"))
    rows = local.join(carry, [F.col(c) == F.col(f"d_{c}") for c in cell])
    recent = F.concat(F.col("past"), F.col("recent"))
    rest = F.when(F.col("k") == 1, F.coalesce(F.least(F.datediff("date", "prev_date"), F.lit(rest_cap)), F.lit(rest_cap))
                  ).otherwise(F.lit(0))
    score = ((F.col("prior") * prior_weight + F.col("s_prev") + F.col("s_in"))
             / (prior_weight + F.col("n_prev") + F.col("n_in")))
    return rows.withColumn("recent", recent).select(
        "game_id", "year", "date", "club", "is_home",
        *[_mean_of_last(F.col("recent"), n).alias(f"last_{n}") for n in windows],
        rest.alias("rest_days"), score.alias("bayesian_gs"))


def attach_history(games: DataFrame, history: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Put both sides' history back on the game row."""
    at = lambda home, c: F.max(F.when(F.col("is_home") == F.lit(home), F.col(c)))
    cols = []
    for n in windows:
        cols += [at(True, f"last_{n}").alias(f"team_last_{n}_rating"),
                 at(False, f"last_{n}").alias(f"opponent_last_{n}_rating")]
    cols += [at(True, "rest_days").alias("team_days_since_most_recent_game"),
             at(False, "rest_days").alias("opponent_days_since_most_recent_game"),
             at(True, "bayesian_gs").alias("team_bayesian_gs"), at(False, "bayesian_gs").alias("opp_bayesian_gs")]
    return games.join(history.groupBy("game_id").agg(*cols), "game_id")


def season_game_number(games: DataFrame) -> DataFrame:
    """League games played in the season strictly before this date."""
    per_day = games.groupBy("year", "date").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("year").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    before = per_day.select("year", "date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("num_games_into_season"))
    return games.join(before, ["year", "date"])


def game_position(games: DataFrame) -> DataFrame:
    """1..n by date inside the season."""
    blocked = games.withColumn("__block", day_block(games))
    return blocked_scan(blocked, ["year"], "__block", ["game_id"], position="game_number").drop("__block")


def team_game_number(games: DataFrame) -> DataFrame:
    """Position of each game in its side's season, one row per side."""
    sides = team_view(games, keep=["game_id", "year", "date"])
    return blocked_scan(sides, ["year", "club"], "date", ["game_id", "is_home"], position="team_game")


def late_season(games: DataFrame, least: int = 40) -> DataFrame:
    """Games in which both sides have reached ``least`` games, this one included."""
    both = team_game_number(games).groupBy("game_id").agg(F.min("team_game").alias("fewest"))
    return games.join(both.filter(F.col("fewest") >= least).select("game_id"), "game_id", "left_semi")


def days_since_last(games: DataFrame, asks: DataFrame, cap: int = REST_CAP) -> DataFrame:
    """For each (team, date) asked: days since the side's latest game strictly before it, at most ``cap``.

    Works on distinct side-days, so its windows are as long as the calendar.
    """
    played = games.select(F.explode(F.array("team", "opponent")).alias("team"), "date").distinct()
    marks = (played.withColumn("played", F.lit(True))
             .unionByName(asks.select("team", "date").distinct().withColumn("played", F.lit(False))))
    days = marks.groupBy("team", "date").agg(F.max("played").alias("played"))
    w = W.partitionBy("team").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("played"), F.col("date")), ignorenulls=True).over(w)
    gap = days.select("team", "date", F.coalesce(F.least(F.datediff("date", last), F.lit(cap)), F.lit(cap)).alias("days"))
    return asks.join(gap, ["team", "date"])


# ---- attribute joins --------------------------------------------------------------------------


def with_prior_ratings(games: DataFrame, end_ratings: DataFrame, predecessors: DataFrame) -> DataFrame:
    """Last season's final rating for both sides; falls back to the predecessor, then the season mean.

    ``end_ratings``: year, team, rating.  ``predecessors``: team, predecessor.
    """
    last = end_ratings.select((F.col("year") + 1).alias("year"), "team", "rating")
    mean = last.groupBy("year").agg(F.avg("rating").alias("__mean"))
    clubs = games.select("year", F.explode(F.array("team", "opponent")).alias("team")).distinct()
    own = last.withColumnRenamed("rating", "__own")
    old = last.select("year", F.col("team").alias("predecessor"), F.col("rating").alias("__old"))
    table = (clubs.join(own, ["year", "team"], "left").join(predecessors, "team", "left")
             .join(old, ["year", "predecessor"], "left").join(mean, "year", "left")
             .select("year", "team", F.coalesce("__own", "__old", "__mean").alias("prior")))
    return join_both(games, table, {"prior": ("last_year_team_rating", "last_year_opp_rating")}, ["year"])


def join_both(games: DataFrame, dim: DataFrame, names: dict[str, tuple[str, str]],
              keys: Sequence[str] = ()) -> DataFrame:
    """Left join a per-side table for the home and the away side.  Catalyst broadcasts it when it is small."""
    keys = list(keys)
    home = dim.select(*keys, "team", *[F.col(c).alias(h) for c, (h, _) in names.items()])
    away = dim.select(*keys, F.col("team").alias("opponent"), *[F.col(c).alias(a) for c, (_, a) in names.items()])
    return games.join(home, [*keys, "team"], "left").join(away, [*keys, "opponent"], "left")


def with_win_totals(games: DataFrame, totals: DataFrame, alternates: DataFrame) -> DataFrame:
    """This and last season's win totals.  ``totals``: year, team, total; ``alternates``: team, alternate.

    Last season: exact name, then the alternate name, then this season's value.
    """
    this = join_both(games, totals, {"total": ("team_win_total_future", "opponent_win_total_future")}, ["year"])
    last = totals.select((F.col("year") + 1).alias("year"), "team", F.col("total").alias("exact"))
    other = (totals.select((F.col("year") + 1).alias("year"), F.col("team").alias("alternate"),
                           F.col("total").alias("alt"))
             .join(alternates, "alternate").select("year", "team", "alt"))
    both = last.join(other, ["year", "team"], "full").select(
        "year", "team", F.coalesce("exact", "alt").alias("last_total"))
    out = join_both(this, both, {"last_total": ("__t", "__o")}, ["year"])
    return out.withColumns({
        "team_win_total_last_year": F.coalesce("__t", "team_win_total_future"),
        "opponent_win_total_last_year": F.coalesce("__o", "opponent_win_total_future")}).drop("__t", "__o")


# ---- home edge --------------------------------------------------------------------------------


def home_edge(games: DataFrame, keys: Sequence[str] = (), prior_mean: float = HCA_PRIOR,
              prior_weight: float = HCA_PRIOR_WEIGHT) -> DataFrame:
    """Home advantage: prior blended with the mean rating-adjusted margin; the prior when there are no games."""
    resid = F.col("margin") - (F.col("team_rating") - F.col("opponent_rating"))
    n = F.count(F.lit(1))
    value = F.coalesce((prior_mean * prior_weight + F.avg(resid) * n) / (prior_weight + n), F.lit(prior_mean))
    return games.groupBy(*keys).agg(value.alias("hca")) if keys else games.agg(value.alias("hca"))


def with_home_edge(games: DataFrame, known: DataFrame) -> DataFrame:
    """Join the stored season values; when any season is missing all are estimated anew.  ``known``: year, hca."""
    missing = games.select("year").distinct().join(known, "year", "left_anti").limit(1).count()
    # a row per season: joined by sorting, a season would be one task
    return games.join(F.broadcast(home_edge(games, ["year"]) if missing else known), "year", "left")


# ---- snapshots --------------------------------------------------------------------------------

SNAPSHOT = ["rating", "last_year_rating", "last_10", "last_5", "last_3", "last_1", "win_total_future", "bayesian_gs"]


def team_snapshots(features: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Each side's latest completed game, else its earliest open one, seen from its own side."""
    keep = {k: F.col(k) for k in [*keys, "completed", "date", "game_id"]}
    home = {**keep, "club": F.col("team"), "rating": F.col("team_rating"),
            "last_year_rating": F.col("last_year_team_rating"),
            **{f"last_{n}": F.col(f"team_last_{n}_rating") for n in WINDOWS},
            "win_total_future": F.col("team_win_total_future"), "bayesian_gs": F.col("team_bayesian_gs")}
    away = {**keep, "club": F.col("opponent"), "rating": F.col("opponent_rating"),
            "last_year_rating": F.col("last_year_opp_rating"),
            **{f"last_{n}": F.col(f"opponent_last_{n}_rating") for n in WINDOWS},
            "win_total_future": F.col("opponent_win_total_future"), "bayesian_gs": F.col("opp_bayesian_gs")}
    days = F.datediff("date", F.lit("1970-01-01").cast("date"))
    order = [F.col("completed").desc(), F.when(F.col("completed"), -days).otherwise(days), F.col("game_id")]
    return first_per_key(both_sides(features, home, away), [*keys, "club"], order).select(*keys, "club", *SNAPSHOT)


# ---- derived model columns --------------------------------------------------------------------


def build_model_features(df: DataFrame) -> DataFrame:
    """Seven differences and five engineered columns."""
    diff = lambda a, b: F.col(a) - F.col(b)
    out = df
    if "team_win_total_last_year" not in df.columns:
        out = out.withColumns({"team_win_total_last_year": F.col("team_win_total_future"),
                               "opponent_win_total_last_year": F.col("opponent_win_total_future")})
    rating = diff("team_rating", "opponent_rating")
    return out.withColumns({
        "rating_diff": rating,
        "last_year_rating_diff": diff("last_year_team_rating", "last_year_opp_rating"),
        **{f"last_{n}_rating_diff": diff(f"team_last_{n}_rating", f"opponent_last_{n}_rating") for n in WINDOWS},
        "bayesian_gs_diff": diff("team_bayesian_gs", "opp_bayesian_gs"),
        "rating_x_season": rating * (F.col("num_games_into_season") / 82.0),
        "win_total_ratio": F.col("team_win_total_future") / (F.col("opponent_win_total_future") + 0.1),
        "trend_1v10_diff": (diff("team_last_1_rating", "team_last_10_rating")
                            - diff("opponent_last_1_rating", "opponent_last_10_rating")),
        "win_total_change_diff": (diff("team_win_total_future", "team_win_total_last_year")
                                  - diff("opponent_win_total_future", "opponent_win_total_last_year")),
        "rating_product": F.col("team_rating") * F.col("opponent_rating"),
    })
