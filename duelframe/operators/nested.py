"""Bracket results between nested and flat form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from .scenarios import HOST_AT_HOME

_GAME = ["game_num", "home", "away", "margin", "winner"]


def series_rows(series: DataFrame) -> DataFrame:
    """Settled series as one row each with an array of games; round and conference from the label."""
    at_home = F.array(*[F.lit(x) for x in HOST_AT_HOME])

    def game(margin: Column, i: Column) -> Column:
        hosted = F.element_at(at_home, (i + 1).cast("int"))
        home = F.when(hosted, F.col("host")).otherwise(F.col("guest"))
        away = F.when(hosted, F.col("guest")).otherwise(F.col("host"))
        return F.struct((i + 1).cast("int").alias("game_num"), home.alias("home"), away.alias("away"),
                        margin.alias("margin"), S.winner(margin, home, away).alias("winner"))

    label = F.col("label")
    return series.select(
        "sim_id", label.alias("series_label"), S.series_round(label).alias("round"), S.series_conference(label).alias("conference"),
        "high_seed", "low_seed", "high_seed_num", "low_seed_num", F.col("winner").alias("series_winner"),
        F.col("loser").alias("series_loser"), "series_length", F.transform("margins", game).alias("games"))


def assemble_series(games: DataFrame, seeds: DataFrame) -> DataFrame:
    """Series from labelled game rows; groups that do not have exactly two sides are left out.

    ``games``: sim_id, playoff_label, date, game_id, team, opponent, margin.  ``seeds``: sim_id, team, seed
    (99 when unknown).
    """
    won = S.winner(F.col("margin"), F.col("team"), F.col("opponent"))
    packed = games.filter(F.col("playoff_label").isNotNull()).groupBy("sim_id", F.col("playoff_label").alias("series_label")).agg(
        F.min(F.least("team", "opponent")).alias("a"), F.max(F.greatest("team", "opponent")).alias("b"),
        F.count_distinct(F.struct(F.least("team", "opponent"), F.greatest("team", "opponent"))).alias("pairings"),
        # a best-of-seven series has at most seven games
        F.sort_array(F.collect_list(F.struct("date", "game_id", F.col("team").alias("home"), F.col("opponent").alias("away"),
                                             "margin", won.alias("winner")))).alias("g"))
    two = packed.filter((F.col("pairings") == 1) & (F.col("a") != F.col("b")))
    sa = seeds.select("sim_id", F.col("team").alias("a"), F.col("seed").alias("sa"))
    sb = seeds.select("sim_id", F.col("team").alias("b"), F.col("seed").alias("sb"))
    both = two.join(sa, ["sim_id", "a"], "left").join(sb, ["sim_id", "b"], "left").fillna(99, ["sa", "sb"])
    first = F.col("sa") <= F.col("sb")
    last = F.element_at("g", -1)["winner"]
    games_array = F.transform("g", lambda x, i: F.struct((i + 1).cast("int").alias("game_num"), x["home"].alias("home"),
                                                         x["away"].alias("away"), x["margin"].alias("margin"), x["winner"].alias("winner")))
    label = F.col("series_label")
    return both.select(
        "sim_id", "series_label", S.series_round(label).alias("round"), S.series_conference(label).alias("conference"),
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("high_seed"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("low_seed"),
        F.least("sa", "sb").alias("high_seed_num"), F.greatest("sa", "sb").alias("low_seed_num"), last.alias("series_winner"),
        F.when(last == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("series_loser"),
        F.size("g").alias("series_length"), games_array.alias("games"))


def series_metrics(series: DataFrame) -> DataFrame:
    wins = F.size(F.filter("games", lambda g: g["winner"] == F.col("series_winner")))
    return series.select("sim_id", "series_label", F.size("games").alias("length"), wins.alias("winner_wins"),
                         (F.size("games") - wins).alias("loser_wins"))


def flatten_games(series: DataFrame, year: int | Column) -> DataFrame:
    """One row per game, seventeen columns."""
    when = year if isinstance(year, Column) else F.lit(year)
    # the outer form keeps Spark from copying the whole games expression into an inferred size filter
    rows = series.withColumn("g", F.explode_outer("games")).filter("g IS NOT NULL")
    return rows.select(
        "sim_id", when.cast("int").alias("year"), "round", "conference", "series_label", "high_seed", "low_seed", "high_seed_num",
        "low_seed_num", "series_winner", "series_loser", "series_length", *[F.col(f"g.{c}").alias(c) for c in _GAME])


def rebuild_results(flat: DataFrame) -> DataFrame:
    """One row per scenario: ordered series with their games, seeds, conferences and champion.

    Seeds and conferences only cover sides present in the bracket.
    """
    per_series = flat.groupBy("sim_id", "year", "series_label").agg(
        F.sort_array(F.collect_list(F.struct(*_GAME))).alias("games"),
        *[F.first(c).alias(c) for c in ("round", "conference", "high_seed", "low_seed", "high_seed_num", "low_seed_num",
                                        "series_winner", "series_loser")])
    order = S.series_round_order(F.col("series_label"))
    body = F.struct(order.alias("o"), "series_label", "round", "conference", "high_seed", "low_seed", "high_seed_num",
                    "low_seed_num", F.col("series_winner"), "series_loser", "games")
    # a bracket has fifteen series and six play-in games
    sims = per_series.groupBy("sim_id", "year").agg(
        F.sort_array(F.collect_list(body)).alias("series"),
        F.max(F.when(F.col("series_label") == "Finals", F.col("series_winner"))).alias("champion"))
    first_of = lambda arr, key: F.aggregate(
        arr, F.slice(arr, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: y[key] == x[key]), acc).otherwise(F.concat(acc, F.array(x))))
    seeds = F.flatten(F.transform("series", lambda s: F.array(
        F.struct(s["high_seed"].alias("team"), s["high_seed_num"].alias("seed")),
        F.struct(s["low_seed"].alias("team"), s["low_seed_num"].alias("seed")))))
    sides = F.flatten(F.transform(F.filter("series", lambda s: s["conference"] != "Inter"), lambda s: F.array(
        F.struct(s["high_seed"].alias("team"), s["conference"].alias("conference")),
        F.struct(s["low_seed"].alias("team"), s["conference"].alias("conference")))))
    return sims.select("sim_id", "year", "series", F.map_from_entries(first_of(seeds, "team")).alias("seeds"),
                       F.map_from_entries(first_of(sides, "team")).alias("conference_of"), "champion")


def renumbered(flat: DataFrame) -> DataFrame:
    """Scenario numbers 0..n-1 in the old order.

    Ranks are counted per block of a thousand numbers and the block counts added up, so no task holds all.
    """
    from .scan import blocked_scan

    ids = flat.select("sim_id").distinct().withColumns({"__all": F.lit(0), "__block": F.floor(F.col("sim_id") / 1000)})
    ranks = blocked_scan(ids, ["__all"], "__block", ["sim_id"], position="__rank")
    table = ranks.select(F.col("sim_id").alias("__old"), (F.col("__rank") - 1).alias("__new"))
    joined = flat.join(table, flat["sim_id"] == table["__old"])
    return joined.select(*[F.col("__new").alias("sim_id") if c == "sim_id" else F.col(c) for c in flat.columns])
