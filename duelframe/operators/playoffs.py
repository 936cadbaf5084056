"""Play-in, bracket and series jobs, keyed by scenario."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..session import materialize
from .perspective import both_sides
from .scan import first_per_key
from .scenarios import Draw, best_of_seven

PLAY_IN_PAIRS = {"P_1": (7, 8), "P_2": (9, 10)}
FIRST_ROUND = ((1, 8), (4, 5), (2, 7), (3, 6))
NEXT_LABEL = {
    "E_1_8": "E_1_4", "E_4_5": "E_1_4", "E_2_7": "E_2_3", "E_3_6": "E_2_3",
    "W_1_8": "W_1_4", "W_4_5": "W_1_4", "W_2_7": "W_2_3", "W_3_6": "W_2_3",
    "E_1_4": "E_1_2", "E_2_3": "E_1_2", "W_1_4": "W_1_2", "W_2_3": "W_1_2", "E_1_2": "Finals", "W_1_2": "Finals",
}


# ---- real post-season games --------------------------------------------------------------------


def post_season_games(games: DataFrame) -> DataFrame:
    """Played post-season games without repeats."""
    played = games.filter((F.col("playoff") == 1) & F.col("margin").isNotNull())
    return first_per_key(played, ["team", "opponent", "date"], [F.col("game_id")])


def first_meetings(games: DataFrame, matchups: DataFrame) -> DataFrame:
    """Earliest post-season game of each proposed pairing, labelled, with winner and loser.

    ``matchups``: label, a, b and any keys.  A game that already carries another label is not taken.
    """
    free = games.withColumn("pair", S.pair_key(F.col("team"), F.col("opponent")))
    if "playoff_label" not in games.columns:
        free = free.withColumn("playoff_label", F.lit(None).cast("string"))
    asked = matchups.withColumn("pair", S.pair_key(F.col("a"), F.col("b")))
    # one candidate per pair and existing label, so that the join stays at matchup size
    candidates = free.groupBy("pair", "playoff_label").agg(
        F.min_by(F.struct("game_id", "date", "team", "opponent", "margin"), F.struct("date", "game_id")).alias("g"))
    fits = F.col("playoff_label").isNull() | (F.col("playoff_label") == F.col("label"))
    hit = asked.join(candidates, "pair", "inner").filter(fits)
    best = hit.groupBy(*matchups.columns).agg(F.min_by("g", F.struct("g.date", "g.game_id")).alias("g"))
    won = S.winner(F.col("g.margin"), F.col("g.team"), F.col("g.opponent"))
    return best.select(*matchups.columns, F.col("g.game_id").alias("game_id"), won.alias("winner"),
                       F.when(won == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"))


def series_records(post: DataFrame) -> DataFrame:
    """Per side and opponent: round index by first meeting, wins and losses."""
    won = (F.col("margin") > 0).cast("int")
    base = {"year": F.col("year"), "date": F.col("date")}
    sides = both_sides(post, {**base, "team": F.col("team"), "rival": F.col("opponent"), "win": won},
                       {**base, "team": F.col("opponent"), "rival": F.col("team"), "win": 1 - won})
    met = sides.groupBy("year", "team", "rival").agg(
        F.min("date").alias("first"), F.sum("win").alias("wins"), F.sum(1 - F.col("win")).alias("losses"))
    order = W.partitionBy("year", "team").orderBy("first", "rival")  # one row per opponent
    return met.select("year", (F.row_number().over(order) - 1).alias("round"), "team", "rival", "wins", "losses")


def playoff_state(seasons: DataFrame, records: DataFrame) -> DataFrame:
    """none, in_progress or completed: a side with four wins in the latest round ends it."""
    top = records.groupBy("year").agg(F.max("round").alias("top"))
    reached = (records.join(top, "year").filter(F.col("round") == F.col("top"))
               .groupBy("year").agg(F.max("wins").alias("most")))
    state = (F.when(F.col("most").isNull(), "none").when(F.col("most") >= 4, "completed").otherwise("in_progress"))
    return seasons.select("year").distinct().join(reached, "year", "left").select("year", state.alias("state"))


def series_winners(labelled: DataFrame) -> DataFrame:
    """Per label: leader, its wins, and whether the series is decided."""
    won = F.coalesce(F.col("winner_name"), S.winner(F.col("margin"), F.col("team"), F.col("opponent")))
    counts = labelled.filter(F.col("playoff_label").isNotNull()).groupBy("playoff_label", won.alias("leader")).agg(
        F.count(F.lit(1)).alias("wins"))
    best = counts.groupBy("playoff_label").agg(F.max_by(F.struct("leader", "wins"), F.struct("wins", "leader")).alias("b"))
    return best.select("playoff_label", "b.leader", "b.wins", (F.col("b.wins") >= 4).alias("decided"))


def trim_decided(future: DataFrame, labelled: DataFrame) -> DataFrame:
    """Drop scheduled games of decided series."""
    decided = series_winners(labelled).filter("decided").select("playoff_label")
    return future.join(decided, "playoff_label", "left_anti")


def actual_series(series: DataFrame, post: DataFrame) -> DataFrame:
    """Real results of each season placed on the bracket slot where scenarios most often had the same two sides."""
    pair = S.pair_key(F.col("high_seed"), F.col("low_seed"))
    slots = (series.filter((F.col("round") != "PLAY_IN") & (F.col("high_seed") != F.col("low_seed")))
             .groupBy(pair.alias("pair"), "round", "conference", F.col("series_label").alias("slot"))
             .agg(F.count(F.lit(1)).alias("n")))
    slot = first_per_key(slots, ["pair"], [F.col("n").desc(), F.col("slot")]).drop("n")
    low_won = S.winner(F.col("margin"), F.col("team"), F.col("opponent")) == F.least("team", "opponent")
    real = (post.filter(F.col("team") != F.col("opponent")).groupBy("year", S.pair_key(F.col("team"), F.col("opponent")).alias("pair"))
            .agg(F.count_if(low_won).alias("lo_wins"), F.count_if(~low_won).alias("hi_wins")))
    most = F.greatest("lo_wins", "hi_wins")
    status = F.when(F.col("lo_wins") + F.col("hi_wins") == 0, "not_started").when(most >= 4, "complete").otherwise("in_progress")
    return real.join(slot, "pair").select("year", "round", "conference", "slot", F.col("pair.lo").alias("team_a"), "lo_wins",
                                          F.col("pair.hi").alias("team_b"), "hi_wins", status.alias("status"))


# ---- scenarios ---------------------------------------------------------------------------------

OneGame = Callable[[Column, Column, Column, Column], Column]


def play_in(seeds: DataFrame, draw: OneGame, post: DataFrame | None = None) -> DataFrame:
    """Final eight seeds per scenario and conference.

    ``seeds``: sim_id, conference (E or W), seed 1..10, team.  7 meets 8 for the seventh place, the loser
    meets the winner of 9 and 10 for the eighth.  Pairings already played keep their real result;
    ``draw(sim_id, label, home, away)`` settles the rest.
    """
    keys = ["sim_id", "conference"]
    slots = seeds.filter(F.col("seed").between(7, 10)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("seed") == i, F.col("team"))).alias(f"s{i}") for i in range(7, 11)])

    def settle(matchups: DataFrame) -> DataFrame:
        drawn = S.winner(draw(F.col("sim_id"), F.col("label"), F.col("a"), F.col("b")), F.col("a"), F.col("b"))
        if post is None:
            won = drawn
            out = matchups
        else:
            real = first_meetings(post, matchups.select("label", "a", "b").distinct()).select(
                "label", "a", "b", F.col("winner").alias("real"))
            out = matchups.join(real, ["label", "a", "b"], "left")
            won = F.coalesce("real", drawn)
        return out.withColumn("winner", won).withColumn(
            "loser", F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")))

    label = lambda suffix: F.concat(F.col("conference"), F.lit(f"_{suffix}"))
    pairs = F.array(*[F.struct(label(s).alias("label"), F.col(f"s{a}").alias("a"), F.col(f"s{b}").alias("b"))
                      for s, (a, b) in PLAY_IN_PAIRS.items()])
    first = settle(slots.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*"))
    upper = F.col("label").endswith("P_1")
    after = first.groupBy(*keys).agg(
        F.max(F.when(upper, F.col("winner"))).alias("seventh"), F.max(F.when(upper, F.col("loser"))).alias("a"),
        F.max(F.when(~upper, F.col("winner"))).alias("b"))
    second = settle(after.withColumn("label", label("P_3")))
    last_two = second.select(*keys, F.explode(F.array(
        F.struct(F.lit(7).alias("seed"), F.col("seventh").alias("team")),
        F.struct(F.lit(8).alias("seed"), F.col("winner").alias("team")))).alias("x")).select(*keys, "x.*")
    return seeds.filter(F.col("seed") <= 6).select(*keys, F.col("seed").cast("int").alias("seed"), "team").unionByName(last_two)


def first_round(seeds: DataFrame) -> DataFrame:
    """1-8, 4-5, 2-7 and 3-6 in each conference; the better seed hosts."""
    keys = ["sim_id", "conference"]
    label = F.lit(None)
    for a, b in FIRST_ROUND:
        label = F.when(F.col("seed").isin(a, b), F.concat(F.col("conference"), F.lit(f"_{a}_{b}"))).otherwise(label)
    return _pair_up(seeds.filter(F.col("seed") <= 8).select(*keys, "seed", "team").withColumn("label", label))


def _pair_up(entrants: DataFrame) -> DataFrame:
    """Two entrants per (sim_id, label) become a series; the lower seed number is high and hosts."""
    pair = entrants.groupBy("sim_id", "label").agg(
        F.min(F.struct("seed", "team")).alias("h"), F.max(F.struct("seed", "team")).alias("l"))
    return pair.select("sim_id", "label", F.col("h.team").alias("host"), F.col("l.team").alias("guest"),
                       F.col("h.team").alias("high_seed"), F.col("l.team").alias("low_seed"),
                       F.col("h.seed").alias("high_seed_num"), F.col("l.seed").alias("low_seed_num"))


def finals_hosts(finals: DataFrame, stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """Host of the last series: more wins, then head-to-head, then net points, then a coin.

    ``stats``: sim_id, team, wins, net_points.  ``pairs``: sim_id, team, rival, wins, losses.
    """
    a = stats.select("sim_id", F.col("team").alias("host"), F.col("wins").alias("aw"), F.col("net_points").alias("an"))
    b = stats.select("sim_id", F.col("team").alias("guest"), F.col("wins").alias("bw"), F.col("net_points").alias("bn"))
    met = pairs.select("sim_id", F.col("team").alias("host"), F.col("rival").alias("guest"),
                       (F.col("wins") - F.col("losses")).alias("met"))
    # tables of all scenarios: rows per scenario are made, so file sizes understate them and a broadcast would be chosen
    joined = (finals.join(a.hint("merge"), ["sim_id", "host"], "left").join(b.hint("merge"), ["sim_id", "guest"], "left")
              .join(met.hint("merge"), ["sim_id", "host", "guest"], "left"))
    zero = F.lit(0.0)
    steps = [F.col("aw") - F.col("bw"), F.col("met"), F.col("an") - F.col("bn")]
    verdict = F.coalesce(*[F.nullif(F.signum(s.cast("double")), zero) for s in steps],
                         F.when(F.xxhash64("sim_id", "host") < F.xxhash64("sim_id", "guest"), 1.0).otherwise(-1.0))
    keep = [c for c in finals.columns if c not in ("host", "guest")]
    return joined.select(*keep, F.when(verdict > 0, F.col("host")).otherwise(F.col("guest")).alias("host"),
                         F.when(verdict > 0, F.col("guest")).otherwise(F.col("host")).alias("guest"))


def bracket(seeds: DataFrame, draw: Draw, stats: DataFrame, pairs: DataFrame,
            played: DataFrame | None = None) -> DataFrame:
    """All series of all scenarios, round by round.  Rows of a scenario stay together: one shuffle in all.

    ``played`` (label, host, host_won, guest_won) carries series that have real games.
    """
    current = first_round(seeds.repartition("sim_id"))
    rounds = []
    for number in range(4):
        if number == 3:
            current = finals_hosts(current, stats, pairs)
        if played is not None:
            current = current.join(played, ["label", "host"], "left").fillna(0, ["host_won", "guest_won"])
        done = materialize(best_of_seven(current, draw))
        rounds.append(done.drop("host_won", "guest_won"))
        if number < 3:
            seed = F.when(F.col("winner") == F.col("high_seed"), F.col("high_seed_num")).otherwise(F.col("low_seed_num"))
            step = S.lookup(F.col("label"), NEXT_LABEL)
            current = _pair_up(done.select("sim_id", step.alias("label"), F.col("winner").alias("team"), seed.alias("seed")))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out
