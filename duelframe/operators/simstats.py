"""Probabilities and summaries over scenarios.

Every job aggregates per scenario rows to counts before anything is pivoted or ordered.
``results`` always means one row per scenario and series (see ``nested.series_rows``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import exact_percentiles, histogram
from .perspective import team_view

WIN_MARKS = (50, 55, 60, 65, 70)
ROUND_COLUMNS = {"R1": "playoffs", "CONF_SEMIS": "second_round", "CONF_FINALS": "conference_finals", "FINALS": "finals"}
SEEDS = tuple(range(1, 16))
REPORT_ORDER = ["champion", "finals", "conference_finals", "second_round", "playoffs"]


def sim_count(df: DataFrame) -> DataFrame:
    """One row: the number of scenarios."""
    return df.select("sim_id").distinct().agg(F.count(F.lit(1)).alias("n_sims"))


def _share(df: DataFrame, sims: DataFrame, count: str = "n") -> DataFrame:
    return df.join(F.broadcast(sims)).withColumn("p", F.col(count) / F.col("n_sims")).drop("n_sims", count)  # one row


# ---- seasons -----------------------------------------------------------------------------------


def season_report(wins: DataFrame) -> DataFrame:
    """Mean, median, deviation, percentiles and threshold shares of season wins.  ``wins``: sim_id, team, wins, losses."""
    marks = [F.avg((F.col("wins") >= m).cast("double")).alias(f"prob_{m}_plus") for m in WIN_MARKS]
    plain = wins.groupBy("team").agg(F.avg("wins").alias("wins"), F.avg("losses").alias("losses"),
                                     F.stddev_pop("wins").alias("wins_std"), *marks)
    ranks = exact_percentiles(wins, ["team"], "wins", {"wins_median": 0.5, "wins_10th": 0.1, "wins_90th": 0.9})
    return plain.join(ranks, "team")


def round_odds(results: DataFrame) -> DataFrame:
    """Share of scenarios in which a side plays each round and wins the title."""
    side = F.explode(F.array("high_seed", "low_seed")).alias("team")
    seen = results.filter(F.col("round") != "PLAY_IN").select("sim_id", "round", side)
    reached = seen.groupBy("team", "round").agg(F.count_distinct("sim_id").alias("n"))
    titles = (results.filter(F.col("round") == "FINALS").groupBy(F.col("series_winner").alias("team"))
              .agg(F.count(F.lit(1)).alias("n")).withColumn("round", F.lit("CHAMPION")))
    names = {**ROUND_COLUMNS, "CHAMPION": "champion"}
    table = _share(reached.unionByName(titles), sim_count(results))
    wide = table.groupBy("team").pivot("round", list(names)).agg(F.first("p")).fillna(0.0)
    return wide.select("team", *[F.col(k).alias(v) for k, v in names.items()])


def sim_report(wins: DataFrame, results: DataFrame) -> DataFrame:
    """Season statistics joined with title odds, best odds first."""
    columns = ["team", "wins", "losses", "wins_median", "wins_std", "wins_10th", "wins_90th",
               *[f"prob_{m}_plus" for m in WIN_MARKS], *REPORT_ORDER]
    return (season_report(wins).join(round_odds(results), "team").select(*columns)
            .orderBy(*[F.col(c).desc() for c in REPORT_ORDER], "team"))


def seed_report(seeds: DataFrame) -> DataFrame:
    """Share of each seed per side, all later seeds in ``seed_later``.  ``seeds``: sim_id, team, seed."""
    share = lambda hit: F.count_if(hit) / F.count(F.lit(1))
    shares = seeds.groupBy("team").agg(*[share(F.col("seed") == s).alias(f"seed_{s}") for s in SEEDS],
                                       share(F.col("seed") > SEEDS[-1]).alias("seed_later"))
    return shares.orderBy(*[F.col(f"seed_{s}").desc() for s in SEEDS], "team")


def wins_matrix(wins: DataFrame, teams: Sequence) -> DataFrame:
    """One row per scenario, one column per side.  The list of sides fixes the columns."""
    return wins.groupBy("sim_id").pivot("team", list(teams)).agg(F.first("wins"))


def first_sims(log: DataFrame, n: int = 1000, column: str = "simulation_id") -> DataFrame:
    """Rows of the ``n`` lowest scenario numbers, scenario number first."""
    keep = log.select(column).distinct().orderBy(column).limit(n)
    rest = [c for c in log.columns if c != column]
    return log.join(keep, column, "left_semi").select(column, *rest)


def win_distribution(wins: DataFrame) -> DataFrame:
    """Share and cumulative share for every win total between a side's lowest and highest."""
    counts = wins.groupBy("team", "wins").agg(F.count(F.lit(1)).alias("n"))
    span = counts.groupBy("team").agg(F.min("wins").alias("lo"), F.max("wins").alias("hi"), F.sum("n").alias("total"))
    grid = span.select("team", "total", F.explode(F.sequence("lo", "hi")).alias("wins"))
    w = W.partitionBy("team").orderBy("wins")  # one row per win total
    pct = 100 * F.coalesce("n", F.lit(0)) / F.col("total")
    return (grid.join(counts, ["team", "wins"], "left")
            .select("team", "wins", pct.alias("pct"),
                    (100 * F.sum(F.coalesce("n", F.lit(0))).over(w) / F.col("total")).alias("cum_pct")))


def win_summary(wins: DataFrame) -> DataFrame:
    plain = wins.groupBy("team").agg(F.avg("wins").alias("mean"), F.stddev_samp("wins").alias("std"))
    return plain.join(exact_percentiles(wins, ["team"], "wins", {"median": 0.5, "p10": 0.1, "p90": 0.9}), "team")


# ---- game log ----------------------------------------------------------------------------------


def rating_band(log: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean and percentile band of each side's rating by date."""
    sides = team_view(log, keep=["date"])
    plain = sides.groupBy("club", "date").agg(F.avg("rating").alias("mean"), F.count("rating").alias("n"))
    return plain.join(exact_percentiles(sides, ["club", "date"], "rating", {"low": low, "high": high}), ["club", "date"])


def expected_margin_band(log: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Expected margin per game seen from each side, rounded to one digit."""
    keys = ["club", "date", "rival", "is_home"]
    sides = team_view(log, keep=["date"])
    plain = sides.groupBy(*keys).agg(F.avg("expected_margin_for_club").alias("mean_margin"), F.count(F.lit(1)).alias("n"))
    band = exact_percentiles(sides, keys, "expected_margin_for_club", {"low_margin": low, "high_margin": high})
    return plain.join(band, keys).select(*keys, *[F.round(c, 1).alias(c) for c in ("mean_margin", "low_margin", "high_margin")], "n")


def game_summary(log: DataFrame) -> DataFrame:
    """Win share, margin mean and deviation, mean expectation and scenario count per game and side."""
    m = F.col("margin_for_club")
    return team_view(log, keep=["date"]).groupBy("club", "date", "rival", "is_home").agg(
        (100 * F.avg((m > 0).cast("double"))).alias("win_pct"), F.avg(m).alias("mean_margin"),
        F.stddev_samp(m).alias("std_margin"), F.avg("expected_margin_for_club").alias("mean_expected"),
        F.count(F.lit(1)).alias("n_sims"))


def margin_histogram(log: DataFrame, bins: int = 30) -> DataFrame:
    return histogram(team_view(log), "margin_for_club", bins, ["club"])


def last_regular_date(log: DataFrame) -> DataFrame:
    return log.agg(F.max(F.when(F.col("playoff") == 0, F.col("date"))).alias("last_regular_date"))


# ---- brackets ----------------------------------------------------------------------------------


def p_champion(results: DataFrame) -> DataFrame:
    won = results.filter(F.col("round") == "FINALS").groupBy(F.col("series_winner").alias("team")).agg(F.count(F.lit(1)).alias("n"))
    return _share(won, sim_count(results)).withColumnRenamed("p", "p_champion")


def p_reaches_round(results: DataFrame, target: str) -> DataFrame:
    side = F.explode(F.array("high_seed", "low_seed")).alias("team")
    seen = results.filter(F.col("round") == target).select("sim_id", side)
    return _share(seen.groupBy("team").agg(F.count_distinct("sim_id").alias("n")), sim_count(results))


def p_wins_round(results: DataFrame, target: str) -> DataFrame:
    won = results.filter(F.col("round") == target).groupBy(F.col("series_winner").alias("team")).agg(F.count(F.lit(1)).alias("n"))
    return _share(won, sim_count(results))


def p_matchup(results: DataFrame, target: str) -> DataFrame:
    met = results.filter(F.col("round") == target).groupBy("high_seed", "low_seed").agg(F.count(F.lit(1)).alias("n"))
    return _share(met, sim_count(results))


def loser_wins() -> Column:
    """Games the series loser won."""
    return F.col("series_length") - F.size(F.filter("games", lambda g: g["winner"] == F.col("series_winner")))


def p_series_outcome(results: DataFrame, target: str) -> DataFrame:
    """Share of each outcome among the scenarios that had the matchup."""
    key = F.concat(F.col("series_winner").cast("string"), F.lit("_4-"), loser_wins().cast("string"))
    counts = (results.filter(F.col("round") == target).groupBy("high_seed", "low_seed", key.alias("outcome"))
              .agg(F.count(F.lit(1)).alias("n")))
    w = W.partitionBy("high_seed", "low_seed")  # a handful of outcomes
    return counts.select("high_seed", "low_seed", "outcome", (F.col("n") / F.sum("n").over(w)).alias("p"))


def p_series_length(results: DataFrame) -> DataFrame:
    """Share of each side's series that took 4, 5, 6 or 7 games."""
    side = F.explode(F.array("high_seed", "low_seed")).alias("team")
    rows = results.filter(F.col("round") != "PLAY_IN").select(side, "series_length")
    share = lambda k: (F.count_if(F.col("series_length") == k) / F.count(F.lit(1))).alias(f"p_{k}")
    return rows.groupBy("team").agg(*[share(k) for k in (4, 5, 6, 7)])


def expected_games(results: DataFrame) -> DataFrame:
    side = F.explode(F.array("high_seed", "low_seed")).alias("team")
    total = (results.filter(F.col("round") != "PLAY_IN").select(side, "series_length").groupBy("team")
             .agg(F.sum("series_length").alias("n")))
    return _share(total, sim_count(results)).withColumnRenamed("p", "expected_games")


def bracket_summary(results: DataFrame) -> DataFrame:
    """Odds of reaching each later round and of the title, in one pass over the scenarios."""
    odds = round_odds(results)
    later = odds.select("team", F.col("second_round").alias("p_reach_r2"), F.col("conference_finals").alias("p_reach_cf"),
                        F.col("finals").alias("p_reach_finals"), F.col("champion").alias("p_champion"))
    any_ = F.greatest("p_reach_r2", "p_reach_cf", "p_reach_finals", "p_champion") > 0
    return later.filter(any_).orderBy(F.col("p_champion").desc(), "team")


def matchup_table(results: DataFrame, target: str) -> DataFrame:
    """Each matchup's share with its outcomes as one map column per matchup."""
    outcome = p_series_outcome(results, target).groupBy("high_seed", "low_seed").agg(
        # at most eight outcomes per matchup
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "p")))).alias("outcomes"))
    return (p_matchup(results, target).join(outcome, ["high_seed", "low_seed"])
            .select("high_seed", "low_seed", F.col("p").alias("p_matchup"), "outcomes")
            .orderBy(F.col("p_matchup").desc(), "high_seed", "low_seed"))


def slot_candidates(results: DataFrame) -> DataFrame:
    """Per bracket slot and side: wins by series length and the seed of its first scenario with one."""
    bracket = results.filter(F.col("round") != "PLAY_IN")
    slot = ["round", "conference", F.col("series_label").alias("slot")]
    sides = bracket.select("sim_id", *slot, "series_length", "series_winner", F.explode(F.array(
        F.struct(F.col("high_seed").alias("team"), F.col("high_seed_num").alias("seed")),
        F.struct(F.col("low_seed").alias("team"), F.col("low_seed_num").alias("seed")))).alias("s"))
    won = F.col("series_winner") == F.col("s.team")
    seeded = F.when(F.col("s.seed") != 0, F.col("sim_id"))
    out = sides.groupBy("round", "conference", "slot", F.col("s.team").alias("team")).agg(
        F.min_by("s.seed", seeded).alias("seed"),
        *[F.count_if(won & (F.col("series_length") == k)).alias(f"w{k}") for k in (4, 5, 6, 7)])
    return out.filter(F.col("w4") + F.col("w5") + F.col("w6") + F.col("w7") > 0)


def slot_document(results: DataFrame, years: Sequence[int], actual: DataFrame | None = None) -> DataFrame:
    """One JSON document per season with all slots; each sized by slots times sides.

    ``actual``: real series with their ``year``; seasons without one hold the candidates alone.
    """
    wins = F.array("w4", "w5", "w6", "w7")
    total = F.col("w4") + F.col("w5") + F.col("w6") + F.col("w7")
    cand = slot_candidates(results).groupBy("round", "conference", "slot").agg(
        F.sort_array(F.collect_list(F.struct((-total).alias("o"), "team", "seed", wins.alias("wins")))).alias("c"))
    cand = cand.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]).cast("array<int>")))
    slot = ["year", "round", "conference", "slot"]
    if actual is None:
        series = F.struct(F.lit("not_started").alias("status"), F.lit(None).cast("map<string,bigint>").alias("games_won"))
        joined = cand.withColumn("series", series)
    else:
        known = actual.select(*slot, "status", F.create_map(
            F.col("team_a").cast("string"), "lo_wins", F.col("team_b").cast("string"), "hi_wins").alias("games_won"))
        # several real matchups may fall on one slot; the last by its sides is kept
        known = known.groupBy(*slot).agg(
            F.max_by(F.struct("status", "games_won"), F.map_keys("games_won")).alias("series"))
        blank = F.struct(F.lit("not_started").alias("status"), F.lit(None).cast("map<string,bigint>").alias("games_won"))
        joined = cand.join(known, slot, "left").withColumn("series", F.coalesce("series", blank))
    candidates = F.transform("c", lambda x: F.struct(x["team"].alias("team"), x["seed"].alias("seed"), x["wins"].alias("wins")))
    slots = joined.groupBy("year").agg(F.sort_array(F.collect_list(F.struct(
        "round", "conference", "slot", candidates.alias("candidates"), F.to_json("series").alias("series")))).alias("slots"))
    doc = F.struct("year", "n_sims", F.transform("slots", lambda s: F.struct(
        s["round"].alias("round"), s["conference"].alias("conference"), s["slot"].alias("slot"), s["candidates"].alias("candidates"),
        F.from_json(s["series"], "status string, games_won map<string,bigint>").alias("series"))).alias("slots"))
    return slots.join(F.broadcast(sim_count(results))).select("year", F.to_json(doc).alias("document"))  # one row of counts


def concentration(odds: DataFrame, keys: Sequence[str], p: str = "p") -> DataFrame:
    """Favourite and its odds, share of the five best, and 1 over the sum of squared odds."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy(F.col(p).desc(), F.col("team"))  # one row per side
    top = odds.withColumn("rn", F.row_number().over(w))
    return top.groupBy(*keys).agg(
        F.max(F.when(F.col("rn") == 1, F.col("team"))).alias("favorite_team"), F.max(p).alias("favorite_odds"),
        (1.0 / F.sum(F.col(p) * F.col(p))).alias("parity_index"),
        F.sum(F.when(F.col("rn") <= 5, F.col(p)).otherwise(0.0)).alias("top_5_share"))
