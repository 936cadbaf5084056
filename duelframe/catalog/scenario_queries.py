"""Scenario fan-out and the summaries over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, history, metrics, records, scenarios, simstats, standings
from ..operators.perspective import all_teams
from .contest import RATED_SQL, noise, noise_sql, r6, rated, rnd, table
from .record_queries import team_dim
from .registry import query

N_SIMS = 50
SEASON = 2001

SCEN_SQL = RATED_SQL + f""", scen AS (SELECT r.game_id, CAST(s.i AS BIGINT) AS sim_id, year, date, team, opponent, playoff, counts_toward_record,
  pred AS expected_margin, pred + 12.0 * {noise_sql('r.game_id', 's.i')} AS margin FROM rated r, range({N_SIMS}) s(i) WHERE NOT completed),
 res AS (SELECT sim_id, team, opponent AS rival, margin > 0 AS win FROM scen WHERE counts_toward_record AND playoff = 0
  UNION ALL SELECT sim_id, opponent, team, NOT (margin > 0) FROM scen WHERE counts_toward_record AND playoff = 0
  UNION ALL SELECT s.i, team, opponent, margin > 0 FROM rated, range({N_SIMS}) s(i) WHERE year = {SEASON} AND completed AND counts_toward_record AND playoff = 0
  UNION ALL SELECT s.i, opponent, team, NOT (margin > 0) FROM rated, range({N_SIMS}) s(i) WHERE year = {SEASON} AND completed AND counts_toward_record AND playoff = 0),
 simw AS (SELECT CAST(sim_id AS BIGINT) AS sim_id, team, CAST(sum(win::INT) AS BIGINT) AS wins, CAST(sum((NOT win)::INT) AS BIGINT) AS losses FROM res GROUP BY ALL)"""


def schedule(spark, sf_dir) -> DataFrame:
    return clean.future_games(rated(spark, sf_dir)).drop("margin").withColumn("expected_margin", F.col("pred"))


def scenario(spark, sf_dir, n_sims: int = N_SIMS) -> DataFrame:
    return scenarios.scenario_games(schedule(spark, sf_dir), n_sims, noise, sigma=12.0)


def played(spark, sf_dir) -> DataFrame:
    return rated(spark, sf_dir).filter((F.col("year") == SEASON) & F.col("completed") & (F.col("playoff") == 0))


def season_wins(spark, sf_dir) -> DataFrame:
    open_games = scenario(spark, sf_dir).filter(F.col("playoff") == 0)
    return scenarios.scenario_records(played(spark, sf_dir), open_games, N_SIMS)


@query("scenario_margins", "M24", SCEN_SQL + f" SELECT game_id, sim_id, {rnd('margin')} AS margin FROM scen")
def scenario_margins(spark, sf_dir):
    return scenario(spark, sf_dir).select("game_id", "sim_id", r6(F.col("margin")).alias("margin"))


@query("scenario_margins_with_spread_and_bias", "M24 A21 M8")
def scenario_margins_with_spread_and_bias(spark, sf_dir):
    """Normal draws, residual spread by season position, and a bias per side and scenario."""
    numbered = history.season_game_number(rated(spark, sf_dir))
    curve = metrics.smoothed_std(numbered, "num_games_into_season", F.col("pred") - F.col("margin"))
    open_games = clean.future_games(numbered).drop("margin").withColumn("expected_margin", F.col("pred"))
    spread = metrics.attach_std(open_games, curve, "num_games_into_season")
    biases = (all_teams(open_games).withColumn("sim_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N_SIMS - 1).cast("bigint"))))
              .withColumn("bias", ((F.col("team") + F.col("sim_id")) % 5 - 2).cast("double")))
    out = scenarios.scenario_games(spread, N_SIMS, sigma=F.col("sigma"), biases=biases, seed=11)
    return out.select("game_id", "sim_id", "expected_margin", "sigma", "margin")


@query("scenario_season_records", "M24 A3", SCEN_SQL + " SELECT * FROM simw")
def scenario_season_records(spark, sf_dir):
    return season_wins(spark, sf_dir)


_P = {"wins_median": 0.5, "wins_10th": 0.1, "wins_90th": 0.9}
REPORT_SQL = (f"{rnd('avg(wins)')} AS wins, {rnd('avg(losses)')} AS losses, {rnd('stddev_pop(wins)')} AS wins_std, "
              + ", ".join(f"{rnd(f'quantile_cont(wins, {p})')} AS {n}" for n, p in _P.items()) + ", "
              + ", ".join(f"{rnd(f'avg((wins >= {m})::INT)')} AS prob_{m}_plus" for m in simstats.WIN_MARKS))


@query("season_report", "A23", SCEN_SQL + f" SELECT team, {REPORT_SQL} FROM simw GROUP BY team")
def season_report(spark, sf_dir):
    out = simstats.season_report(season_wins(spark, sf_dir))
    return out.select("team", *[r6(F.col(c)).alias(c) for c in out.columns if c != "team"])


@query("win_distribution", "A42", SCEN_SQL + f""", c AS (SELECT team, wins, count(*) AS n FROM simw GROUP BY ALL),
 s AS (SELECT team, min(wins) AS lo, max(wins) AS hi, sum(n) AS total FROM c GROUP BY team), g AS (SELECT team, total, unnest(range(lo, hi + 1)) AS wins FROM s)
 SELECT g.team, g.wins, {rnd('100.0 * coalesce(n, 0) / total')} AS pct, {rnd('100.0 * sum(coalesce(n, 0)) OVER (PARTITION BY g.team ORDER BY g.wins) / total')} AS cum_pct
 FROM g LEFT JOIN c ON c.team = g.team AND c.wins = g.wins""")
def win_distribution(spark, sf_dir):
    out = simstats.win_distribution(season_wins(spark, sf_dir))
    return out.select("team", "wins", r6(F.col("pct")).alias("pct"), r6(F.col("cum_pct")).alias("cum_pct"))


@query("win_summary", "A43", SCEN_SQL + f""" SELECT team, {rnd('avg(wins)')} AS mean, {rnd('stddev_samp(wins)')} AS std, {rnd('quantile_cont(wins, 0.5)')} AS median,
 {rnd('quantile_cont(wins, 0.1)')} AS p10, {rnd('quantile_cont(wins, 0.9)')} AS p90 FROM simw GROUP BY team""")
def win_summary(spark, sf_dir):
    out = simstats.win_summary(season_wins(spark, sf_dir))
    return out.select("team", *[r6(F.col(c)).alias(c) for c in out.columns if c != "team"])


def side_ids(spark, sf_dir):
    """The side dimension, one number per side; they name the matrix's columns."""
    return [r.n_nationkey for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]


@query("wins_matrix", "K7", SCEN_SQL + " SELECT sim_id, "
       + ", ".join(f'max(CASE WHEN team = {t} THEN wins END) AS "{t}"' for t in range(25)) + " FROM simw GROUP BY sim_id")
def wins_matrix(spark, sf_dir):
    return simstats.wins_matrix(season_wins(spark, sf_dir), side_ids(spark, sf_dir))


@query("wins_matrix_unpivoted", "S10 S4", SCEN_SQL + " SELECT sim_id, CAST(team AS VARCHAR) AS team, wins FROM simw")
def wins_matrix_unpivoted(spark, sf_dir):
    wide = simstats.wins_matrix(season_wins(spark, sf_dir), side_ids(spark, sf_dir))
    return wide.unpivot("sim_id", [c for c in wide.columns if c != "sim_id"], "team", "wins").filter("wins IS NOT NULL")


# ---- the game log explorer jobs read -----------------------------------------------------------

LOG_SQL = SCEN_SQL + """, log AS (SELECT sim_id AS simulation_id, game_id, date, team, opponent, playoff, margin,
  expected_margin + (sim_id % 7 - 3) / 2.0 AS expected_margin,
  (team * 7 + year) % 13 - 6 + ((sim_id * 13 + team) % 11 - 5) / 4.0 AS team_rating,
  (opponent * 7 + year) % 13 - 6 + ((sim_id * 13 + opponent) % 11 - 5) / 4.0 AS opponent_rating FROM scen),
 ls AS (SELECT simulation_id, date, playoff, team AS club, opponent AS rival, TRUE AS is_home, CAST(margin AS DOUBLE) AS m, CAST(expected_margin AS DOUBLE) AS e, CAST(team_rating AS DOUBLE) AS r FROM log
  UNION ALL SELECT simulation_id, date, playoff, opponent, team, FALSE, -margin, -expected_margin, opponent_rating FROM log)"""


def log(spark, sf_dir) -> DataFrame:
    sim = F.col("sim_id")
    shake = lambda t: ((sim * 13 + F.col(t)) % 11 - 5) / 4.0
    return scenario(spark, sf_dir).select(
        sim.alias("simulation_id"), "game_id", "date", "team", "opponent", "playoff", "margin",
        (F.col("expected_margin") + (sim % 7 - 3) / 2.0).alias("expected_margin"),
        (F.col("team_rating") + shake("team")).alias("team_rating"),
        (F.col("opponent_rating") + shake("opponent")).alias("opponent_rating"))


@query("saved_scenario_games", "K8 W14", LOG_SQL + f""" SELECT simulation_id, game_id, {rnd('margin')} AS margin FROM log WHERE simulation_id < 1000""")
def saved_scenario_games(spark, sf_dir):
    out = simstats.first_sims(log(spark, sf_dir))
    return out.select("simulation_id", "game_id", r6(F.col("margin")).alias("margin"))


@query("rating_band", "A40", LOG_SQL + f""" SELECT club, date, {rnd('avg(r)')} AS mean, count(*) AS n, {rnd('quantile_cont(r, 0.1)')} AS low, {rnd('quantile_cont(r, 0.9)')} AS high FROM ls GROUP BY ALL""")
def rating_band(spark, sf_dir):
    out = simstats.rating_band(log(spark, sf_dir))
    return out.select("club", "date", "n", *[r6(F.col(c)).alias(c) for c in ("mean", "low", "high")])


@query("expected_margin_band", "A41 P31", LOG_SQL + f""" SELECT club, date, rival, is_home, count(*) AS n, {rnd('quantile_cont(e, 0.1)', 1)} AS low_margin, {rnd('quantile_cont(e, 0.9)', 1)} AS high_margin,
 CASE WHEN is_home THEN 'vs ' ELSE '@ ' END || CAST(rival AS VARCHAR) AS label FROM ls WHERE playoff = 0 GROUP BY ALL""")
def expected_margin_band(spark, sf_dir):
    from ..functions.scalar import game_label

    out = simstats.expected_margin_band(log(spark, sf_dir).filter(F.col("playoff") == 0))
    return out.select("club", "date", "rival", "is_home", "n", "low_margin", "high_margin",
                      game_label(F.col("is_home"), F.col("rival")).alias("label"))


@query("game_summary", "A44", LOG_SQL + f""" SELECT club, date, rival, is_home, {rnd('100.0 * avg((m > 0)::INT)')} AS win_pct, {rnd('avg(m)')} AS mean_margin, {rnd('stddev_samp(m)')} AS std_margin,
 {rnd('avg(e)')} AS mean_expected, count(*) AS n_sims FROM ls GROUP BY ALL""")
def game_summary(spark, sf_dir):
    out = simstats.game_summary(log(spark, sf_dir))
    return out.select("club", "date", "rival", "is_home", "n_sims",
                      *[r6(F.col(c)).alias(c) for c in ("win_pct", "mean_margin", "std_margin", "mean_expected")])


@query("margin_histogram", "A45", LOG_SQL + """, mm AS (SELECT club, min(m) AS lo, max(m) AS hi FROM ls GROUP BY club)
 SELECT ls.club, CAST(least(floor((m - lo) * 30 / (hi - lo)), 29) AS INT) AS bin, count(*) AS n FROM ls JOIN mm ON ls.club = mm.club GROUP BY ALL""")
def margin_histogram(spark, sf_dir):
    return simstats.margin_histogram(log(spark, sf_dir))


@query("last_regular_date", "A46", LOG_SQL + " SELECT max(CASE WHEN playoff = 0 THEN date END) AS last_regular_date FROM log")
def last_regular_date(spark, sf_dir):
    return simstats.last_regular_date(log(spark, sf_dir))


@query("expected_wins_and_losses", "A22", SCEN_SQL + f""", pr AS (SELECT game_id, team, opponent, avg((margin > 0)::INT) AS p FROM scen GROUP BY ALL),
 cur AS (SELECT team, sum(w) AS wins, sum(1 - w) AS losses FROM (SELECT team, (margin > 0)::INT AS w FROM rated WHERE year = 2001 AND completed AND counts_toward_record AND playoff = 0
  UNION ALL SELECT opponent, 1 - (margin > 0)::INT FROM rated WHERE year = 2001 AND completed AND counts_toward_record AND playoff = 0) GROUP BY team),
 f AS (SELECT team, sum(p) AS w, sum(1 - p) AS l FROM (SELECT team, p FROM pr UNION ALL SELECT opponent, 1 - p FROM pr) GROUP BY team)
 SELECT cur.team, {rnd('wins + coalesce(w, 0)')} AS expected_wins, {rnd('losses + coalesce(l, 0)')} AS expected_losses FROM cur LEFT JOIN f ON cur.team = f.team""")
def expected_wins_and_losses(spark, sf_dir):
    prob = scenario(spark, sf_dir).groupBy("game_id", "team", "opponent").agg(
        F.avg((F.col("margin") > 0).cast("double")).alias("win_prob"))
    out = scenarios.expected_records(records.team_records(played(spark, sf_dir)), prob)
    return out.select("team", r6(F.col("expected_wins")).alias("expected_wins"), r6(F.col("expected_losses")).alias("expected_losses"))


@query("scenario_standings", "M20 M24")
def scenario_standings(spark, sf_dir):
    open_games = scenario(spark, sf_dir).filter(F.col("playoff") == 0)
    pairs = scenarios.scenario_pairs(played(spark, sf_dir), open_games, N_SIMS)
    return standings.standings_from_pairs(pairs, team_dim(spark, sf_dir), ["sim_id"])


SEED_SQL = SCEN_SQL + """, sd AS (SELECT sim_id, team, row_number() OVER (PARTITION BY sim_id, team % 2 ORDER BY wins DESC, team) AS seed FROM simw)"""


def plain_seeds(spark, sf_dir) -> DataFrame:
    """Seeds by wins and name only, which SQL can follow."""
    wins = season_wins(spark, sf_dir).withColumn("conference", F.col("team") % 2)
    return records.ranked(wins, "wins", ["sim_id", "conference"], "seed").select("sim_id", "team", "seed")


@query("seed_report", "A25 K6", SEED_SQL + " SELECT team, " + ", ".join(f"{rnd(f'count(*) FILTER (seed = {s}) / count(*)')} AS seed_{s}" for s in simstats.SEEDS)
       + f", {rnd('count(*) FILTER (seed > 15) / count(*)')} AS seed_later FROM sd GROUP BY team")
def seed_report(spark, sf_dir):
    out = simstats.seed_report(plain_seeds(spark, sf_dir))
    return out.select("team", *[r6(F.col(c)).alias(c) for c in out.columns if c != "team"])


@query("weekly_concentration", "A50", RATED_SQL + f""", w AS (SELECT year, team, count(*) FILTER (margin > 0) AS n FROM rated WHERE completed GROUP BY ALL),
 o AS (SELECT year, team, n / sum(n) OVER (PARTITION BY year) AS p, row_number() OVER (PARTITION BY year ORDER BY n DESC, team) AS rn FROM w)
 SELECT year, max(CASE WHEN rn = 1 THEN team END) AS favorite_team, {rnd('max(p)')} AS favorite_odds, {rnd('1.0 / sum(p * p)')} AS parity_index,
 {rnd('sum(CASE WHEN rn <= 5 THEN p ELSE 0 END)')} AS top_5_share FROM o GROUP BY year""")
def weekly_concentration(spark, sf_dir):
    won = rated(spark, sf_dir).filter("completed").groupBy("year", "team").agg(F.count_if(F.col("margin") > 0).alias("n"))
    total = won.groupBy("year").agg(F.sum("n").alias("t"))
    odds = won.join(total, "year").select("year", "team", (F.col("n") / F.col("t")).alias("p"))
    out = simstats.concentration(odds, ["year"])
    return out.select("year", "favorite_team", *[r6(F.col(c)).alias(c) for c in ("favorite_odds", "parity_index", "top_5_share")])
