"""History features, attribute joins and home edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import history
from .contest import GAMES_SQL, RATED_SQL, SIDES_SQL, games, r6, rated, rnd
from .registry import query

_W = "OVER (PARTITION BY year, club ORDER BY date, game_id, is_home"


def _last(n: int) -> str:
    frame = f"{_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count(adj) {frame} = {n} THEN avg(adj) {frame} ELSE 0 END AS last_{n}"


HISTORY_SQL = SIDES_SQL + f""", adj AS (SELECT *, m + rival_r + CASE WHEN is_home THEN -2.5 ELSE 2.5 END AS adj,
  m + rival_r + CASE WHEN is_home THEN -3.5 ELSE 3.5 END AS sc FROM sides),
 hist AS (SELECT game_id, year, club, is_home, {', '.join(_last(n) for n in (10, 5, 3, 1))},
  least(coalesce(date_diff('day', lag(date) {_W}), date), 10), 10) AS rest_days,
  (last_r * 5 + coalesce(sum(sc) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (5 + count(sc) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS bayesian_gs
  FROM adj)"""

FEATURES_SQL = HISTORY_SQL + """, totals AS (SELECT DISTINCT year, CAST(t AS BIGINT) AS team, CAST(20 + (t * 3 + year) % 40 AS DOUBLE) AS total
  FROM (SELECT year, team AS t FROM games UNION ALL SELECT year, opponent FROM games)),
 feats AS (SELECT r.*, CAST(rank() OVER (PARTITION BY r.year ORDER BY date) - 1 AS BIGINT) AS num_games_into_season,
  h.last_10 AS team_last_10_rating, a.last_10 AS opponent_last_10_rating, h.last_5 AS team_last_5_rating, a.last_5 AS opponent_last_5_rating,
  h.last_3 AS team_last_3_rating, a.last_3 AS opponent_last_3_rating, h.last_1 AS team_last_1_rating, a.last_1 AS opponent_last_1_rating,
  h.rest_days AS team_days_since_most_recent_game, a.rest_days AS opponent_days_since_most_recent_game,
  h.bayesian_gs AS team_bayesian_gs, a.bayesian_gs AS opp_bayesian_gs,
  tt.total AS team_win_total_future, ot.total AS opponent_win_total_future,
  coalesce(tl.total, tt.total) AS team_win_total_last_year, coalesce(ol.total, ot.total) AS opponent_win_total_last_year, 2.5 AS hca
  FROM rated r JOIN hist h ON h.game_id = r.game_id AND h.is_home JOIN hist a ON a.game_id = r.game_id AND NOT a.is_home
  LEFT JOIN totals tt ON tt.year = r.year AND tt.team = r.team LEFT JOIN totals ot ON ot.year = r.year AND ot.team = r.opponent
  LEFT JOIN totals tl ON tl.year = r.year - 1 AND tl.team = r.team LEFT JOIN totals ol ON ol.year = r.year - 1 AND ol.team = r.opponent)"""


def totals(g: DataFrame) -> DataFrame:
    """Stand-in season win totals for every side of a season."""
    return (g.select("year", F.explode(F.array("team", "opponent")).alias("team")).distinct()
            .withColumn("total", (20 + (F.col("team") * 3 + F.col("year")) % 40).cast("double")))


def features(spark, sf_dir) -> DataFrame:
    """Full feature rows over the stand-in ratings."""
    g = rated(spark, sf_dir)
    full = history.attach_history(g, history.side_history(g))
    full = history.season_game_number(full)
    none = spark.createDataFrame([], "team bigint, alternate bigint")
    return history.with_win_totals(full, totals(g), none).withColumn("hca", F.lit(2.5))


@query("side_history_features", "W1 W2 W5 W6", HISTORY_SQL + " SELECT game_id, year, club, is_home, rest_days, "
       + ", ".join(f"{rnd(c)} AS {c}" for c in ("last_10", "last_5", "last_3", "last_1", "bayesian_gs")) + " FROM hist")
def side_history_features(spark, sf_dir):
    h = history.side_history(rated(spark, sf_dir))
    return h.select("game_id", "year", "club", "is_home", *[r6(F.col(f"last_{n}")).alias(f"last_{n}") for n in (10, 5, 3, 1)],
                    F.col("rest_days").cast("bigint").alias("rest_days"), r6(F.col("bayesian_gs")).alias("bayesian_gs"))


@query("games_into_season", "W3", GAMES_SQL + """ SELECT game_id, CAST(rank() OVER (PARTITION BY year ORDER BY date) - 1 AS BIGINT)
 AS num_games_into_season FROM games""")
def games_into_season(spark, sf_dir):
    return history.season_game_number(games(spark, sf_dir)).select("game_id", "num_games_into_season")


@query("season_game_position", "W4 W16", GAMES_SQL + """ SELECT game_id,
 row_number() OVER (PARTITION BY year ORDER BY date, game_id) AS game_number FROM games""")
def season_game_position(spark, sf_dir):
    return history.game_position(games(spark, sf_dir)).select("game_id", "game_number")


@query("late_season_games", "W7", SIDES_SQL + """, o AS (SELECT game_id, row_number() OVER (PARTITION BY year, club
 ORDER BY date, game_id, is_home) AS rn FROM sides) SELECT game_id FROM o GROUP BY 1 HAVING min(rn) >= 40""")
def late_season_games(spark, sf_dir):
    return history.late_season(rated(spark, sf_dir)).select("game_id")


@query("days_since_last_game", "J9", GAMES_SQL + """, p AS (SELECT DISTINCT team, date FROM games UNION SELECT DISTINCT opponent, date FROM games),
 a AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS team, DATE '2000-06-30' + CAST(s_suppkey % 90 AS INT) AS date FROM supplier)
 SELECT a.team, a.date, least(coalesce(date_diff('day', max(p.date), a.date), 10), 10) AS days
 FROM a LEFT JOIN p ON p.team = a.team AND p.date < a.date GROUP BY a.team, a.date""")
def days_since_last_game(spark, sf_dir):
    asks = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_nationkey").cast("bigint").alias("team"),
        F.date_add(F.lit("2000-06-30").cast("date"), (F.col("s_suppkey") % 90).cast("int")).alias("date")).distinct()
    return history.days_since_last(games(spark, sf_dir), asks).select("team", "date", F.col("days").cast("bigint").alias("days"))


@query("prior_season_ratings", "J2", GAMES_SQL + f""", e AS (SELECT DISTINCT year, t AS team, CAST((t * 11 + year) % 17 AS DOUBLE) AS rating
  FROM (SELECT year, team AS t FROM games UNION ALL SELECT year, opponent FROM games) WHERE t % 6 <> 0),
 l AS (SELECT year + 1 AS year, team, rating FROM e), mn AS (SELECT year, avg(rating) AS m FROM l GROUP BY 1)
 SELECT game_id, {rnd('coalesce(l1.rating, CASE WHEN g.team % 12 = 0 THEN p1.rating END, m)')} AS last_year_team_rating,
 {rnd('coalesce(l2.rating, CASE WHEN g.opponent % 12 = 0 THEN p2.rating END, m)')} AS last_year_opp_rating
 FROM games g LEFT JOIN l l1 ON l1.year = g.year AND l1.team = g.team LEFT JOIN l l2 ON l2.year = g.year AND l2.team = g.opponent
 LEFT JOIN l p1 ON p1.year = g.year AND p1.team = g.team + 1 LEFT JOIN l p2 ON p2.year = g.year AND p2.team = g.opponent + 1
 LEFT JOIN mn ON mn.year = g.year""")
def prior_season_ratings(spark, sf_dir):
    g = games(spark, sf_dir)
    clubs = g.select("year", F.explode(F.array("team", "opponent")).alias("team")).distinct()
    end = clubs.filter(F.col("team") % 6 != 0).withColumn(
        "rating", ((F.col("team") * 11 + F.col("year")) % 17).cast("double"))
    predecessors = clubs.select("team").distinct().filter(F.col("team") % 12 == 0).withColumn("predecessor", F.col("team") + 1)
    out = history.with_prior_ratings(g, end, predecessors)
    return out.select("game_id", *[r6(F.col(c)).alias(c) for c in ("last_year_team_rating", "last_year_opp_rating")])


@query("win_total_features", "J3 J4 S4", GAMES_SQL + """, totals AS (SELECT DISTINCT year, t AS team, CAST(20 + (t * 3 + year) % 40 AS DOUBLE) AS total
  FROM (SELECT year, team AS t FROM games UNION ALL SELECT year, opponent FROM games) WHERE NOT (year % 2 = 1 AND t % 7 = 3))
 SELECT game_id, tt.total AS team_win_total_future, ot.total AS opponent_win_total_future,
 coalesce(tl.total, ta.total, tt.total) AS team_win_total_last_year, coalesce(ol.total, oa.total, ot.total) AS opponent_win_total_last_year
 FROM games r LEFT JOIN totals tt ON tt.year = r.year AND tt.team = r.team LEFT JOIN totals ot ON ot.year = r.year AND ot.team = r.opponent
 LEFT JOIN totals tl ON tl.year = r.year - 1 AND tl.team = r.team LEFT JOIN totals ol ON ol.year = r.year - 1 AND ol.team = r.opponent
 LEFT JOIN totals ta ON ta.year = r.year - 1 AND ta.team = r.team + 1 AND r.team % 2 = 0
 LEFT JOIN totals oa ON oa.year = r.year - 1 AND oa.team = r.opponent + 1 AND r.opponent % 2 = 0""")
def win_total_features(spark, sf_dir):
    g = games(spark, sf_dir)
    some = totals(g).filter(~((F.col("year") % 2 == 1) & (F.col("team") % 7 == 3)))
    alternates = (totals(g).select("team").distinct().filter(F.col("team") % 2 == 0)
                  .withColumn("alternate", F.col("team") + 1))
    return history.with_win_totals(g, some, alternates).select(
        "game_id", "team_win_total_future", "opponent_win_total_future", "team_win_total_last_year",
        "opponent_win_total_last_year")


_HCA = "(2.5 * 20 + avg(margin - (team_rating - opponent_rating)) * count(*)) / (20 + count(*))"


@query("home_edge_by_season", "A8 K11", RATED_SQL + f" SELECT year, {rnd(_HCA)} AS hca FROM rated WHERE completed GROUP BY year")
def home_edge_by_season(spark, sf_dir):
    g = rated(spark, sf_dir).filter("completed")
    return history.home_edge(g, ["year"]).select("year", r6(F.col("hca")).alias("hca"))


@query("home_edge_overall", "A7", RATED_SQL + f" SELECT {rnd(_HCA)} AS hca FROM rated WHERE completed")
def home_edge_overall(spark, sf_dir):
    return history.home_edge(rated(spark, sf_dir).filter("completed")).select(r6(F.col("hca")).alias("hca"))


@query("home_edge_join", "J5", RATED_SQL + f""", e AS (SELECT year, {_HCA} AS h FROM rated WHERE completed GROUP BY year)
 SELECT game_id, {rnd('h')} AS hca FROM rated r JOIN e ON e.year = r.year WHERE completed""")
def home_edge_join(spark, sf_dir):
    known = spark.createDataFrame([(1995, 2.0), (1996, 3.0)], "year int, hca double")
    g = rated(spark, sf_dir).filter("completed")
    return history.with_home_edge(g, known).select("game_id", r6(F.col("hca")).alias("hca"))


_FEATURE_COLUMNS = {
    "rating_diff": "team_rating - opponent_rating",
    "last_year_rating_diff": "last_year_team_rating - last_year_opp_rating",
    "last_10_rating_diff": "team_last_10_rating - opponent_last_10_rating",
    "last_1_rating_diff": "team_last_1_rating - opponent_last_1_rating",
    "bayesian_gs_diff": "team_bayesian_gs - opp_bayesian_gs",
    "rating_x_season": "(team_rating - opponent_rating) * (num_games_into_season / 82.0)",
    "win_total_ratio": "team_win_total_future / (opponent_win_total_future + 0.1)",
    "trend_1v10_diff": "(team_last_1_rating - team_last_10_rating) - (opponent_last_1_rating - opponent_last_10_rating)",
    "win_total_change_diff": "(team_win_total_future - team_win_total_last_year) - (opponent_win_total_future - opponent_win_total_last_year)",
    "rating_product": "team_rating * opponent_rating",
}


@query("model_features", "P13 M27", FEATURES_SQL + " SELECT game_id, "
       + ", ".join(f"{rnd(e)} AS {n}" for n, e in _FEATURE_COLUMNS.items()) + " FROM feats")
def model_features(spark, sf_dir):
    out = history.build_model_features(features(spark, sf_dir))
    return out.select("game_id", *[r6(F.col(n)).alias(n) for n in _FEATURE_COLUMNS])


_SNAP = ["last_10", "last_5", "last_3", "last_1"]


@query("team_snapshots", "J10", FEATURES_SQL + f""", x AS (SELECT year, completed, date, game_id, team AS club, team_rating AS rating, last_year_team_rating AS last_year_rating,
  {', '.join(f'team_{c}_rating AS {c}' for c in _SNAP)}, team_win_total_future AS win_total_future, team_bayesian_gs AS bayesian_gs FROM feats
  UNION ALL SELECT year, completed, date, game_id, opponent, opponent_rating, last_year_opp_rating,
  {', '.join(f'opponent_{c}_rating' for c in _SNAP)}, opponent_win_total_future, opp_bayesian_gs FROM feats)
 SELECT year, club, rating, last_year_rating, {', '.join(f'{rnd(c)} AS {c}' for c in _SNAP)}, win_total_future, {rnd('bayesian_gs')} AS bayesian_gs
 FROM x QUALIFY row_number() OVER (PARTITION BY year, club ORDER BY completed DESC,
  CASE WHEN completed THEN -date_diff('day', DATE '1970-01-01', date) ELSE date_diff('day', DATE '1970-01-01', date) END, game_id) = 1""")
def team_snapshots(spark, sf_dir):
    s = history.team_snapshots(features(spark, sf_dir))
    return s.select("year", "club", "rating", "last_year_rating", *[r6(F.col(c)).alias(c) for c in _SNAP],
                    "win_total_future", r6(F.col("bayesian_gs")).alias("bayesian_gs"))
