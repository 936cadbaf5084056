"""Iterative rating jobs, checked by recursive SQL; tests also check them against per-game loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, ratings, records
from .contest import RATED_SQL, r6, rated, rnd
from .registry import query


def _em_sql(edge: str, cap: float | None, final: str) -> str:
    """The damped iteration, with the same stopping rule per season."""
    clip = (lambda e: f"({e})") if cap is None else (lambda e: f"greatest(least({e}, {cap}), -{cap})")
    return (RATED_SQL.replace("games AS (", "RECURSIVE games AS (", 1) + f""", done AS (SELECT * FROM rated WHERE completed),
 lastd AS (SELECT year, max(date) AS d, {edge} AS hca FROM done GROUP BY year),
 homes AS (SELECT DISTINCT year, team FROM done),
 p AS (SELECT g.year, g.team AS h, g.opponent AS a, any_value(hca) AS hca, count(*) AS n, sum({clip('margin')}) AS s FROM done g JOIN lastd l ON l.year = g.year
  WHERE date > d - 200 AND EXISTS (SELECT 1 FROM homes x WHERE x.year = g.year AND x.team = g.opponent) GROUP BY ALL),
 gm AS (SELECT year, team, sum(n) AS games FROM (SELECT year, h AS team, n FROM p UNION ALL SELECT year, a, n FROM p) GROUP BY ALL),
 it AS (SELECT 0 AS step, year, team, CAST(0 AS DOUBLE) AS r, TRUE AS active FROM gm UNION ALL
  SELECT step + 1, year, team, r + ch, active AND (step = 0 OR max(abs(ch)) OVER (PARTITION BY year) >= 1e-7) FROM (
   SELECT i.step, i.year, i.team, i.r, i.active, CASE WHEN i.active THEN 0.1 * e.e / gm.games ELSE 0 END AS ch FROM it i JOIN gm ON gm.year = i.year AND gm.team = i.team
   JOIN (SELECT year, team, sum(e) AS e FROM (
     SELECT p.year, p.h AS team, s - n * {clip('x.r - y.r + hca')} AS e FROM p JOIN it x ON x.year = p.year AND x.team = p.h JOIN it y ON y.year = p.year AND y.team = p.a
     UNION ALL SELECT p.year, p.a, n * {clip('x.r - y.r + hca')} - s FROM p JOIN it x ON x.year = p.year AND x.team = p.h JOIN it y ON y.year = p.year AND y.team = p.a) GROUP BY ALL) e
    ON e.year = i.year AND e.team = i.team WHERE i.step < 1000 AND (SELECT bool_or(active) FROM it))),
 em AS (SELECT h.year, h.team, coalesce(r, 0) AS rating FROM homes h LEFT JOIN (SELECT * FROM it WHERE step = (SELECT max(step) FROM it)) z ON z.year = h.year AND z.team = h.team)
 """ + final)


_EDGE = "(2.5 * 20 + avg(margin - (team_rating - opponent_rating)) * count(*)) / (20 + count(*))"
_PLAIN = f"SELECT year, team, {rnd('rating')} AS rating FROM em"
EFFICIENCY_SQL = (RATED_SQL.replace("games AS (", "RECURSIVE games AS (", 1) + f""", g AS (SELECT year, team AS h, opponent AS a, team_score AS sh, opponent_score AS sa, coalesce(pace, 100.0) AS p FROM rated WHERE completed),
 av AS (SELECT year, avg(sh / p) AS avg FROM g GROUP BY year),
 pr AS (SELECT g.year, h, a, any_value(avg) AS avg, count(*) AS n, sum((sh + 1.25) / p) AS x, sum((sa - 1.25) / p) AS y FROM g JOIN av ON av.year = g.year GROUP BY ALL),
 it AS (SELECT 0 AS step, year, team, avg(o) AS o, avg(d) AS d FROM (SELECT year, h AS team, sh / p AS o, sa / p AS d FROM g UNION ALL SELECT year, a, sa / p, sh / p FROM g) GROUP BY ALL
  UNION ALL SELECT step + 1, year, team, sum(o) / sum(n), sum(d) / sum(n) FROM (
   SELECT m.step, pr.year, h AS team, n, x - n * avg + n * v.d AS o, n * avg - y + n * v.o AS d FROM pr JOIN it m ON m.year = pr.year AND m.team = pr.h JOIN it v ON v.year = pr.year AND v.team = pr.a WHERE m.step < 100
   UNION ALL SELECT m.step, pr.year, a, n, y - n * avg + n * m.d, n * avg - x + n * m.o FROM pr JOIN it m ON m.year = pr.year AND m.team = pr.h JOIN it v ON v.year = pr.year AND v.team = pr.a WHERE m.step < 100) GROUP BY ALL)
 SELECT year, team, {rnd('100 * (o - avg(o) OVER (PARTITION BY year))')} AS adj_off, {rnd('100 * (d - avg(d) OVER (PARTITION BY year))')} AS adj_def FROM it WHERE step = 100""")


@query("season_em_ratings", "M1 M3", _em_sql(_EDGE, None, _PLAIN))
def season_em_ratings(spark, sf_dir):
    g = rated(spark, sf_dir).filter("completed")
    out = ratings.em_ratings(g, ["year"], edges=history.home_edge(g, ["year"]))
    return out.select("year", "team", r6(F.col("rating")).alias("rating"))


@query("season_em_ratings_capped", "M1", _em_sql("2.5", 15.0, _PLAIN))
def season_em_ratings_capped(spark, sf_dir):
    out = ratings.em_ratings(rated(spark, sf_dir).filter("completed"), ["year"], cap=15.0)
    return out.select("year", "team", r6(F.col("rating")).alias("rating"))


@query("season_rating_ranking", "M3 K5 W12", _em_sql("2.5", None, f"SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY rating DESC, team) AS INT) AS rank, team, {rnd('rating', 2)} AS rating FROM em"))
def season_rating_ranking(spark, sf_dir):
    rated_sides = ratings.season_end_ratings(rated(spark, sf_dir))
    return records.ranked(rated_sides, "rating", ["year"]).select("year", "rank", "team", r6(F.col("rating"), 2).alias("rating"))


# the same iteration for the first game day of each month, from the games before it
_ASKED_SQL = RATED_SQL.replace("games AS (", "RECURSIVE games AS (", 1) + f""", done AS (SELECT * FROM rated WHERE completed AND margin IS NOT NULL),
 asks AS (SELECT year, min(date) AS as_of FROM rated GROUP BY year, month(date)),
 seen AS (SELECT asks.year, as_of, count(date) AS games_before, max(date) AS last_day FROM asks LEFT JOIN done ON done.year = asks.year AND date < as_of GROUP BY ALL),
 fh AS (SELECT year, team, min(date) AS first_home FROM done GROUP BY ALL),
 p AS (SELECT s.year, s.as_of, g.team AS h, g.opponent AS a, count(*) AS n, sum(margin) AS s FROM done g JOIN seen s ON s.year = g.year AND games_before > 100 AND g.date <= last_day AND g.date > last_day - 200
  JOIN fh x ON x.year = g.year AND x.team = g.team AND x.first_home < as_of JOIN fh y ON y.year = g.year AND y.team = g.opponent AND y.first_home < as_of GROUP BY ALL),
 gm AS (SELECT year, as_of, team, sum(n) AS games FROM (SELECT year, as_of, h AS team, n FROM p UNION ALL SELECT year, as_of, a, n FROM p) GROUP BY ALL),
 it AS (SELECT 0 AS step, year, as_of, team, CAST(0 AS DOUBLE) AS r, TRUE AS active FROM gm UNION ALL
  SELECT step + 1, year, as_of, team, r + ch, active AND (step = 0 OR max(abs(ch)) OVER (PARTITION BY year, as_of) >= 1e-7) FROM (
   SELECT i.step, i.year, i.as_of, i.team, i.r, i.active, CASE WHEN i.active THEN 0.1 * e.e / gm.games ELSE 0 END AS ch FROM it i JOIN gm USING (year, as_of, team)
   JOIN (SELECT year, as_of, team, sum(e) AS e FROM (
     SELECT p.year, p.as_of, unnest([h, a]) AS team, unnest([s - n * (x.r - y.r + 2.5), n * (x.r - y.r + 2.5) - s]) AS e FROM p
      JOIN it x ON x.year = p.year AND x.as_of = p.as_of AND x.team = p.h JOIN it y ON y.year = p.year AND y.as_of = p.as_of AND y.team = p.a) GROUP BY ALL) e
    USING (year, as_of, team) WHERE i.step < 1000 AND (SELECT bool_or(active) FROM it))),
 sides_of AS (SELECT year, team FROM rated UNION SELECT year, opponent FROM rated)
 SELECT seen.year, seen.as_of, t.team, CASE WHEN games_before <= 100 THEN 0 WHEN first_home < seen.as_of THEN {rnd('coalesce(r, 0)')} END AS rating
 FROM seen JOIN sides_of t ON t.year = seen.year LEFT JOIN fh ON fh.year = t.year AND fh.team = t.team
 LEFT JOIN (SELECT * FROM it WHERE step = (SELECT max(step) FROM it)) z ON z.year = t.year AND z.as_of = seen.as_of AND z.team = t.team"""


def _asked(games):
    month = games.groupBy("year", F.trunc("date", "month")).agg(F.min(F.to_date("date")).alias("as_of"))
    out = ratings.point_in_time_ratings(games, wanted=month.select("year", "as_of"))
    return out.select("year", "as_of", "team", r6(F.col("rating")).alias("rating"))


@query("ratings_on_asked_dates", "M2 J12", _ASKED_SQL)
def ratings_on_asked_dates(spark, sf_dir):
    return _asked(rated(spark, sf_dir))


@query("ratings_on_asked_dates_with_times", "M2 J12", _ASKED_SQL)
def ratings_on_asked_dates_with_times(spark, sf_dir):
    """The same games with a time of day, as feeds deliver them."""
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("game_id") % 1440).cast("int"))
    return _asked(rated(spark, sf_dir).withColumn("date", F.col("date").cast("timestamp") + minutes))


@query("point_in_time_ratings", "M2 J12")
def point_in_time_ratings(spark, sf_dir):
    return ratings.point_in_time_ratings(rated(spark, sf_dir))


@query("schedule_adjusted_efficiencies", "M4", EFFICIENCY_SQL)
def schedule_adjusted_efficiencies(spark, sf_dir):
    out = ratings.adjusted_efficiencies(rated(spark, sf_dir).filter("completed"), ["year"])
    return out.select("year", "team", r6(F.col("adj_off")).alias("adj_off"), r6(F.col("adj_def")).alias("adj_def"))
