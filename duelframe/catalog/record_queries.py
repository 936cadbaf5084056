"""Records, efficiencies, tie-break statistics and standings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import clean, records, standings
from ..operators.perspective import all_teams
from .contest import GAMES_SQL, RATED_SQL, SIDES_SQL, games, r6, rated, rnd
from .registry import query

WL = "CAST(sum(CASE WHEN win THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN win THEN 0 ELSE 1 END) AS BIGINT) AS losses"

RESULTS_SQL = SIDES_SQL + """, results AS (
 SELECT *, CASE WHEN is_home THEN m > 0 ELSE NOT (-m > 0) END AS win FROM sides
 WHERE m IS NOT NULL AND counts_toward_record)"""

TEAMS_SQL = RESULTS_SQL + """, teams AS (SELECT DISTINCT CAST(t AS BIGINT) AS team, CAST(t % 2 AS BIGINT) AS conference,
 CAST(t % 5 AS BIGINT) AS division FROM (SELECT team AS t FROM games UNION ALL SELECT opponent FROM games)),
 pairs AS (SELECT year, club AS team, rival, CAST(sum(CASE WHEN win THEN 1 ELSE 0 END) AS BIGINT) AS wins,
  CAST(sum(CASE WHEN win THEN 0 ELSE 1 END) AS BIGINT) AS losses, count(*) AS games
  FROM results WHERE playoff = 0 GROUP BY ALL),
 tb AS (SELECT r.year, r.club AS team, a.conference, a.division,
  CAST(sum(CASE WHEN win THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN win THEN 0 ELSE 1 END) AS BIGINT) AS losses,
  CAST(sum(CASE WHEN win AND a.conference = b.conference THEN 1 ELSE 0 END) AS BIGINT) AS conference_wins,
  CAST(sum(CASE WHEN NOT win AND a.conference = b.conference THEN 1 ELSE 0 END) AS BIGINT) AS conference_losses,
  sum(m) AS net_points
  FROM results r JOIN teams a ON r.club = a.team JOIN teams b ON r.rival = b.team WHERE playoff = 0 GROUP BY ALL)"""


def team_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of every side: conference = id mod 2, division = id mod 5."""
    return all_teams(games(spark, sf_dir)).select(
        "team", (F.col("team") % 2).alias("conference"), (F.col("team") % 5).alias("division"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.tiebreak_stats(records.pair_table(rated(spark, sf_dir), ["year"]), team_dim(spark, sf_dir), ["year"])


@query("team_records", "A1", RESULTS_SQL + f" SELECT year, club AS team, {WL} FROM results GROUP BY ALL")
def team_records(spark, sf_dir):
    return records.team_records(rated(spark, sf_dir), ["year"])


@query("standings_by_wins", "P2 A1 W12",
       RESULTS_SQL + f", w AS (SELECT year, club AS team, {WL} FROM results GROUP BY ALL) SELECT *, "
       "CAST(row_number() OVER (PARTITION BY year ORDER BY wins DESC, team) AS INT) AS rank FROM w")
def standings_by_wins(spark, sf_dir):
    return records.ranked(records.team_records(rated(spark, sf_dir), ["year"]), "wins", ["year"])


@query("first_games_records", "A2", SIDES_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY year, club
 ORDER BY date, game_id, is_home) AS rn FROM sides WHERE m IS NOT NULL AND counts_toward_record)
 SELECT year, club AS team, CAST(sum(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins,
 CAST(sum(CASE WHEN m > 0 THEN 0 ELSE 1 END) AS BIGINT) AS losses FROM o WHERE rn <= 82 GROUP BY ALL""")
def first_games_records(spark, sf_dir):
    return records.capped_records(rated(spark, sf_dir), ["year"])


@query("regular_season_records", "A3",
       RESULTS_SQL + f" SELECT year, club AS team, {WL} FROM results WHERE playoff = 0 GROUP BY ALL")
def regular_season_records(spark, sf_dir):
    return records.regular_records(rated(spark, sf_dir), ["year"])


@query("team_efficiencies", "A4 P15", SIDES_SQL + f""" SELECT year, club AS team,
 {rnd('avg(pts_for / coalesce(pace, 100.0))')} AS off_eff, {rnd('avg(pts_against / coalesce(pace, 100.0))')} AS def_eff
 FROM sides GROUP BY ALL""")
def team_efficiencies(spark, sf_dir):
    e = records.efficiencies(rated(spark, sf_dir), ["year"])
    return e.select("year", "team", r6(F.col("off_eff")).alias("off_eff"), r6(F.col("def_eff")).alias("def_eff"))


@query("team_mean_pace", "A5 P15", SIDES_SQL + f""" SELECT year, club AS team,
 {rnd('avg(coalesce(pace, 100.0))')} AS pace FROM sides GROUP BY ALL""")
def team_mean_pace(spark, sf_dir):
    return records.team_pace(rated(spark, sf_dir), ["year"]).select("year", "team", r6(F.col("pace")).alias("pace"))


@query("remaining_schedule_strength", "A6", RATED_SQL + f""", rt AS (SELECT DISTINCT t AS team, CAST((t*7) % 13 AS DOUBLE) AS r
 FROM (SELECT team AS t FROM games UNION ALL SELECT opponent FROM games)),
 f AS (SELECT team AS club, opponent AS rival FROM rated WHERE NOT completed
  UNION ALL SELECT opponent, team FROM rated WHERE NOT completed)
 SELECT rt.team, {rnd('x.s')} AS remaining_sos FROM rt LEFT JOIN (SELECT club, avg(r) AS s FROM f JOIN rt ON rival = team
 GROUP BY club) x ON x.club = rt.team""")
def remaining_schedule_strength(spark, sf_dir):
    g = rated(spark, sf_dir)
    ratings = all_teams(g).withColumn("predictive_rating", ((F.col("team") * 7) % 13).cast("double"))
    out = records.remaining_schedule(ratings, clean.future_games(g))
    return out.select("team", r6(F.col("remaining_sos")).alias("remaining_sos"))


@query("league_pace_summary", "A9 P15", GAMES_SQL + f""" SELECT {rnd('avg(pace)')} AS mean_pace,
 {rnd('stddev_samp(pace)')} AS std_pace FROM games WHERE completed""")
def league_pace_summary(spark, sf_dir):
    out = records.pace_summary(clean.completed_games(games(spark, sf_dir)))
    return out.select(r6(F.col("mean_pace")).alias("mean_pace"), r6(F.col("std_pace")).alias("std_pace"))


@query("one_step_adjusted_efficiency", "M5", SIDES_SQL + f""", e AS (SELECT year, club,
  avg(pts_for / coalesce(pace, 100.0)) AS o, avg(pts_against / coalesce(pace, 100.0)) AS d FROM sides GROUP BY ALL)
 SELECT s.year, s.club AS team, {rnd('avg(pts_for / pace - e.d)')} AS adj_off, {rnd('avg(pts_against / pace - e.o)')} AS adj_def
 FROM sides s JOIN e ON s.year = e.year AND s.club = e.club WHERE pace IS NOT NULL GROUP BY ALL""")
def one_step_adjusted_efficiency(spark, sf_dir):
    g = rated(spark, sf_dir)
    out = records.adjusted_one_step(g, records.efficiencies(g, ["year"]), ["year"])
    return out.select("year", "team", r6(F.col("adj_off")).alias("adj_off"), r6(F.col("adj_def")).alias("adj_def"))


@query("tiebreak_statistics", "A10 P24 J1", TEAMS_SQL + " SELECT * FROM tb")
def tiebreak_statistics(spark, sf_dir):
    return stats(spark, sf_dir)


@query("head_to_head_records", "A10", TEAMS_SQL + " SELECT * FROM pairs")
def head_to_head_records(spark, sf_dir):
    return records.head_to_head(rated(spark, sf_dir), ["year"])


@query("division_winners", "A11", TEAMS_SQL + """ SELECT year, team, conference, division, wins,
 wins = max(wins) OVER (PARTITION BY year, conference, division) AS division_winner FROM tb""")
def division_winners(spark, sf_dir):
    out = records.with_division_winner(stats(spark, sf_dir), ["year"])
    return out.select("year", "team", "conference", "division", "wins", "division_winner")


@query("conference_top_ten", "A13 W17", TEAMS_SQL + """ SELECT year, conference, team, wins FROM tb
 QUALIFY row_number() OVER (PARTITION BY year, conference ORDER BY wins DESC, team) <= 10""")
def conference_top_ten(spark, sf_dir):
    return records.conference_top(stats(spark, sf_dir), ["year"]).select("year", "conference", "team", "wins")


TOP_SQL = TEAMS_SQL + """, top AS (SELECT year, conference, team FROM tb
 QUALIFY row_number() OVER (PARTITION BY year, conference ORDER BY wins DESC, team) <= 10)"""


@query("record_against_contenders", "A14 J16", TOP_SQL + """ SELECT e.year, e.team,
 CAST(coalesce(sum(p.wins), 0) AS BIGINT) AS wins, CAST(coalesce(sum(p.losses), 0) AS BIGINT) AS losses
 FROM (SELECT DISTINCT year, team FROM pairs) e LEFT JOIN (SELECT p.* FROM pairs p SEMI JOIN top
  ON p.year = top.year AND p.rival = top.team) p ON e.year = p.year AND e.team = p.team GROUP BY ALL""")
def record_against_contenders(spark, sf_dir):
    g = rated(spark, sf_dir)
    top = records.conference_top(stats(spark, sf_dir), ["year"])
    return records.record_against(records.head_to_head(g, ["year"]), top, ["year"])


@query("balanced_tied_groups", "A12", TEAMS_SQL + """, tied AS (SELECT year, team, CAST(conference * 1000000 + wins // 10 AS BIGINT) AS grp FROM tb),
 sz AS (SELECT year, grp, count(*) AS size FROM tied GROUP BY ALL),
 met AS (SELECT a.year, a.grp, count(*) AS met, min(games) AS lo, max(games) AS hi FROM tied a JOIN tied b ON a.year = b.year
  AND a.grp = b.grp AND a.team < b.team JOIN pairs p ON p.year = a.year AND p.team = a.team AND p.rival = b.team GROUP BY ALL)
 SELECT sz.year, sz.grp AS "group", size, coalesce(met = size * (size - 1) / 2 AND lo = hi AND lo > 0, FALSE) AS balanced
 FROM sz LEFT JOIN met ON sz.year = met.year AND sz.grp = met.grp""")
def balanced_tied_groups(spark, sf_dir):
    s = stats(spark, sf_dir)
    groups = s.select("year", F.expr("conference * 1000000 + wins div 10").alias("group"), "team")
    return records.balanced_groups(records.head_to_head(rated(spark, sf_dir), ["year"]), groups, ["year"])


def _refined_sql(k: int) -> str:
    """One refinement of the tied sets of ``s<k>``; a coin, which only another hash could toss, is left to the side's number."""
    rules = ["r0", "r1", "conference_wins", "own", "other", "net_points"]
    whole = "(PARTITION BY year, conference, place)"
    value = "coalesce(" + ", ".join(f"CASE WHEN min({r}) OVER w <> max({r}) OVER w THEN CAST({r} AS DOUBLE) END" for r in rules) + ")"
    return f""", t{k} AS MATERIALIZED (SELECT *, count(*) OVER {whole} AS size FROM s{k}),
 m{k} AS MATERIALIZED (SELECT a.year, a.team, sum(p.wins) AS direct, count(*) AS rivals, min(p.games) AS fewest, max(p.games) AS most
  FROM t{k} a JOIN t{k} b ON a.year = b.year AND a.conference = b.conference AND a.place = b.place AND a.team <> b.team
  JOIN pairs p ON p.year = a.year AND p.team = a.team AND p.rival = b.team WHERE a.size > 1 GROUP BY ALL),
 f{k} AS MATERIALIZED (SELECT t.*, coalesce(direct, 0) AS direct, min(coalesce(rivals, 0)) OVER w = size - 1 AND min(coalesce(fewest, 0)) OVER w = max(coalesce(most, 0)) OVER w
   AND min(coalesce(fewest, 0)) OVER w > 0 AS even, min(division) OVER w = max(division) OVER w AS same_division
  FROM t{k} t LEFT JOIN m{k} m ON m.year = t.year AND m.team = t.team WINDOW w AS (PARTITION BY t.year, conference, place)),
 g{k} AS MATERIALIZED (SELECT *, CASE WHEN size = 2 THEN direct ELSE champ::INT END AS r0, CASE WHEN size = 2 THEN CASE WHEN same_division THEN champ::INT ELSE 0 END
   ELSE CASE WHEN even THEN direct ELSE 0 END END AS r1 FROM f{k}),
 v{k} AS MATERIALIZED (SELECT *, {value} AS v FROM g{k} WINDOW w AS {whole}),
 s{k + 1} AS MATERIALIZED (SELECT year, team, conference, division, wins, losses, champ, conference_wins, own, other, net_points,
  place + rank() OVER (PARTITION BY year, conference, place ORDER BY v DESC NULLS LAST, CASE WHEN v IS NULL THEN team END) - 1 AS place FROM v{k})"""


_STEPS = 8
STANDINGS_SQL = TOP_SQL.replace(" AS (SELECT", " AS MATERIALIZED (SELECT") + """, vs AS MATERIALIZED (SELECT p.year, p.team, t.conference AS rc, CAST(sum(p.wins) AS BIGINT) AS w
  FROM pairs p JOIN top t ON p.year = t.year AND p.rival = t.team GROUP BY ALL),
 s0 AS MATERIALIZED (SELECT tb.year, tb.team, tb.conference, division, wins, losses, wins = max(wins) OVER (PARTITION BY tb.year, tb.conference, division) AS champ,
  conference_wins, coalesce(o.w, 0) AS own, coalesce(x.w, 0) AS other, net_points, rank() OVER (PARTITION BY tb.year, tb.conference ORDER BY wins DESC) AS place
  FROM tb LEFT JOIN vs o ON o.year = tb.year AND o.team = tb.team AND o.rc = tb.conference
  LEFT JOIN (SELECT v.year, v.team, b.conference AS mine, sum(w) AS w FROM vs v JOIN tb b ON b.year = v.year AND b.team = v.team AND b.conference <> v.rc GROUP BY ALL) x
   ON x.year = tb.year AND x.team = tb.team)""" + "".join(map(_refined_sql, range(_STEPS)))


@query("standings_with_tiebreaks", "M20 A10 A11 A12 A13 A14", STANDINGS_SQL + f" SELECT year, conference, team, wins, losses, CAST(place AS INT) AS seed FROM s{_STEPS}")
def standings_with_tiebreaks(spark, sf_dir):
    return standings.standings(rated(spark, sf_dir), team_dim(spark, sf_dir), ["year"])


# the same order when no three sides tie: full two-side rule chain in SQL
@query("two_team_tiebreaks", "M20", (TOP_SQL + """, dw AS (SELECT *, wins = max(wins) OVER (PARTITION BY year, conference, division) AS champ FROM tb),
 vs AS (SELECT p.year, p.team, t.conference AS rc, CAST(sum(p.wins) AS BIGINT) AS w FROM pairs p JOIN top t ON p.year = t.year AND p.rival = t.team GROUP BY ALL),
 two AS (SELECT year, conference, wins FROM tb GROUP BY ALL HAVING count(*) = 2),
 ab AS (SELECT a.year, a.conference, a.wins, a.team AS a, b.team AS b, a.division = b.division AS same_div, a.champ AS ac, b.champ AS bc,
  a.conference_wins AS acw, b.conference_wins AS bcw, a.net_points AS apd, b.net_points AS bpd
  FROM dw a JOIN dw b ON a.year = b.year AND a.conference = b.conference AND a.wins = b.wins AND a.team < b.team
  JOIN two ON two.year = a.year AND two.conference = a.conference AND two.wins = a.wins),
 k AS (SELECT ab.*, coalesce(p.wins - p.losses, 0) AS h2h,
  coalesce(ao.w, 0) - coalesce(bo.w, 0) AS own, coalesce(ax.w, 0) - coalesce(bx.w, 0) AS other
  FROM ab LEFT JOIN pairs p ON p.year = ab.year AND p.team = a AND p.rival = b
  LEFT JOIN vs ao ON ao.year = ab.year AND ao.team = a AND ao.rc = ab.conference
  LEFT JOIN vs bo ON bo.year = ab.year AND bo.team = b AND bo.rc = ab.conference
  LEFT JOIN vs ax ON ax.year = ab.year AND ax.team = a AND ax.rc <> ab.conference
  LEFT JOIN vs bx ON bx.year = ab.year AND bx.team = b AND bx.rc <> ab.conference)
 SELECT year, conference, wins, CASE WHEN h2h <> 0 THEN CASE WHEN h2h > 0 THEN a ELSE b END
  WHEN same_div AND ac <> bc THEN CASE WHEN ac THEN a ELSE b END
  WHEN acw <> bcw THEN CASE WHEN acw > bcw THEN a ELSE b END
  WHEN own <> 0 THEN CASE WHEN own > 0 THEN a ELSE b END
  WHEN other <> 0 THEN CASE WHEN other > 0 THEN a ELSE b END
  WHEN apd <> bpd THEN CASE WHEN apd > bpd THEN a ELSE b END END AS first_team FROM k""").replace(" AS (SELECT", " AS MATERIALIZED (SELECT"))
def two_team_tiebreaks(spark, sf_dir):
    return standings.two_way_ties(rated(spark, sf_dir), team_dim(spark, sf_dir), ["year"])
