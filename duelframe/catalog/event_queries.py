"""Play-by-play and box-score jobs on the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..operators import clean, events
from .contest import ACTIONS_SQL, GAMES_SQL, actions, games, r6, rnd
from .registry import query

# text form, as a feed sends it: clock as a duration, scores as strings that are blank on some rows
LOG_SQL = ACTIONS_SQL + """, log AS (SELECT *, 'PT' || lpad(CAST(clock_left // 60 AS VARCHAR), 2, '0') || 'M' || lpad(CAST(clock_left % 60 AS VARCHAR), 2, '0') || '.00S' AS clock,
 CASE WHEN action_number % 17 = 5 THEN '' ELSE CAST(score_home_n AS VARCHAR) END AS score_home,
 CASE WHEN action_number % 17 = 5 THEN NULL ELSE CAST(score_away_n AS VARCHAR) END AS score_away FROM actions)"""


def log(spark, sf_dir) -> DataFrame:
    blank = F.col("action_number") % 17 == 5
    two = lambda e: F.lpad(F.expr(e).cast("string"), 2, "0")
    return actions(spark, sf_dir).withColumns({
        "clock": F.concat(F.lit("PT"), two("clock_left div 60"), F.lit("M"), two("clock_left % 60"), F.lit(".00S")),
        "score_home": F.when(blank, F.lit("")).otherwise(F.col("score_home_n").cast("string")),
        "score_away": F.when(~blank, F.col("score_away_n").cast("string"))})


READ_SQL = LOG_SQL + """, rd AS (SELECT *, coalesce(TRY_CAST(nullif(score_home, '') AS INT), 0) - coalesce(TRY_CAST(nullif(score_away, '') AS INT), 0) AS lead,
  CASE WHEN period <= 4 THEN (4 - period) * 720 + clock_left ELSE clock_left END AS remaining,
  ((period - 1) * 720 + 720 - clock_left) / 60.0 AS elapsed,
  CASE WHEN lower(action_type) IN ('shot','freethrow','turnover','violation','timeout','jumpball') THEN team_id END AS claims FROM log),
 ow AS (SELECT *, last_value(claims IGNORE NULLS) OVER (PARTITION BY game ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner,
  last_value(claims IGNORE NULLS) OVER (PARTITION BY game ORDER BY action_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM rd),
 ch AS (SELECT *, coalesce(claims <> held, FALSE) AS changed FROM ow),
 ft AS (SELECT game, team_id, min(action_number) AS f FROM log WHERE team_id IS NOT NULL GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY f) AS k FROM ft),
 hv AS (SELECT game, max(CASE WHEN k = 1 THEN team_id END) AS home_id, max(CASE WHEN k = 2 THEN team_id END) AS away_id FROM rk GROUP BY game),
 ef AS (SELECT ch.*, greatest(0, lead + CASE WHEN owner IS NULL OR lead = 0 THEN 0 WHEN lead > 0 AND owner = home_id THEN 0.5
   WHEN lead < 0 AND owner = away_id THEN 0.5 ELSE -0.5 END) AS eff FROM ch LEFT JOIN hv ON ch.game = hv.game),
 cut AS (SELECT game, min(action_number) AS cut FROM ef WHERE eff * eff > remaining AND elapsed <= 45 GROUP BY game)"""


LEADS_SQL = """ SELECT ef.game, cut.cut IS NOT NULL AS safe_lead,
 max(CASE WHEN action_number = cut THEN period END) AS cutoff_period, max(CASE WHEN action_number = cut THEN clock END) AS cutoff_clock,
 cut.cut AS cutoff_action_number, count(*) FILTER (changed AND (cut IS NULL OR action_number <= cut)) AS possessions_before_cutoff,
 CAST(coalesce(max(CASE WHEN action_number = cut THEN abs(lead) END), abs(max_by(lead, action_number))) AS INT) AS final_score_diff
 FROM ef LEFT JOIN cut ON ef.game = cut.game GROUP BY ef.game, cut.cut"""


@query("safe_lead_detection", "M18 P19 P20 P21 P22 W11", READ_SQL + LEADS_SQL)
def safe_lead_detection(spark, sf_dir):
    return events.safe_leads(log(spark, sf_dir))


@query("safe_lead_either_side", "M18", READ_SQL.replace("greatest(0, lead + CASE", "greatest(0, abs(lead) + CASE") + LEADS_SQL)
def safe_lead_either_side(spark, sf_dir):
    return events.safe_leads(log(spark, sf_dir), symmetric=True)


@query("possession_flow", "W9 P21", READ_SQL + """ SELECT game, action_number, owner,
 CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY game ORDER BY action_number) AS BIGINT) AS possessions FROM ch""")
def possession_flow(spark, sf_dir):
    out = events.possession_counter(log(spark, sf_dir))
    return out.select("game", "action_number", "owner", "possessions")


@query("first_two_sides", "W10", READ_SQL + " SELECT * FROM hv")
def first_two_sides(spark, sf_dir):
    return events.first_two_sides(actions(spark, sf_dir))


@query("score_at_cutoff", "M19", READ_SQL + """, l AS (SELECT log.*, cut.cut FROM log JOIN cut ON log.game = cut.game WHERE action_number <= cut.cut)
 SELECT game, coalesce(TRY_CAST(nullif(max_by(coalesce(score_home,''), action_number), '') AS INT), 0) AS home_score_at_cutoff,
 coalesce(TRY_CAST(nullif(max_by(coalesce(score_away,''), action_number), '') AS INT), 0) AS away_score_at_cutoff,
 coalesce(TRY_CAST(nullif(max_by(coalesce(score_home,''), action_number), '') AS INT), 0)
  - coalesce(TRY_CAST(nullif(max_by(coalesce(score_away,''), action_number), '') AS INT), 0) AS margin_at_cutoff, count(*) AS total_actions
 FROM l GROUP BY game""")
def score_at_cutoff(spark, sf_dir):
    found = events.safe_leads(log(spark, sf_dir)).filter("safe_lead")
    return events.score_at_cutoff(log(spark, sf_dir), found)


@query("event_clock_values", "P19 P20 P22", READ_SQL + f""" SELECT game, action_number, lead, CAST(clock_left AS DOUBLE) AS seconds, CAST(remaining AS DOUBLE) AS remaining,
 {rnd('elapsed')} AS elapsed FROM rd""")
def event_clock_values(spark, sf_dir):
    out = events._readable(log(spark, sf_dir)).withColumn("seconds", S.clock_seconds(F.col("clock")))
    return out.select("game", "action_number", "lead", "seconds", "remaining", r6(F.col("elapsed")).alias("elapsed"))


BOX_SQL = GAMES_SQL + """, box AS (SELECT game_id, CAST(80 + game_id % 15 AS DOUBLE) AS h_fga, CAST(35 + game_id % 9 AS DOUBLE) AS h_fgm, CAST(15 + game_id % 12 AS DOUBLE) AS h_fta,
 CAST(CASE WHEN game_id % 40 = 0 THEN 0 ELSE 8 + game_id % 6 END AS DOUBLE) AS h_oreb, CAST(CASE WHEN game_id % 40 = 0 THEN 0 ELSE 30 + game_id % 7 END AS DOUBLE) AS h_dreb, CAST(10 + game_id % 8 AS DOUBLE) AS h_tov,
 CAST(82 + game_id % 13 AS DOUBLE) AS a_fga, CAST(34 + game_id % 10 AS DOUBLE) AS a_fgm, CAST(14 + game_id % 11 AS DOUBLE) AS a_fta,
 CAST(CASE WHEN game_id % 40 = 0 THEN 0 ELSE 7 + game_id % 5 END AS DOUBLE) AS a_oreb, CAST(CASE WHEN game_id % 40 = 0 THEN 0 ELSE 29 + game_id % 8 END AS DOUBLE) AS a_dreb, CAST(11 + game_id % 7 AS DOUBLE) AS a_tov,
 CASE game_id % 4 WHEN 0 THEN '240:00' WHEN 1 THEN 'PT265M00.00S' WHEN 2 THEN '265' ELSE NULL END AS minutes FROM games WHERE completed)"""


def box(spark, sf_dir) -> DataFrame:
    """Box scores derived from the game key, one struct per side."""
    key = F.col("game_id")
    value = lambda base, mod: (base + key % mod).cast("double")
    rebound = lambda base, mod: F.when(key % 40 == 0, F.lit(0.0)).otherwise(value(base, mod))
    minutes = (F.when(key % 4 == 0, "240:00").when(key % 4 == 1, "PT265M00.00S").when(key % 4 == 2, "265"))
    side = lambda fga, fgm, fta, oreb, dreb, tov: F.struct(
        value(*fga).alias("fga"), value(*fgm).alias("fgm"), value(*fta).alias("fta"), rebound(*oreb).alias("oreb"),
        rebound(*dreb).alias("dreb"), value(*tov).alias("tov"), minutes.alias("minutes"))
    return clean.completed_games(games(spark, sf_dir)).select(
        "game_id", side((80, 15), (35, 9), (15, 12), (8, 6), (30, 7), (10, 8)).alias("home"),
        side((82, 13), (34, 10), (14, 11), (7, 5), (29, 8), (11, 7)).alias("away"))


PACE_SQL = BOX_SQL + """, ps AS (SELECT game_id, h_fga - h_fgm * 1.07 * CASE WHEN h_oreb + a_dreb > 0 THEN h_oreb / (h_oreb + a_dreb) ELSE 0 END + 0.4 * h_fta + h_tov AS hp,
  a_fga - a_fgm * 1.07 * CASE WHEN a_oreb + h_dreb > 0 THEN a_oreb / (a_oreb + h_dreb) ELSE 0 END + 0.4 * a_fta + a_tov AS ap,
  CASE game_id % 4 WHEN 1 THEN 265.0 WHEN 2 THEN 265.0 ELSE 240.0 END AS mins FROM box),
 pc AS (SELECT game_id, 48 * ((hp + ap) / 2) / (mins / 5) AS pace FROM ps)"""


@query("game_pace_from_box_scores", "P16 P17 P18 S8", PACE_SQL + f" SELECT game_id, {rnd('pace')} AS pace, pace < 60 OR pace > 130 AS unusual FROM pc")
def game_pace_from_box_scores(spark, sf_dir):
    return events.game_paces(box(spark, sf_dir)).select("game_id", r6(F.col("pace")).alias("pace"), "unusual")


@query("pace_backfill", "J8", PACE_SQL + f""" SELECT g.game_id, {rnd('coalesce(g.pace, pc.pace)')} AS pace FROM games g LEFT JOIN pc ON g.game_id = pc.game_id""")
def pace_backfill(spark, sf_dir):
    g = games(spark, sf_dir)
    waiting = clean.backfill_candidates(g, "pace").select("game_id")
    fresh = events.game_paces(box(spark, sf_dir).join(waiting, "game_id", "left_semi"))
    return clean.write_back(g, fresh, ["pace"]).select("game_id", r6(F.col("pace")).alias("pace"))


@query("safe_lead_backfill", "J8 M28", READ_SQL + ", " + GAMES_SQL + """ SELECT g.game_id, CASE WHEN g.completed AND l.game IS NOT NULL THEN l.cut IS NOT NULL END AS garbage_time_detected,
 CASE WHEN g.completed THEN CAST(l.cut AS INT) END AS garbage_time_cutoff_action_number FROM games g LEFT JOIN
 (SELECT DISTINCT a.game, cut.cut FROM log a LEFT JOIN cut ON a.game = cut.game) l ON l.game = g.game_id""")
def safe_lead_backfill(spark, sf_dir):
    leads = events.safe_leads(log(spark, sf_dir))
    out = events.with_safe_leads(games(spark, sf_dir), leads)
    return out.select("game_id", "garbage_time_detected", "garbage_time_cutoff_action_number")
