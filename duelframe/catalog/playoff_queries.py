"""Series, bracket and slot jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..operators import nested, playoffs, scenarios, simstats
from ..schema import SERIES_LABELS
from .contest import BRACKET, RATED_SQL, games, noise, noise_sql, r6, rated, rating_of, rnd
from .registry import query
from .scenario_queries import REPORT_SQL, SCEN_SQL, season_wins  # noqa: F401

_LABELS = "[" + ", ".join(f"'{b}'" for b in BRACKET) + "]"
_PLAY_IN = {"E_P_1": 101, "E_P_2": 102, "E_P_3": 103, "W_P_1": 111, "W_P_2": 112, "W_P_3": 113}
_AT_HOME = "g IN (1, 2, 5, 7)"


# ---- a reproducible draw, on both engines -------------------------------------------------------


def draw(sim: Column, label: Column, home: Column, away: Column, game_num: int) -> Column:
    number = S.lookup(label, {b: i for i, b in enumerate(BRACKET)})
    edge = rating_of(home, F.lit(2001)) - rating_of(away, F.lit(2001)) + 2.5
    return edge + 12.0 * noise((number * 10 + game_num).cast("bigint"), sim)


def draw_once(sim: Column, label: Column, home: Column, away: Column) -> Column:
    edge = rating_of(home, F.lit(2001)) - rating_of(away, F.lit(2001)) + 2.5
    return edge + 12.0 * noise(S.lookup(label, _PLAY_IN).cast("bigint"), sim)


def _edge_sql(home: str, away: str) -> str:
    return f"(({home} * 7 + 2001) % 13 - ({away} * 7 + 2001) % 13 + 2.5)"


def series_sql(name: str, source: str) -> str:
    """CTEs settling ``source`` (sim_id, label, host, guest, high_seed, low_seed, high_seed_num, low_seed_num)."""
    z = noise_sql("CAST(no * 10 + g AS BIGINT)", "sim_id")
    return f""", {name}_a AS (SELECT *, list_position({_LABELS}, label) - 1 AS no, unnest(range(1, 8)) AS g FROM {source}),
 {name}_b AS (SELECT *, CASE WHEN {_AT_HOME} THEN host ELSE guest END AS home, CASE WHEN {_AT_HOME} THEN guest ELSE host END AS away FROM {name}_a),
 {name}_c AS (SELECT *, {_edge_sql('home', 'away')} + 12.0 * {z} AS margin FROM {name}_b),
 {name}_d AS (SELECT *, CASE WHEN margin > 0 THEN home ELSE away END AS game_winner FROM {name}_c),
 {name}_e AS (SELECT *, sum((game_winner = host)::INT) OVER (PARTITION BY sim_id, label ORDER BY g) AS hw FROM {name}_d),
 {name}_l AS (SELECT sim_id, label, min(g) AS len FROM {name}_e WHERE hw = 4 OR g - hw = 4 GROUP BY ALL),
 {name}_g AS (SELECT e.*, l.len, max(CASE WHEN g = len THEN game_winner END) OVER (PARTITION BY e.sim_id, e.label) AS winner
  FROM {name}_e e JOIN {name}_l l ON e.sim_id = l.sim_id AND e.label = l.label WHERE g <= len),
 {name} AS (SELECT sim_id, label AS series_label, host, guest, high_seed, low_seed, high_seed_num, low_seed_num, winner AS series_winner,
  CASE WHEN winner = host THEN guest ELSE host END AS series_loser, len AS series_length, count(*) FILTER (game_winner <> winner) AS loser_wins
  FROM {name}_g GROUP BY ALL)"""


# ---- series drawn from the contest table: fifteen consecutive games make one scenario -----------

SERIES_SQL = RATED_SQL + f""", src AS (SELECT game_id // 15 AS sim_id, list_extract({_LABELS}, CAST(game_id % 15 + 1 AS INT)) AS label, team, opponent, 1 + team % 8 AS sa, 1 + opponent % 8 AS sb FROM games),
 sr AS (SELECT sim_id, label, CASE WHEN (sa, team) < (sb, opponent) THEN team ELSE opponent END AS host, CASE WHEN (sa, team) < (sb, opponent) THEN opponent ELSE team END AS guest,
  CASE WHEN (sa, team) < (sb, opponent) THEN team ELSE opponent END AS high_seed, CASE WHEN (sa, team) < (sb, opponent) THEN opponent ELSE team END AS low_seed,
  least(sa, sb) AS high_seed_num, greatest(sa, sb) AS low_seed_num FROM src)""" + series_sql("fs", "sr") + """,
 rs AS (SELECT *, CASE WHEN series_label = 'Finals' THEN 'FINALS' WHEN series_label[3:] IN ('1_8','4_5','2_7','3_6') THEN 'R1' WHEN series_label[3:] = '1_2' THEN 'CONF_FINALS' ELSE 'CONF_SEMIS' END AS round,
  CASE WHEN series_label = 'Finals' THEN 'Inter' WHEN series_label[1:1] = 'E' THEN 'East' ELSE 'West' END AS conference FROM fs),
 ns AS (SELECT count(DISTINCT sim_id) AS n FROM rs), sd AS (SELECT sim_id, round, unnest([high_seed, low_seed]) AS team, series_length FROM rs)"""


def drawn_series(spark, sf_dir) -> DataFrame:
    g = games(spark, sf_dir).select("game_id", "team", "opponent")
    a = F.struct((1 + F.col("team") % 8).cast("int").alias("s"), F.col("team").alias("t"))
    b = F.struct((1 + F.col("opponent") % 8).cast("int").alias("s"), F.col("opponent").alias("t"))
    label = F.element_at(F.array(*[F.lit(x) for x in BRACKET]), (F.col("game_id") % 15 + 1).cast("int"))
    pairs = g.select(F.expr("game_id div 15").alias("sim_id"), label.alias("label"), F.least(a, b).alias("h"), F.greatest(a, b).alias("l"))
    source = pairs.select("sim_id", "label", F.col("h.t").alias("host"), F.col("l.t").alias("guest"), F.col("h.t").alias("high_seed"),
                          F.col("l.t").alias("low_seed"), F.col("h.s").alias("high_seed_num"), F.col("l.s").alias("low_seed_num"))
    return scenarios.best_of_seven(source, draw)


def results(spark, sf_dir) -> DataFrame:
    return nested.series_rows(drawn_series(spark, sf_dir))


@query("best_of_seven_series", "M25 P33", SERIES_SQL + " SELECT sim_id, series_label AS label, series_winner AS winner, series_loser AS loser, CAST(series_length AS INT) AS series_length FROM rs")
def best_of_seven_series(spark, sf_dir):
    return drawn_series(spark, sf_dir).select("sim_id", "label", "winner", "loser", "series_length")


@query("flat_series_games", "N3 S11 K9", SERIES_SQL + f""" SELECT g.sim_id, 2001 AS year, rs.round, rs.conference, g.label AS series_label, g.high_seed, g.low_seed,
 CAST(g.high_seed_num AS INT) AS high_seed_num, CAST(g.low_seed_num AS INT) AS low_seed_num, rs.series_winner, rs.series_loser, CAST(rs.series_length AS INT) AS series_length,
 CAST(g.g AS INT) AS game_num, g.home, g.away, {rnd('g.margin')} AS margin, g.game_winner AS winner FROM fs_g g JOIN rs ON rs.sim_id = g.sim_id AND rs.series_label = g.label""")
def flat_series_games(spark, sf_dir):
    return nested.flatten_games(results(spark, sf_dir), 2001).withColumn("margin", r6(F.col("margin")))


@query("renumbered_series_games", "K9", SERIES_SQL + """, k AS (SELECT sim_id, CAST(dense_rank() OVER (ORDER BY sim_id) - 1 AS BIGINT) AS new_id, label, g FROM fs_g)
 SELECT new_id AS sim_id, label AS series_label, CAST(g AS INT) AS game_num FROM k""")
def renumbered_series_games(spark, sf_dir):
    flat = nested.flatten_games(results(spark, sf_dir), 2001).withColumn("sim_id", F.col("sim_id") * 37 + 5)  # with gaps
    return nested.renumbered(flat).select("sim_id", "series_label", "game_num")


@query("series_metrics", "N2", SERIES_SQL + " SELECT sim_id, series_label, CAST(series_length AS INT) AS length, CAST(series_length - loser_wins AS INT) AS winner_wins, CAST(loser_wins AS INT) AS loser_wins FROM rs")
def series_metrics(spark, sf_dir):
    return nested.series_metrics(results(spark, sf_dir))


@query("rebuilt_results", "N4", SERIES_SQL + """ SELECT sim_id, CAST(count(*) AS INT) AS n_series, max(CASE WHEN series_label = 'Finals' THEN series_winner END) AS champion,
 CAST((SELECT count(DISTINCT team) FROM sd WHERE sd.sim_id = rs.sim_id) AS INT) AS n_teams, CAST(sum(series_length) AS BIGINT) AS n_games FROM rs GROUP BY sim_id""")
def rebuilt_results(spark, sf_dir):
    back = nested.rebuild_results(nested.flatten_games(results(spark, sf_dir), 2001))
    total = F.aggregate("series", F.lit(0).cast("bigint"), lambda acc, s: acc + F.size(s["games"]))
    return back.select("sim_id", F.size("series").alias("n_series"), "champion", F.size(F.map_keys("seeds")).alias("n_teams"), total.alias("n_games"))


@query("assembled_series", "N1", SERIES_SQL + """, q AS (SELECT g.*, game_id % 1 AS zero FROM (SELECT *, sim_id * 1000 + no * 10 + g AS game_id FROM fs_g) g),
 ok AS (SELECT sim_id, label FROM q GROUP BY ALL)
 SELECT rs.sim_id, rs.series_label, rs.round, rs.conference, rs.high_seed, rs.low_seed, rs.series_winner, rs.series_loser, CAST(rs.series_length AS INT) AS series_length
 FROM rs JOIN ok ON ok.sim_id = rs.sim_id AND ok.label = rs.series_label""")
def assembled_series(spark, sf_dir):
    flat = nested.flatten_games(results(spark, sf_dir), 2001)
    rows = flat.select("sim_id", F.col("series_label").alias("playoff_label"), F.date_add(F.lit("2001-11-01").cast("date"), F.col("game_num")).alias("date"),
                       F.col("game_num").alias("game_id"), F.col("home").alias("team"), F.col("away").alias("opponent"), "margin")
    side = F.explode(F.array(F.struct(F.col("high_seed").alias("team"), F.col("high_seed_num").alias("seed"), F.lit(0).alias("low")),
                             F.struct(F.col("low_seed").alias("team"), F.col("low_seed_num").alias("seed"), F.lit(1).alias("low"))))
    # with equal seeds the smaller side is high on both routes
    seeds = results(spark, sf_dir).select("sim_id", side.alias("s")).select("sim_id", "s.team", "s.seed").distinct()
    out = nested.assemble_series(rows, seeds)
    return out.select("sim_id", "series_label", "round", "conference", "high_seed", "low_seed", "series_winner", "series_loser", "series_length")


@query("series_label_attributes", "P23", "SELECT label, round, conference FROM (VALUES "
       + ", ".join(f"('{k}', '{v[0]}', '{v[2]}')" for k, v in SERIES_LABELS.items())
       + ") t(label, round, conference) WHERE (SELECT count(*) FROM orders) > 15")
def series_label_attributes(spark, sf_dir):
    labels = drawn_series(spark, sf_dir).select("label").distinct()
    return labels.select("label", S.series_round(F.col("label")).alias("round"), S.series_conference(F.col("label")).alias("conference"))


# ---- probabilities ------------------------------------------------------------------------------


def _p(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[r6(F.col(n)).alias(n) for n in names])


@query("title_odds", "A26", SERIES_SQL + f" SELECT series_winner AS team, {rnd('count(*) / (SELECT n FROM ns)')} AS p_champion FROM rs WHERE round = 'FINALS' GROUP BY 1")
def title_odds(spark, sf_dir):
    return _p(simstats.p_champion(results(spark, sf_dir)), "p_champion")


@query("odds_of_reaching_round", "A27", SERIES_SQL + f" SELECT team, {rnd('count(DISTINCT sim_id) / (SELECT n FROM ns)')} AS p FROM sd WHERE round = 'CONF_SEMIS' GROUP BY 1")
def odds_of_reaching_round(spark, sf_dir):
    return _p(simstats.p_reaches_round(results(spark, sf_dir), "CONF_SEMIS"), "p")


@query("odds_of_winning_round", "A28", SERIES_SQL + f" SELECT series_winner AS team, {rnd('count(*) / (SELECT n FROM ns)')} AS p FROM rs WHERE round = 'R1' GROUP BY 1")
def odds_of_winning_round(spark, sf_dir):
    return _p(simstats.p_wins_round(results(spark, sf_dir), "R1"), "p")


@query("matchup_odds", "A29", SERIES_SQL + f" SELECT high_seed, low_seed, {rnd('count(*) / (SELECT n FROM ns)')} AS p FROM rs WHERE round = 'R1' GROUP BY ALL")
def matchup_odds(spark, sf_dir):
    return _p(simstats.p_matchup(results(spark, sf_dir), "R1"), "p")


_OUT = ", oc AS (SELECT high_seed, low_seed, CAST(series_winner AS VARCHAR) || '_4-' || CAST(loser_wins AS VARCHAR) AS outcome, count(*) AS c FROM rs WHERE round = 'R1' GROUP BY ALL)"


@query("series_outcome_odds", "A30", SERIES_SQL + _OUT + f" SELECT high_seed, low_seed, outcome, {rnd('c / sum(c) OVER (PARTITION BY high_seed, low_seed)')} AS p FROM oc")
def series_outcome_odds(spark, sf_dir):
    return _p(simstats.p_series_outcome(results(spark, sf_dir), "R1"), "p")


@query("series_length_odds", "A31", SERIES_SQL + " SELECT team, " + ", ".join(f"{rnd(f'count(*) FILTER (series_length = {k}) / count(*)')} AS p_{k}" for k in (4, 5, 6, 7)) + " FROM sd GROUP BY team")
def series_length_odds(spark, sf_dir):
    return _p(simstats.p_series_length(results(spark, sf_dir)), "p_4", "p_5", "p_6", "p_7")


@query("expected_playoff_games", "A32", SERIES_SQL + f" SELECT team, {rnd('sum(series_length) / (SELECT n FROM ns)')} AS expected_games FROM sd GROUP BY team")
def expected_playoff_games(spark, sf_dir):
    return _p(simstats.expected_games(results(spark, sf_dir)), "expected_games")


def _odds_sql(name: str, cond: str) -> str:
    return f"{rnd(f'count(DISTINCT CASE WHEN {cond} THEN sim_id END) / (SELECT n FROM ns)')} AS {name}"


ODDS_SQL = SERIES_SQL + ", od AS (SELECT sim_id, round, team FROM sd UNION ALL SELECT sim_id, 'CHAMPION', series_winner FROM rs WHERE round = 'FINALS')"


@query("round_odds", "A24", ODDS_SQL + " SELECT team, " + ", ".join(
    _odds_sql(v, f"round = '{k}'") for k, v in {**simstats.ROUND_COLUMNS, 'CHAMPION': 'champion'}.items()) + " FROM od GROUP BY team")
def round_odds(spark, sf_dir):
    return _p(simstats.round_odds(results(spark, sf_dir)), *simstats.REPORT_ORDER)


@query("bracket_summary", "A33", ODDS_SQL + " SELECT team, " + ", ".join(
    _odds_sql(v, f"round = '{k}'") for k, v in {'CONF_SEMIS': 'p_reach_r2', 'CONF_FINALS': 'p_reach_cf', 'FINALS': 'p_reach_finals', 'CHAMPION': 'p_champion'}.items())
    + " FROM od WHERE round <> 'R1' GROUP BY team")
def bracket_summary(spark, sf_dir):
    return _p(simstats.bracket_summary(results(spark, sf_dir)), "p_reach_r2", "p_reach_cf", "p_reach_finals", "p_champion")


@query("matchup_table", "A34", SERIES_SQL + _OUT + f""" SELECT high_seed, low_seed, {rnd('sum(c) / (SELECT n FROM ns)')} AS p_matchup, CAST(count(*) AS INT) AS n_outcomes, {rnd('max(c) / sum(c)')} AS top_p FROM oc GROUP BY ALL""")
def matchup_table(spark, sf_dir):
    out = simstats.matchup_table(results(spark, sf_dir), "R1")
    return out.select("high_seed", "low_seed", r6(F.col("p_matchup")).alias("p_matchup"), F.size(F.map_keys("outcomes")).alias("n_outcomes"),
                      r6(F.array_max(F.map_values("outcomes"))).alias("top_p"))


@query("slot_candidates", "A35 K10", SERIES_SQL + """, sl AS (SELECT sim_id, round, conference, series_label AS slot, series_length, series_winner, high_seed AS team, high_seed_num AS seed FROM rs
  UNION ALL SELECT sim_id, round, conference, series_label, series_length, series_winner, low_seed, low_seed_num FROM rs)
 SELECT round, conference, slot, team, CAST(min_by(seed, sim_id) AS INT) AS seed, """ + ", ".join(f"count(*) FILTER (series_winner = team AND series_length = {k}) AS w{k}" for k in (4, 5, 6, 7))
       + " FROM sl GROUP BY ALL HAVING w4 + w5 + w6 + w7 > 0")
def slot_candidates(spark, sf_dir):
    return simstats.slot_candidates(results(spark, sf_dir))


@query("slot_document", "K10")
def slot_document(spark, sf_dir):
    years = sorted(r.year for r in rated(spark, sf_dir).select("year").distinct().collect())  # seasons
    found = results(spark, sf_dir)
    return simstats.slot_document(found, years, playoffs.actual_series(found, post(spark, sf_dir)))


@query("scenario_report", "J15 A23 A24 K14", SCEN_SQL + SERIES_SQL.replace(RATED_SQL, "") + ", od AS (SELECT sim_id, round, team FROM sd UNION ALL SELECT sim_id, 'CHAMPION', series_winner FROM rs WHERE round = 'FINALS'), o AS (SELECT team, "
       + ", ".join(_odds_sql(v, f"round = '{k}'") for k, v in {**simstats.ROUND_COLUMNS, 'CHAMPION': 'champion'}.items())
       + f" FROM od GROUP BY team), sw AS (SELECT team, {REPORT_SQL} FROM simw GROUP BY team) SELECT sw.*, o.* EXCLUDE (team) FROM sw JOIN o ON sw.team = o.team")
def scenario_report(spark, sf_dir):
    out = simstats.sim_report(season_wins(spark, sf_dir), results(spark, sf_dir))
    return out.select("team", *[r6(F.col(c)).alias(c) for c in out.columns if c != "team"])


# ---- real post-season ---------------------------------------------------------------------------

POST_SQL = RATED_SQL + """, post AS (SELECT * FROM rated WHERE playoff = 1 AND margin IS NOT NULL QUALIFY row_number() OVER (PARTITION BY team, opponent, date ORDER BY game_id) = 1),
 ps AS (SELECT year, date, team, opponent AS rival, (margin > 0)::INT AS win FROM post UNION ALL SELECT year, date, opponent, team, 1 - (margin > 0)::INT FROM post),
 rec AS (SELECT year, team, rival, min(date) AS first, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(1 - win) AS BIGINT) AS losses FROM ps GROUP BY ALL),
 rc AS (SELECT year, CAST(row_number() OVER (PARTITION BY year, team ORDER BY first, rival) - 1 AS INT) AS round, team, rival, wins, losses FROM rec)"""


def post(spark, sf_dir) -> DataFrame:
    return playoffs.post_season_games(rated(spark, sf_dir))


@query("post_season_series_records", "A36 W13 W15", POST_SQL + " SELECT * FROM rc")
def post_season_series_records(spark, sf_dir):
    return playoffs.series_records(post(spark, sf_dir))


@query("post_season_state", "A37", POST_SQL + """, t AS (SELECT year, max(round) AS top FROM rc GROUP BY 1), m AS (SELECT rc.year, max(wins) AS most FROM rc JOIN t ON t.year = rc.year AND rc.round = t.top GROUP BY 1)
 SELECT y.year, CASE WHEN most IS NULL THEN 'none' WHEN most >= 4 THEN 'completed' ELSE 'in_progress' END AS state FROM (SELECT DISTINCT year FROM rated) y LEFT JOIN m ON m.year = y.year""")
def post_season_state(spark, sf_dir):
    return playoffs.playoff_state(rated(spark, sf_dir), playoffs.series_records(post(spark, sf_dir)))


LABELLED_SQL = POST_SQL + f""", lab AS (SELECT *, CASE WHEN game_id % 4 <> 3 THEN list_extract({_LABELS}, CAST((team + opponent) % 15 + 1 AS INT)) || CAST(year AS VARCHAR) || '_' || CAST(team % 5 AS VARCHAR) END AS playoff_label FROM post),
 wc AS (SELECT playoff_label, CASE WHEN margin > 0 THEN team ELSE opponent END AS leader, count(*) AS wins FROM lab WHERE playoff_label IS NOT NULL GROUP BY ALL),
 ld AS (SELECT playoff_label, leader, wins, wins >= 4 AS decided FROM wc QUALIFY row_number() OVER (PARTITION BY playoff_label ORDER BY wins DESC, leader DESC) = 1)"""


def labelled(spark, sf_dir) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in BRACKET]), ((F.col("team") + F.col("opponent")) % 15 + 1).cast("int"))
    named = F.concat(label, F.col("year").cast("string"), F.lit("_"), (F.col("team") % 5).cast("string"))
    return post(spark, sf_dir).withColumn("playoff_label", F.when(F.col("game_id") % 4 != 3, named)).withColumn(
        "winner_name", F.when(F.col("game_id") % 2 == 0, S.winner(F.col("margin"), F.col("team"), F.col("opponent"))))


@query("series_leaders", "A38", LABELLED_SQL + " SELECT * FROM ld")
def series_leaders(spark, sf_dir):
    return playoffs.series_winners(labelled(spark, sf_dir))


@query("trimmed_schedule", "A39", LABELLED_SQL + f""", fut AS (SELECT game_id, list_extract({_LABELS}, CAST(game_id % 15 + 1 AS INT)) || CAST(1995 + game_id % 7 AS VARCHAR) || '_' || CAST(game_id % 5 AS VARCHAR) AS playoff_label FROM rated WHERE NOT completed)
 SELECT game_id, playoff_label FROM fut WHERE playoff_label NOT IN (SELECT playoff_label FROM ld WHERE decided)""")
def trimmed_schedule(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(x) for x in BRACKET]), (F.col("game_id") % 15 + 1).cast("int"))
    future = rated(spark, sf_dir).filter(~F.col("completed")).select(
        "game_id", F.concat(label, (1995 + F.col("game_id") % 7).cast("string"), F.lit("_"), (F.col("game_id") % 5).cast("string")).alias("playoff_label"))
    return playoffs.trim_decided(future, labelled(spark, sf_dir)).select("game_id", "playoff_label")


@query("actual_series_on_slots", "J13", SERIES_SQL + POST_SQL.replace(RATED_SQL, "") + """, sc AS (SELECT least(high_seed, low_seed) AS lo, greatest(high_seed, low_seed) AS hi, round, conference, series_label AS slot, count(*) AS c FROM rs GROUP BY ALL),
 best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lo, hi ORDER BY c DESC, slot) = 1),
 rl AS (SELECT least(team, opponent) AS lo, greatest(team, opponent) AS hi, CASE WHEN margin > 0 THEN team ELSE opponent END AS w, year FROM post),
 rw AS (SELECT year, lo, hi, count(*) FILTER (w = lo) AS lo_wins, count(*) FILTER (w = hi) AS hi_wins FROM rl GROUP BY ALL)
 SELECT year, round, conference, slot, rw.lo AS team_a, lo_wins, rw.hi AS team_b, hi_wins, CASE WHEN greatest(lo_wins, hi_wins) >= 4 THEN 'complete' ELSE 'in_progress' END AS status
 FROM rw JOIN best ON best.lo = rw.lo AND best.hi = rw.hi""")
def actual_series_on_slots(spark, sf_dir):
    return playoffs.actual_series(results(spark, sf_dir), post(spark, sf_dir))


@query("first_post_season_meetings", "J14", POST_SQL + """, mu AS (SELECT 'M' || CAST(n_nationkey AS VARCHAR) AS label, CAST(n_nationkey AS BIGINT) AS a, CAST((n_nationkey + 3) % 25 AS BIGINT) AS b FROM nation),
 h AS (SELECT mu.*, p.game_id, p.team, p.margin, row_number() OVER (PARTITION BY label ORDER BY p.date, p.game_id) AS rn FROM mu JOIN post p ON least(a, b) = least(p.team, p.opponent) AND greatest(a, b) = greatest(p.team, p.opponent)
  WHERE NOT (p.game_id % 5 = 0))
 SELECT label, a, b, game_id, CASE WHEN (margin > 0) = (team = a) THEN a ELSE b END AS winner, CASE WHEN (margin > 0) = (team = a) THEN b ELSE a END AS loser FROM h WHERE rn = 1""")
def first_post_season_meetings(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    matchups = nation.select(F.concat(F.lit("M"), F.col("n_nationkey").cast("string")).alias("label"),
                             F.col("n_nationkey").cast("bigint").alias("a"), ((F.col("n_nationkey") + 3) % 25).cast("bigint").alias("b"))
    marked = post(spark, sf_dir).withColumn("playoff_label", F.when(F.col("game_id") % 5 == 0, "taken"))
    return playoffs.first_meetings(marked, matchups)


@query("remaining_series_schedule", "P33 P34", LABELLED_SQL + """, st AS (SELECT year, team AS host, rival AS guest, wins % 4 AS w, losses % 4 AS l, first FROM rec WHERE team < rival),
 x AS (SELECT *, unnest(range(1, 4 - greatest(w, l) + 1)) AS step FROM st)
 SELECT year, CAST(w + l + step AS INT) AS game_num, CASE WHEN (w + l + step) IN (1, 2, 5, 7) THEN host ELSE guest END AS team, CASE WHEN (w + l + step) IN (1, 2, 5, 7) THEN guest ELSE host END AS opponent,
 first + CAST(3 * step AS INT) AS date FROM x""")
def remaining_series_schedule(spark, sf_dir):
    p = post(spark, sf_dir)
    first = p.groupBy("year", F.least("team", "opponent").alias("host"), F.greatest("team", "opponent").alias("guest")).agg(F.min("date").alias("last_date"))
    rec = playoffs.series_records(p).filter(F.col("team") < F.col("rival"))
    series = rec.select("year", F.col("team").alias("host"), F.col("rival").alias("guest"), (F.col("wins") % 4).cast("int").alias("wins"),
                        (F.col("losses") % 4).cast("int").alias("losses")).join(first, ["year", "host", "guest"])
    return scenarios.remaining_series_games(series)


# ---- bracket chain: one scenario per customer ---------------------------------------------------

CHAIN_SQL = RATED_SQL + """, tm AS (SELECT DISTINCT CAST(t AS BIGINT) AS team FROM (SELECT team AS t FROM games UNION ALL SELECT opponent FROM games)),
 ws AS (SELECT c_custkey AS sim_id, team, CASE WHEN team % 2 = 0 THEN 'E' ELSE 'W' END AS conference, (team * 7919 + c_custkey * 104729) % 1009 AS w FROM customer, tm),
 sdd AS (SELECT sim_id, conference, team, CAST(row_number() OVER (PARTITION BY sim_id, conference ORDER BY w DESC, team) AS INT) AS seed, w FROM ws)"""


def scenario_seeds(spark, sf_dir) -> DataFrame:
    """Ten ordered sides per scenario and conference, with a stand-in record."""
    from ..operators.perspective import all_teams
    from ..operators.records import ranked

    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("sim_id"))
    # the list of sides is the dimension: a constant 25 names
    teams = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))).alias("team")
    ws = customer.select("sim_id", teams).join(all_teams(games(spark, sf_dir)), "team", "left_semi")
    ws = ws.withColumns({"conference": F.when(F.col("team") % 2 == 0, "E").otherwise("W"),
                         "w": (F.col("team") * 7919 + F.col("sim_id") * 104729) % 1009})
    return ranked(ws, "w", ["sim_id", "conference"], "seed")


def scenario_stats(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    seeds = scenario_seeds(spark, sf_dir)
    stats = seeds.select("sim_id", "team", (F.col("w") % 83).alias("wins"), (F.col("w") % 41).cast("double").alias("net_points"))
    top = seeds.filter(F.col("seed") <= 2)
    e = top.filter("conference = 'E'").select("sim_id", F.col("team").alias("a"))
    w = top.filter("conference = 'W'").select("sim_id", F.col("team").alias("b"))
    met = e.join(w.hint("merge"), "sim_id").withColumns({"x": (F.col("a") * 3 + F.col("b") * 5 + F.col("sim_id")) % 4,
                                           "y": (F.col("a") * 7 + F.col("b") + F.col("sim_id")) % 4})
    both = F.explode(F.array(F.struct(F.col("a").alias("team"), F.col("b").alias("rival"), F.col("x").alias("wins"), F.col("y").alias("losses")),
                             F.struct(F.col("b").alias("team"), F.col("a").alias("rival"), F.col("y").alias("wins"), F.col("x").alias("losses"))))
    return stats, met.select("sim_id", both.alias("p")).select("sim_id", "p.*")


_FIRST = ("CASE WHEN seed IN (1, 8) THEN '_1_8' WHEN seed IN (4, 5) THEN '_4_5' WHEN seed IN (2, 7) THEN '_2_7' ELSE '_3_6' END")


def _pair_sql(source: str) -> str:
    return (f"SELECT sim_id, label, min((seed, team))[2] AS host, max((seed, team))[2] AS guest, min((seed, team))[2] AS high_seed, max((seed, team))[2] AS low_seed, "
            f"min((seed, team))[1] AS high_seed_num, max((seed, team))[1] AS low_seed_num FROM ({source}) GROUP BY sim_id, label")


def _advance_sql(previous: str) -> str:
    step = "CASE series_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in playoffs.NEXT_LABEL.items()) + " END"
    return (f"SELECT sim_id, {step} AS label, series_winner AS team, CASE WHEN series_winner = high_seed THEN high_seed_num ELSE low_seed_num END AS seed FROM {previous}")


BRACKET_SQL = (CHAIN_SQL + f", m1 AS ({_pair_sql(f'SELECT sim_id, conference || {_FIRST} AS label, seed, team FROM sdd WHERE seed <= 8')})" + series_sql("r1", "m1")
               + f", m2 AS ({_pair_sql(_advance_sql('r1'))})" + series_sql("r2", "m2") + f", m3 AS ({_pair_sql(_advance_sql('r2'))})" + series_sql("r3", "m3")
               + f", m4a AS ({_pair_sql(_advance_sql('r3'))})" + """,
 m4b AS (SELECT m.*, a.w % 83 AS aw, b.w % 83 AS bw, a.w % 41 AS an, b.w % 41 AS bn, a.seed AS asd, b.seed AS bsd, a.conference AS ac FROM m4a m JOIN sdd a ON a.sim_id = m.sim_id AND a.team = host JOIN sdd b ON b.sim_id = m.sim_id AND b.team = guest),
 m4c AS (SELECT *, CASE WHEN asd <= 2 AND bsd <= 2 THEN CASE WHEN ac = 'E' THEN (host * 3 + guest * 5 + sim_id) % 4 - (host * 7 + guest + sim_id) % 4
   ELSE (guest * 7 + host + sim_id) % 4 - (guest * 3 + host * 5 + sim_id) % 4 END END AS met FROM m4b),
 m4d AS (SELECT *, coalesce(nullif(sign(aw - bw), 0), nullif(sign(met), 0), nullif(sign(an - bn), 0)) AS v FROM m4c),
 m4 AS (SELECT sim_id, label, CASE WHEN v > 0 THEN host ELSE guest END AS host, CASE WHEN v > 0 THEN guest ELSE host END AS guest, high_seed, low_seed, high_seed_num, low_seed_num FROM m4d)"""
               + series_sql("r4", "m4"))


@query("bracket_outcomes", "M22 M23 M25", BRACKET_SQL + " SELECT sim_id, series_label AS label, host, guest, series_winner AS winner, CAST(series_length AS INT) AS series_length FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)")
def bracket_outcomes(spark, sf_dir):
    stats, pairs = scenario_stats(spark, sf_dir)
    out = playoffs.bracket(scenario_seeds(spark, sf_dir), draw, stats, pairs)
    return out.select("sim_id", "label", "host", "guest", "winner", "series_length")


_Z = noise_sql("CAST(k AS BIGINT)", "sim_id")
_FM = ("(SELECT least(team, opponent) AS lo, greatest(team, opponent) AS hi, min_by(CASE WHEN margin > 0 THEN team ELSE opponent END, (date, game_id)) AS w FROM post WHERE year = 2000 GROUP BY ALL)")


def _settle_sql(name: str, source: str) -> str:
    return (f", {name} AS (SELECT s.*, coalesce(f.w, CASE WHEN {_edge_sql('a', 'b')} + 12.0 * {_Z} > 0 THEN a ELSE b END) AS winner FROM ({source}) s LEFT JOIN fm f ON f.lo = least(a, b) AND f.hi = greatest(a, b))")


PLAY_IN_SQL = (CHAIN_SQL + POST_SQL.replace(RATED_SQL, "") + f", fm AS {_FM}, sp AS (SELECT sim_id, conference, " + ", ".join(f"max(CASE WHEN seed = {i} THEN team END) AS s{i}" for i in range(7, 11))
               + " FROM sdd GROUP BY ALL)"
               + _settle_sql("p1", "SELECT sim_id, conference, s7 AS a, s8 AS b, CASE conference WHEN 'E' THEN 101 ELSE 111 END AS k FROM sp")
               + _settle_sql("p2", "SELECT sim_id, conference, s9 AS a, s10 AS b, CASE conference WHEN 'E' THEN 102 ELSE 112 END AS k FROM sp")
               + _settle_sql("p3", "SELECT p1.sim_id, p1.conference, CASE WHEN p1.winner = p1.a THEN p1.b ELSE p1.a END AS a, p2.winner AS b, CASE p1.conference WHEN 'E' THEN 103 ELSE 113 END AS k FROM p1 JOIN p2 ON p1.sim_id = p2.sim_id AND p1.conference = p2.conference"))


@query("play_in_seeds", "M21 J14", PLAY_IN_SQL + """ SELECT sim_id, conference, seed, team FROM sdd WHERE seed <= 6 UNION ALL SELECT sim_id, conference, 7, winner FROM p1 UNION ALL SELECT sim_id, conference, 8, winner FROM p3""")
def play_in_seeds(spark, sf_dir):
    real = playoffs.post_season_games(rated(spark, sf_dir).filter(F.col("year") == 2000))
    return playoffs.play_in(scenario_seeds(spark, sf_dir), draw_once, real)
