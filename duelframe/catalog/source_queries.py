"""Parsing of the stored and fed forms, on documents made from the contest table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import clean, history
from ..plans.ingest import ingest_games
from ..session import output_folder
from ..sinks import writers
from ..sources import readers
from .clean_queries import NAMED_SQL, abbreviated, named
from .contest import ABBRS, GAMES_SQL, RATED_SQL, games, r6, rated, rnd
from .event_queries import LOG_SQL, PACE_SQL, box, log
from .registry import query
from .scenario_queries import LOG_SQL as SIM_LOG_SQL, log as sim_log, side_ids


def _mixed_dates() -> F.Column:
    """Eight spellings that season files have had."""
    day = F.date_format("date", "yyyy-MM-dd")
    forms = [day, F.date_format("date", "MM/dd/yyyy"), *[F.concat(day, F.lit(tail)) for tail in (
        " 00:00:00", "T00:00:00Z", "T00:00:00", "T00:00:00+00:00", "T00:00:00.000Z", " 00:00:00.000")]]
    return F.get(F.array(*forms), (F.col("key") % len(forms)).cast("int"))


@query("season_file_rows", "S1 S2", NAMED_SQL + """ SELECT text_id AS game_id, CAST(date AS TIMESTAMP) AS date, abbr AS team, opp_abbr AS opponent, text_id NOT LIKE '006__00001' AS counts_toward_record,
 CAST(NULL AS BOOLEAN) AS garbage_time_detected, 'Home' AS location FROM named WHERE completed""")
def season_file_rows(spark, sf_dir):
    """Through files: old ones with other column names and fewer columns beside new ones."""
    df = named(spark, sf_dir).withColumn("key", F.col("game_id"))
    raw = df.select("key", F.col("text_id").alias("game_id"), _mixed_dates().alias("date"), "abbr", "opp_abbr", "completed", "pace")
    path = output_folder(spark, "season_files")
    for old, names in ((True, ("team_abbr", "opponent_abbr")), (False, ("team", "opponent"))):
        part = raw.filter((F.col("key") % 2 == 0) == F.lit(old)).drop("key", *(["pace"] if old else []))
        part.withColumnsRenamed(dict(zip(("abbr", "opp_abbr"), names))).write.option("header", True).csv(f"{path}/{'old' if old else 'new'}")
    out = readers.read_completed_games(spark, f"{path}/*/*.csv")
    return out.select("game_id", F.col("date").cast("timestamp_ntz").alias("date"), "team", "opponent", "counts_toward_record", "garbage_time_detected", "location")


@query("feature_archive_rows", "S3", GAMES_SQL + """ SELECT game_id, coalesce(CASE WHEN game_id % 3 = 0 THEN FALSE WHEN game_id % 3 = 1 THEN TRUE END, TRUE) AS counts_toward_record,
 CAST(date >= CASE year WHEN 2000 THEN DATE '2000-04-20' WHEN 2001 THEN DATE '2001-04-19' ELSE make_date(year, 4, 14) END AS INT) AS playoff FROM games""")
def feature_archive_rows(spark, sf_dir):
    key = F.col("game_id")
    raw = games(spark, sf_dir).select("game_id", "date", "year", F.lit(1).alias("Unnamed: 0"),
                                      F.when(key % 3 == 0, "False").when(key % 3 == 1, "True").alias("counts_toward_record"))
    out = readers.parse_feature_archive(raw)
    return out.select("game_id", "counts_toward_record", "playoff") if "Unnamed: 0" not in out.columns else out


@query("win_total_matrix", "S4", GAMES_SQL + """ SELECT y.year, CAST(i AS VARCHAR) AS team, CASE WHEN (i + y.year) % 5 = 0 THEN NULL ELSE CAST(n AS DOUBLE) END AS total
 FROM (SELECT DISTINCT year FROM games) y CROSS JOIN (SELECT n_nationkey AS i FROM nation) r LEFT JOIN (SELECT year, team AS t, count(*) AS n FROM games GROUP BY ALL) c ON c.year = y.year AND c.t = i""")
def win_total_matrix(spark, sf_dir):
    n = games(spark, sf_dir).groupBy("year", "team").agg(F.count(F.lit(1)).alias("n"))
    cell = F.when((F.col("team") + F.col("year")) % 5 == 0, F.lit(" ")).otherwise(F.col("n").cast("string"))
    wide = n.withColumn("cell", cell).groupBy("year").pivot("team", side_ids(spark, sf_dir)).agg(F.first("cell"))
    return readers.unpivot_totals(wide)


_HCA = "(2.5 * 20 + avg(margin - (team_rating - opponent_rating)) * count(*)) / (20 + count(*))"


@query("year_map_round_trip", "S5 K11", RATED_SQL + f" SELECT year, {rnd(_HCA)} AS hca FROM rated WHERE completed GROUP BY year")
def year_map_round_trip(spark, sf_dir):
    edges = history.home_edge(rated(spark, sf_dir).filter("completed"), ["year"])
    return readers.parse_year_map(writers.year_map_document(edges)).select("year", r6(F.col("hca")).alias("hca"))


def schedule_texts(spark, sf_dir) -> DataFrame:
    """One document per game, as a feed would send it."""
    key = F.col("game_id")
    side = lambda a, s: F.struct(F.col(a).alias("teamTricode"), F.concat(F.lit("Team "), F.col(a)).alias("teamName"), F.col(s).cast("int").alias("score"))
    g = F.struct(F.col("text_id").alias("gameId"), F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit("T00:30:00Z")).alias("gameDateUTC"),
                 F.when(F.col("completed"), 3).otherwise(1).alias("gameStatus"),
                 F.when(key % 31 == 0, "Preseason").when(key % 37 == 0, "In-Season Cup").alias("gameLabel"),
                 F.when(key % 74 == 0, "Championship").alias("gameSubLabel"),
                 side("abbr", "team_score").alias("homeTeam"), side("opp_abbr", "opponent_score").alias("awayTeam"))
    doc = F.struct(F.struct(F.array(F.struct(F.array(g).alias("games"))).alias("gameDates")).alias("leagueSchedule"))
    return named(spark, sf_dir).select(F.to_json(doc).alias("value"))


SCHEDULE_SQL = NAMED_SQL + """, sch AS (SELECT *, CASE WHEN game_id % 31 = 0 THEN 'Preseason' WHEN game_id % 37 = 0 THEN 'In-Season Cup' ELSE '' END AS label,
 CASE WHEN game_id % 74 = 0 THEN 'Championship' ELSE '' END AS sub FROM named)"""


@query("schedule_document_rows", "S6", SCHEDULE_SQL + """ SELECT text_id AS "gameId", strftime(date, '%Y-%m-%d') || 'T00:30:00Z' AS "gameDate", CASE WHEN completed THEN 3 ELSE 1 END AS "gameStatus", label AS "gameLabel", sub AS "gameSubLabel",
 abbr AS "homeTeam_teamTricode", 'Team ' || abbr AS "homeTeam_teamName", CAST(team_score AS INT) AS "homeTeam_score", opp_abbr AS "awayTeam_teamTricode", 'Team ' || opp_abbr AS "awayTeam_teamName", CAST(opponent_score AS INT) AS "awayTeam_score" FROM sch""")
def schedule_document_rows(spark, sf_dir):
    return readers.flatten_schedule(schedule_texts(spark, sf_dir))


_KNOWN = "[" + ", ".join(f"'{a}'" for a in ABBRS) + "]"
_CANON = "CASE {c} WHEN 'BKN' THEN 'BRK' WHEN 'CHA' THEN 'CHO' WHEN 'PHO' THEN 'PHX' ELSE {c} END"


@query("normalised_schedule", "S9 P3 P7", SCHEDULE_SQL + f""" SELECT text_id AS game_id, CAST(date AS TIMESTAMP) + INTERVAL 30 MINUTE AS date, {_CANON.format(c='abbr')} AS team, {_CANON.format(c='opp_abbr')} AS opponent,
 CASE WHEN completed THEN CAST(margin AS DOUBLE) END AS margin, completed, 2001 AS year, NOT ((label LIKE '%Cup%' AND sub = 'Championship') OR text_id LIKE '006__00001') AS counts_toward_record
 FROM sch WHERE label <> 'Preseason' AND list_contains({_KNOWN}, abbr) AND list_contains({_KNOWN}, opp_abbr)""")
def normalised_schedule(spark, sf_dir):
    flat = readers.flatten_schedule(schedule_texts(spark, sf_dir))
    out = readers.normalise_schedule(flat, spark.createDataFrame([(a,) for a in ABBRS], "abbr string"), 2001)
    return out.select("game_id", F.col("date").cast("timestamp_ntz").alias("date"), "team", "opponent", "margin", "completed", "year", "counts_toward_record")


@query("play_by_play_rows", "S7", LOG_SQL + """ SELECT CAST(game AS VARCHAR) AS "gameId", CAST(action_number AS INT) AS "actionNumber", clock, period, team_id AS "teamId", action_type AS "actionType", score_home AS "scoreHome", score_away AS "scoreAway" FROM log""")
def play_by_play_rows(spark, sf_dir):
    a = F.struct(F.col("action_number").cast("int").alias("actionNumber"), "clock", "period", F.col("team_id").alias("teamId"), F.col("action_type").alias("actionType"),
                 F.col("score_home").alias("scoreHome"), F.col("score_away").alias("scoreAway"))
    docs = log(spark, sf_dir).select(F.to_json(F.struct(F.struct(F.col("game").cast("string").alias("gameId"), F.array(a).alias("actions")).alias("game"))).alias("value"))
    return readers.flatten_actions(docs).select("gameId", "actionNumber", "clock", "period", "teamId", "actionType", "scoreHome", "scoreAway")


@query("box_score_documents", "S8 P17", PACE_SQL + " SELECT CAST(b.game_id AS VARCHAR) AS game_id, h_fga AS home_fga, a_dreb AS away_dreb, coalesce(minutes, '240:00') AS minutes FROM box b")
def box_score_documents(spark, sf_dir):
    names = {v: k for k, v in readers._BOX_NAMES.items()}
    side = lambda s: F.struct(F.struct(*[F.col(f"{s}.{k}").alias(v) for v, k in names.items()], F.col(f"{s}.minutes").alias("minutes")).alias("statistics"))
    docs = box(spark, sf_dir).select(F.to_json(F.struct(F.struct(F.col("game_id").cast("string").alias("gameId"), side("home").alias("homeTeam"),
                                                                  side("away").alias("awayTeam")).alias("game"))).alias("value"))
    return readers.flatten_box_scores(docs).select("game_id", F.col("home.fga").alias("home_fga"), F.col("away.dreb").alias("away_dreb"), F.col("home.minutes").alias("minutes"))


@query("box_score_side_rows", "S8", PACE_SQL + " SELECT game_id, h_fgm AS home_fgm, a_fgm AS away_fgm FROM box")
def box_score_side_rows(spark, sf_dir):
    two = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("home").alias("s")), F.struct(F.lit(1).alias("o"), F.col("away").alias("s")))).alias("x")
    rows = box(spark, sf_dir).select("game_id", two).select("game_id", F.col("x.o").alias("side_order"), "x.s.*")
    return readers.sides_to_box(rows).select("game_id", F.col("home.fgm").alias("home_fgm"), F.col("away.fgm").alias("away_fgm"))


@query("scenario_game_flags", "S10 P6", SIM_LOG_SQL + " SELECT simulation_id, game_id, CAST(date >= DATE '2001-04-19' AS INT) AS playoff FROM log")
def scenario_game_flags(spark, sf_dir):
    return readers.flag_sim_games(sim_log(spark, sf_dir).drop("playoff")).select("simulation_id", "game_id", "playoff")


@query("dated_archive_latest", "S13 W15", GAMES_SQL + """ SELECT team, max(date) AS file_date, arg_max(pts, date) AS pts FROM (SELECT team, date, sum(team_score) AS pts FROM games GROUP BY ALL) GROUP BY team""".replace("sum(team_score)", "CAST(sum(team_score) AS BIGINT)"))
def dated_archive_latest(spark, sf_dir):
    daily = games(spark, sf_dir).groupBy("team", "date").agg(F.sum("team_score").alias("pts"))
    paths = daily.select("team", "pts", F.concat(F.lit("archive/report_"), F.col("date").cast("string"), F.lit(".csv")).alias("path"))
    return readers.latest_snapshot(readers.with_file_date(paths, "path"), ["team"]).select("team", "file_date", "pts")


@query("team_dimension", "S12 P3", f"""SELECT n_name AS name, {_CANON.format(c='ab')} AS abbr FROM (SELECT n_name, list_extract({_KNOWN}, CAST(n_nationkey + 1 AS INT)) AS ab FROM nation)""")
def team_dimension(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    abbr = F.element_at(F.array(*[F.lit(a) for a in ABBRS]), F.col("n_nationkey") + 1)
    return readers.team_dimension(nation.select(F.col("n_name").alias("name"), abbr.alias("abbr")))


@query("ordered_game_table", "K1", NAMED_SQL + " SELECT text_id AS game_id, date, abbr AS team, opp_abbr AS opponent, team_score, opponent_score, margin, pace, completed, year, counts_toward_record FROM named")
def ordered_game_table(spark, sf_dir):
    df = abbreviated(spark, sf_dir).drop("game_id").withColumnRenamed("text_id", "game_id")
    return writers.ordered_game_columns(df.withColumn("scratch", F.lit(1)))


@query("season_rating_rows", "K4", GAMES_SQL + f" SELECT year, team, {rnd('avg(margin)')} AS rating FROM games GROUP BY ALL")
def season_rating_rows(spark, sf_dir):
    mean = games(spark, sf_dir).groupBy("year", "team").agg(F.avg("margin").alias("rating"))
    return mean.select("year", "team", r6(F.col("rating")).alias("rating"))


_INGEST_SQL = NAMED_SQL + f""", one AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY game_id) = 1)
 SELECT text_id AS game_id, CASE WHEN game_id % 3 = 0 THEN {_CANON.format(c='abbr')} ELSE abbr END AS team, CASE WHEN game_id % 3 = 0 THEN {_CANON.format(c='opp_abbr')} ELSE opp_abbr END AS opponent,
 CAST(margin AS DOUBLE) AS margin, completed, text_id NOT LIKE '006__00001' AS counts_toward_record FROM one WHERE completed OR game_id % 3 <> 0"""


@query("ingested_games", "M28 J6 J7 J8 K1", _INGEST_SQL)
def ingested_games(spark, sf_dir):
    """Two thirds of the table arrive as a feed on top of the stored third."""
    g = abbreviated(spark, sf_dir).withColumns({"key": F.col("game_id"), "margin": F.col("margin").cast("double")})
    g = clean.distinct_first(g.withColumn("game_id", F.col("text_id")), ["game_id"], ["key"])
    old = g.filter(F.col("key") % 3 == 0).select("game_id", "date", "team", "opponent", "team_score", "opponent_score", "pace", "completed", "year")
    fed = g.filter(F.col("key") % 3 != 0).select("game_id", "date", "team", "opponent", "team_score", "opponent_score", "margin", "pace", "completed", "year")
    dim = spark.createDataFrame([(a, f"Team {a}") for a in ABBRS], "abbr string, name string")
    out = ingest_games(old, fed, readers.team_dimension(dim))
    return out.select("game_id", "team", "opponent", "margin", "completed", "counts_toward_record")
