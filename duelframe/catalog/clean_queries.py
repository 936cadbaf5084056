"""Normalising, filtering and reshaping contest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..operators import clean, perspective
from ..schema import REGULAR_SEASON_END
from .contest import ABBRS, GAMES_SQL, RATED_SQL, games, r6, rated, rnd
from .registry import query

_LIST = "[" + ", ".join(f"'{a}'" for a in ABBRS) + "]"
_CANON = "CASE {c} WHEN 'BKN' THEN 'BRK' WHEN 'CHA' THEN 'CHO' WHEN 'PHO' THEN 'PHX' ELSE {c} END"

# games with the text columns a file carries
NAMED_SQL = GAMES_SQL + f""", named AS (SELECT *, CASE WHEN game_id % 211 = 0 THEN NULL WHEN team = 7 AND game_id % 5 = 0 THEN 'x7' ELSE list_extract({_LIST}, CAST(team + 1 AS INT)) END AS abbr,
 list_extract({_LIST}, CAST(opponent + 1 AS INT)) AS opp_abbr,
 CASE WHEN game_id % 97 = 0 THEN '006' || lpad(CAST(year % 100 AS VARCHAR), 2, '0') || '00001' ELSE '002' || lpad(CAST(game_id AS VARCHAR), 7, '0') END AS text_id FROM games)"""


def named(spark, sf_dir) -> DataFrame:
    abbr = lambda c: F.element_at(F.array(*[F.lit(a) for a in ABBRS]), (F.col(c) + 1).cast("int"))
    key = F.col("game_id")
    home = F.when(key % 211 == 0, None).when((F.col("team") == 7) & (key % 5 == 0), "x7").otherwise(abbr("team"))
    cup = F.concat(F.lit("006"), F.lpad((F.col("year") % 100).cast("string"), 2, "0"), F.lit("00001"))
    return games(spark, sf_dir).withColumns({
        "abbr": home, "opp_abbr": abbr("opponent"),
        "text_id": F.when(key % 97 == 0, cup).otherwise(F.concat(F.lit("002"), F.lpad(key.cast("string"), 7, "0")))})


def abbreviated(spark, sf_dir) -> DataFrame:
    """The same rows with abbreviations as the side names."""
    return named(spark, sf_dir).drop("team", "opponent").withColumnsRenamed({"abbr": "team", "opp_abbr": "opponent"})


@query("flip_perspective", "P1", RATED_SQL + """ SELECT game_id, team, opponent, margin, team_rating, opponent_rating, last_year_team_rating, last_year_opp_rating FROM rated
 UNION ALL SELECT game_id, opponent, team, -margin + 5.0, opponent_rating, team_rating, last_year_opp_rating, last_year_team_rating FROM rated""")
def flip_perspective(spark, sf_dir):
    cols = ["game_id", "team", "opponent", "margin", "team_rating", "opponent_rating", "last_year_team_rating", "last_year_opp_rating"]
    return perspective.flip_perspective(rated(spark, sf_dir).select(*cols))


@query("team_perspective_view", "P2", RATED_SQL + """ SELECT game_id, team AS club, opponent AS rival, TRUE AS is_home, margin AS margin_for_club, team_rating AS rating, opponent_rating AS rival_rating FROM rated
 UNION ALL SELECT game_id, opponent, team, FALSE, -margin, opponent_rating, team_rating FROM rated""")
def team_perspective_view(spark, sf_dir):
    return perspective.team_view(rated(spark, sf_dir), keep=["game_id"])


@query("canonical_abbreviations", "P3", NAMED_SQL + f" SELECT game_id, {_CANON.format(c='abbr')} AS team, {_CANON.format(c='opp_abbr')} AS opponent FROM named")
def canonical_abbreviations(spark, sf_dir):
    return clean.canonicalize(abbreviated(spark, sf_dir)).select("game_id", "team", "opponent")


@query("source_team_ids", "P4 S12", NAMED_SQL + f""", cn AS (SELECT game_id, {_CANON.format(c='opp_abbr')} AS team FROM named),
 dim AS (SELECT list_extract({_LIST}, CAST(n_nationkey + 1 AS INT)) AS abbr, 1000 + n_nationkey AS team_id FROM nation)
 SELECT game_id, team, CAST(team_id AS BIGINT) AS team_id FROM (SELECT *, CASE team WHEN 'BRK' THEN 'BKN' WHEN 'CHO' THEN 'CHA' ELSE team END AS src FROM cn) LEFT JOIN dim ON src = abbr""")
def source_team_ids(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    dim = nation.select(F.element_at(F.array(*[F.lit(a) for a in ABBRS]), F.col("n_nationkey") + 1).alias("abbr"),
                        (F.col("n_nationkey") + 1000).cast("bigint").alias("team_id"))
    canon = clean.canonicalize(abbreviated(spark, sf_dir), ["opponent"]).select("game_id", F.col("opponent").alias("team"))
    return clean.with_source_ids(canon, dim).select("game_id", "team", "team_id")


_STARTS = "CASE year WHEN 2000 THEN DATE '2000-04-20' WHEN 2001 THEN DATE '2001-04-19' ELSE make_date(year, 4, 14) END"


@query("playoff_start_dates", "P5", GAMES_SQL + f" SELECT DISTINCT year, {_STARTS} AS playoff_start FROM games")
def playoff_start_dates(spark, sf_dir):
    return games(spark, sf_dir).select("year", S.playoff_start(F.col("year"), REGULAR_SEASON_END).alias("playoff_start")).distinct()


@query("playoff_flags", "P6 S10", GAMES_SQL + f" SELECT game_id, CAST(date >= {_STARTS} AS INT) AS playoff FROM games")
def playoff_flags(spark, sf_dir):
    return clean.add_playoff_flag(games(spark, sf_dir)).select("game_id", "playoff")


@query("record_counting_flags", "P7", NAMED_SQL + """ SELECT game_id, CASE WHEN game_id % 5 = 0 THEN game_id % 10 = 0 ELSE text_id NOT LIKE '006__00001' END AS counts_toward_record FROM named""")
def record_counting_flags(spark, sf_dir):
    stored = F.when(F.col("key") % 10 == 0, "True").when(F.col("key") % 5 == 0, "False")
    df = named(spark, sf_dir).withColumn("key", F.col("game_id")).drop("game_id", "counts_toward_record")
    df = df.withColumnRenamed("text_id", "game_id").withColumn("counts_toward_record", stored)
    return clean.add_counts_flag(df).select(F.col("key").alias("game_id"), "counts_toward_record")


@query("completed_and_future_counts", "P8 A49", NAMED_SQL + """ SELECT year, count(*) FILTER (completed) AS completed, count(*) FILTER (NOT completed) AS future
 FROM named WHERE abbr IS NOT NULL AND opp_abbr IS NOT NULL GROUP BY year""")
def completed_and_future_counts(spark, sf_dir):
    df = clean.drop_missing_teams(abbreviated(spark, sf_dir))
    return df.groupBy("year").agg(F.count_if("completed").alias("completed"), F.count_if(~F.col("completed")).alias("future"))


@query("load_quality_counters", "A49", NAMED_SQL + """ SELECT count(*) FILTER (completed) AS completed, count(*) FILTER (abbr IS NULL OR opp_abbr IS NULL) AS missing_team,
 count(*) FILTER (completed AND pace IS NOT NULL) AS with_pace FROM named""")
def load_quality_counters(spark, sf_dir):
    return clean.quality_counters(abbreviated(spark, sf_dir))


@query("as_of_replay_split", "P9", RATED_SQL + """ SELECT game_id, date < DATE '2000-06-01' AS completed FROM rated WHERE date < DATE '2000-06-01' OR playoff = 0""")
def as_of_replay_split(spark, sf_dir):
    return clean.replay_split(rated(spark, sf_dir), "2000-06-01").select("game_id", "completed")


@query("margin_from_scores", "P10", GAMES_SQL + """ SELECT game_id, CASE WHEN year = 1997 THEN CAST(margin AS DOUBLE) WHEN completed THEN CAST(margin AS DOUBLE) + 0.5 END AS margin FROM games""")
def margin_from_scores(spark, sf_dir):
    stored = F.when((F.col("year") != 1997) & F.col("completed"), F.col("margin").cast("double") + 0.5)
    return clean.margin_if_absent(games(spark, sf_dir).withColumn("margin", stored)).select("game_id", "margin")


@query("valid_team_games", "P11 J16", NAMED_SQL + """, c AS (SELECT h.year, h.t FROM (SELECT year, abbr AS t, count(*) AS n FROM named GROUP BY ALL) h
  JOIN (SELECT year, opp_abbr AS t, count(*) AS n FROM named GROUP BY ALL) a ON h.year = a.year AND h.t = a.t
  WHERE regexp_full_match(h.t, '[A-Z]{3}') AND h.n + a.n >= 20)
 SELECT game_id FROM named n WHERE EXISTS (SELECT 1 FROM c WHERE c.year = n.year AND c.t = abbr) AND EXISTS (SELECT 1 FROM c WHERE c.year = n.year AND c.t = opp_abbr)""")
def valid_team_games(spark, sf_dir):
    return clean.keep_valid_games(abbreviated(spark, sf_dir)).select("game_id")


@query("game_winners", "P12", GAMES_SQL + " SELECT game_id, CASE WHEN margin > 0 THEN team ELSE opponent END AS winner, CAST(margin > 0 AS INT) AS team_win FROM games")
def game_winners(spark, sf_dir):
    m = F.col("margin")
    return games(spark, sf_dir).select("game_id", S.winner(m, F.col("team"), F.col("opponent")).alias("winner"),
                                       S.home_win(m).cast("int").alias("team_win"))


@query("game_edges_and_pace", "P14 P15", GAMES_SQL + """ SELECT game_id, CAST(CASE WHEN NOT counts_toward_record THEN 0.0 ELSE 2.5 END AS DOUBLE) AS edge, coalesce(pace, 100.0) AS pace FROM games""")
def game_edges_and_pace(spark, sf_dir):
    neutral = ~F.col("counts_toward_record")
    return games(spark, sf_dir).select("game_id", S.game_edge(neutral, F.lit(2.5)).alias("edge"), S.pace_or_default(F.col("pace")).alias("pace"))


@query("season_and_game_labels", "P31", GAMES_SQL + """ SELECT game_id, CAST(year - 1 AS VARCHAR) || '-' || lpad(CAST(year % 100 AS VARCHAR), 2, '0') AS season,
 CASE WHEN game_id % 2 = 0 THEN 'vs ' ELSE '@ ' END || CAST(opponent AS VARCHAR) AS label FROM games""")
def season_and_game_labels(spark, sf_dir):
    return games(spark, sf_dir).select("game_id", S.season_label(F.col("year")).alias("season"),
                                       S.game_label(F.col("game_id") % 2 == 0, F.col("opponent")).alias("label"))


@query("box_score_completeness", "P32", GAMES_SQL + """ SELECT game_id, game_id % 3 <> 0 AND game_id % 4 <> 0 AS complete FROM games""")
def box_score_completeness(spark, sf_dir):
    key = F.col("game_id")
    df = games(spark, sf_dir).withColumns({
        "fgm": F.when(key % 3 != 0, F.lit(40.0)), "off_rating": F.lit(110.0), "opp_fgm": F.when(key % 4 != 0, F.lit(38.0)),
        "opp_off_rating": F.lit(108.0)})
    return df.select("game_id", clean.has_box_stats(df).alias("complete"))


@query("new_game_rows", "J6", GAMES_SQL + " SELECT game_id FROM games WHERE NOT (game_id % 3 = 0)")
def new_game_rows(spark, sf_dir):
    g = games(spark, sf_dir)
    return clean.new_rows(g, g.filter(F.col("game_id") % 3 == 0)).select("game_id")


@query("existing_and_new_rows", "J7", GAMES_SQL + """ SELECT game_id, CASE WHEN game_id % 3 = 0 THEN 'NATION_' || CAST(team AS VARCHAR) END AS team_name,
 CASE WHEN game_id % 3 = 0 THEN 'NATION_' || CAST(opponent AS VARCHAR) END AS opponent_name, CAST(margin AS DOUBLE) AS margin FROM games""")
def existing_and_new_rows(spark, sf_dir):
    g = games(spark, sf_dir)
    dim = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.col("n_nationkey").cast("bigint").alias("abbr"), F.col("n_name").alias("name"))
    old = g.filter(F.col("game_id") % 3 == 0).drop("margin")
    fresh = clean.new_rows(g, old).withColumn("margin", F.col("margin").cast("double"))
    return clean.union_backfilled(old, fresh, dim).select("game_id", "team_name", "opponent_name", "margin")


@query("distinct_teams", "J17", GAMES_SQL + " SELECT year, team FROM games UNION SELECT year, opponent FROM games")
def distinct_teams(spark, sf_dir):
    return perspective.all_teams(games(spark, sf_dir), ["year"])


@query("season_team_complements", "J16 J18", GAMES_SQL + """, a AS (SELECT team FROM games GROUP BY team HAVING max(margin) >= 49), b AS (SELECT opponent AS team FROM games GROUP BY opponent HAVING min(margin) <= -49)
 SELECT (SELECT count(*) FROM (SELECT team FROM a INTERSECT SELECT team FROM b)) AS shared, (SELECT count(*) FROM (SELECT team FROM a EXCEPT SELECT team FROM b)) AS only_home,
 (SELECT count(*) FROM a) = (SELECT count(DISTINCT team) FROM a) AS no_duplicates""")
def season_team_complements(spark, sf_dir):
    g = games(spark, sf_dir)
    home = g.groupBy("team").agg(F.max("margin").alias("m")).filter("m >= 49").select("team")
    away = g.groupBy(F.col("opponent").alias("team")).agg(F.min("margin").alias("m")).filter("m <= -49").select("team")
    marked = home.withColumn("h", F.lit(1)).join(away.withColumn("a", F.lit(1)), "team", "full")
    return marked.agg(F.count_if(F.col("h").isNotNull() & F.col("a").isNotNull()).alias("shared"),
                      F.count_if(F.col("h").isNotNull() & F.col("a").isNull()).alias("only_home"),
                      (F.count("h") == F.count_distinct(F.when(F.col("h").isNotNull(), F.col("team")))).alias("no_duplicates"))


@query("appended_games", "J19", GAMES_SQL + """ SELECT game_id, completed, counts_toward_record, pace FROM games UNION ALL
 SELECT game_id + 1000000000, FALSE, TRUE, NULL FROM games WHERE NOT completed""")
def appended_games(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "completed", "counts_toward_record", "pace")
    extra = clean.future_games(g).select((F.col("game_id") + 1000000000).alias("game_id"))
    return clean.append_games(g, extra)


@query("first_row_per_game", "W15", GAMES_SQL + """ SELECT team, opponent, date, min(game_id) AS game_id FROM games GROUP BY ALL""")
def first_row_per_game(spark, sf_dir):
    g = games(spark, sf_dir).select("game_id", "team", "opponent", "date")
    return clean.distinct_first(g, ["team", "opponent", "date"], ["game_id"])


@query("accuracy_columns", "P35", RATED_SQL + f" SELECT game_id, CAST(margin > 0 AS INT) AS actual_win, {rnd('pred - margin')} AS margin_error FROM rated WHERE completed")
def accuracy_columns(spark, sf_dir):
    return rated(spark, sf_dir).filter("completed").select(
        "game_id", S.home_win(F.col("margin")).cast("int").alias("actual_win"), r6(F.col("pred") - F.col("margin")).alias("margin_error"))
