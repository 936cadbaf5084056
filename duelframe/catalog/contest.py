"""The contest tables that every query starts from, derived from the given star schema.

Each Spark view has a SQL twin (a CTE text) used by the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ABBRS = ["ATL", "BOS", "BKN", "CHA", "CHI", "CLE", "DAL", "DEN", "DET", "GSW", "HOU", "IND", "LAC",
         "LAL", "MEM", "MIA", "MIL", "MIN", "NOP", "NYK", "OKC", "ORL", "PHI", "PHO", "POR"]
NOISE_MOD = 2147483647
BRACKET = ["E_1_8", "E_4_5", "E_2_7", "E_3_6", "W_1_8", "W_4_5", "W_2_7", "W_3_6",
           "E_1_4", "E_2_3", "W_1_4", "W_2_3", "E_1_2", "W_1_2", "Finals"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- games: one row per contest, home side first ---------------------------------------------

GAMES_SQL = """games AS (
 SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year,
  CAST(c_nationkey AS BIGINT) AS team, CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS BIGINT) AS opponent,
  80 + CAST(floor(o_totalprice / 10000) AS BIGINT) AS team_score,
  CAST(80 + (o_orderkey * 37 + o_custkey) % 50 AS BIGINT) AS opponent_score,
  80 + CAST(floor(o_totalprice / 10000) AS BIGINT) - CAST(80 + (o_orderkey * 37 + o_custkey) % 50 AS BIGINT) AS margin,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(90 + o_orderkey % 20 AS DOUBLE) END AS pace,
  o_orderdate < TIMESTAMP '2001-04-01' AS completed, o_orderkey % 97 <> 0 AS counts_toward_record
 FROM orders JOIN customer ON o_custkey = c_custkey)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("o_orderkey")
    home_score = 80 + F.floor(F.col("o_totalprice") / 10000)
    away_score = 80 + (key * 37 + F.col("o_custkey")) % 50
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("game_id"),
        F.to_date("o_orderdate").alias("date"),
        F.year("o_orderdate").alias("year"),
        F.col("c_nationkey").cast("bigint").alias("team"),
        ((F.col("c_nationkey") + 1 + key % 24) % 25).cast("bigint").alias("opponent"),
        home_score.alias("team_score"),
        away_score.alias("opponent_score"),
        (home_score - away_score).alias("margin"),
        F.when(key % 50 != 0, (90 + key % 20).cast("double")).alias("pace"),
        (F.col("o_orderdate") < F.lit("2001-04-01").cast("timestamp")).alias("completed"),
        (key % 97 != 0).alias("counts_toward_record"),
    )


# ---- rated: games with stand-in ratings, a season stage flag and a stand-in prediction ---------
# Margins of games that are not completed are null, as in a live season table.


def rating_of(team: Column, year: Column) -> Column:
    return ((team * 7 + year) % 13 - 6).cast("double")


def last_rating_of(team: Column, year: Column) -> Column:
    return ((team * 5 + year) % 11 - 5).cast("double")


RATED_SQL = GAMES_SQL + """, rated AS (
 SELECT game_id, date, year, team, opponent, team_score, opponent_score,
  CASE WHEN completed THEN CAST(margin AS DOUBLE) END AS margin, pace, completed, counts_toward_record,
  CAST((team * 7 + year) % 13 - 6 AS DOUBLE) AS team_rating,
  CAST((opponent * 7 + year) % 13 - 6 AS DOUBLE) AS opponent_rating,
  CAST((team * 5 + year) % 11 - 5 AS DOUBLE) AS last_year_team_rating,
  CAST((opponent * 5 + year) % 11 - 5 AS DOUBLE) AS last_year_opp_rating,
  CAST(date >= make_date(year, 11, 1) AS INT) AS playoff,
  CAST((team * 7 + year) % 13 - (opponent * 7 + year) % 13 AS DOUBLE) + 2.5 AS pred
 FROM games)"""


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir)
    year = F.col("year").cast("bigint")
    team, rival = F.col("team"), F.col("opponent")
    return g.withColumns({
        "margin": F.when(F.col("completed"), F.col("margin").cast("double")),
        "team_rating": rating_of(team, year),
        "opponent_rating": rating_of(rival, year),
        "last_year_team_rating": last_rating_of(team, year),
        "last_year_opp_rating": last_rating_of(rival, year),
        "playoff": (F.col("date") >= F.make_date("year", F.lit(11), F.lit(1))).cast("int"),
        "pred": rating_of(team, year) - rating_of(rival, year) + 2.5,
    })


# two rows per rated game
SIDES_SQL = RATED_SQL + """, sides AS (
 SELECT game_id, date, year, team AS club, opponent AS rival, TRUE AS is_home, margin AS m, team_rating AS own_r,
  opponent_rating AS rival_r, last_year_team_rating AS last_r, pace, completed, counts_toward_record, playoff, pred,
  team_score AS pts_for, opponent_score AS pts_against FROM rated
 UNION ALL
 SELECT game_id, date, year, opponent, team, FALSE, -margin, opponent_rating, team_rating, last_year_opp_rating, pace,
  completed, counts_toward_record, playoff, -pred, opponent_score, team_score FROM rated)"""


# ---- event log: one key per user, actions numbered in time order ------------------------------

ACTIONS_SQL = """actions AS (
 SELECT user_id AS game, rn AS action_number, event_id,
  CAST(1 + (rn - 1) * 4 // n AS INT) AS period,
  CAST(720 - (((rn - 1) * 2880) // n) % 720 AS INT) AS clock_left,
  CASE event_type WHEN 'view' THEN 'Shot' WHEN 'signup' THEN 'rebound' WHEN 'click' THEN 'turnover'
   WHEN 'error' THEN 'foul' ELSE 'FreeThrow' END AS action_type,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id * 10 + event_id % 2 END AS team_id,
  CAST(rn // 2 AS BIGINT) AS score_home_n,
  CAST(CASE WHEN user_id % 3 = 0 THEN rn // 2 ELSE rn // 6 END AS BIGINT) AS score_away_n
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
        count(*) OVER (PARTITION BY user_id) AS n FROM events))"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Play-by-play shaped log; positions come from the blocked scan so that one busy key is not one task."""
    from ..operators.scan import blocked_scan

    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ev = ev.withColumn("day", F.to_date("ts"))
    numbered = blocked_scan(ev, ["user_id"], "day", ["ts", "event_id"], position="rn")
    size = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    rn, n = F.col("rn"), F.col("n")
    kind = (F.when(F.col("event_type") == "view", "Shot").when(F.col("event_type") == "signup", "rebound")
            .when(F.col("event_type") == "click", "turnover").when(F.col("event_type") == "error", "foul")
            .otherwise("FreeThrow"))
    away = F.when(F.col("user_id") % 3 == 0, F.expr("rn div 2")).otherwise(F.expr("rn div 6"))
    return numbered.join(size, "user_id").select(
        F.col("user_id").alias("game"),
        rn.alias("action_number"),
        "event_id",
        F.expr("CAST(1 + (rn - 1) * 4 div n AS INT)").alias("period"),
        F.expr("CAST(720 - (((rn - 1) * 2880) div n) % 720 AS INT)").alias("clock_left"),
        kind.alias("action_type"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id") * 10 + F.col("event_id") % 2).alias("team_id"),
        F.expr("rn div 2").alias("score_home_n"),
        away.alias("score_away_n"),
    )


# ---- deterministic noise for scenario checks --------------------------------------------------


def noise(game: Column, sim: Column) -> Column:
    """Reproducible draw with mean 0 and variance 1, the same on every engine."""
    p = F.lit(NOISE_MOD).cast("bigint")
    v = (game * 1103515245 + sim.cast("bigint") * 1999999973 + 12345) % p
    r = (((v * v) % p) * v) % p
    return F.sqrt(F.lit(3.0)) * (2 * (r / F.lit(float(NOISE_MOD))) - 1)


def noise_sql(game: str, sim: str) -> str:
    v = f"(({game}*1103515245 + CAST({sim} AS BIGINT)*1999999973 + 12345) % 2147483647)"
    return f"(sqrt(3.0)*(2*((((({v}*{v}) % 2147483647) * {v}) % 2147483647)/2147483647.0) - 1))"


def rnd(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def r6(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits) + 0.0
