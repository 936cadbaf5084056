"""Readers with explicit schemas.  Each file reader is a thin load plus a parse step that also works on any DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalar as S
from ..operators.clean import add_counts_flag, add_playoff_flag, canonicalize
from ..operators.scan import first_per_key
from ..schema import (ACTION_FIELDS, ACTIONS_SCHEMA, BOX_SCORE_SCHEMA, GAME_FILE_SCHEMA, PLAYOFF_GAME_SCHEMA,
                      SAFE_LEAD_COLUMNS, SCHEDULE_SCHEMA, SIM_GAME_SCHEMA)

_SAFE_LEAD_TYPES = dict(zip(SAFE_LEAD_COLUMNS, ("boolean", "int", "string", "int", "int")))


# ---- season games ------------------------------------------------------------------------------


def parse_games(raw: DataFrame) -> DataFrame:
    """Rename old side columns, parse mixed date formats, fill columns that old files lack."""
    out = raw
    if "team_abbr" in out.columns and "team" not in out.columns:
        out = out.withColumnsRenamed({"team_abbr": "team", "opponent_abbr": "opponent"})
    out = out.withColumns({"game_id": F.col("game_id").cast("string"), "date": S.parse_mixed_timestamp(F.col("date").cast("string"))})
    missing = {c: F.lit(None).cast(t) for c, t in _SAFE_LEAD_TYPES.items() if c not in out.columns}
    return add_counts_flag(out.withColumns(missing) if missing else out)


def read_games(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Season files (a glob or a list).  Columns are matched by header name, which may differ from file to file;
    numbers as text keep leading zeros.  ``unreadable_dates`` counts what ``date`` can't take."""
    types = dict(part.split(" ") for part in GAME_FILE_SCHEMA.split(", "))
    out = None
    for files in files_by_header(spark, path):
        raw = spark.read.option("header", True).option("enforceSchema", False).csv(files)
        typed = parse_games(raw.select(*[F.col(c).try_cast(types.get(c, "string")).alias(c) for c in raw.columns]))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


def files_by_header(spark: SparkSession, path: str | Sequence[str]) -> list[list[str]]:
    """The files below ``path``, those with the same header line together; one entry per header and file."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.first("value").alias("header"))
    groups: dict[str, list[str]] = {}
    for row in sorted(first.collect(), key=lambda r: r.file_path):
        groups.setdefault(row.header, []).append(row.file_path)
    if not groups:
        raise ValueError(f"no season file below {path}")
    return list(groups.values())


def unreadable_dates(raw: DataFrame) -> DataFrame:
    """One row: how many dates are written, and how many of them can't be read."""
    text = F.col("date").cast("string")
    return raw.agg(F.count_if(F.trim(text) != "").alias("dates"), F.count_if(S.unreadable_date(text)).alias("unreadable"))


def read_completed_games(spark: SparkSession, path: str) -> DataFrame:
    return completed_with_defaults(read_games(spark, path))


def completed_with_defaults(games: DataFrame) -> DataFrame:
    """Completed rows only; every stored row is a home row."""
    return games.filter("completed").withColumn("location", F.lit("Home"))


def parse_feature_archive(df: DataFrame) -> DataFrame:
    out = df.drop(*[c for c in df.columns if "Unnamed" in c])
    flag = F.coalesce(S.as_boolean(F.col("counts_toward_record")), F.lit(True)) if "counts_toward_record" in out.columns else F.lit(True)
    return add_playoff_flag(out.withColumn("counts_toward_record", flag))


# ---- keyed matrices and maps -------------------------------------------------------------------


def unpivot_totals(wide: DataFrame) -> DataFrame:
    """First column is the season, the others are sides; blank cells are null."""
    year, *teams = wide.columns
    long = wide.select(F.col(year).cast("int").alias("year"), *[F.col(f"`{t}`").cast("string").alias(t) for t in teams]).unpivot(
        "year", teams, "team", "cell")
    return long.select("year", "team", F.nullif(F.trim("cell"), F.lit("")).try_cast("double").alias("total"))


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return unpivot_totals(spark.read.option("header", True).csv(path))


def parse_year_map(texts: DataFrame, column: str = "value") -> DataFrame:
    """A JSON object of year to number, one row per year."""
    entries = F.explode(F.from_json(F.col(column), "map<string,double>")).alias("year", "hca")
    return texts.select(entries).select(F.col("year").cast("int").alias("year"), "hca")


def read_year_map(spark: SparkSession, path: str) -> DataFrame:
    """A missing file gives no rows."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], "year int, hca double")
    return parse_year_map(spark.read.text(path, wholetext=True))


SLOT_DOCUMENT = ("year int,slots array<struct<round:string,conference:string,slot:string,"
                 "candidates:array<struct<team:bigint,seed:int,wins:array<bigint>>>>>")


def parse_slot_document(texts: DataFrame, column: str = "value") -> DataFrame:
    """The candidates of slot documents, one row each, with their wins by length of series."""
    documents = texts.select(F.from_json(F.col(column), SLOT_DOCUMENT).alias("d"))
    slots = documents.select("d.year", F.explode("d.slots").alias("s"))
    rows = slots.select("year", "s.round", "s.conference", "s.slot", F.explode("s.candidates").alias("c"))
    wins = [F.get("c.wins", F.lit(k)).alias(f"w{k + 4}") for k in range(4)]
    return rows.select("year", "round", "conference", "slot", "c.team", "c.seed", *wins)


# ---- feeds -------------------------------------------------------------------------------------


def flatten_schedule(texts: DataFrame, column: str = "value") -> DataFrame:
    doc = texts.select(F.from_json(F.col(column), SCHEDULE_SCHEMA).alias("d"))
    days = doc.select(F.explode("d.leagueSchedule.gameDates").alias("day"))
    g = days.select(F.explode("day.games").alias("g"))
    return g.select(
        F.col("g.gameId").alias("gameId"), F.col("g.gameDateUTC").alias("gameDate"), F.col("g.gameStatus").alias("gameStatus"),
        F.coalesce("g.gameLabel", F.lit("")).alias("gameLabel"), F.coalesce("g.gameSubLabel", F.lit("")).alias("gameSubLabel"),
        *[F.col(f"g.{side}.{name}").alias(f"{side}_{name}") for side in ("homeTeam", "awayTeam") for name in ("teamTricode", "teamName", "score")])


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    return flatten_schedule(spark.read.text(path, wholetext=True))


def normalise_schedule(schedule: DataFrame, team_dim: DataFrame, year: int) -> DataFrame:
    """Feed rows to contest rows: no preseason, known sides only, status 3 is final, naive UTC dates."""
    known = team_dim.select(F.col("abbr").alias("homeTeam_teamTricode"))
    rival = team_dim.select(F.col("abbr").alias("awayTeam_teamTricode"))
    kept = (schedule.filter(F.coalesce(F.col("gameLabel") != "Preseason", F.lit(True)))
            .join(known, "homeTeam_teamTricode", "left_semi").join(rival, "awayTeam_teamTricode", "left_semi"))
    done = F.col("gameStatus") == 3
    home, away = F.col("homeTeam_score").cast("double"), F.col("awayTeam_score").cast("double")
    return canonicalize(kept.select(
        F.col("gameId").alias("game_id"), S.parse_mixed_timestamp(F.col("gameDate")).alias("date"),
        F.col("homeTeam_teamTricode").alias("team"), F.col("awayTeam_teamTricode").alias("opponent"),
        F.col("homeTeam_teamName").alias("team_name"), F.col("awayTeam_teamName").alias("opponent_name"),
        home.alias("team_score"), away.alias("opponent_score"), F.when(done, home - away).alias("margin"),
        F.lit("Home").alias("location"), F.lit(None).cast("double").alias("pace"), done.alias("completed"),
        F.lit(year).alias("year"),
        (~S.is_cup_final(F.col("gameId"), F.col("gameLabel"), F.col("gameSubLabel"))).alias("counts_toward_record")))


def flatten_actions(texts: DataFrame, column: str = "value") -> DataFrame:
    doc = texts.select(F.from_json(F.col(column), ACTIONS_SCHEMA).alias("d"))
    rows = doc.select(F.col("d.game.gameId").alias("gameId"), F.explode("d.game.actions").alias("a"))
    return rows.select("gameId", *[F.col(f"a.{c}").alias(c) for c in ACTION_FIELDS])


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    return flatten_actions(spark.read.text(path, wholetext=True))


def as_event_log(actions: DataFrame) -> DataFrame:
    """Names the event jobs use."""
    return actions.select(F.col("gameId").alias("game"), F.col("actionNumber").alias("action_number"), "period", "clock",
                          F.col("actionType").alias("action_type"), F.col("teamId").alias("team_id"),
                          F.col("scoreHome").alias("score_home"), F.col("scoreAway").alias("score_away"))


_BOX_NAMES = {"fga": "fieldGoalsAttempted", "fgm": "fieldGoalsMade", "fta": "freeThrowsAttempted", "oreb": "reboundsOffensive",
              "dreb": "reboundsDefensive", "tov": "turnovers"}
_BOX_EXTRA = {"fg3m": "threePointersMade", "fg3a": "threePointersAttempted", "ftm": "freeThrowsMade", "ast": "assists",
              "stl": "steals", "blk": "blocks", "efg_pct": "fieldGoalsEffectiveAdjusted", "ts_pct": "trueShootingPercentage"}


def flatten_box_scores(texts: DataFrame, column: str = "value") -> DataFrame:
    """Home and away structs; minutes default to a regulation game."""
    doc = texts.select(F.from_json(F.col(column), BOX_SCORE_SCHEMA).alias("d"))

    def side(name: str):
        stats = f"d.game.{name}.statistics"
        fields = [F.col(f"{stats}.{v}").alias(k) for k, v in {**_BOX_NAMES, **_BOX_EXTRA}.items()]
        return F.struct(*fields, F.coalesce(f"{stats}.minutes", F.lit("240:00")).alias("minutes"))

    return doc.select(F.col("d.game.gameId").alias("game_id"), side("homeTeam").alias("home"), side("awayTeam").alias("away"))


def sides_to_box(rows: DataFrame) -> DataFrame:
    """Two rows per game (first row is home by ``side_order``) to one row with two structs."""
    stats = F.struct(*[c for c in rows.columns if c not in ("game_id", "side_order")])
    return rows.groupBy("game_id").agg(F.min_by(stats, "side_order").alias("home"), F.max_by(stats, "side_order").alias("away"))


# ---- scenario outputs and archives -------------------------------------------------------------


def read_sim_games(spark: SparkSession, path: str) -> DataFrame:
    """Saved scenario games with a playoff flag by the latest season in the file."""
    log = spark.read.schema(SIM_GAME_SCHEMA).option("header", True).csv(path)
    return flag_sim_games(log)


def flag_sim_games(log: DataFrame) -> DataFrame:
    season = log.agg(F.max(F.year("date")).alias("year"))
    return add_playoff_flag(log.join(F.broadcast(season))).drop("year")  # one row


def read_win_matrix(spark: SparkSession, path: str) -> DataFrame:
    wide = spark.read.option("header", True).csv(path)
    first, *teams = wide.columns
    return wide.unpivot(first, teams, "team", "wins").select(
        F.col(first).cast("bigint").alias("sim_id"), "team", F.col("wins").try_cast("int").alias("wins"))


def read_playoff_games(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    reader = spark.read.schema(PLAYOFF_GAME_SCHEMA)
    return reader.option("header", True).csv(path) if form == "csv" else reader.parquet(path)


def team_dimension(names: DataFrame) -> DataFrame:
    """name and canonical abbreviation, usable in both directions.  Input: name, abbr."""
    return canonicalize(names.select("name", "abbr"), ["abbr"]).distinct()


def with_file_date(df: DataFrame, path_column: str) -> DataFrame:
    """The date in each row's file name."""
    return df.withColumn("file_date", F.to_date(F.regexp_extract(path_column, r"(\d{4}-\d{2}-\d{2})", 1)))


def read_dated_archive(spark: SparkSession, glob: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(glob).withColumn("__path", F.input_file_name())
    return with_file_date(raw, "__path").drop("__path")


def latest_snapshot(archive: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest archived row per key."""
    return first_per_key(archive, keys, [F.col("file_date").desc()])
