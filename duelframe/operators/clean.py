"""Normalising and filtering contest rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from ..schema import ABBR_SOURCE, BOX_REQUIRED, REGULAR_SEASON_END


def canonicalize(df: DataFrame, columns: Iterable[str] = ("team", "opponent")) -> DataFrame:
    return df.withColumns({c: S.canonical_abbr(F.col(c)) for c in columns if c in df.columns})


def with_source_ids(df: DataFrame, team_dim: DataFrame, column: str = "team") -> DataFrame:
    """Canonical abbreviation back to the source's spelling and its id (null when unknown)."""
    spelled = df.withColumn("source_abbr", S.lookup(F.col(column), ABBR_SOURCE, F.col(column)))
    dim = team_dim.select(F.col("abbr").alias("source_abbr"), F.col("team_id"))
    return spelled.join(dim, "source_abbr", "left")


def add_playoff_flag(df: DataFrame, ends: Mapping[int, str] = REGULAR_SEASON_END) -> DataFrame:
    """Date at or after the season's playoff start; rows that already carry a flag keep it."""
    year = F.col("year") if "year" in df.columns else F.year("date")
    derived = (F.to_date("date") >= S.playoff_start(year, ends)).cast("int")
    return df.withColumn("playoff", F.coalesce(F.col("playoff"), derived) if "playoff" in df.columns else derived)


def add_counts_flag(df: DataFrame) -> DataFrame:
    """Whether a game counts toward the record: stored text or boolean, else every game but the cup final."""
    derived = ~S.is_cup_final(F.col("game_id"))
    if "counts_toward_record" in df.columns:
        derived = F.coalesce(S.as_boolean(F.col("counts_toward_record")), derived)
    return df.withColumn("counts_toward_record", derived)


def drop_missing_teams(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["team", "opponent"])


def completed_games(df: DataFrame) -> DataFrame:
    return df.filter(F.col("completed"))


def future_games(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("completed"), F.lit(False)))


def completed_from_margin(df: DataFrame) -> DataFrame:
    return df.withColumn("completed", F.col("margin").isNotNull())


def replay_split(df: DataFrame, start_date: str) -> DataFrame:
    """Season as it stood at ``start_date``: earlier games completed, later ones open; later playoff games drop."""
    open_game = F.col("date") >= F.lit(start_date).cast("date")
    return df.withColumn("completed", ~open_game).filter(~open_game | (F.col("playoff") == 0))


def margin_if_absent(df: DataFrame, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Score difference only for groups whose margin column is wholly null; other groups are left alone."""
    present = df.groupBy(*keys).agg(F.count("margin").alias("__present"))
    filled = F.when(F.col("__present") == 0, (F.col("team_score") - F.col("opponent_score")).cast("double"))
    return (df.join(present, list(keys)).withColumn("margin", F.coalesce(filled, F.col("margin")))
            .select(*df.columns))


def valid_teams(df: DataFrame, min_games: int = 20, keys: Sequence[str] = ("year",)) -> DataFrame:
    """Three-capital names seen at least ``min_games`` times, and on both sides."""
    home = df.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("h"))
    away = df.groupBy(*keys, F.col("opponent").alias("team")).agg(F.count(F.lit(1)).alias("a"))
    return (home.join(away, [*keys, "team"], "inner")
            .filter(F.col("team").rlike("^[A-Z]{3}$") & (F.col("h") + F.col("a") >= min_games))
            .select(*keys, "team"))


def keep_valid_games(df: DataFrame, min_games: int = 20, keys: Sequence[str] = ("year",)) -> DataFrame:
    valid = valid_teams(df, min_games, keys)
    rivals = valid.withColumnRenamed("team", "opponent")
    return df.join(valid, [*keys, "team"], "left_semi").join(rivals, [*keys, "opponent"], "left_semi")


def has_box_stats(df: DataFrame) -> Column:
    """True where every required box column exists and is filled."""
    if not set(BOX_REQUIRED) <= set(df.columns):
        return F.lit(False)
    flag = F.lit(True)
    for name in BOX_REQUIRED:
        flag = flag & F.col(name).isNotNull()
    return flag


def distinct_first(df: DataFrame, subset: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per ``subset`` in an explicit order."""
    order_key = F.struct(*order)
    kept = df.groupBy(*subset).agg(F.min_by(F.struct(*df.columns), order_key).alias("row"))
    return kept.select("row.*")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str = "game_id") -> DataFrame:
    return incoming.join(existing.select(key), key, "left_anti")


def union_backfilled(existing: DataFrame, incoming: DataFrame, team_dim: DataFrame) -> DataFrame:
    """Old and new rows in one table; names and margins missing on old rows are filled in."""
    home = team_dim.select(F.col("abbr").alias("team"), F.col("name").alias("__home_name"))
    away = team_dim.select(F.col("abbr").alias("opponent"), F.col("name").alias("__away_name"))
    base = existing
    for name in ("team_name", "opponent_name"):
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast("string"))
    filled = (base.join(home, "team", "left").join(away, "opponent", "left")
              .withColumn("team_name", F.coalesce("team_name", "__home_name"))
              .withColumn("opponent_name", F.coalesce("opponent_name", "__away_name"))
              .withColumn("margin", (F.col("team_score") - F.col("opponent_score")).cast("double"))
              .drop("__home_name", "__away_name"))
    return filled.unionByName(incoming, allowMissingColumns=True)


def backfill_candidates(df: DataFrame, attribute: str) -> DataFrame:
    return df.filter(F.col("completed") & F.col(attribute).isNull())


def write_back(df: DataFrame, values: DataFrame, attributes: Sequence[str], key: str = "game_id") -> DataFrame:
    """Fill null attributes from ``values``; existing values win."""
    fresh = values.select(key, *[F.col(a).alias(f"__new_{a}") for a in attributes])
    merged = df.join(fresh, key, "left")
    return merged.withColumns({a: F.coalesce(F.col(a), F.col(f"__new_{a}")) for a in attributes}).select(*df.columns)


def append_games(df: DataFrame, generated: DataFrame) -> DataFrame:
    """Add generated rows; columns they lack are null, flags get their defaults."""
    defaults = generated.withColumns({
        "completed": F.lit(False) if "completed" not in generated.columns else F.col("completed"),
        "counts_toward_record": (F.lit(True) if "counts_toward_record" not in generated.columns
                                 else F.col("counts_toward_record")),
    })
    return df.unionByName(defaults, allowMissingColumns=True)


def quality_counters(df: DataFrame) -> DataFrame:
    filled = lambda c: F.count_if(F.col("completed") & F.col(c).isNotNull())
    aggs = [F.count_if("completed").alias("completed"),
            F.count_if(F.col("team").isNull() | F.col("opponent").isNull()).alias("missing_team")]
    if "pace" in df.columns:
        aggs.append(filled("pace").alias("with_pace"))
    if "garbage_time_detected" in df.columns:
        aggs.append(filled("garbage_time_detected").alias("with_safe_lead"))
    return df.agg(*aggs)
