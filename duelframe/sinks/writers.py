"""Writers.  Tables are Parquet partitioned by the column reports are read by; dates are arguments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import BOX_COLUMNS, GAME_COLUMNS, PLAYOFF_GAME_COLUMNS, SAFE_LEAD_COLUMNS

ROWS_PER_FILE = 5_000_000


def _table(df: DataFrame, path: str, partitions: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Only the partitions present in ``df`` are replaced."""
    writer = (df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
              .option("partitionOverwriteMode", "dynamic" if partitions else "static"))
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def _report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def ordered_game_columns(df: DataFrame) -> DataFrame:
    """Base columns, then whichever optional ones exist, in a fixed order."""
    order = [*GAME_COLUMNS, *SAFE_LEAD_COLUMNS, "counts_toward_record", *BOX_COLUMNS]
    return df.select([c for c in order if c in df.columns])


def write_games(df: DataFrame, path: str) -> None:
    _table(ordered_game_columns(df), path, ["year"])


def write_features(df: DataFrame, path: str) -> None:
    _table(df, path, ["year"])


def write_season_ratings(df: DataFrame, path: str) -> None:
    _table(df.select("team", "rating", "year"), path, ["year"])


def write_latest_and_archive(df: DataFrame, path: str, run_date: str, by_year: bool = False) -> None:
    """The current report, and a copy under its date (and year, when asked)."""
    _report(df, f"{path}/latest")
    folder = f"run_year={run_date[:4]}/run_date={run_date}" if by_year else f"run_date={run_date}"
    _report(df, f"{path}/archive/{folder}")


def write_predictions(df: DataFrame, path: str, run_date: str) -> None:
    write_latest_and_archive(df, path, run_date)


def write_retrospective(df: DataFrame, path: str, run_date: str) -> None:
    write_latest_and_archive(df, path, run_date, by_year=True)


def write_ratings_table(ranked: DataFrame, path: str) -> None:
    """rank, team, rating rounded to two digits."""
    keys = [c for c in ("year",) if c in ranked.columns]
    _table(ranked.select(*keys, "rank", "team", F.round("rating", 2).alias("rating")), path, keys)


def write_predictive_ratings(df: DataFrame, path: str) -> None:
    _table(df.withColumn("mode", F.when(F.col("playoff") == 1, "playoff").otherwise("regular")).drop("playoff"), path, ["mode"])


def write_seed_report(report: DataFrame, conferences: DataFrame, path: str, run_date: str) -> None:
    """All sides, and the same split by conference; each as latest and archive."""
    write_latest_and_archive(report, f"{path}/all", run_date)
    split = report.join(conferences.select("team", "conference"), "team")
    for folder in ("latest", f"archive/run_date={run_date}"):
        split.write.mode("overwrite").partitionBy("conference").option("header", True).csv(f"{path}/by_conference/{folder}")


def write_wins_matrix(matrix: DataFrame, path: str) -> None:
    _report(matrix, path)


def write_sim_games(log: DataFrame, path: str, run_date: str) -> None:
    write_latest_and_archive(log, path, run_date)


def write_playoff_games(flat: DataFrame, path: str) -> None:
    _table(flat.select(*PLAYOFF_GAME_COLUMNS), path)


def write_slot_document(document: DataFrame, path: str) -> None:
    """One folder per season, each with that season's document as its only file."""
    document.repartition("year").write.mode("overwrite").partitionBy("year").text(path)


def year_map_document(edges: DataFrame) -> DataFrame:
    """One JSON object of year to value; as many entries as there are seasons."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("year").cast("string"), "hca")))
    return edges.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_year_map(edges: DataFrame, path: str) -> None:
    year_map_document(edges).coalesce(1).write.mode("overwrite").text(path)  # one row


def write_standings(final: DataFrame, path: str) -> None:
    _report(final, path)


def write_grid(table: DataFrame, path: str) -> None:
    _report(table, path)
