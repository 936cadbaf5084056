"""Every writer, from a checked query through files in the shared folder and back.

The SQL is that of the query whose rows are written: what is read back must still be those rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history
from ..session import output_folder
from ..sinks import writers
from ..sources import readers
from .contest import RATED_SQL, r6, rated
from .registry import CHECKS, QUERIES, query

RUN_DATE = "2001-04-02"


def _back(df, path: str, form: str = "parquet"):
    """The written rows, with the types they had."""
    reader = df.sparkSession.read
    if form == "csv":
        return reader.schema(df.schema).option("header", True).csv(path)
    return reader.parquet(path).select(*df.columns)


def _through(source: str, covers: str, name: str, write, where: str = "", form: str = "parquet") -> None:
    @query(name, covers, CHECKS[source])
    def run(spark, sf_dir):
        df = QUERIES[source](spark, sf_dir)
        path = output_folder(spark, name)
        write(df, path)
        return _back(df, path + where, form)


_ARCHIVE = f"/archive/run_date={RUN_DATE}"
_through("ordered_game_table", "K1", "games_written", writers.write_games)
_through("season_rating_ranking", "K2", "features_written", writers.write_features)
_through("predictions_next_week", "K3", "predictions_written_latest", lambda df, p: writers.write_predictions(df, p, RUN_DATE), "/latest", "csv")
_through("predictions_all_future", "K3", "predictions_written_archive", lambda df, p: writers.write_predictions(df, p, RUN_DATE), _ARCHIVE, "csv")
_through("season_em_ratings", "K4", "season_ratings_written", writers.write_season_ratings)
_through("season_rating_ranking", "K5", "ratings_table_written", writers.write_ratings_table)
_through("wins_matrix", "K7", "wins_matrix_written", writers.write_wins_matrix, "", "csv")
_through("saved_scenario_games", "K8", "scenario_games_written", lambda df, p: writers.write_sim_games(df, p, RUN_DATE), "/latest", "csv")
_through("flat_series_games", "K9", "playoff_games_written", writers.write_playoff_games)
_through("retrospective_predictions", "K12", "retrospective_written", lambda df, p: writers.write_retrospective(df, p, RUN_DATE),
         f"/archive/run_year={RUN_DATE[:4]}/run_date={RUN_DATE}", "csv")
_through("standings_by_wins", "K14", "standings_written", writers.write_standings, "", "csv")
_through("binned_errors", "K15", "grid_written", writers.write_grid, "", "csv")


@query("seed_report_written", "K6", CHECKS["seed_report"])
def seed_report_written(spark, sf_dir):
    """Read back from the split by conference, which holds every side once."""
    df = QUERIES["seed_report"](spark, sf_dir)
    halves = df.select("team", F.when(F.col("team") % 2 == 0, "East").otherwise("West").alias("conference"))
    path = output_folder(spark, "seed_report_written")
    writers.write_seed_report(df, halves, path, RUN_DATE)
    return _back(df, f"{path}/by_conference/archive/run_date={RUN_DATE}/conference=*", "csv")


@query("predictive_ratings_written", "K13", CHECKS["predictive_ratings"])
def predictive_ratings_written(spark, sf_dir):
    df = QUERIES["predictive_ratings"](spark, sf_dir)
    path = output_folder(spark, "predictive_ratings_written")
    writers.write_predictive_ratings(df, path)
    stored = spark.read.parquet(path).withColumn("playoff", (F.col("mode") == "playoff").cast("int"))
    return stored.select(*df.columns)


@query("year_map_written", "K11 S5", CHECKS["year_map_round_trip"])
def year_map_written(spark, sf_dir):
    completed = rated(spark, sf_dir).filter("completed")
    path = output_folder(spark, "year_map_written")
    writers.write_year_map(history.home_edge(completed, ["year"]), path)
    return readers.read_year_map(spark, path).select("year", r6(F.col("hca")).alias("hca"))


@query("slot_document_written", "K10", f"SELECT y.year, c.* FROM ({CHECKS['slot_candidates']}) c CROSS JOIN (WITH {RATED_SQL} SELECT DISTINCT year FROM rated) y")
def slot_document_written(spark, sf_dir):
    """Each season's slot document, written, read and taken apart again into its candidates."""
    return readers.parse_slot_document(_document(spark, sf_dir))


def _document(spark, sf_dir):
    path = output_folder(spark, "slot_document_written")
    writers.write_slot_document(QUERIES["slot_document"](spark, sf_dir), path)
    return spark.read.text(path, wholetext=True)
