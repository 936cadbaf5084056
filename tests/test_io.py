"""Readers and writers through files."""

import json

from pyspark.sql import functions as F

from duelframe.catalog.playoff_queries import results
from duelframe.operators import nested
from duelframe.schema import PLAYOFF_GAME_COLUMNS
from duelframe.sinks import writers
from duelframe.sources import readers


def test_season_csv(spark, tmp_path):
    (tmp_path / "year_data_2024.csv").write_text(
        "game_id,date,team_abbr,opponent_abbr,team_score,opponent_score,pace,completed,year\n"
        "0022300001,2023-10-24,BKN,CHA,110,100,99.5,True,2024\n0062300001,12/09/2023,LAL,IND,123,109,,True,2024\n"
        "0022300002,2023-10-25 00:00:00,PHO,BOS,,,,False,2024\n")
    rows = {r.game_id: r for r in readers.read_games(spark, str(tmp_path / "*.csv")).collect()}
    assert rows["0022300001"].team == "BKN" and rows["0022300001"].team_score == 110.0
    assert str(rows["0062300001"].date)[:10] == "2023-12-09" and rows["0062300001"].pace is None
    assert rows["0022300001"].counts_toward_record and not rows["0062300001"].counts_toward_record
    assert readers.read_completed_games(spark, str(tmp_path / "*.csv")).count() == 2


def test_season_files_with_different_headers(spark, tmp_path):
    (tmp_path / "year_data_2003.csv").write_text("game_id,date,team_abbr,opponent_abbr,completed,year\n0020200001,2002-10-24T19:30:00.000Z,BKN,CHA,True,2003\n")
    (tmp_path / "year_data_2024.csv").write_text("game_id,date,team,opponent,pace,completed,year\n0022300001,2023-10-24T19:30:00+00:00,LAL,IND,99.5,True,2024\n"
                                                 "0022300002,24th of October,LAL,BOS,,False,2024\n")
    rows = {r.game_id: r for r in readers.read_games(spark, str(tmp_path / "*.csv")).collect()}
    assert rows["0020200001"].team == "BKN" and rows["0020200001"].pace is None and rows["0022300001"].pace == 99.5
    assert all(rows[k].date.hour == 19 for k in ("0020200001", "0022300001")) and rows["0022300002"].date is None
    raw = spark.read.option("header", True).csv(str(tmp_path / "year_data_2024.csv"))
    assert readers.unreadable_dates(raw).first().asDict() == {"dates": 2, "unreadable": 1}


def test_every_known_date_form_is_read(spark):
    forms = ["2024-10-22", "10/22/2024", "2024-10-22 19:30:00", "2024-10-22T19:30:00", "2024-10-22T19:30:00Z", "2024-10-22T19:30:00+00:00",
             "2024-10-22 19:30:00+00:00", "2024-10-22T19:30:00.000Z", "2024-10-22 19:30:00.000", "2024-10-22T19:30:00.123456", None, "", "soon"]
    from duelframe.functions import scalar

    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "i int, t string")
    got = {r.i: r for r in df.select("i", scalar.parse_mixed_timestamp(F.col("t")).alias("d"), scalar.unreadable_date(F.col("t")).alias("u")).collect()}
    assert all(str(got[i].d)[:10] == "2024-10-22" for i in range(10)) and all(got[i].d is None for i in (10, 11, 12))
    assert [bool(got[i].u) for i in (9, 10, 11, 12)] == [False, False, False, True]


def test_totals_and_year_map(spark, tmp_path):
    (tmp_path / "t.csv").write_text("year,ATL,BRK\n2023,45.5,\n2024,40,30.5\n")
    got = {(r.year, r.team): r.total for r in readers.read_totals(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {(2023, "ATL"): 45.5, (2023, "BRK"): None, (2024, "ATL"): 40.0, (2024, "BRK"): 30.5}
    edges = spark.createDataFrame([(2023, 2.25), (2024, 3.0)], "year int, hca double")
    writers.write_year_map(edges, str(tmp_path / "m"))
    assert sorted(map(tuple, readers.read_year_map(spark, str(tmp_path / "m")).collect())) == [(2023, 2.25), (2024, 3.0)]
    assert readers.read_year_map(spark, str(tmp_path / "none.json")).count() == 0


def test_partition_overwrite_keeps_other_seasons(spark, tmp_path):
    path = str(tmp_path / "g")
    base = spark.createDataFrame([("1", 2023, 5.0), ("2", 2024, 6.0)], "game_id string, year int, margin double")
    writers.write_games(base, path)
    writers.write_games(base.filter("year = 2024").withColumn("margin", F.lit(9.0)), path)
    assert sorted((r.year, r.margin) for r in spark.read.parquet(path).collect()) == [(2023, 5.0), (2024, 9.0)]


def test_latest_archive_and_dated_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("A", 1.0)], "team string, v double")
    writers.write_predictions(df, path, "2024-01-02")
    writers.write_predictions(df.withColumn("v", F.lit(2.0)), path, "2024-01-03")
    archive = readers.read_dated_archive(spark, f"{path}/archive/*")
    assert archive.count() == 2
    assert readers.latest_snapshot(archive, ["team"]).first()["v"] == "2.0"
    assert spark.read.option("header", True).csv(f"{path}/latest").first()["v"] == "2.0"
    writers.write_retrospective(df, str(tmp_path / "r"), "2024-01-03")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r/archive/run_year=2024/run_date=2024-01-03").count() == 1


def test_seed_report_split(spark, tmp_path):
    report = spark.createDataFrame([("A", 1.0), ("B", 0.5)], "team string, seed_1 double")
    conf = spark.createDataFrame([("A", "East"), ("B", "West")], "team string, conference string")
    writers.write_seed_report(report, conf, str(tmp_path / "s"), "2024-02-01")
    east = spark.read.option("header", True).csv(f"{tmp_path}/s/by_conference/latest/conference=East")
    assert [r.team for r in east.collect()] == ["A"]


def test_playoff_games_round_trip(spark, sf_dir, tmp_path):
    flat = nested.flatten_games(results(spark, sf_dir), 2001)
    text = flat.select(*[F.col(c).cast("string").alias(c) if c in ("high_seed", "low_seed", "series_winner", "series_loser", "home", "away", "winner")
                         else F.col(c).cast("int").alias(c) if c == "sim_id" else F.col(c) for c in PLAYOFF_GAME_COLUMNS])
    writers.write_playoff_games(text, str(tmp_path / "pg"))
    back = readers.read_playoff_games(spark, str(tmp_path / "pg"))
    assert back.columns == PLAYOFF_GAME_COLUMNS and back.count() == flat.count()
    rebuilt = nested.rebuild_results(back)
    series = rebuilt.select(F.explode("series").alias("s")).select("s.*")
    assert series.count() == results(spark, sf_dir).count()


def test_slot_document_is_json(spark, sf_dir, tmp_path):
    from duelframe.catalog.contest import rated
    from duelframe.catalog.playoff_queries import slot_document

    doc = slot_document(spark, sf_dir)
    writers.write_slot_document(doc, str(tmp_path / "d"))
    read = {r.year: json.loads(r.value) for r in spark.read.text(str(tmp_path / "d"), wholetext=True).collect()}
    seasons = {r.year for r in rated(spark, sf_dir).select("year").distinct().collect()}
    assert set(read) == seasons and all(body["year"] == y and len(body["slots"]) == 15 for y, body in read.items())
    played = {y for y, body in read.items() if any(s["series"]["status"] != "not_started" for s in body["slots"])}
    assert len(played) > 1
    body = read[2001]
    wins = [sum(c["wins"]) for c in body["slots"][0]["candidates"]]
    assert wins == sorted(wins, reverse=True)
    assert {"status", "games_won"} >= set(body["slots"][0]["series"]) - {"games_won"}
