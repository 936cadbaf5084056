"""Single-row rules on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from duelframe.functions import scalar as S
from duelframe.operators import clean, history
from duelframe.operators.perspective import flip_perspective, paired_columns


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, seconds", [("PT11M58.00S", 718.0), ("PT58.00S", 58.0), ("", 0.0), (None, 0.0), ("PT05M", 300.0), ("PT00M03.40S", 3.4)])
def test_clock(spark, text, seconds):
    assert _one(spark, S.clock_seconds(F.lit(text).cast("string"))) == seconds


@pytest.mark.parametrize("text, minutes", [("240:00", 240.0), ("265:30", 265.5), ("PT240M00.00S", 240.0), ("PTxM", 240.0), ("265", 265.0), (None, 240.0)])
def test_minutes(spark, text, minutes):
    assert _one(spark, S.team_minutes(F.lit(text).cast("string"))) == minutes


def test_possessions_without_rebounds(spark):
    zero = F.lit(0.0)
    assert _one(spark, S.possessions(F.lit(80.0), F.lit(40.0), F.lit(10.0), zero, zero, F.lit(12.0))) == 96.0


def test_remaining_and_elapsed(spark):
    assert _one(spark, S.seconds_remaining(F.lit(1), F.lit(720.0))) == 2880
    assert _one(spark, S.seconds_remaining(F.lit(5), F.lit(120.0))) == 120
    assert _one(spark, S.minutes_elapsed(F.lit(4), F.lit(0.0))) == 48
    assert _one(spark, S.minutes_elapsed(F.lit(6), F.lit(300.0))) == 53


def test_playoff_start(spark):
    assert _one(spark, S.playoff_start(F.lit(2023))) == dt.date(2023, 4, 10)
    assert _one(spark, S.playoff_start(F.lit(1990))) == dt.date(1990, 4, 14)


def test_labels(spark):
    assert _one(spark, S.series_round(F.lit("E_P_1"))) == "PLAY_IN"
    assert _one(spark, S.series_round(F.lit("W_2_3"))) == "CONF_SEMIS"
    assert _one(spark, S.series_conference(F.lit("Finals"))) == "Inter"
    with pytest.raises(Exception, match="unknown series label"):
        _one(spark, S.series_round(F.concat(F.lit("E_9_"), F.col("id").cast("string"))))


def test_cup_final(spark):
    assert _one(spark, S.is_cup_final(F.lit("0062300001")))
    assert _one(spark, S.is_cup_final(F.lit("0022300100"), F.lit("In-Season Cup"), F.lit("Championship")))
    assert not _one(spark, S.is_cup_final(F.lit("0022300001"), F.lit(None).cast("string"), F.lit(None).cast("string")))


def test_flip_margin_and_pairs(spark):
    df = spark.createDataFrame([("A", "B", 10.0, 5.0, -2.0, 3.0, 1.0, 1, 2.5, 0.1, 0.2)],
                               "team string, opponent string, margin double, team_rating double, opponent_rating double, "
                               "last_year_team_rating double, last_year_opp_rating double, team_win int, hca double, "
                               "team_bayesian_gs double, opp_bayesian_gs double")
    flipped = [r for r in flip_perspective(df).collect() if r.team == "B"][0]
    assert flipped.margin == -10 + 2 * 2.5 and flipped.team_win == 0
    assert (flipped.team_rating, flipped.last_year_team_rating, flipped.team_bayesian_gs) == (-2.0, 1.0, 0.2)
    kept = [r for r in flip_perspective(df, swap_bayesian=False).collect() if r.team == "B"][0]
    assert kept.team_bayesian_gs == 0.1
    assert "margin" not in paired_columns(df.columns)


def test_valid_teams_need_both_sides(spark):
    rows = [(2000, "AAA", "BBB")] * 10 + [(2000, "BBB", "AAA")] * 10 + [(2000, "CCC", "AAA")] * 30 + [(2000, "x7", "AAA")] * 30
    df = spark.createDataFrame(rows, "year int, team string, opponent string")
    assert sorted(r.team for r in clean.valid_teams(df).collect()) == ["AAA", "BBB"]


def test_margin_only_when_wholly_absent(spark):
    df = spark.createDataFrame([(1, 90, 80, None), (1, 70, 75, None), (2, 90, 80, 3.0), (2, 90, 80, None)],
                               "year int, team_score int, opponent_score int, margin double")
    got = sorted((r.year, r.margin is None, r.margin or 0) for r in clean.margin_if_absent(df).collect())
    assert got == [(1, False, -5.0), (1, False, 10.0), (2, False, 3.0), (2, True, 0)]


def test_home_edge(spark):
    df = spark.createDataFrame([(2.0, 0.0, 0.0), (3.0, 0.0, 0.0), (3.0, 0.0, 0.0)], "margin double, team_rating double, opponent_rating double")
    assert abs(history.home_edge(df).first()["hca"] - 58 / 23) < 1e-12
    assert history.home_edge(df.limit(0)).first()["hca"] == 2.5


def test_rest_days(spark):
    d = dt.date
    df = spark.createDataFrame(
        [("1", d(2024, 1, 1), 2024, "A", "B"), ("2", d(2024, 1, 4), 2024, "A", "C"), ("3", d(2024, 2, 4), 2024, "C", "A")],
        "game_id string, date date, year int, team string, opponent string").withColumns(
        {c: F.lit(0.0) for c in ("margin", "team_rating", "opponent_rating", "last_year_team_rating", "last_year_opp_rating")})
    out = {r.game_id: r for r in history.attach_history(df, history.side_history(df)).collect()}
    rest = lambda g: (out[g].team_days_since_most_recent_game, out[g].opponent_days_since_most_recent_game)
    assert rest("1") == (10, 10) and rest("2") == (3, 10) and rest("3") == (10, 10)


def test_prior_falls_back_to_predecessor_then_mean(spark):
    games = spark.createDataFrame([(2001, "NEW", "ODD")], "year int, team string, opponent string")
    end = spark.createDataFrame([(2000, "OLD", 4.0), (2000, "ZZZ", 0.0)], "year int, team string, rating double")
    pre = spark.createDataFrame([("NEW", "OLD")], "team string, predecessor string")
    row = history.with_prior_ratings(games, end, pre).first()
    assert (row.last_year_team_rating, row.last_year_opp_rating) == (4.0, 2.0)


def test_features_are_idempotent(spark):
    cols = {f"{s}_last_{n}_rating": 1.0 for s in ("team", "opponent") for n in (10, 5, 3, 1)}
    base = {"team_rating": 5.0, "opponent_rating": -2.0, "last_year_team_rating": 1.0, "last_year_opp_rating": 0.5, "team_bayesian_gs": 2.0,
            "opp_bayesian_gs": 1.0, "num_games_into_season": 41.0, "team_win_total_future": 50.0, "opponent_win_total_future": 40.0, **cols}
    df = spark.range(1).withColumns({k: F.lit(v) for k, v in base.items()})
    once = history.build_model_features(df)
    twice = history.build_model_features(once)
    row, again = once.first(), twice.first()
    assert row.rating_diff == 7.0 and row.rating_x_season == 3.5 and row.rating_product == -10.0 and row.win_total_change_diff == 0.0
    assert row.asDict() == again.asDict()
