"""Solvers against per-game loops, and the joined route against the grouped one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duelframe.operators import ratings, records


def _games(seed=3, n=220, teams=8, seasons=(2000, 2001)):
    rng = np.random.default_rng(seed)
    rows = []
    for year in seasons:
        for i in range(n):
            # one side is in a third of all games
            home = 0 if rng.random() < 0.33 else int(rng.integers(0, teams))
            away = int((home + rng.integers(1, teams)) % teams)
            day = int(rng.integers(0, 280))
            rows.append((year * 10000 + i, pd.Timestamp(f"{year}-01-01") + pd.Timedelta(days=day), year, home, away,
                         float(rng.integers(-25, 26)), int(rng.integers(80, 130)), int(rng.integers(80, 130)),
                         None if rng.random() < 0.1 else float(rng.integers(90, 110))))
    pdf = pd.DataFrame(rows, columns=["game_id", "date", "year", "team", "opponent", "margin", "team_score", "opponent_score", "pace"])
    return pdf.sort_values(["date", "game_id"]).reset_index(drop=True)


def _frame(spark, pdf):
    return (spark.createDataFrame(pdf).withColumn("date", F.to_date("date")).withColumn("year", F.col("year").cast("int"))
            .withColumn("completed", F.lit(True)).withColumn("pace", F.nanvl("pace", F.lit(None).cast("double"))))


def _loop(games, index, hca=2.5, cap=None, day_cap=200):
    games = games[games.date > games.date.max() - pd.Timedelta(days=day_cap)]
    games = games[games.team.isin(index) & games.opponent.isin(index)]
    clip = (lambda x: x) if cap is None else (lambda x: float(np.clip(x, -cap, cap)))
    r = {t: 0.0 for t in index}
    for epoch in range(1000):
        total, count = dict.fromkeys(index, 0.0), dict.fromkeys(index, 0)
        for h, a, m in zip(games.team, games.opponent, games.margin):
            e = clip(m) - clip(r[h] - r[a] + hca)
            total[h] += e
            total[a] -= e
            count[h] += 1
            count[a] += 1
        step = {t: 0.1 * total[t] / count[t] if count[t] else 0.0 for t in index}
        for t in index:
            r[t] += step[t]
        if epoch and max(abs(v) for v in step.values()) < 1e-7:
            break
    return r


@pytest.mark.parametrize("cap", [None, 12.0])
def test_season_ratings(spark, cap):
    pdf = _games()
    got = {(r.year, r.team): r.rating for r in ratings.em_ratings(_frame(spark, pdf), cap=cap).collect()}
    for year, g in pdf.groupby("year"):
        want = _loop(g, list(g.team.unique()), cap=cap)
        assert all(abs(got[year, t] - v) < 1e-9 for t, v in want.items())


def test_single_game_and_named_sides(spark):
    df = spark.createDataFrame([(2000, "2000-01-01", "A", "B", 10.0)], "year int, date string, team string, opponent string, margin double")
    df = df.withColumn("date", F.to_date("date"))
    names = spark.createDataFrame([(2000, t) for t in "ABC"], "year int, team string")
    got = {r.team: r.rating for r in ratings.em_ratings(df, teams=names).collect()}
    assert abs(got["A"] - got["B"] - 7.5) < 1e-4 and got["C"] == 0.0
    assert {r.team: r.rating for r in ratings.em_ratings(df).collect()} == {"A": 0.0}


def test_point_in_time(spark):
    pdf = _games(n=150, teams=6, seasons=(2000,))
    got = {(r.as_of, r.team): r.rating for r in ratings.point_in_time_ratings(_frame(spark, pdf), least_games=40).collect()}
    for day in sorted(pdf.date.unique())[::9]:
        past = pdf[pdf.date < day]
        key = pd.Timestamp(day).date()
        if len(past) <= 40:
            assert all(got[key, t] == 0.0 for t in range(6))
            continue
        want = _loop(past, list(past.team.unique()))
        for t in range(6):
            assert (got[key, t] is None) if t not in want else abs(got[key, t] - want[t]) < 1e-9


def test_point_in_time_with_a_time_of_day(spark):
    df = _frame(spark, _games(n=150, teams=6, seasons=(2000,)))
    late = df.withColumn("date", F.col("date").cast("timestamp") + F.expr("INTERVAL 30 MINUTES"))
    a, b = ({(r.as_of, r.team): r.rating for r in ratings.point_in_time_ratings(x, least_games=40).collect()} for x in (df, late))
    assert a == b and any(a.values())
    joined = ratings.attach_ratings(late, ratings.point_in_time_ratings(late, least_games=40))
    assert joined.count() == late.count() and joined.where("team_rating <> 0").count() > 0
    assert joined.schema["date"].dataType.typeName() == "timestamp"


def test_only_wanted_days_are_rated(spark):
    df = _frame(spark, _games(n=150, teams=6, seasons=(2000,)))
    every = {(r.as_of, r.team): r.rating for r in ratings.point_in_time_ratings(df, least_games=40).collect()}
    days = sorted({k[0] for k in every})[::20]
    wanted = spark.createDataFrame([(2000, d) for d in days], "year int, as_of date")
    got = {(r.as_of, r.team): r.rating for r in ratings.point_in_time_ratings(df, least_games=40, wanted=wanted).collect()}
    assert got == {k: v for k, v in every.items() if k[0] in days}


def _efficiency_loop(g, hca=2.5):
    g = g.assign(p=g.pace.fillna(100.0))
    teams = sorted(set(g.team) | set(g.opponent))
    off = {t: np.concatenate([(g.team_score / g.p)[g.team == t], (g.opponent_score / g.p)[g.opponent == t]]).mean() for t in teams}
    dfn = {t: np.concatenate([(g.opponent_score / g.p)[g.team == t], (g.team_score / g.p)[g.opponent == t]]).mean() for t in teams}
    avg = (g.team_score / g.p).mean()
    for _ in range(100):
        o, d = {t: [] for t in teams}, {t: [] for t in teams}
        for h, a, sh, sa, p in zip(g.team, g.opponent, g.team_score, g.opponent_score, g.p):
            x, y = (sh + hca / 2) / p, (sa - hca / 2) / p
            o[h].append(x - avg + dfn[a])
            d[h].append(avg - y + off[a])
            o[a].append(y - avg + dfn[h])
            d[a].append(avg - x + off[h])
        off, dfn = {t: np.mean(v) for t, v in o.items()}, {t: np.mean(v) for t, v in d.items()}
    mo, md = np.mean(list(off.values())), np.mean(list(dfn.values()))
    return {t: (100 * (off[t] - mo), 100 * (dfn[t] - md)) for t in teams}


def test_adjusted_efficiencies(spark):
    pdf = _games(n=120)
    got = {(r.year, r.team): (r.adj_off, r.adj_def) for r in ratings.adjusted_efficiencies(_frame(spark, pdf)).collect()}
    for year, g in pdf.groupby("year"):
        for t, want in _efficiency_loop(g).items():
            assert np.allclose(got[year, t], want, atol=1e-8)


def test_capped_records_count_ties_as_losses(spark):
    rows = [(i, "2000-01-%02d" % (i + 1), "A", "B", float(m)) for i, m in enumerate([5, 0, -3, 4])]
    df = spark.createDataFrame(rows, "game_id int, date string, team string, opponent string, margin double")
    got = {r.team: (r.wins, r.losses) for r in records.capped_records(df, limit=3).collect()}
    assert got == {"A": (1, 2), "B": (1, 2)}
    assert {r.team: (r.wins, r.losses) for r in records.team_records(df).collect()} == {"A": (2, 2), "B": (2, 2)}
