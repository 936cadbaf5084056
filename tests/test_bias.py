"""Kalman filter against a dense textbook loop, for any block size; draws and grid."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from duelframe.operators import bias


def _games(n=90, teams=5, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for year in (2000, 2001):
        for i in range(n):
            h = 0 if rng.random() < 0.35 else int(rng.integers(0, teams))
            a = int((h + rng.integers(1, teams)) % teams)
            m = None if rng.random() < 0.1 else float(rng.normal(2, 12))
            rows.append((year * 1000 + i, pd.Timestamp(f"{year}-02-01") + pd.Timedelta(days=i // 4), year, h, a, m, float(rng.normal(2, 5))))
    return pd.DataFrame(rows, columns=["game_id", "date", "year", "team", "opponent", "margin", "pred"])


def _frame(spark, pdf):
    return (spark.createDataFrame(pdf).withColumn("date", F.to_date("date")).withColumn("year", F.col("year").cast("int"))
            .withColumn("margin", F.nanvl("margin", F.lit(None).cast("double"))))


def _loop(pdf, rho=0.999, q=0.005, r=190.0, init_var=3.0, teams=5):
    out, mean, cov, prev = {}, None, None, None
    for g in pdf.sort_values(["year", "date", "game_id"]).itertuples():
        if g.year != prev:
            mean, cov, prev = np.zeros(teams), np.eye(teams) * init_var, g.year
        mean, cov = rho * mean, rho ** 2 * cov + q * np.eye(teams)
        H = np.zeros(teams)
        H[g.team], H[g.opponent] = 1, -1
        row = [mean[g.team], mean[g.opponent], H @ cov @ H, 0.0, 0.0]
        if not np.isnan(g.margin):
            nu, S = g.margin - g.pred - H @ mean, H @ cov @ H + r
            K = cov @ H / S
            mean, cov = mean + K * nu, (np.eye(teams) - np.outer(K, H)) @ cov
            row[3:] = [nu, S]
        out[g.game_id] = row
        state = (g.year, mean, cov)
        out[("state", g.year)] = state
    return out


def test_filter_for_any_block_size(spark):
    pdf = _games()
    want = _loop(pdf)
    for block in (1000, 17):
        for r in bias.kalman_pass(_frame(spark, pdf), block_games=block).collect():
            got = [r.home_bias, r.away_bias, r.bias_diff_var, r.innovation, r.innovation_var]
            assert np.allclose(got, want[r.game_id], atol=1e-8), (block, r)


def test_final_state_and_draws(spark):
    pdf = _games()
    done = pdf[pdf.margin.notna()]
    want = _loop(done)
    for block in (1000, 11):
        state, numbers = bias.kalman_state(_frame(spark, pdf), block_games=block)
        for r in bias.kalman_posteriors(state, numbers).collect():
            _, mean, cov = want["state", r.year]
            assert np.isclose(r["mean"], -mean[r.team]) and np.isclose(r["var"], cov[r.team, r.team])
            assert np.isclose(r.tau, np.sqrt(np.mean(np.diag(cov))))
    draws = bias.draw_biases(state, numbers, n_sims=3000, seed=4, chunk=700).toPandas()
    assert draws.groupby("year").sim_id.nunique().eq(3000).all()
    for (year, team), x in draws.groupby(["year", "team"]).bias:
        _, mean, cov = want["state", year]
        assert abs(x.mean() + mean[team]) < 0.12 and abs(x.var() / cov[team, team] - 1) < 0.15


def test_grid_ranks_by_error(spark):
    pdf = _games(n=40)
    grid = {"rho": (1.0, 0.99), "q": (0.01, 0.3), "r": (60.0,), "init_var": (5.0, 20.0)}
    rows = bias.grid_search(_frame(spark, pdf), grid=grid).orderBy("rank").collect()
    assert len(rows) == 8 and [r.rmse_kalman for r in rows] == sorted(r.rmse_kalman for r in rows)
    for r in rows[:3]:
        want = _loop(pdf, r.rho, r.q, r.r, r.init_var)
        done = pdf[pdf.margin.notna()]
        err = [g.pred + want[g.game_id][0] - want[g.game_id][1] - g.margin for g in done.itertuples()]
        assert np.isclose(r.rmse_kalman, np.sqrt(np.mean(np.square(err))))


def test_blocks_of_unequal_length_go_together(spark, monkeypatch):
    """Lanes of one task: blocks and parameter sets, decay written out rarely, none or strong decay."""
    pdf = _games()
    for lanes, settle in ((1, 1), (8, 3), (64, 32)):
        monkeypatch.setattr(bias, "LANES", lanes)
        monkeypatch.setattr(bias, "SETTLE", settle)
        sets = [bias.FILTER_DEFAULTS, {"rho": 0.3, "q": 0.2, "r": 50.0, "init_var": 1.0}]
        got = bias.kalman_pass(_frame(spark, pdf), params=sets, block_games=7).collect()
        assert len(got) == 2 * len(pdf)
        for k, p in enumerate(sets):
            want = _loop(pdf, p["rho"], p["q"], p["r"], p["init_var"])
            for r in got:
                if r.param_id == k:
                    assert np.allclose([r.home_bias, r.away_bias, r.bias_diff_var, r.innovation, r.innovation_var], want[r.game_id], atol=1e-8)


def test_a_step_serves_all_lanes():
    """A block of a season is stepped with its neighbours: as many steps as the longest has games."""
    rng = np.random.default_rng(5)
    n = 50
    pdf = pd.DataFrame({"seq": np.arange(n), "block": np.arange(n) // 20, "sides": 4, "h": rng.integers(0, 2, n), "a": rng.integers(2, 4, n),
                        "pred": 0.0, "margin": rng.normal(size=n)})
    seen = []
    bias._walk(pdf, [bias.FILTER_DEFAULTS], look=lambda rows, found, nu: seen.append(len(rows)))
    assert seen == [3] * 10 + [2] * 10
