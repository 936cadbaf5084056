"""Bias, prediction quality and residual spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as st
from ..operators import bias, history, metrics
from .contest import RATED_SQL, SIDES_SQL, noise, noise_sql, r6, rated, rnd
from .registry import query

TAU, SIGMA = 1.5, 13.0


def _r6(df, *names, keep=()):
    return df.select(*keep, *[r6(F.col(n)).alias(n) for n in names])


@query("bias_prior", "A15", SIDES_SQL + f""", sg AS (SELECT stddev_pop(pred - margin) AS sigma FROM rated WHERE margin IS NOT NULL),
 t AS (SELECT year, club, avg(pred - m) AS mean, count(*) AS n FROM sides WHERE m IS NOT NULL GROUP BY ALL)
 SELECT {rnd('sqrt(greatest(var_pop(mean) - avg(sigma * sigma / n), 0.25))')} AS tau, {rnd('max(sigma)')} AS sigma, count(*) AS team_seasons FROM t, sg""")
def bias_prior(spark, sf_dir):
    return _r6(bias.bias_prior(rated(spark, sf_dir)), "tau", "sigma", keep=["team_seasons"])


@query("bias_posterior", "A16 W8", SIDES_SQL + f""", o AS (SELECT year, club, pred - m AS resid,
  power(0.97, row_number() OVER (PARTITION BY year, club ORDER BY date DESC, game_id DESC, is_home DESC) - 1) AS w FROM sides WHERE m IS NOT NULL),
 s AS (SELECT year, club AS team, count(*) AS n_games, sum(w) AS w, sum(w * w) AS w2, sum(w * resid) AS wr FROM o GROUP BY ALL),
 v AS (SELECT *, w * w / w2 AS ne, 1.0 / ((w * w / w2) / {SIGMA ** 2} + 1.0 / {TAU ** 2}) AS var FROM s)
 SELECT year, team, n_games, {rnd(f'var * ne * (wr / w) / {SIGMA ** 2}')} AS mean, {rnd('var')} AS var FROM v""")
def bias_posterior(spark, sf_dir):
    return _r6(bias.bias_posterior(rated(spark, sf_dir), TAU, SIGMA), "mean", "var", keep=["year", "team", "n_games"])


@query("largest_biases", "W17 A16", SIDES_SQL + f""", t AS (SELECT year, club AS team, avg(pred - m) AS b FROM sides WHERE m IS NOT NULL GROUP BY ALL)
 SELECT year, team, {rnd('b')} AS mean_bias FROM t ORDER BY abs(b) DESC, year, team LIMIT 5""")
def largest_biases(spark, sf_dir):
    means = bias.residual_sides(rated(spark, sf_dir)).groupBy("year", "team").agg(F.avg("resid").alias("mean_bias"))
    return _r6(means.orderBy(F.abs("mean_bias").desc(), "year", "team").limit(5), "mean_bias", keep=["year", "team"])


@query("bias_corrected_predictions", "P29", RATED_SQL + f""", b AS (SELECT DISTINCT t AS team, CAST((t % 5) - 2 AS DOUBLE) / 4 AS mean
  FROM (SELECT team AS t FROM games UNION ALL SELECT opponent FROM games) WHERE t % 8 <> 0)
 SELECT game_id, {rnd('pred - coalesce(h.mean, 0) + coalesce(a.mean, 0)')} AS pred FROM rated r
 LEFT JOIN b h ON h.team = r.team LEFT JOIN b a ON a.team = r.opponent""")
def bias_corrected_predictions(spark, sf_dir):
    g = rated(spark, sf_dir)
    known = (bias.all_teams(g).filter(F.col("team") % 8 != 0)
             .withColumn("mean", ((F.col("team") % 5) - 2).cast("double") / 4))
    return _r6(bias.correct_prediction(g, known), "pred", keep=["game_id"])


_ERR = "pred - margin"
METRICS_SQL = (f"{rnd(f'sqrt(avg(({_ERR}) * ({_ERR})))')} AS rmse, {rnd(f'avg(abs({_ERR}))')} AS mae, "
               f"{rnd(f'1 - sum(({_ERR}) * ({_ERR})) / (sum(margin * margin) - sum(margin) * sum(margin) / count(margin))')} AS r2, "
               f"{rnd(f'avg({_ERR})')} AS bias")


@query("prediction_errors", "A18 P28", RATED_SQL + f" SELECT year, {METRICS_SQL} FROM rated WHERE completed GROUP BY year")
def prediction_errors(spark, sf_dir):
    g = rated(spark, sf_dir).filter("completed")
    return _r6(g.groupBy("year").agg(*st.error_metrics(F.col("pred"), F.col("margin"))), "rmse", "mae", "r2", "bias", keep=["year"])


@query("residual_summary", "A17", RATED_SQL + f" SELECT {rnd(f'avg({_ERR})')} AS resid_mean, {rnd(f'stddev_pop({_ERR})')} AS resid_std FROM rated")
def residual_summary(spark, sf_dir):
    return _r6(rated(spark, sf_dir).agg(*st.residual_summary(F.col("pred"), F.col("margin"))), "resid_mean", "resid_std")


NUMBERED_SQL = RATED_SQL + """, num AS (SELECT *, CAST(rank() OVER (PARTITION BY year ORDER BY date) - 1 AS BIGINT) AS gn FROM rated)"""


def numbered(spark, sf_dir):
    return history.season_game_number(rated(spark, sf_dir))


@query("errors_by_season_part", "A19", NUMBERED_SQL + f""", c AS (SELECT quantile_cont(gn, 0.2) AS c0, quantile_cont(gn, 0.4) AS c1,
  quantile_cont(gn, 0.6) AS c2, quantile_cont(gn, 0.8) AS c3 FROM num WHERE completed)
 SELECT CAST((gn > c0)::INT + (gn > c1)::INT + (gn > c2)::INT + (gn > c3)::INT AS INT) AS segment, count(*) AS n, {METRICS_SQL}
 FROM num, c WHERE completed GROUP BY 1""")
def errors_by_season_part(spark, sf_dir):
    out = metrics.segment_metrics(numbered(spark, sf_dir).filter("completed"), "pred", "margin", "num_games_into_season")
    return _r6(out, "rmse", "mae", "r2", "bias", keep=["segment", "n"])


@query("binned_errors", "A20", NUMBERED_SQL + f""" SELECT CAST(gn // 5 * 5 AS DOUBLE) + 2.5 AS bin_center,
 {rnd(f'sqrt(avg(({_ERR}) * ({_ERR})))')} AS rmse, count(*) AS n FROM num WHERE margin IS NOT NULL GROUP BY 1""")
def binned_errors(spark, sf_dir):
    return _r6(metrics.binned_rmse(numbered(spark, sf_dir), "pred", "margin", "num_games_into_season"), "rmse",
               keep=["bin_center", "n"])


@query("smoothed_residual_spread", "A21", NUMBERED_SQL + f""", s AS (SELECT gn, count(*) AS n, sum(({_ERR}) * ({_ERR})) AS sq FROM num WHERE margin IS NOT NULL GROUP BY 1),
 g AS (SELECT unnest(range(0, (SELECT max(gn) FROM s) + 1)) AS game_number)
 SELECT game_number, {rnd('sqrt(sum(sq * exp(-0.5 * pow((gn - game_number) / 60.0, 2))) / sum(n * exp(-0.5 * pow((gn - game_number) / 60.0, 2))))')} AS std
 FROM g, s GROUP BY 1""")
def smoothed_residual_spread(spark, sf_dir):
    out = metrics.smoothed_std(numbered(spark, sf_dir), "num_games_into_season", F.col("pred") - F.col("margin"))
    return _r6(out, "std", keep=["game_number"])


@query("sample_weights", "P25", RATED_SQL + f""" SELECT game_id, {rnd('CASE WHEN year = 1999 THEN 0.5 ELSE 1.0 END * (0.2 + 0.8 * (year - 1995.0) / (2001.0 - 1995.0))')} AS weight
 FROM rated""".replace("1995.0", "min(year) OVER ()").replace("2001.0", "max(year) OVER ()"))
def sample_weights(spark, sf_dir):
    return _r6(metrics.sample_weight(rated(spark, sf_dir), halved_years=[1999]), "weight", keep=["game_id"])


@query("training_target_and_split", "P27 P28", RATED_SQL + """ SELECT game_id, coalesce(-(CASE WHEN game_id % 3 = 0 THEN -pred END), margin) AS target,
 year = 2000 AS is_test FROM rated WHERE completed AND year IN (1996, 1998, 1999, 2000)""")
def training_target_and_split(spark, sf_dir):
    g = rated(spark, sf_dir).withColumn("vegas_spread", F.when(F.col("game_id") % 3 == 0, -F.col("pred")))
    train, test = metrics.split_years(g, [1996, 1997, 1998, 1999], [2000], omit=[1997])
    both = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    return both.select("game_id", metrics.training_target(both).alias("target"), "is_test")


@query("noisy_features", "P26", RATED_SQL + f""" SELECT game_id, {rnd('last_year_team_rating + 0.5 * ' + noise_sql('game_id', '7'))} AS last_year_team_rating,
 {rnd('last_year_opp_rating + 0.5 * ' + noise_sql('game_id', '8'))} AS last_year_opp_rating FROM rated""")
def noisy_features(spark, sf_dir):
    """With the reproducible draw in place of the normal one."""
    names = ["last_year_team_rating", "last_year_opp_rating"]
    out = metrics.with_noise(rated(spark, sf_dir), names, 0.5, 7, lambda k: noise(F.col("game_id"), F.lit(k)))
    return _r6(out, *names, keep=["game_id"])


def _kalman_sql(rows: str, final: str) -> str:
    """The filter game by game: every season's state is a list of means and one of covariances, row after row."""
    f = bias.FILTER_DEFAULTS
    return RATED_SQL.replace("games AS (", "RECURSIVE games AS (", 1) + f""", sd AS (SELECT team FROM rated UNION SELECT opponent FROM rated),
 ix AS (SELECT team, row_number() OVER (ORDER BY team) AS i, count(*) OVER () AS t FROM sd),
 sq AS (SELECT r.*, row_number() OVER (PARTITION BY year ORDER BY date, game_id) AS seq, x.i AS h, y.i AS a, x.t AS t FROM rated r JOIN ix x ON x.team = r.team JOIN ix y ON y.team = r.opponent WHERE {rows}),
 pr AS (SELECT DISTINCT year, t FROM sq),
 it AS (SELECT CAST(0 AS BIGINT) AS step, year, list_transform(range(t), lambda x: CAST(0 AS DOUBLE)) AS m,
   list_transform(range(t * t), lambda x: CASE WHEN x // t = x % t THEN CAST({f['init_var']} AS DOUBLE) ELSE 0 END) AS c,
   CAST(0 AS DOUBLE) AS hb, CAST(0 AS DOUBLE) AS ab, CAST(0 AS DOUBLE) AS dv, CAST(0 AS DOUBLE) AS nu, CAST(0 AS DOUBLE) AS s FROM pr
  UNION ALL SELECT seq, year, CASE WHEN margin IS NULL THEN pm ELSE list_transform(pm, lambda x, i: x + row[i] * nu / s) END,
   CASE WHEN margin IS NULL THEN pc ELSE list_transform(pc, lambda x, i: x - row[(i - 1) // t + 1] * row[(i - 1) % t + 1] / s) END,
   pm[h], pm[a], row[h] - row[a], nu, s FROM (SELECT *, row[h] - row[a] + {f['r']} AS s, margin - pred - (pm[h] - pm[a]) AS nu FROM (
    SELECT *, list_transform(range(1, t + 1), lambda k: pc[(h - 1) * t + k] - pc[(a - 1) * t + k]) AS row FROM (
     SELECT g.*, list_transform(m, lambda x: x * {f['rho']}) AS pm,
      list_transform(c, lambda x, i: x * {f['rho']} * {f['rho']} + CASE WHEN (i - 1) // t = (i - 1) % t THEN {f['q']} ELSE 0 END) AS pc
     FROM it JOIN sq g ON g.year = it.year AND g.seq = it.step + 1))))
 """ + final


_PASS_COLUMNS = ("home_bias", "away_bias", "bias_diff", "bias_diff_var", "pred_final", "innovation", "innovation_var")


@query("kalman_bias_pass", "M6 M17", _kalman_sql("TRUE", f"""SELECT sq.year, game_id, seq, pred, margin, 0 AS param_id, {rnd('hb', 4)} AS home_bias, {rnd('ab', 4)} AS away_bias, {rnd('hb - ab', 4)} AS bias_diff,
 {rnd('dv', 4)} AS bias_diff_var, {rnd('pred + hb - ab', 4)} AS pred_final, {rnd('coalesce(nu, 0)', 4)} AS innovation, CASE WHEN margin IS NULL THEN 0 ELSE {rnd('s', 4)} END AS innovation_var
 FROM sq JOIN it ON it.year = sq.year AND it.step = sq.seq"""))
def kalman_bias_pass(spark, sf_dir):
    out = bias.kalman_pass(rated(spark, sf_dir))
    return out.withColumns({c: r6(F.col(c), 4) for c in _PASS_COLUMNS})


@query("kalman_final_biases", "M7", _kalman_sql("margin IS NOT NULL", f"""SELECT it.year, team, {rnd('-m[i]', 4)} AS mean, {rnd('c[(i - 1) * t + i]', 4)} AS var,
 {rnd('sqrt(list_sum(list_transform(range(1, t + 1), lambda k: c[(k - 1) * t + k])) / t)', 4)} AS tau
 FROM it, ix WHERE step = (SELECT max(seq) FROM sq WHERE sq.year = it.year)"""))
def kalman_final_biases(spark, sf_dir):
    out = bias.kalman_posteriors(*bias.kalman_state(rated(spark, sf_dir)))
    return out.withColumns({c: r6(F.col(c), 4) for c in ("mean", "var", "tau")})


@query("kalman_bias_draws", "M8")
def kalman_bias_draws(spark, sf_dir):
    return bias.draw_biases(*bias.kalman_state(rated(spark, sf_dir)), n_sims=200, seed=3)


@query("kalman_parameter_grid", "M16 K15")
def kalman_parameter_grid(spark, sf_dir):
    return bias.grid_search(rated(spark, sf_dir), years=[1999, 2000, 2001])


@query("kalman_errors", "M17 A18")
def kalman_errors(spark, sf_dir):
    return bias.pass_metrics(bias.kalman_pass(rated(spark, sf_dir)))


@query("kalman_team_summary", "A47")
def kalman_team_summary(spark, sf_dir):
    g = rated(spark, sf_dir)
    return bias.team_bias_summary(bias.kalman_pass(g), g)


# the same aggregates over a stand-in filter output, which SQL can follow
_PASS_SQL = RATED_SQL + """, pass AS (SELECT game_id, year, team, opponent, date, margin, (game_id % 7 - 3) / 4.0 AS hb, (game_id % 5 - 2) / 4.0 AS ab,
  margin - pred AS innovation, 150.0 + game_id % 40 AS iv FROM rated)"""


def _stand_in_pass(spark, sf_dir):
    key = F.col("game_id")
    return rated(spark, sf_dir).select(
        "game_id", "year", "margin", F.lit(0).alias("param_id"), key.alias("seq"), ((key % 7 - 3) / 4.0).alias("home_bias"),
        ((key % 5 - 2) / 4.0).alias("away_bias"), (F.col("margin") - F.col("pred")).alias("innovation"),
        (150.0 + key % 40).alias("innovation_var"))


@query("team_bias_table", "A47", _PASS_SQL + f""", s AS (SELECT year, team, game_id, hb AS b FROM pass UNION ALL SELECT year, opponent, game_id, ab FROM pass)
 SELECT year, team, {rnd('avg(b)')} AS mean_bias, {rnd('avg(abs(b))')} AS mean_abs_bias, {rnd('max_by(b, game_id)')} AS final_bias, count(*) AS n_games FROM s GROUP BY ALL""")
def team_bias_table(spark, sf_dir):
    out = bias.team_bias_summary(_stand_in_pass(spark, sf_dir), rated(spark, sf_dir))
    return _r6(out, "mean_bias", "mean_abs_bias", "final_bias", keep=["year", "team", "n_games"])


@query("most_biased_sides", "A47 W17", _PASS_SQL + f""", s AS (SELECT year, team, hb AS b FROM pass UNION ALL SELECT year, opponent, ab FROM pass),
 m AS (SELECT year, team, {rnd('avg(abs(b))')} AS mean_abs_bias FROM s GROUP BY ALL)
 SELECT year, team, mean_abs_bias FROM m QUALIFY row_number() OVER (PARTITION BY year ORDER BY mean_abs_bias DESC, team) <= 6""")
def most_biased_sides(spark, sf_dir):
    out = _r6(bias.team_bias_summary(_stand_in_pass(spark, sf_dir), rated(spark, sf_dir)), "mean_abs_bias", keep=["year", "team"])
    return metrics.first_per_key(out, ["year"], [F.col("mean_abs_bias").desc(), F.col("team")], 6)


@query("innovation_calibration", "A48", _PASS_SQL + f""" SELECT {rnd('avg(innovation / sqrt(iv))')} AS z_mean, {rnd('stddev_pop(innovation / sqrt(iv))')} AS z_std,
 count(*) AS n FROM pass WHERE margin IS NOT NULL""")
def innovation_calibration(spark, sf_dir):
    return _r6(bias.innovation_calibration(_stand_in_pass(spark, sf_dir)), "z_mean", "z_std", keep=["n"])


@query("innovation_histogram", "A48 A45", _PASS_SQL + """, v AS (SELECT innovation AS x FROM pass WHERE innovation IS NOT NULL), mm AS (SELECT min(x) AS lo, max(x) AS hi FROM v)
 SELECT CAST(least(floor((x - lo) * 50 / (hi - lo)), 49) AS INT) AS bin, count(*) AS n FROM v, mm GROUP BY 1""")
def innovation_histogram(spark, sf_dir):
    return st.histogram(_stand_in_pass(spark, sf_dir), "innovation", 50)
