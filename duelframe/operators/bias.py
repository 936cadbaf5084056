"""Per-side prediction bias: variance prior, recency-weighted posterior and a season-long Kalman filter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.stats import error_metrics
from ..session import spread
from .perspective import all_teams, both_sides
from .scan import blocked_scan, day_block

FILTER_DEFAULTS = {"rho": 0.999, "q": 0.005, "r": 190.0, "init_var": 3.0}
GRID = {"rho": (1.0, 0.999, 0.995), "q": (0.01, 0.05, 0.1, 0.25), "r": (50.0, 100.0, 150.0), "init_var": (5.0, 10.0, 25.0)}
BLOCK_GAMES = (2_048, 32_768)  # least and most; 1,024 a parameter set in between
PARAMS_PER_TASK = 54
LANES = 32  # filters that a task steps through together, if its parameter sets are fewer
SETTLE = 32  # games between two writings-out of the decay


def residual_sides(games: DataFrame, pred: str = "pred", keep: Sequence[str] = ("year", "date", "game_id")) -> DataFrame:
    """Prediction minus result for the home side, negated for the away side."""
    resid = F.col(pred) - F.col("margin")
    base = {c: F.col(c) for c in keep}
    return both_sides(games.filter(F.col("margin").isNotNull()),
                      {**base, "team": F.col("team"), "is_home": F.lit(True), "resid": resid},
                      {**base, "team": F.col("opponent"), "is_home": F.lit(False), "resid": -resid})


def bias_prior(games: DataFrame, sigma: float | None = None, keys: Sequence[str] = ("year",), pred: str = "pred") -> DataFrame:
    """Spread of true biases: variance of side means less its sampling part, floored at 0.25.

    ``sigma`` defaults to the population deviation of the residuals, taken in the same pass.
    """
    sides = residual_sides(games, pred, [*keys])
    at_home = F.when(F.col("is_home"), F.col("resid"))  # every game once
    means = sides.groupBy(*keys, "team").agg(
        F.avg("resid").alias("mean"), F.count(F.lit(1)).alias("n"), F.count(at_home).alias("games"),
        F.sum(at_home).alias("s"), F.sum(at_home * at_home).alias("q"))
    all_games = means.agg(
        F.var_pop("mean").alias("between"), F.avg(1 / F.col("n")).alias("thin"), F.count(F.lit(1)).alias("team_seasons"),
        F.sum("games").alias("games"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("games")
    spread = F.sqrt(F.col("q") / F.col("games") - mean * mean) if sigma is None else F.lit(float(sigma))
    known = all_games.withColumn("sigma", spread)
    tau = F.sqrt(F.greatest(F.col("between") - F.col("sigma") * F.col("sigma") * F.col("thin"), F.lit(0.25)))
    return known.select(tau.alias("tau"), "sigma", "team_seasons")


def bias_posterior(games: DataFrame, tau: float, sigma: float, decay: float = 0.97, pred: str = "pred",
                   keys: Sequence[str] = ("year",)) -> DataFrame:
    """Normal posterior per side; a game's weight is ``decay`` to the number of later games of the side."""
    keys = list(keys)
    sides = residual_sides(games, pred, [*dict.fromkeys([*keys, "date", "game_id"])])
    placed = blocked_scan(sides, [*keys, "team"], "date", ["game_id", "is_home"], position="pos")
    total = sides.groupBy(*keys, "team").agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.lit(float(decay)), F.col("n") - F.col("pos"))
    sums = (placed.join(total, [*keys, "team"]).withColumn("w", weight).groupBy(*keys, "team")
            .agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"),
                 F.sum(F.col("w") * F.col("resid")).alias("wr"), F.count(F.lit(1)).alias("n_games")))
    effective = F.col("w") * F.col("w") / F.col("w2")
    var = 1.0 / (effective / sigma ** 2 + 1.0 / tau ** 2)
    return sums.select(*keys, "team", "n_games", (var * effective * (F.col("wr") / F.col("w")) / sigma ** 2).alias("mean"),
                       var.alias("var"))


def correct_prediction(games: DataFrame, biases: DataFrame, pred: str = "pred", keys: Sequence[str] = ()) -> DataFrame:
    """Prediction less the home side's bias plus the away side's; unknown sides have none."""
    keys = list(keys)
    home = biases.select(*keys, "team", F.col("mean").alias("__h"))
    away = biases.select(*keys, F.col("team").alias("opponent"), F.col("mean").alias("__a"))
    zero = F.lit(0.0)
    fixed = F.col(pred) - F.coalesce("__h", zero) + F.coalesce("__a", zero)
    return (games.join(home, [*keys, "team"], "left").join(away, [*keys, "opponent"], "left")
            .withColumn(pred, fixed).drop("__h", "__a"))


# ---- Kalman filter -----------------------------------------------------------------------------
#
# State: one additive bias per side.  Before every game all biases decay by rho and gain variance q; a
# result observes the difference of two biases with noise r.  A season is cut into blocks of games.  A block
# is summarised by the linear-Gaussian map from its starting state to its end and the information it gives
# about that start (the associative element of parallel Kalman filtering, Sarkka and Garcia-Fernandez 2021),
# so that blocks run in parallel, their summaries are chained in order, and each block then filters its own
# games from the right start.  A task steps through its filters together, one lane for each block and parameter set.


class _Filters:
    """Filters stepped through together, for every block each parameter set; and, when asked, their blocks' summaries.

    Covariance, gain and mean stand side by side in one array, since a result takes the same multiple off the rows of all
    three.  Their decay is kept as factors (covariance = ``alpha`` times the array + ``delta`` on the diagonal, gain and
    mean = ``g`` times it) and written out every ``SETTLE`` games.  Blocks that end earlier must come later.
    """

    def __init__(self, params: Sequence[dict], blocks: int, sides: int, mean=None, cov=None, summarise=False):
        column = lambda k: np.tile(np.array([p[k] for p in params], dtype=float), blocks)
        self.rho, self.q, self.r = column("rho"), column("q"), column("r")
        self.sets, self.sides, lanes = len(params), sides, len(params) * blocks
        self.x = np.zeros((lanes, sides, (2 if summarise else 1) * sides + 1))
        self.part = np.empty_like(self.x)
        if cov is not None:
            self.x[:, :, :sides], self.x[:, :, -1] = cov, mean
        self.alpha, self.delta, self.g = np.ones(lanes), np.zeros(lanes), np.ones(lanes)
        self.lane, self.at = np.arange(lanes), np.arange(sides)
        self.eager, self.steps = bool((np.abs(self.rho) < 0.5).any()), 0
        self.summarise = summarise
        if summarise:
            self.x[:, self.at, sides + self.at] = 1
            self.info, self.eta = np.zeros((lanes, sides, sides)), np.zeros((lanes, sides))
            self.seen, self.told = np.zeros((lanes, SETTLE, sides)), np.zeros((lanes, SETTLE))

    def settle(self):
        t = self.sides
        self.x[:, :, :t] *= self.alpha[:, None, None]
        self.x[:, self.at, self.at] += self.delta[:, None]
        self.x[:, :, t:] *= self.g[:, None, None]
        self.alpha[:], self.delta[:], self.g[:] = 1, 0, 1

    def collect(self):
        if self.summarise and self.steps:
            seen = self.seen[:, :self.steps].swapaxes(1, 2)
            self.info += seen @ self.seen[:, :self.steps]
            self.eta += (seen @ self.told[:, :self.steps, None])[..., 0]
            self.seen[:], self.told[:] = 0, 0
        self.steps = 0

    def step(self, home: np.ndarray, away: np.ndarray, z: np.ndarray):
        """Decay before one game of each of the first blocks; what is known of it then, by lane: among others both sides'
        means, the variance of their difference, that of the innovation, and ``z``, the result less the prediction."""
        n = len(home) * self.sets
        if len(home) == 1:  # a game for all lanes: no look-up by lane
            at_h, at_a = (slice(None), int(home[0])), (slice(None), int(away[0]))
        else:
            at_h, at_a = ((self.lane[:n], np.repeat(v, self.sets)) for v in (home, away))
        z = np.repeat(z, self.sets)
        alpha, delta, g, rho = self.alpha[:n], self.delta[:n], self.g[:n], self.rho[:n]
        g *= rho
        alpha *= rho * rho
        delta *= rho * rho
        delta += self.q[:n]
        if self.eager:
            self.settle()
        x = self.x[:n]
        at_home, at_away = x[at_h], x[at_a]
        row = at_home - at_away
        shift = delta / alpha
        row[at_h] += shift
        row[at_a] -= shift
        var = alpha * (row[at_h] - row[at_a])
        s = var + self.r[:n]
        mh, ma = g * at_home[:, -1], g * at_away[:, -1]
        return n, row, alpha, g, mh, ma, var, s, z

    def update(self, found, played: np.ndarray):
        """Take in the results of the step's games that have one; returns the innovations."""
        n, row, alpha, g, mh, ma, var, s, z = found
        t, every = self.sides, bool(played.all())
        weight, nu = alpha / s, z - (mh - ma)
        row[:, -1] = -nu / g
        if not every:
            open_ = np.repeat(~played, self.sets)
            weight[open_], nu[open_], row[open_, -1] = 0.0, 0.0, 0.0
        if self.summarise:
            root = np.sqrt(1 / s)
            if not every:
                root[open_] = 0.0
            self.seen[:n, self.steps] = row[:, t:2 * t] * (g * root)[:, None]
            self.told[:n, self.steps] = nu * root
        self.x[:n] -= np.einsum("lt,lw->ltw", row[:, :t] * weight[:, None], row, out=self.part[:n])
        self.steps += 1
        if self.steps == SETTLE:
            self.collect()
            self.settle()
        return nu

    def finish(self):
        self.collect()
        self.settle()

    @property
    def cov(self) -> np.ndarray:
        return self.x[:, :, :self.sides]

    @property
    def gain(self) -> np.ndarray:
        return self.x[:, :, self.sides:2 * self.sides]

    @property
    def mean(self) -> np.ndarray:
        return self.x[:, :, -1]


def _initial(params: Sequence[dict], sides: int) -> np.ndarray:
    return np.eye(sides) * np.array([p["init_var"] for p in params])[:, None, None]


def _indexed(games: DataFrame, pred: str, batches: list[list[dict]], block_games: int | None) -> tuple[DataFrame, DataFrame]:
    """Games with dense side numbers, their block and their group of blocks, one copy per parameter batch; and the number
    table."""
    sets = len(batches[0])
    if block_games is None:
        block_games = min(max(1_024 * sets, BLOCK_GAMES[0]), BLOCK_GAMES[1])
    names = all_teams(games)
    numbers = names.withColumn("idx", F.row_number().over(W.orderBy("team")) - 1)  # one row per side
    sides = numbers.agg(F.count(F.lit(1)).alias("sides"))
    rows = games.select("year", "date", "game_id", "team", "opponent", "margin", F.col(pred).alias("pred"))
    placed = blocked_scan(rows.withColumn("__block", day_block(rows)), ["year"], "__block", ["game_id"], position="seq")
    home = numbers.select("team", F.col("idx").alias("h"))
    away = numbers.select(F.col("team").alias("opponent"), F.col("idx").alias("a"))
    out = (placed.join(home, "team").join(away, "opponent").join(F.broadcast(sides))  # one row
           .select("year", F.explode(F.array(*[F.lit(i) for i in range(len(batches))])).alias("batch"),
                   F.expr(f"(seq - 1) div {block_games}").alias("block"), "seq", "game_id", "h", "a", "sides", "pred",
                   F.col("margin").cast("double").alias("margin")))
    return _grouped(out, batches), numbers


def _grouped(df: DataFrame, batches: list[list[dict]]) -> DataFrame:
    return df.withColumn("part", F.expr(f"block div {max(1, LANES // len(batches[0]))}"))


_KEYS = ["year", "batch"]
_GROUP = [*_KEYS, "part"]
_STATE = "year int, batch int, block bigint, mean array<double>, cov array<double>"


def _split(params: Sequence[dict]) -> list[list[dict]]:
    return [list(params[i:i + PARAMS_PER_TASK]) for i in range(0, len(params), PARAMS_PER_TASK)]


def _walk(pdf: pd.DataFrame, params: list[dict], state: pd.DataFrame | None = None, summarise: bool = False, look=None
          ) -> tuple[_Filters, list]:
    """Filter the games of some blocks together, each from its row of ``state``, else from the season's start; with
    ``summarise`` from nothing.  ``look(rows, found, nu)`` sees every step, ``rows`` being places in the sorted ``pdf``."""
    block, first, size = np.unique(pdf["block"].to_numpy(), return_index=True, return_counts=True)
    order = np.argsort(-size, kind="stable")
    block, first, size = block[order], first[order], size[order]
    t, sets = int(pdf["sides"].iloc[0]), len(params)
    mean, cov = None, None
    if not summarise:
        known = {} if state is None else {b: k for k, b in enumerate(state["block"])}
        mean, cov = np.zeros((len(block), sets, t)), np.repeat(_initial(params, t)[None], len(block), 0)
        for k, b in enumerate(block):
            if b in known:
                row = state.iloc[known[b]]
                mean[k], cov[k] = np.reshape(row["mean"], (sets, t)), np.reshape(row["cov"], (sets, t, t))
        mean, cov = mean.reshape(-1, t), cov.reshape(-1, t, t)
    f = _Filters(params, len(block), t, mean, cov, summarise)
    home, away = pdf["h"].to_numpy(np.int64), pdf["a"].to_numpy(np.int64)
    margin = pdf["margin"].to_numpy(float)
    z, played = margin - pdf["pred"].to_numpy(float), ~np.isnan(margin)
    for i in range(int(size[0])):
        rows = first[:int(np.searchsorted(-size, -i, "left"))] + i  # blocks with more than i games
        found = f.step(home[rows], away[rows], z[rows])
        nu = f.update(found, played[rows])
        if look:
            look(rows, found, nu)
    f.finish()
    return f, block.tolist()


def _chain_starts(games: DataFrame, batches: list[list[dict]]) -> DataFrame:
    """Starting state of every block but the first."""
    last = games.groupBy(*_KEYS).agg(F.max("block").alias("last_block"))
    inner = games.join(last, _KEYS).filter(F.col("block") < F.col("last_block")).drop("last_block")
    fields = "sides int, gain array<double>, shift array<double>, cov array<double>, info array<double>, eta array<double>"

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        first = pdf.iloc[0]
        f, blocks = _walk(pdf, batches[int(first.batch)], summarise=True)
        lanes = lambda v, k: v[k * f.sets:(k + 1) * f.sets].ravel()
        return pd.DataFrame([{"year": first.year, "batch": first.batch, "block": b, "sides": first.sides,
                              "gain": lanes(f.gain, k), "shift": lanes(f.mean, k), "cov": lanes(f.cov, k),
                              "info": lanes(f.info, k), "eta": lanes(f.eta, k)} for k, b in enumerate(blocks)])

    def chain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, mean, cov = None, None, None
        for part in parts:
            rows = []
            for b in part.itertuples():
                t = b.sides
                sets = batches[b.batch]
                square, flat = (len(sets), t, t), (len(sets), t)
                if current != (b.year, b.batch):
                    current, mean, cov = (b.year, b.batch), np.zeros(flat), _initial(sets, t)
                gain, info = np.reshape(b.gain, square), np.reshape(b.info, square)
                # posterior of the start given the block, then through the block's map
                weight = np.linalg.inv(np.eye(t) + cov @ info)
                start = (weight @ (mean[..., None] + cov @ np.reshape(b.eta, flat)[..., None]))
                mean = (gain @ start)[..., 0] + np.reshape(b.shift, flat)
                cov = gain @ (weight @ cov) @ gain.swapaxes(1, 2) + np.reshape(b.cov, square)
                cov = (cov + cov.swapaxes(1, 2)) / 2
                rows.append((b.year, b.batch, b.block + 1, mean.ravel().copy(), cov.ravel().copy()))
            yield pd.DataFrame(rows, columns=["year", "batch", "block", "mean", "cov"])

    summaries = spread(inner, *_GROUP).groupBy(*_GROUP).applyInPandas(summarise, f"year int, batch int, block bigint, {fields}")
    # streamed in order: one state in memory, however many blocks a season has
    return _grouped(summaries.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "block").mapInPandas(chain, _STATE)
                    .toDF("year", "batch", "block", "mean", "cov"), batches)


def kalman_pass(games: DataFrame, pred: str = "pred", params: Sequence[dict] = (FILTER_DEFAULTS,),
                block_games: int | None = None) -> DataFrame:
    """Per game and parameter set: biases known before it, corrected prediction, and the innovation afterwards.

    Seasons start anew; games without a margin only advance the state.
    """
    batches = _split(params)
    indexed, _ = _indexed(games, pred, batches, block_games)
    starts = _chain_starts(indexed, batches)
    values = ["home_bias", "away_bias", "bias_diff", "bias_diff_var", "pred_final", "innovation", "innovation_var"]
    base = ["year", "game_id", "seq", "pred", "margin"]
    schema = ("year int, game_id bigint, seq bigint, pred double, margin double, param_id int, "
              + ", ".join(f"{v} double" for v in values))

    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=[*base, "param_id", *values])
        pdf = pdf.sort_values("seq")
        first_id = int(pdf["batch"].iloc[0]) * PARAMS_PER_TASK
        sets = len(batches[int(pdf["batch"].iloc[0])])
        out, guess, played = np.zeros((len(pdf), sets, len(values))), pdf["pred"].to_numpy(float), pdf["margin"].notna().to_numpy()

        def look(rows, found, nu):
            mh, ma, var, s = (v.reshape(-1, sets) for v in found[4:8])
            has = played[rows][:, None]
            for k, v in enumerate((mh, ma, mh - ma, var, guess[rows][:, None] + mh - ma, np.where(has, nu.reshape(-1, sets), 0.0), np.where(has, s, 0.0))):
                out[rows, :, k] = v

        _walk(pdf, batches[int(pdf["batch"].iloc[0])], state, look=look)
        res = pdf[base].loc[pdf.index.repeat(sets)].reset_index(drop=True)
        res["param_id"] = np.tile(np.arange(first_id, first_id + sets), len(pdf))
        return pd.concat([res, pd.DataFrame(out.reshape(-1, len(values)), columns=values)], axis=1)

    result = spread(indexed, *_GROUP).groupBy(*_GROUP).cogroup(starts.groupBy(*_GROUP)).applyInPandas(run, schema)
    return result.withColumn("margin", F.nanvl("margin", F.lit(None).cast("double")))


def kalman_state(games: DataFrame, pred: str = "pred", params: dict = FILTER_DEFAULTS,
                 block_games: int | None = None) -> tuple[DataFrame, DataFrame]:
    """State after each season's completed games, and the side numbers its arrays follow."""
    batches = [[params]]
    indexed, numbers = _indexed(games, pred, batches, block_games)
    played = indexed.filter(F.col("margin").isNotNull())
    starts = _chain_starts(played, batches)
    last = played.groupBy(*_KEYS).agg(F.max("block").alias("last_block"))
    tail = played.join(last, _KEYS).filter(F.col("block") == F.col("last_block")).drop("last_block")

    def finish(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["year", "batch", "block", "mean", "cov"])
        pdf = pdf.sort_values("seq")
        f, blocks = _walk(pdf, batches[0], state)
        first = pdf.iloc[0]
        return pd.DataFrame([{"year": first.year, "batch": first.batch, "block": blocks[0], "mean": f.mean.ravel(),
                              "cov": f.cov.ravel()}])

    state = spread(tail, *_GROUP).groupBy(*_GROUP).cogroup(starts.groupBy(*_GROUP)).applyInPandas(finish, _STATE)
    return state.select("year", "mean", "cov"), numbers


def kalman_posteriors(state: DataFrame, numbers: DataFrame) -> DataFrame:
    """(year, team, mean, var) with positive meaning overprediction, and tau for unknown sides."""
    t = F.size("mean")
    diagonal = F.transform(F.sequence(F.lit(0), t - 1), lambda i: F.get("cov", i * t + i))
    total = F.aggregate(diagonal, F.lit(0.0), lambda acc, x: acc + x)
    long = state.select("year", F.sqrt(total / t).alias("tau"), F.posexplode(F.arrays_zip(F.col("mean").alias("m"), diagonal.alias("v"))))
    return (long.join(numbers, long["pos"] == numbers["idx"])
            .select("year", "team", (-F.col("col.m")).alias("mean"), F.col("col.v").alias("var"), "tau"))


def draw_biases(state: DataFrame, numbers: DataFrame, n_sims: int, seed: int = 0, chunk: int = 1000) -> DataFrame:
    """One joint draw of all biases per scenario: (year, sim_id, team, bias)."""
    tasks = state.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((n_sims - 1) // chunk))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                t = len(row.mean)
                size = min(chunk, n_sims - row.chunk * chunk)
                cov = np.reshape(row.cov, (t, t))
                values, vectors = np.linalg.eigh((cov + cov.T) / 2)
                root = vectors * np.sqrt(np.clip(values, 0, None))
                rng = np.random.default_rng([seed, row.year, row.chunk])
                sample = np.asarray(row.mean) + rng.standard_normal((size, t)) @ root.T
                yield pd.DataFrame({"year": row.year, "sim_id": np.repeat(row.chunk * chunk + np.arange(size), t),
                                    "idx": np.tile(np.arange(t), size), "bias": -sample.ravel()})

    drawn = tasks.repartition("year", "chunk").mapInPandas(draw, "year int, sim_id bigint, idx int, bias double")
    return drawn.join(numbers, "idx").select("year", "sim_id", "team", "bias")


def _squared_errors(games: DataFrame, pred: str, params: Sequence[dict]) -> DataFrame:
    """Number and sum of squared errors of ``kalman_pass``, before and after correction, per group of blocks and parameter
    set: the errors of a game stay in its task."""
    batches = _split(params)
    indexed, _ = _indexed(games, pred, batches, None)
    starts = _chain_starts(indexed, batches)
    columns = ["param_id", "n", "s", "n_base", "s_base"]

    def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        pdf = pdf.sort_values("seq")
        batch = int(pdf["batch"].iloc[0])
        sets, error = len(batches[batch]), (pdf["pred"] - pdf["margin"]).to_numpy(float)
        n, s, base = np.zeros(sets, np.int64), np.zeros(sets), error[~np.isnan(error)]

        def look(rows, found, nu):
            left = error[rows][:, None] + (found[4] - found[5]).reshape(-1, sets)
            known = ~np.isnan(left)
            n[:] += known.sum(0)
            s[:] += np.where(known, left * left, 0.0).sum(0)

        _walk(pdf, batches[batch], state, look=look)
        return pd.DataFrame({"param_id": batch * PARAMS_PER_TASK + np.arange(sets), "n": n, "s": s, "n_base": len(base),
                             "s_base": float((base * base).sum())})[columns]

    return spread(indexed, *_GROUP).groupBy(*_GROUP).cogroup(starts.groupBy(*_GROUP)).applyInPandas(
        run, "param_id int, n bigint, s double, n_base bigint, s_base double")


def grid_search(games: DataFrame, pred: str = "pred", grid: dict = GRID, years: Sequence[int] | None = None) -> DataFrame:
    """Error of every parameter set over the chosen seasons, best first by ``rank``."""
    import itertools

    params = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    chosen = games.filter(F.col("year").isin(*years)) if years else games
    sums = _squared_errors(chosen, pred, params).groupBy("param_id").agg(*[F.sum(c).alias(c) for c in ("n", "s", "n_base", "s_base")])
    rmse = lambda n, s: F.when(F.col(n) > 0, F.sqrt(F.col(s) / F.col(n)))
    table = sums.select("param_id", rmse("n", "s").alias("rmse_kalman"), rmse("n_base", "s_base").alias("rmse_base"))
    names = F.array(*[F.struct(*[F.lit(float(p[k])).alias(k) for k in grid]) for p in params])
    return (table.withColumn("p", F.get(names, F.col("param_id"))).select("param_id", "p.*", "rmse_kalman", "rmse_base",
            (F.col("rmse_kalman") - F.col("rmse_base")).alias("delta"))
            .withColumn("rank", F.row_number().over(W.orderBy("rmse_kalman", "param_id"))))  # one row per set


def team_bias_summary(passed: DataFrame, games: DataFrame) -> DataFrame:
    """Mean, mean absolute, final bias and games per side over a filter pass."""
    named = passed.select("game_id", "param_id", "seq", "home_bias", "away_bias").join(
        games.select("game_id", "year", "team", "opponent"), "game_id")
    base = {"year": F.col("year"), "seq": F.col("seq")}
    sides = both_sides(named, {**base, "team": F.col("team"), "b": F.col("home_bias")},
                       {**base, "team": F.col("opponent"), "b": F.col("away_bias")})
    return sides.groupBy("year", "team").agg(
        F.avg("b").alias("mean_bias"), F.avg(F.abs("b")).alias("mean_abs_bias"), F.max_by("b", "seq").alias("final_bias"),
        F.count(F.lit(1)).alias("n_games"))


def innovation_calibration(passed: DataFrame) -> DataFrame:
    """Standardised innovations should have mean 0 and deviation 1."""
    z = F.col("innovation") / F.sqrt("innovation_var")
    return passed.filter(F.col("margin").isNotNull()).agg(
        F.avg(z).alias("z_mean"), F.stddev_pop(z).alias("z_std"), F.count(F.lit(1)).alias("n"))


def pass_metrics(passed: DataFrame) -> DataFrame:
    """Errors before and after correction."""
    done = passed.filter(F.col("margin").isNotNull())
    return done.agg(*error_metrics(F.col("pred"), F.col("margin"), "base_"),
                    *error_metrics(F.col("pred_final"), F.col("margin"), "kalman_"))
