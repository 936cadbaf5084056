"""Iterative team ratings and schedule-adjusted efficiencies.

Games collapse to one row per ordered pair before any iteration, so what is iterated grows with sides
squared per season and not with games; one task solves one season (or one chunk of dates) from that table.
Ten thousand sides in a season would be at most a hundred million pairs, and only pairs that met have a row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as S
from ..schema import HCA_PRIOR, RATING_DAY_CAP
from ..session import spread
from .perspective import all_teams

STEP = 0.1
EPOCHS = 1000
TOLERANCE = 1e-7
LEAST_GAMES = 100


def _clip(value: Column, cap: float | None) -> Column:
    return value if cap is None else F.greatest(F.least(value, F.lit(float(cap))), F.lit(-float(cap)))


def recent_games(games: DataFrame, keys: Sequence[str], day_cap: int = RATING_DAY_CAP) -> DataFrame:
    """Games less than ``day_cap`` days before the key's last one."""
    last = games.groupBy(*keys).agg(F.max("date").alias("__last"))
    return games.join(last, list(keys)).filter(F.col("date") > F.date_sub("__last", day_cap)).drop("__last")


def rating_pairs(games: DataFrame, keys: Sequence[str], cap: float | None = None) -> DataFrame:
    return games.groupBy(*keys, "team", "opponent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_clip(F.col("margin").cast("double"), cap)).alias("s"))


def relax(block, home, away, n, s, hca, blocks: int, sides: int, cap=None, epochs=EPOCHS):
    """Damped mean-residual iteration for several independent games tables at once.

    All arrays are per pair row; ``block`` says which table a row belongs to.  A table stops moving once
    its largest change falls below the tolerance, tested from the second round on.
    """
    size = blocks * sides
    hi, ai = block * sides + home, block * sides + away
    games = np.bincount(hi, n, size) + np.bincount(ai, n, size)
    scale = np.divide(STEP, games, out=np.zeros(size), where=games > 0)
    rating = np.zeros(size)
    active = np.ones(blocks, dtype=bool)
    for epoch in range(epochs):
        expected = rating[hi] - rating[ai] + hca
        if cap is not None:
            expected = np.clip(expected, -cap, cap)
        error = s - n * expected
        change = scale * (np.bincount(hi, error, size) - np.bincount(ai, error, size))
        change.reshape(blocks, sides)[~active] = 0.0
        rating += change
        if epoch:
            active &= np.abs(change).reshape(blocks, sides).max(axis=1) >= TOLERANCE
            if not active.any():
                break
    return rating.reshape(blocks, sides)


def _solve_grouped(pairs: DataFrame, keys: list[str], cap, epochs) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", team {kinds['team']}, rating double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["team"], pdf["opponent"]]), return_inverse=True)
        home, away = codes[: len(pdf)], codes[len(pdf):]
        rating = relax(np.zeros(len(pdf), dtype=int), home, away, pdf["n"].to_numpy(float), pdf["s"].to_numpy(float),
                       pdf["hca"].to_numpy(float), 1, len(names), cap, epochs)[0]
        out = pd.DataFrame({"team": names, "rating": rating})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "team", "rating"]]

    return spread(pairs, *keys).groupBy(*keys).applyInPandas(solve, schema)


def em_ratings(games: DataFrame, keys: Sequence[str] = ("year",), teams: DataFrame | None = None,
               edges: DataFrame | None = None, hca: float = HCA_PRIOR, cap: float | None = None,
               day_cap: int = RATING_DAY_CAP, epochs: int = EPOCHS) -> DataFrame:
    """Ratings per key from completed games.

    ``teams`` (keys, team) names the rated sides; without it they are the sides seen at home.  Games with
    an unrated side are left out, rated sides without games get 0.  ``edges`` (keys, hca) overrides ``hca``.
    """
    keys = list(keys)
    played = games.filter(F.col("margin").isNotNull()).select(*keys, "date", "team", "opponent", "margin")
    index = (teams if teams is not None else played).select(*keys, "team").distinct()
    pairs = rating_pairs(recent_games(played, keys, day_cap), keys, cap)
    pairs = (pairs.join(index, [*keys, "team"], "left_semi")
             .join(index.withColumnRenamed("team", "opponent"), [*keys, "opponent"], "left_semi"))
    if edges is None:
        pairs = pairs.withColumn("hca", F.lit(float(hca)))
    else:
        pairs = pairs.join(edges.select(*keys, "hca"), keys, "left").fillna(float(hca), ["hca"])
    solved = _solve_grouped(pairs, keys, cap, epochs)
    return index.join(solved, [*keys, "team"], "left").fillna(0.0, ["rating"])


def season_end_ratings(games: DataFrame, edges: DataFrame | None = None, **kwargs) -> DataFrame:
    return em_ratings(games.filter("completed"), ["year"], edges=edges, **kwargs)


# ---- ratings as they stood before every date ---------------------------------------------------


def by_day(games: DataFrame) -> DataFrame:
    """Dates cut to calendar days; a feed's dates may carry a time."""
    return games.withColumn("date", F.to_date("date"))


def as_of_dates(games: DataFrame) -> DataFrame:
    """Per season and game day: completed games so far and the last day that had one."""
    per_day = by_day(games).groupBy("year", "date").agg(F.count_if("completed").alias("done"))
    before = W.partitionBy("year").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    return per_day.select(
        "year", F.col("date").alias("as_of"), F.coalesce(F.sum("done").over(before), F.lit(0)).alias("games_before"),
        F.last(F.when(F.col("done") > 0, F.col("date")), ignorenulls=True).over(before).alias("last_day"))


def point_in_time_ratings(games: DataFrame, edges: DataFrame | None = None, hca: float = HCA_PRIOR,
                          day_cap: int = RATING_DAY_CAP, least_games: int = LEAST_GAMES, chunk_days: int = 31,
                          wanted: DataFrame | None = None) -> DataFrame:
    """year, as_of, team, rating: ratings from completed games before each day, 0 until there are enough.

    ``wanted`` (year, as_of) limits the days that are rated; each must be a game day of its season.  Daily pair
    sums are sent to the month-sized chunks of days that can see them; each chunk solves its days together.
    Sides not yet seen at home have a null rating.
    """
    games = by_day(games)
    played = games.filter(F.col("completed") & F.col("margin").isNotNull())
    daily = played.groupBy("year", "date", "team", "opponent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("margin").cast("double")).alias("s"))
    asks = as_of_dates(games)
    if wanted is not None:
        asks = asks.join(wanted.select("year", F.to_date("as_of").alias("as_of")).distinct(), ["year", "as_of"], "left_semi")
    first_home = daily.groupBy("year", "team").agg(F.min("date").alias("first_home"))
    solvable = asks.filter(F.col("games_before") > least_games).withColumn(
        "chunk", F.expr(f"datediff(as_of, DATE '1970-01-01') div {chunk_days}"))
    edge = (solvable.select("year").distinct().withColumn("hca", F.lit(float(hca))) if edges is None
            else edges.select("year", "hca"))
    solvable = solvable.join(edge, "year", "left").fillna(float(hca), ["hca"])
    home = first_home.select("year", "team", F.col("first_home").alias("home_seen"))
    away = first_home.select("year", F.col("team").alias("opponent"), F.col("first_home").alias("away_seen"))
    # a pair counts from the day after both of its sides have been seen at home
    usable = (daily.join(home, ["year", "team"]).join(away, ["year", "opponent"])
              .withColumn("usable_after", F.greatest("home_seen", "away_seen")))
    spans = solvable.groupBy("year", "chunk").agg(F.date_sub(F.min("last_day"), day_cap).alias("lo"),
                                                  F.max("last_day").alias("hi"))
    seen = usable.join(spans, "year").filter((F.col("date") > F.col("lo")) & (F.col("date") <= F.col("hi")))
    solved = _solve_chunks(seen, solvable, day_cap)
    grid = asks.join(all_teams(games, ["year"]), "year").join(first_home, ["year", "team"], "left")
    rating = (F.when(F.col("games_before") <= least_games, F.lit(0.0))
              .when(F.col("first_home") < F.col("as_of"), F.coalesce("rating", F.lit(0.0))))
    return grid.join(solved, ["year", "as_of", "team"], "left").select("year", "as_of", "team", rating.alias("rating"))


def _solve_chunks(seen: DataFrame, solvable: DataFrame, day_cap: int) -> DataFrame:
    kind = seen.schema["team"].dataType.simpleString()

    def solve(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = ["year", "as_of", "team", "rating"]
        if rows.empty or asks.empty:
            return pd.DataFrame(columns=columns)
        names, codes = np.unique(np.concatenate([rows["team"], rows["opponent"]]), return_inverse=True)
        home, away = codes[: len(rows)], codes[len(rows):]
        pair_ids, pair = np.unique(home * len(names) + away, return_inverse=True)
        day = pd.to_datetime(rows["date"]).to_numpy()
        after = pd.to_datetime(rows["usable_after"]).to_numpy()
        n, s = rows["n"].to_numpy(float), rows["s"].to_numpy(float)
        parts = []
        for b, ask in enumerate(asks.itertuples()):
            last = np.datetime64(ask.last_day)
            use = (day <= last) & (day > last - np.timedelta64(day_cap, "D")) & (after < np.datetime64(ask.as_of))
            cn = np.bincount(pair[use], n[use], len(pair_ids))
            live = np.flatnonzero(cn)
            cs = np.bincount(pair[use], s[use], len(pair_ids))
            parts.append((np.full(len(live), b), pair_ids[live], cn[live], cs[live], np.full(len(live), ask.hca)))
        block, pid, cn, cs, edge = (np.concatenate(x) for x in zip(*parts))
        rating = relax(block, pid // len(names), pid % len(names), cn, cs, edge, len(asks), len(names))
        return pd.DataFrame({"year": asks["year"].iloc[0], "as_of": np.repeat(asks["as_of"].to_numpy(), len(names)),
                             "team": np.tile(names, len(asks)), "rating": rating.ravel()})[columns]

    rows = spread(seen.select("year", "chunk", "date", "team", "opponent", "n", "s", "usable_after"), "year", "chunk")
    return (rows.groupBy("year", "chunk")
            .cogroup(solvable.select("year", "chunk", "as_of", "last_day", "hca")
                     .toDF("year", "chunk", "as_of", "last_day", "hca").groupBy("year", "chunk"))
            .applyInPandas(solve, f"year int, as_of date, team {kind}, rating double"))


def attach_ratings(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Point-in-time ratings of both sides on the game row."""
    home = ratings.select("year", F.col("as_of").alias("__day"), "team", F.col("rating").alias("team_rating"))
    away = ratings.select("year", F.col("as_of").alias("__day"), F.col("team").alias("opponent"),
                          F.col("rating").alias("opponent_rating"))
    dated = games.withColumn("__day", F.to_date("date"))
    return (dated.join(home, ["year", "__day", "team"], "left").join(away, ["year", "__day", "opponent"], "left")
            .drop("__day"))


# ---- schedule-adjusted efficiencies ------------------------------------------------------------


def adjusted_efficiencies(games: DataFrame, keys: Sequence[str] = ("year",), hca: float = HCA_PRIOR,
                          steps: int = 100) -> DataFrame:
    """Exactly ``steps`` synchronous steps from the raw efficiencies, centred and scaled by 100."""
    keys = list(keys)
    pace = S.pace_or_default(F.col("pace"))
    own, other = (F.col("team_score") + hca / 2) / pace, (F.col("opponent_score") - hca / 2) / pace
    pairs = games.groupBy(*keys, "team", "opponent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(own).alias("own"), F.sum(other).alias("other"),
        F.sum(F.col("team_score") / pace).alias("raw_own"), F.sum(F.col("opponent_score") / pace).alias("raw_other"))
    average = pairs.groupBy(*keys).agg((F.sum("raw_own") / F.sum("n")).alias("avg"))
    return _efficiency_grouped(pairs.join(average, keys), keys, steps)


def _efficiency_grouped(pairs: DataFrame, keys: list[str], steps: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", team {kinds['team']}, adj_off double, adj_def double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(np.concatenate([pdf["team"], pdf["opponent"]]), return_inverse=True)
        home, away, t = codes[: len(pdf)], codes[len(pdf):], len(names)
        n = pdf["n"].to_numpy(float)
        games = np.bincount(home, n, t) + np.bincount(away, n, t)
        per_side = lambda at_home, at_away: (np.bincount(home, at_home, t) + np.bincount(away, at_away, t)) / games
        off = per_side(pdf["raw_own"], pdf["raw_other"])
        dfn = per_side(pdf["raw_other"], pdf["raw_own"])
        own = pdf["own"].to_numpy(float) - n * pdf["avg"].to_numpy(float)
        other = pdf["other"].to_numpy(float) - n * pdf["avg"].to_numpy(float)
        for _ in range(steps):
            off, dfn = (per_side(own + n * dfn[away], other + n * dfn[home]),
                        per_side(n * off[away] - other, n * off[home] - own))
        out = pd.DataFrame({"team": names, "adj_off": 100 * (off - off.mean()), "adj_def": 100 * (dfn - dfn.mean())})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "team", "adj_off", "adj_def"]]

    return spread(pairs, *keys).groupBy(*keys).applyInPandas(solve, schema)
