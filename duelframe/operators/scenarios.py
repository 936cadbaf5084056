"""Many outcomes of the same schedule, side by side: the scenario number is a column.

Ratings are held at their as-of state for the whole schedule; results of a scenario do not feed back into
its later games.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import games_needed
from . import records
from .perspective import both_sides

CHUNK = 1000
# home side of games 1..7 of a series
HOST_AT_HOME = (True, True, False, False, True, False, True)
DAYS_BETWEEN = 3


def fan_out(schedule: DataFrame, n_sims: int, key: str = "game_id") -> DataFrame:
    """One row per scheduled game and scenario.

    Rows are spread by (game, thousand scenarios) before the final expansion, so a short schedule still
    uses the whole cluster.
    """
    chunks = schedule.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit((n_sims - 1) // CHUNK))))
    first = F.col("__chunk") * CHUNK
    last = F.least(first + (CHUNK - 1), F.lit(n_sims - 1))
    return (chunks.repartition(key, "__chunk")
            .withColumn("sim_id", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).drop("__chunk"))


def scenario_games(schedule: DataFrame, n_sims: int, noise: Callable[[Column, Column], Column] | None = None,
                   sigma: Column | float = 12.0, biases: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Draw a margin for every game and scenario from ``expected_margin``.

    ``noise(game_id, sim_id)`` gives the standard draw (default: normal numbers from ``seed``); ``biases``
    (sim_id, team, bias) shifts the expectation per scenario.
    """
    out = fan_out(schedule, n_sims)
    expected = F.col("expected_margin")
    if biases is not None:
        home = biases.select("sim_id", "team", F.col("bias").alias("__h"))
        away = biases.select("sim_id", F.col("team").alias("opponent"), F.col("bias").alias("__a"))
        out = out.join(home, ["sim_id", "team"], "left").join(away, ["sim_id", "opponent"], "left")
        expected = expected - F.coalesce("__h", F.lit(0.0)) + F.coalesce("__a", F.lit(0.0))
        out = out.withColumn("expected_margin", expected).drop("__h", "__a")
    draw = F.randn(seed) if noise is None else noise(F.col("game_id"), F.col("sim_id"))
    spread = F.lit(float(sigma)) if isinstance(sigma, (int, float)) else sigma
    return out.withColumn("margin", F.col("expected_margin") + spread * draw)


def _per_sim(df: DataFrame, n_sims: int) -> DataFrame:
    return df.withColumn("sim_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_sims - 1).cast("bigint"))))


def scenario_pairs(played: DataFrame, scenarios: DataFrame, n_sims: int) -> DataFrame:
    """Pair table per scenario: real games are aggregated once and only their pair totals are repeated."""
    columns = ["sim_id", "team", "rival", "wins", "losses", "games", "net"]
    real = _per_sim(records.pair_table(played), n_sims).select(*columns)
    drawn = records.pair_table(scenarios, ["sim_id"]).select(*columns)
    return real.unionByName(drawn).groupBy("sim_id", "team", "rival").agg(
        *[F.sum(c).alias(c) for c in columns[3:]])


def scenario_records(played: DataFrame, scenarios: DataFrame, n_sims: int) -> DataFrame:
    """Season wins and losses per scenario and side."""
    real = _per_sim(records.team_records(played), n_sims).select("sim_id", "team", "wins", "losses")
    drawn = records.team_records(scenarios, ["sim_id"])
    return real.unionByName(drawn).groupBy("sim_id", "team").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def remaining_series_games(series: DataFrame) -> DataFrame:
    """Games a series still needs, three days apart.  Input: label, host, guest, wins, losses, last_date."""
    wins, losses = F.col("wins"), F.col("losses")
    needed = games_needed(wins, losses)
    played = wins + losses
    numbers = F.when(needed > 0, F.sequence(F.lit(1), needed)).otherwise(F.array().cast("array<int>"))
    out = series.withColumn("step", F.explode(numbers)).withColumn("game_num", (played + F.col("step")).cast("int"))
    at_home = F.element_at(F.array(*[F.lit(x) for x in HOST_AT_HOME]), F.col("game_num"))
    return out.select(
        *[c for c in series.columns if c not in ("host", "guest", "wins", "losses", "last_date")], "game_num",
        F.when(at_home, F.col("host")).otherwise(F.col("guest")).alias("team"),
        F.when(at_home, F.col("guest")).otherwise(F.col("host")).alias("opponent"),
        F.date_add("last_date", (F.col("step") * DAYS_BETWEEN).cast("int")).alias("date"))


Draw = Callable[[Column, Column, Column, Column, int], Column]


def best_of_seven(series: DataFrame, draw: Draw) -> DataFrame:
    """Settle every series at once, with no shuffle: seven draws per row, first side to four.

    Input: sim_id, label, host, guest, and optionally host_won, guest_won for games already played.
    ``draw(sim_id, label, home, away, game_num)`` is the home margin.  Adds margins (home side's, one per
    game of the series that was drawn), series_length, winner, loser.
    """
    host_won = F.col("host_won") if "host_won" in series.columns else F.lit(0)
    guest_won = F.col("guest_won") if "guest_won" in series.columns else F.lit(0)
    before = host_won + guest_won
    margins, gains = [], []
    for i, at_home in enumerate(HOST_AT_HOME):
        home, away = ("host", "guest") if at_home else ("guest", "host")
        margins.append(draw(F.col("sim_id"), F.col("label"), F.col(home), F.col(away), i + 1))
    drawn = series.withColumn("__m", F.array(*margins))
    for i, at_home in enumerate(HOST_AT_HOME):
        margin = F.col("__m")[i]
        host_wins = margin > 0 if at_home else ~(margin > 0)
        gains.append(F.when(F.lit(i + 1) > before, host_wins.cast("int")).otherwise(0))
    counted = drawn.withColumns({f"__w{i + 1}": g for i, g in enumerate(gains)})
    running, total = {}, host_won
    for i in range(1, 8):
        total = total + F.col(f"__w{i}")
        running[i] = total
    length = F.when((host_won >= 4) | (guest_won >= 4), before)
    for i in range(4, 7):
        done = (F.lit(i) >= before) & ((running[i] == 4) | (i - running[i] == 4))
        length = length.when(done, F.lit(i))
    length = length.otherwise(F.lit(7))
    counted = counted.withColumns({"series_length": length.cast("int"), "__won": running[7]})
    # host wins when it reaches four within the series length
    host_total = host_won
    for i in range(1, 8):
        host_total = host_total + F.when(F.lit(i) <= F.col("series_length"), F.col(f"__w{i}")).otherwise(0)
    won = host_total >= 4
    return counted.select(
        *series.columns, F.slice("__m", (before + 1).cast("int"), (F.col("series_length") - before).cast("int")).alias("margins"),
        "series_length", F.when(won, F.col("host")).otherwise(F.col("guest")).alias("winner"),
        F.when(won, F.col("guest")).otherwise(F.col("host")).alias("loser"))


def expected_records(current: DataFrame, future: DataFrame) -> DataFrame:
    """Current record plus the win probabilities still to come.  ``future``: team, opponent, win_prob."""
    p = F.col("win_prob")
    sides = both_sides(future, {"team": F.col("team"), "w": p, "l": 1 - p},
                       {"team": F.col("opponent"), "w": 1 - p, "l": p})
    coming = sides.groupBy("team").agg(F.sum("w").alias("w"), F.sum("l").alias("l"))
    zero = F.lit(0.0)
    return current.join(coming, "team", "left").select(
        "team", (F.col("wins") + F.coalesce("w", zero)).alias("expected_wins"),
        (F.col("losses") + F.coalesce("l", zero)).alias("expected_losses"))
