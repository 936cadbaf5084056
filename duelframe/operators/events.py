"""Play-by-play jobs: who holds the ball, when a lead became safe, pace from box scores.

An event log is cut into blocks of consecutive actions, so a very long game is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from .scan import blocked_scan, first_per_key

BLOCK_ACTIONS = 100_000
MAX_MINUTES = 45.0


def possessions_over_time(actions: DataFrame, block_actions: int = BLOCK_ACTIONS) -> DataFrame:
    """Adds ``owner`` (holder after the action) and ``changed`` (the action moved the ball to the other side)."""
    tagged = actions.withColumns({
        "__block": F.floor(F.col("action_number") / block_actions),
        "__claims": S.possession_owner(F.col("action_type"), F.col("team_id"))})
    scanned = blocked_scan(tagged, ["game"], "__block", ["action_number"],
                           last_known={"owner": F.col("__claims")}, last_before={"__held": F.col("__claims")})
    changed = F.coalesce(F.col("__claims") != F.col("__held"), F.lit(False))
    return scanned.withColumn("changed", changed).drop("__claims", "__held", "__block")


def possession_counter(actions: DataFrame, block_actions: int = BLOCK_ACTIONS) -> DataFrame:
    """``possessions``: changes of possession up to and including each action."""
    flagged = possessions_over_time(actions, block_actions).withColumns({
        "__block": F.floor(F.col("action_number") / block_actions), "__one": F.col("changed").cast("int")})
    counted = blocked_scan(flagged, ["game"], "__block", ["action_number"], sums_before={"__earlier": F.col("__one")})
    return counted.withColumn("possessions", F.col("__earlier") + F.col("__one")).drop("__block", "__one", "__earlier")


def first_two_sides(actions: DataFrame) -> DataFrame:
    """First two distinct sides to act: taken as home and away."""
    seen = actions.filter(F.col("team_id").isNotNull()).groupBy("game", "team_id").agg(
        F.min("action_number").alias("first"))
    two = first_per_key(seen, ["game"], [F.col("first"), F.col("team_id")], 2)
    return two.groupBy("game").agg(
        F.min_by("team_id", "first").alias("home_id"),
        F.when(F.count(F.lit(1)) > 1, F.max_by("team_id", "first")).alias("away_id"))


def _readable(actions: DataFrame) -> DataFrame:
    """Numeric clock and scores from the text the log carries."""
    clock = S.clock_seconds(F.col("clock"))
    home, away = S.score_value(F.col("score_home")), S.score_value(F.col("score_away"))
    return actions.withColumns({
        "lead": home - away, "remaining": S.seconds_remaining(F.col("period"), clock),
        "elapsed": S.minutes_elapsed(F.col("period"), clock)})


def safe_leads(actions: DataFrame, max_minutes: float = MAX_MINUTES, symmetric: bool = False,
               block_actions: int = BLOCK_ACTIONS) -> DataFrame:
    """Per game, the first action at which the squared effective lead exceeds the seconds left.

    The lead is the home side's unless ``symmetric``.  Games that never qualify report their final
    difference and all possession changes.
    """
    flow = _readable(possessions_over_time(actions, block_actions))
    flow = flow.join(first_two_sides(actions), "game", "left")
    leader = F.when(F.col("lead") > 0, F.col("home_id")).when(F.col("lead") < 0, F.col("away_id"))
    holds = F.when(F.coalesce(F.col("owner") == leader, F.lit(False)), F.lit(0.5)).otherwise(F.lit(-0.5))
    edge = F.when(F.col("owner").isNotNull() & (F.col("lead") != 0), holds).otherwise(F.lit(0.0))
    signed = F.abs("lead") if symmetric else F.col("lead")
    effective = F.greatest(F.lit(0.0), signed + edge)
    flow = flow.select(
        "game", "action_number", "period", "clock", "lead", "changed",
        ((effective * effective > F.col("remaining")) & (F.col("elapsed") <= max_minutes)).alias("safe"))
    first = F.when(F.col("safe"), F.col("action_number"))
    at_first = lambda c: F.min_by(F.col(c), first)
    cut = flow.groupBy("game").agg(
        F.min(first).alias("cut"), F.when(F.min(first).isNotNull(), at_first("period")).alias("cut_period"),
        F.when(F.min(first).isNotNull(), at_first("clock")).alias("cut_clock"),
        F.when(F.min(first).isNotNull(), F.abs(at_first("lead"))).alias("cut_lead"),
        F.abs(F.max_by("lead", "action_number")).alias("final_lead"))
    changes = flow.filter("changed").select("game", "action_number")
    counted = (changes.join(cut.select("game", "cut"), "game")
               .filter(F.col("cut").isNull() | (F.col("action_number") <= F.col("cut")))
               .groupBy("game").agg(F.count(F.lit(1)).alias("possessions")))
    return cut.join(counted, "game", "left").select(
        "game", F.col("cut").isNotNull().alias("safe_lead"), F.col("cut_period").alias("cutoff_period"),
        F.col("cut_clock").alias("cutoff_clock"), F.col("cut").alias("cutoff_action_number"),
        F.coalesce("possessions", F.lit(0)).cast("bigint").alias("possessions_before_cutoff"),
        F.coalesce("cut_lead", "final_lead").alias("final_score_diff"))


def score_at_cutoff(actions: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Score, margin and action count up to each game's cutoff.  ``cutoffs``: game, cutoff_action_number."""
    upto = (actions.join(cutoffs.select("game", "cutoff_action_number"), "game")
            .filter(F.col("action_number") <= F.col("cutoff_action_number")))
    home, away = S.score_value(F.col("score_home")), S.score_value(F.col("score_away"))
    last = upto.groupBy("game").agg(F.max_by(F.struct(home.alias("h"), away.alias("a")), "action_number").alias("s"),
                                    F.count(F.lit(1)).alias("total_actions"))
    return last.select("game", F.col("s.h").alias("home_score_at_cutoff"), F.col("s.a").alias("away_score_at_cutoff"),
                       (F.col("s.h") - F.col("s.a")).alias("margin_at_cutoff"), "total_actions")


def game_paces(box: DataFrame) -> DataFrame:
    """Pace per game from home and away box-score structs; flags values outside 60 to 130."""
    side = lambda own, other: S.possessions(
        F.col(f"{own}.fga"), F.col(f"{own}.fgm"), F.col(f"{own}.fta"), F.col(f"{own}.oreb"), F.col(f"{other}.dreb"),
        F.col(f"{own}.tov"))
    pace = S.game_pace(side("home", "away"), side("away", "home"), S.team_minutes(F.col("home.minutes")))
    return box.select("game_id", pace.alias("pace")).withColumn("unusual", S.unusual_pace(F.col("pace")))


def with_safe_leads(games: DataFrame, leads: DataFrame) -> DataFrame:
    """Write detection results onto completed games that lack them."""
    from .clean import write_back

    values = leads.select(
        F.col("game").alias("game_id"), F.col("safe_lead").alias("garbage_time_detected"),
        F.col("cutoff_period").alias("garbage_time_cutoff_period"), F.col("cutoff_clock").alias("garbage_time_cutoff_clock"),
        F.col("cutoff_action_number").cast("int").alias("garbage_time_cutoff_action_number"),
        F.col("possessions_before_cutoff").cast("int").alias("garbage_time_possessions_before_cutoff"))
    names = values.columns[1:]
    base = games
    for name in names:
        if name not in base.columns:
            base = base.withColumn(name, F.lit(None).cast(values.schema[name].dataType))
    waiting = base.filter(F.col("completed") & F.col("garbage_time_detected").isNull()).select("game_id")
    return write_back(base, values.join(waiting, "game_id", "left_semi"), names)
