"""Streaming twin of safe-lead detection: one small state per running game."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalar as S
from ..operators.events import MAX_MINUTES

OUTPUT = ("game bigint, cutoff_action_number bigint, cutoff_period int, cutoff_clock string, "
          "possessions_before_cutoff bigint, lead int")
_STATE = "held bigint, home bigint, away bigint, changes bigint, fired boolean"
EXPIRE_MS = 6 * 3600 * 1000


def live_safe_leads(actions: DataFrame, max_minutes: float = MAX_MINUTES, expire_ms: int | None = EXPIRE_MS) -> DataFrame:
    """Emits one row when a game's lead first becomes safe.  Actions of a game must arrive in order.

    State goes away after ``expire_ms`` without actions.  Pass None for a replay that should stop by itself:
    a processing-time expiry keeps the query alive.
    """
    clock = S.clock_seconds(F.col("clock"))
    ready = actions.select(
        F.col("game").cast("bigint"), F.col("action_number").cast("bigint"), F.col("period").cast("int"), "clock",
        F.col("team_id").cast("bigint").alias("team_id"),
        S.possession_owner(F.col("action_type"), F.col("team_id")).cast("bigint").alias("claims"),
        (S.score_value(F.col("score_home")) - S.score_value(F.col("score_away"))).cast("int").alias("lead"),
        S.seconds_remaining(F.col("period"), clock).alias("remaining"), S.minutes_elapsed(F.col("period"), clock).alias("elapsed"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, home, away, changes, fired = state.get if state.exists else (None, None, None, 0, False)
        rows = pd.concat(list(batches)).sort_values("action_number")
        hit = None
        for r in rows.itertuples():
            if not pd.isna(r.team_id):
                team = int(r.team_id)
                home = team if home is None else home
                away = team if away is None and team != home else away
            if not pd.isna(r.claims):
                claims = int(r.claims)
                changes += held is not None and claims != held
                held = claims
            leader = home if r.lead > 0 else away
            edge = 0.0 if held is None or r.lead == 0 else (0.5 if held == leader else -0.5)
            effective = max(0.0, r.lead + edge)
            if not fired and effective ** 2 > r.remaining and r.elapsed <= max_minutes:
                fired = True
                hit = (key[0], r.action_number, r.period, r.clock, changes, abs(r.lead))
        state.update((held, home, away, changes, fired))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        columns = ["game", "cutoff_action_number", "cutoff_period", "cutoff_clock", "possessions_before_cutoff", "lead"]
        yield pd.DataFrame([hit] if hit else [], columns=columns)

    expiry = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return ready.groupBy("game").applyInPandasWithState(step, OUTPUT, _STATE, "append", expiry)
