"""Conference order with tie-breaks.

All statistics are distributed aggregates.  Ties are settled as sets: all tied sets of all keys are split at once, by the
first rule that separates their members, until every set holds one side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import materialize
from . import records


def criteria(pairs: DataFrame, teams: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One row per side with every tie-break value, and the head-to-head pair table.

    ``pairs`` comes from ``records.pair_table``: sides squared per key, and all that is read from here on.
    """
    pairs = materialize(pairs)
    stats = records.with_division_winner(records.tiebreak_stats(pairs, teams, keys), keys)
    top = records.conference_top(stats, keys).select(*keys, F.col("team").alias("rival"),
                                                     F.col("conference").alias("rival_conference"))
    against = (pairs.join(top, [*keys, "rival"]).groupBy(*keys, "team", "rival_conference")
               .agg(F.sum("wins").alias("w")))
    split = (stats.select(*keys, "team", "conference").join(against, [*keys, "team"])
             .groupBy(*keys, "team")
             .agg(F.sum(F.when(F.col("rival_conference") == F.col("conference"), F.col("w"))).alias("own_wins"),
                  F.sum(F.when(F.col("rival_conference") != F.col("conference"), F.col("w"))).alias("other_wins")))
    level = W.partitionBy(*keys, "conference", "wins")
    table = (stats.join(split, [*keys, "team"], "left").fillna(0, ["own_wins", "other_wins"])
             .withColumn("tied", F.count(F.lit(1)).over(level))
             .withColumn("coin", F.xxhash64(*keys, "team")))
    return materialize(table), pairs


def _two_way(table: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    level = [*keys, "conference", "wins"]
    values = ["team", "division", "division_winner", "conference_wins", "own_wins", "other_wins", "net_points", "coin"]
    two = table.filter(F.col("tied") == 2).select(*level, *values)
    packed = two.groupBy(*level).agg(F.sort_array(F.collect_list(F.struct(*values))).alias("p"))
    ab = packed.select(*level, F.col("p")[0].alias("a"), F.col("p")[1].alias("b"),
                       F.col("p")[0]["team"].alias("team"), F.col("p")[1]["team"].alias("rival"))
    met = pairs.select(*keys, "team", "rival", (F.col("wins") - F.col("losses")).alias("h2h"))
    ab = ab.join(met, [*keys, "team", "rival"], "left")
    edge = lambda name: F.col(f"a.{name}") - F.col(f"b.{name}")
    same_division = F.col("a.division") == F.col("b.division")
    steps = [F.coalesce(F.col("h2h"), F.lit(0)),
             F.when(same_division, F.col("a.division_winner").cast("int") - F.col("b.division_winner").cast("int"))
             .otherwise(0),
             edge("conference_wins"), edge("own_wins"), edge("other_wins"), edge("net_points")]
    signs = [F.signum(s.cast("double")) for s in steps]
    choice = F.when(F.col("a.coin") < F.col("b.coin"), F.lit(1.0)).otherwise(F.lit(-1.0))
    decided = F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in signs])
    verdict = F.coalesce(decided, choice)
    return ab.select(*level, "team", "rival",
                     F.when(verdict > 0, F.col("team")).otherwise(F.col("rival")).alias("first_team"),
                     decided.isNotNull().alias("decided"))


def two_way_ties(games: DataFrame, teams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Better side of every two-way tie; null where only a coin could settle it."""
    table, pairs = criteria(records.pair_table(games, keys), teams, keys)
    out = _two_way(table, pairs, keys)
    return out.select(*keys, "conference", "wins", F.when(F.col("decided"), F.col("first_team")).alias("first_team"))


def order_tied(members: list[dict]) -> list:
    """Best-to-worst order of one tied group, plainly; what ``refined`` does for all groups at once is held against it.

    A rule that separates anyone restarts on each part.
    """
    if len(members) <= 1:
        return [m["team"] for m in members]
    names = [m["team"] for m in members]

    def met(m, what):
        return sum(m[what].get(n, 0) for n in names if n != m["team"])

    counts = {m["games"].get(n, 0) for m in members for n in names if n != m["team"]}
    balanced = len(counts) == 1 and 0 not in counts
    division = lambda m: int(m["division_winner"])
    direct = lambda m: met(m, "h2h")
    later = [lambda m, c=c: m[c] for c in ("conference_wins", "own_wins", "other_wins", "net_points")]
    if len(members) == 2:
        same = members[0]["division"] == members[1]["division"]
        rules = [direct] + ([division] if same else []) + later
    else:
        rules = [division] + ([direct] if balanced else []) + later
    for rule in rules:
        scores = {}
        for m in members:
            scores.setdefault(rule(m), []).append(m)
        if len(scores) > 1:
            return [t for s in sorted(scores, reverse=True) for t in order_tied(scores[s])]
    return [m["team"] for m in sorted(members, key=lambda m: m["coin"])]


def refined(state: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One step of the fixed point: every set of tied sides (one ``place`` in a conference) is split by the first rule that
    separates any of its members, or by the coin where none does.

    Rules look at the set as it is, so a set that was split starts over with all of them.
    """
    group = [*keys, "conference", "place"]
    whole = W.partitionBy(*group)
    tied = state.withColumn("size", F.count(F.lit(1)).over(whole))
    open_sets = tied.filter("size > 1")
    side = open_sets.select(*group, "team")
    rival = open_sets.select(*keys, F.col("conference").alias("rc"), F.col("place").alias("rp"), F.col("team").alias("rival"))
    met = (pairs.select(*keys, "team", "rival", "wins", "games").join(side, [*keys, "team"]).join(rival, [*keys, "rival"])
           .filter((F.col("conference") == F.col("rc")) & (F.col("place") == F.col("rp"))).groupBy(*group, "team")
           .agg(F.sum("wins").alias("direct"), F.count(F.lit(1)).alias("rivals"), F.min("games").alias("fewest"), F.max("games").alias("most")))
    full = tied.join(met, [*group, "team"], "left").fillna(0, ["direct", "rivals", "fewest", "most"])
    even = ((F.min("rivals").over(whole) == F.col("size") - 1) & (F.min("fewest").over(whole) == F.max("most").over(whole))
            & (F.min("fewest").over(whole) > 0))
    same_division = F.min("division").over(whole) == F.max("division").over(whole)
    winner, direct = F.col("division_winner").cast("int"), F.col("direct")
    first = F.when(F.col("size") == 2, direct).otherwise(winner)
    second = F.when(F.col("size") == 2, F.when(same_division, winner).otherwise(0)).otherwise(F.when(even, direct).otherwise(0))
    rules = [first, second, F.col("conference_wins"), F.col("own_wins"), F.col("other_wins"), F.col("net_points")]
    names = [f"rule_{k}" for k in range(len(rules))]
    full = full.withColumns({n: r.cast("double") for n, r in zip(names, rules)})
    separates = [F.min(n).over(whole) != F.max(n).over(whole) for n in names]
    full = full.withColumns({f"{n}_splits": s for n, s in zip(names, separates)})
    value = F.coalesce(*[F.when(F.col(f"{n}_splits"), F.col(n)) for n in names])
    order = W.partitionBy(*group).orderBy(F.col("value").desc_nulls_last(), F.when(F.col("value").isNull(), F.col("coin")))
    placed = full.withColumn("value", value).withColumn("step", F.rank().over(order) - 1)
    return placed.withColumn("place", (F.col("place") + F.col("step")).cast("int")).select(*state.columns)


def standings(games: DataFrame, teams: DataFrame, keys: Sequence[str] = ("sim_id",)) -> DataFrame:
    """Seed of every side in its conference, for every key at once."""
    return standings_from_pairs(records.pair_table(games, keys), teams, keys)


def standings_from_pairs(pairs: DataFrame, teams: DataFrame, keys: Sequence[str] = ("sim_id",)) -> DataFrame:
    """Sets of sides with equal wins, refined until each holds one side: as many steps as the deepest tie needs."""
    keys = list(keys)
    table, pairs = criteria(pairs, teams, keys)
    better = W.partitionBy(*keys, "conference").orderBy(F.col("wins").desc())
    state = table.withColumn("place", F.rank().over(better).cast("int"))
    ties = state.groupBy(*keys, "conference", "place").count().filter("count > 1")
    while not ties.isEmpty():
        state = materialize(refined(state, pairs, keys))
        ties = state.groupBy(*keys, "conference", "place").count().filter("count > 1")
    return state.select(*keys, "conference", "team", "wins", "losses", F.col("place").alias("seed"))
