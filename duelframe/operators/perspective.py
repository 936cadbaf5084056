"""From one row per game to one row per side, in a single pass over the input."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import HCA_PRIOR


def paired_columns(columns: Iterable[str], extra: Iterable[tuple[str, str]] = (("team_bayesian_gs", "opp_bayesian_gs"),)
                   ) -> dict[str, str]:
    """Swap map found by name: team/opponent, team_x/opponent_x, a_team_b/a_opp_b, plus ``extra`` pairs."""
    names = set(columns)
    swap: dict[str, str] = {}
    candidates = [("team", "opponent")]
    candidates += [(c, "opponent_" + c.removeprefix("team_")) for c in sorted(names) if c.startswith("team_")]
    candidates += [(c, c.replace("_team_", "_opp_")) for c in sorted(names) if "_team_" in c]
    candidates += list(extra)
    for left, right in candidates:
        if {left, right} <= names and left not in swap and right not in swap:
            swap[left], swap[right] = right, left
    return swap


def both_sides(df: DataFrame, home: dict[str, Column], away: dict[str, Column]) -> DataFrame:
    """Two output rows per input row; both dicts give the same names."""
    rows = F.array(F.struct(*[c.alias(n) for n, c in home.items()]),
                   F.struct(*[away[n].alias(n) for n in home]))
    return df.select(F.explode(rows).alias("side")).select("side.*")


def flip_perspective(df: DataFrame, hca: float = HCA_PRIOR, swap_bayesian: bool = True) -> DataFrame:
    """Each game plus its mirror: paired columns swap, margin becomes ``-margin + 2*hca``, team_win inverts.

    The neutral bayesian score pair is swapped too unless ``swap_bayesian`` is false.
    """
    swap = paired_columns(df.columns) if swap_bayesian else paired_columns(df.columns, extra=())
    home_edge = F.col("hca") if "hca" in df.columns else F.lit(float(hca))
    home = {c: F.col(c) for c in df.columns}
    away = {c: F.col(swap.get(c, c)) for c in df.columns}
    if "margin" in home:
        home["margin"] = F.col("margin").cast("double")
        away["margin"] = -F.col("margin") + 2 * home_edge
    if "team_win" in home:
        away["team_win"] = 1 - F.col("team_win")
    return both_sides(df, home, away)


def team_view(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Own-side view without any home-edge term: club, rival, is_home, margin (negated for the away side)."""
    keep = list(keep)
    home = {"club": F.col("team"), "rival": F.col("opponent"), "is_home": F.lit(True)}
    away = {"club": F.col("opponent"), "rival": F.col("team"), "is_home": F.lit(False)}
    for name in ("margin", "expected_margin"):
        if name in df.columns:
            home[f"{name}_for_club"] = F.col(name)
            away[f"{name}_for_club"] = -F.col(name)
    if "team_rating" in df.columns:
        home["rating"], away["rating"] = F.col("team_rating"), F.col("opponent_rating")
        home["rival_rating"], away["rival_rating"] = F.col("opponent_rating"), F.col("team_rating")
    for name in keep:
        home[name] = away[name] = F.col(name)
    return both_sides(df, home, away)


def all_teams(df: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Distinct sides, home or away."""
    keys = list(keys)
    side = F.explode(F.array("team", "opponent")).alias("team")
    return df.select(*keys, side).distinct()
