"""Column expressions for single rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ..schema import (ABBR_CANONICAL, DEFAULT_PACE, REGULAR_SEASON_END, SERIES_LABELS)

SECONDS_PER_PERIOD = 720
SECONDS_PER_OVERTIME = 300
POSSESSION_ACTIONS = ("shot", "freethrow", "turnover", "violation", "timeout", "jumpball")


def lookup(column: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Value of a small constant map; unmapped keys give ``default`` (null if not given)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), column)
    return found if default is None else F.coalesce(found, default)


def canonical_abbr(column: Column) -> Column:
    return lookup(column, ABBR_CANONICAL, column)


def parse_mixed_timestamp(text: Column) -> Column:
    """First format that fits, with or without seconds' fraction and zone; naive result in UTC, null if none fits."""
    clock = "HH:mm:ss[.SSSSSS][.SSS][XXX][X]"
    formats = [f"yyyy-MM-dd'T'{clock}", f"yyyy-MM-dd {clock}", "yyyy-MM-dd", "MM/dd/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def unreadable_date(text: Column) -> Column:
    """A date is written there, but in none of the known forms."""
    return (F.trim(text) != "") & parse_mixed_timestamp(text).isNull()


def playoff_start(year: Column, ends: Mapping[int, str] = REGULAR_SEASON_END) -> Column:
    """Day after the regular season; 14 April when the year is not in the table."""
    end = lookup(year.cast("int"), {int(k): v for k, v in ends.items()}).cast("date")
    return F.coalesce(F.date_add(end, 1), F.make_date(year.cast("int"), F.lit(4), F.lit(14)))


def as_boolean(column: Column) -> Column:
    return F.lower(F.trim(column.cast("string"))) == "true"


def is_cup_final(game_id: Column, label: Column | None = None, sub_label: Column | None = None) -> Column:
    by_id = game_id.cast("string").rlike(r"^006\d{2}00001$")
    if label is None:
        return by_id
    by_label = F.coalesce(label.contains("Cup") & (sub_label == "Championship"), F.lit(False))
    return by_label | by_id


def home_win(margin: Column) -> Column:
    """Ties count for the away side."""
    return margin > 0


def winner(margin: Column, home: Column, away: Column) -> Column:
    return F.when(margin > 0, home).otherwise(away)


def clock_seconds(clock: Column) -> Column:
    """``PT11M58.00S`` -> 718.0; empty or null -> 0."""
    minutes = F.regexp_extract(clock, r"^(?:PT)?(\d+)M", 1)
    seconds = F.regexp_extract(clock, r"(\d+(?:\.\d+)?)S", 1)
    total = F.coalesce(minutes.try_cast("int"), F.lit(0)) * 60 + F.coalesce(seconds.try_cast("double"), F.lit(0.0))
    return F.coalesce(total, F.lit(0.0))


def seconds_remaining(period: Column, clock: Column) -> Column:
    return F.when(period <= 4, (4 - period) * SECONDS_PER_PERIOD + clock).otherwise(clock)


def minutes_elapsed(period: Column, clock: Column) -> Column:
    regulation = (period - 1) * SECONDS_PER_PERIOD + SECONDS_PER_PERIOD - clock
    overtime = 4 * SECONDS_PER_PERIOD + (period - 5) * SECONDS_PER_OVERTIME + SECONDS_PER_OVERTIME - clock
    return F.when(period <= 4, regulation).otherwise(overtime) / 60.0


def possession_owner(action_type: Column, team_id: Column) -> Column:
    return F.when(F.lower(action_type).isin(*POSSESSION_ACTIONS), team_id)


def score_value(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(text.cast("string")), F.lit("")).try_cast("int"), F.lit(0))


def possessions(fga: Column, fgm: Column, fta: Column, oreb: Column, rival_dreb: Column, turnovers: Column) -> Column:
    share = F.when(oreb + rival_dreb > 0, oreb / (oreb + rival_dreb)).otherwise(F.lit(0.0))
    return fga - fgm * 1.07 * share + 0.4 * fta + turnovers


def team_minutes(text: Column) -> Column:
    """``240:00``, ``PT240M00.00S`` or a number; 240 when absent or unreadable ISO text."""
    iso = F.coalesce(F.regexp_extract(text, r"^PT(\d+)M", 1).try_cast("double"), F.lit(240.0))
    colon = (F.try_element_at(F.split(text, ":"), F.lit(1)).try_cast("double")
             + F.try_element_at(F.split(text, ":"), F.lit(2)).try_cast("double") / 60.0)
    return (F.when(text.isNull() | (text == ""), F.lit(240.0))
            .when(text.startswith("PT"), iso)
            .when(text.contains(":"), colon)
            .otherwise(text.try_cast("double")))


def game_pace(possessions_home: Column, possessions_away: Column, minutes: Column) -> Column:
    return 48 * ((possessions_home + possessions_away) / 2) / (minutes / 5)


def unusual_pace(pace: Column) -> Column:
    return (pace < 60) | (pace > 130)


def pace_or_default(pace: Column, default: float = DEFAULT_PACE) -> Column:
    return F.coalesce(pace, F.lit(float(default)))


def series_round(label: Column) -> Column:
    known = lookup(label, {k: v[0] for k, v in SERIES_LABELS.items()})
    return F.coalesce(F.when(label.contains("_P_"), F.lit("PLAY_IN")), known,
                      F.raise_error(F.concat(F.lit("unknown series label: "), label)).cast("string"))


def series_round_order(label: Column) -> Column:
    known = lookup(label, {k: v[1] for k, v in SERIES_LABELS.items()})
    return F.coalesce(F.when(label.contains("_P_"), F.lit(0)), known)


def series_conference(label: Column) -> Column:
    return (F.when(label == "Finals", F.lit("Inter"))
            .when(label.startswith("E"), F.lit("East"))
            .when(label.startswith("W"), F.lit("West"))
            .otherwise(F.raise_error(F.concat(F.lit("unknown series label: "), label)).cast("string")))


def games_needed(wins: Column, losses: Column) -> Column:
    """Least number of games left in a best-of-seven; 0 when decided."""
    return F.when((wins >= 4) | (losses >= 4), F.lit(0)).otherwise(4 - F.greatest(wins, losses))


def season_label(year: Column) -> Column:
    return F.concat((year - 1).cast("string"), F.lit("-"), F.lpad((year % 100).cast("string"), 2, "0"))


def game_label(is_home: Column, rival: Column) -> Column:
    return F.concat_ws(" ", F.when(is_home, F.lit("vs")).otherwise(F.lit("@")), rival.cast("string"))


def game_edge(neutral: Column, hca: Column) -> Column:
    return F.when(neutral, F.lit(0.0)).otherwise(hca)


def record_text(wins: Column, losses: Column) -> Column:
    return F.concat_ws("-", wins.cast("string"), losses.cast("string"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def pair_key(a: Column, b: Column) -> Column:
    """Same value for (a, b) and (b, a)."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
