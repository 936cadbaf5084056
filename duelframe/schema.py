"""Explicit schemas and the fixed values that results depend on."""

from __future__ import annotations

# ---- fixed values -----------------------------------------------------------------------------

ABBR_CANONICAL = {"BKN": "BRK", "CHA": "CHO", "PHO": "PHX"}
ABBR_SOURCE = {"BRK": "BKN", "CHO": "CHA"}
ABBR_ALTERNATE = {"BKN": "BRK", "BRK": "BKN", "CHA": "CHO", "CHO": "CHA", "PHO": "PHX", "PHX": "PHO"}
FRANCHISE_PREDECESSOR = {"BRK": "NJN", "NOP": "NOH", "CHO": "CHA"}

# last day of the regular season, by season year
REGULAR_SEASON_END = {
    2000: "2000-04-19", 2001: "2001-04-18", 2002: "2002-04-17", 2003: "2003-04-16", 2004: "2004-04-14",
    2005: "2005-04-20", 2006: "2006-04-19", 2007: "2007-04-18", 2008: "2008-04-16", 2009: "2009-04-16",
    2010: "2010-04-14", 2011: "2011-04-13", 2012: "2012-04-26", 2013: "2013-04-17", 2014: "2014-04-16",
    2015: "2015-04-15", 2016: "2016-04-13", 2017: "2017-04-12", 2018: "2018-04-11", 2019: "2019-04-10",
    2020: "2020-08-14", 2021: "2021-05-16", 2022: "2022-04-10", 2023: "2023-04-09", 2024: "2024-04-14",
    2025: "2025-04-13", 2026: "2026-04-12",
}

DIVISIONS = {
    "Atlantic": ["BOS", "TOR", "BRK", "PHI", "NYK"],
    "Central": ["MIL", "IND", "CHI", "DET", "CLE"],
    "Southeast": ["MIA", "ORL", "CHO", "WAS", "ATL"],
    "Northwest": ["DEN", "UTA", "POR", "OKC", "MIN"],
    "Pacific": ["LAL", "LAC", "PHX", "SAC", "GSW"],
    "Southwest": ["HOU", "DAL", "MEM", "NOP", "SAS"],
}
EAST_DIVISIONS = ("Atlantic", "Central", "Southeast")

# bracket label -> (round, round order, conference)
SERIES_LABELS = {
    "E_1_8": ("R1", 1, "East"), "E_4_5": ("R1", 1, "East"), "E_2_7": ("R1", 1, "East"), "E_3_6": ("R1", 1, "East"),
    "W_1_8": ("R1", 1, "West"), "W_4_5": ("R1", 1, "West"), "W_2_7": ("R1", 1, "West"), "W_3_6": ("R1", 1, "West"),
    "E_1_4": ("CONF_SEMIS", 2, "East"), "E_2_3": ("CONF_SEMIS", 2, "East"),
    "W_1_4": ("CONF_SEMIS", 2, "West"), "W_2_3": ("CONF_SEMIS", 2, "West"),
    "E_1_2": ("CONF_FINALS", 3, "East"), "W_1_2": ("CONF_FINALS", 3, "West"),
    "Finals": ("FINALS", 4, "Inter"),
}

HCA_PRIOR = 2.5
HCA_PRIOR_WEIGHT = 20.0
GAME_SCORE_HCA = 3.5
GAME_SCORE_PRIOR_WEIGHT = 5.0
RATING_DAY_CAP = 200
REST_CAP = 10
DEFAULT_PACE = 100.0
SEASON_GAMES = 82

# ---- feature names ----------------------------------------------------------------------------

MODEL_FEATURES = [
    "team_rating", "opponent_rating", "rating_diff",
    "team_win_total_future", "opponent_win_total_future",
    "last_year_team_rating", "last_year_opp_rating", "last_year_rating_diff",
    "num_games_into_season",
    "team_last_10_rating", "opponent_last_10_rating", "last_10_rating_diff",
    "team_last_5_rating", "opponent_last_5_rating", "last_5_rating_diff",
    "team_last_3_rating", "opponent_last_3_rating", "last_3_rating_diff",
    "team_last_1_rating", "opponent_last_1_rating", "last_1_rating_diff",
    "team_days_since_most_recent_game", "opponent_days_since_most_recent_game",
    "hca", "playoff",
    "rating_x_season", "win_total_ratio", "trend_1v10_diff", "win_total_change_diff", "rating_product",
    "team_bayesian_gs", "opp_bayesian_gs", "bayesian_gs_diff",
]
NOISE_FEATURES = ["team_win_total_future", "opponent_win_total_future", "last_year_team_rating", "last_year_opp_rating"]

_BOX = ["fgm", "fga", "fg_pct", "fg3m", "fg3a", "fg3_pct", "ftm", "fta", "ft_pct", "oreb", "dreb", "reb",
        "ast", "stl", "blk", "tov", "pf"]
_ADVANCED = ["off_rating", "def_rating", "net_rating", "efg_pct", "ts_pct", "tov_pct", "oreb_pct", "dreb_pct",
             "ast_pct", "ast_to"]
BOX_COLUMNS = _BOX + [f"opp_{c}" for c in _BOX] + _ADVANCED + [f"opp_{c}" for c in _ADVANCED]
BOX_REQUIRED = ["fgm", "off_rating", "opp_fgm", "opp_off_rating"]

GAME_COLUMNS = ["game_id", "date", "team", "opponent", "team_name", "opponent_name", "team_score",
                "opponent_score", "margin", "location", "pace", "completed", "year"]
SAFE_LEAD_COLUMNS = ["garbage_time_detected", "garbage_time_cutoff_period", "garbage_time_cutoff_clock",
                     "garbage_time_cutoff_action_number", "garbage_time_possessions_before_cutoff"]
PLAYOFF_GAME_COLUMNS = ["sim_id", "year", "round", "conference", "series_label", "high_seed", "low_seed",
                        "high_seed_num", "low_seed_num", "series_winner", "series_loser", "series_length",
                        "game_num", "home", "away", "margin", "winner"]

# ---- schemas (DDL text: usable before a session exists) ----------------------------------------------------------------------------------

# as stored: dates stay text until parsed, because files mix formats
GAME_FILE_SCHEMA = (
    "game_id string, date string, team string, opponent string, team_name string, opponent_name string, "
    "team_score double, opponent_score double, margin double, location string, pace double, "
    "completed boolean, year int, garbage_time_detected boolean, garbage_time_cutoff_period int, "
    "garbage_time_cutoff_clock string, garbage_time_cutoff_action_number int, "
    "garbage_time_possessions_before_cutoff int, counts_toward_record string"
)

_SIDE = "struct<teamTricode:string,teamName:string,score:int>"
SCHEDULE_SCHEMA = (
    "leagueSchedule struct<gameDates:array<struct<games:array<struct<gameId:string,gameDateUTC:string,"
    f"gameStatus:int,gameLabel:string,gameSubLabel:string,homeTeam:{_SIDE},awayTeam:{_SIDE}>>>>>"
)

ACTION_FIELDS = ["actionNumber", "clock", "period", "teamId", "teamTricode", "actionType", "subType", "descriptor",
                 "scoreHome", "scoreAway", "personId", "playerName", "description"]
ACTIONS_SCHEMA = (
    "game struct<gameId:string,actions:array<struct<actionNumber:int,clock:string,period:int,teamId:bigint,"
    "teamTricode:string,actionType:string,subType:string,descriptor:string,scoreHome:string,scoreAway:string,"
    "personId:bigint,playerName:string,description:string>>>"
)

_STATS = ("struct<fieldGoalsAttempted:double,fieldGoalsMade:double,freeThrowsAttempted:double,freeThrowsMade:double,"
          "threePointersMade:double,threePointersAttempted:double,reboundsOffensive:double,reboundsDefensive:double,"
          "assists:double,steals:double,blocks:double,turnovers:double,fieldGoalsEffectiveAdjusted:double,"
          "trueShootingPercentage:double,minutes:string>")
BOX_SCORE_SCHEMA = (
    f"game struct<gameId:string,homeTeam:struct<statistics:{_STATS}>,awayTeam:struct<statistics:{_STATS}>>"
)

PLAYOFF_GAME_SCHEMA = (
    "sim_id int, year int, round string, conference string, series_label string, high_seed string, low_seed string, "
    "high_seed_num int, low_seed_num int, series_winner string, series_loser string, series_length int, "
    "game_num int, home string, away string, margin double, winner string"
)
SIM_GAME_SCHEMA = (
    "simulation_id int, date date, team string, opponent string, margin double, team_rating double, "
    "opponent_rating double, expected_margin double"
)
