"""Tie-break chains on built seasons, and the bracket pieces."""

import itertools

import pytest
from pyspark.sql import functions as F

from duelframe.operators import nested, playoffs, scenarios, standings


def _member(team, h2h=None, games=None, **kw):
    base = {"team": team, "division": "d", "division_winner": False, "conference_wins": 0, "own_wins": 0, "other_wins": 0, "net_points": 0.0,
            "coin": 0, "h2h": h2h or {}, "games": games or {}}
    return {**base, **kw}


@pytest.mark.parametrize("field", ["conference_wins", "own_wins", "other_wins", "net_points"])
def test_two_way_later_rules(field):
    assert standings.order_tied([_member("A"), _member("B", **{field: 1})]) == ["B", "A"]


def test_two_way_head_to_head_first():
    a = _member("A", {"B": 1}, {"B": 3}, conference_wins=9)
    b = _member("B", {"A": 2}, {"A": 3})
    assert standings.order_tied([a, b]) == ["B", "A"]


def test_three_way_division_winner_then_restart():
    a = _member("A", {"B": 0, "C": 5}, {"B": 2, "C": 5})
    b = _member("B", {"A": 2, "C": 0}, {"A": 2, "C": 1})
    c = _member("C", division_winner=True)
    # C leads by division; A and B restart as a two-way tie decided head to head
    assert standings.order_tied([a, b, c]) == ["C", "B", "A"]


def test_three_way_balanced_and_unbalanced():
    teams = "ABC"
    even = {t: {o: 2 for o in teams if o != t} for t in teams}
    h2h = {"A": {"B": 2, "C": 2}, "B": {"A": 0, "C": 1}, "C": {"A": 0, "B": 1}}
    ms = [_member(t, h2h[t], even[t], conference_wins={"A": 0, "B": 1, "C": 2}[t]) for t in teams]
    assert standings.order_tied(ms) == ["A", "C", "B"]
    uneven = {**even, "A": {"B": 3, "C": 2}, "B": {"A": 3, "C": 2}}
    ms = [_member(t, h2h[t], uneven[t], conference_wins={"A": 0, "B": 1, "C": 2}[t]) for t in teams]
    assert standings.order_tied(ms) == ["C", "B", "A"]


def test_coin_is_repeatable():
    ms = [_member(t, coin=c) for t, c in zip("ABC", (3, 1, 2))]
    assert all(standings.order_tied(list(p)) == ["B", "C", "A"] for p in itertools.permutations(ms))


def test_standings_order(spark):
    # A, B and C all end with two wins; A beat B, B beat C, C beat A; net points decide
    rows = [("A", "B", 10.0), ("B", "C", 4.0), ("C", "A", 1.0), ("A", "D", 1.0), ("B", "D", 1.0), ("C", "D", 1.0)]
    games = spark.createDataFrame([(1, t, o, m, 0) for t, o, m in rows], "sim_id int, team string, opponent string, margin double, playoff int")
    teams = spark.createDataFrame([(t, "E", d) for t, d in zip("ABCD", "wxyz")], "team string, conference string, division string")
    got = [(r.team, r.seed) for r in standings.standings(games, teams).orderBy("seed").collect()]
    assert got == [("A", 1), ("C", 2), ("B", 3), ("D", 4)]


def _play(host_wins_pattern, host0, guest0):
    h, g, n = host0, guest0, host0 + guest0
    while max(h, g) < 4:
        if host_wins_pattern[n]:
            h += 1
        else:
            g += 1
        n += 1
    return h, n


def test_best_of_seven_with_real_games(spark):
    cases = []
    for i, bits in enumerate(itertools.product([0, 1], repeat=7)):
        for h0, g0 in ((0, 0), (1, 0), (2, 3), (3, 3), (4, 1)):
            cases.append((i, "E_1_8", "H", "G", h0, g0, list(bits)))
    df = spark.createDataFrame(cases, "sim_id int, label string, host string, guest string, host_won int, guest_won int, bits array<int>")

    def draw(sim, label, home, away, n):
        host_wins = F.get(F.col("bits"), n - 1) == 1
        at_home = scenarios.HOST_AT_HOME[n - 1]
        return F.when(host_wins if at_home else ~host_wins, F.lit(5.0)).otherwise(F.lit(-5.0))

    for r in scenarios.best_of_seven(df, draw).collect():
        h, n = _play(r.bits, r.host_won, r.guest_won)
        assert (r.series_length, r.winner) == (n, "H" if h >= 4 else "G"), r
        assert len(r.margins) == n - r.host_won - r.guest_won


def test_play_in_prefers_real_games(spark):
    seeds = spark.createDataFrame([(1, "E", i, f"T{i}") for i in range(1, 11)], "sim_id int, conference string, seed int, team string")
    real = spark.createDataFrame([("g1", "2024-04-20", "T7", "T8", -3.0)], "game_id string, date string, team string, opponent string, margin double")
    home_wins = lambda sim, label, home, away: F.lit(1.0)
    got = {r.seed: r.team for r in playoffs.play_in(seeds, home_wins, real).collect()}
    # 8 really beat 7; 9 beats 10 at home; 7 hosts 9
    assert got[7] == "T8" and got[8] == "T7" and got[1] == "T1" and len(got) == 8
    got = {r.seed: r.team for r in playoffs.play_in(seeds, home_wins).collect()}
    assert got[7] == "T7" and got[8] == "T8"


def test_malformed_series_is_skipped(spark):
    rows = [(1, "E_1_8", "2024-04-20", 1, "A", "B", 3.0), (1, "E_1_8", "2024-04-22", 2, "B", "A", 3.0),
            (1, "W_1_8", "2024-04-20", 3, "C", "D", 3.0), (1, "W_1_8", "2024-04-21", 4, "C", "E", 3.0)]
    games = spark.createDataFrame(rows, "sim_id int, playoff_label string, date string, game_id int, team string, opponent string, margin double")
    seeds = spark.createDataFrame([(1, "A", 8), (1, "B", 1)], "sim_id int, team string, seed int")
    got = nested.assemble_series(games, seeds).collect()
    assert len(got) == 1
    assert (got[0].high_seed, got[0].low_seed, got[0].series_winner, got[0].series_length) == ("B", "A", "B", 2)


def test_remaining_schedule(spark):
    df = spark.createDataFrame([("E_1_8", "H", "G", 2, 1, "2024-04-25"), ("W_1_8", "X", "Y", 4, 0, "2024-04-25")],
                               "label string, host string, guest string, wins int, losses int, last_date string").withColumn("last_date", F.to_date("last_date"))
    got = [(r.game_num, r.team, str(r.date)) for r in scenarios.remaining_series_games(df).orderBy("game_num").collect()]
    assert got == [(4, "G", "2024-04-28"), (5, "H", "2024-05-01")]


def _seasons(spark, seasons=40, sides=9, seed=5):
    """Short seasons with small margins, so that ties of many sides are common."""
    import random

    rng, games = random.Random(seed), []
    for s in range(seasons):
        names = [f"{'EW'[k % 2]}{k}" for k in range(sides)]
        for a, b in itertools.combinations(names, 2):
            for _ in range(rng.choice([1, 1, 1, 2]) if s % 3 else 1):  # every third season is balanced
                games.append((s, a, b, float(rng.choice([-2, -1, 1, 2])), 0))
    teams = [(f"{'EW'[k % 2]}{k}", "EW"[k % 2], f"d{k % 4}") for k in range(sides)]
    return (spark.createDataFrame(games, "sim_id int, team string, opponent string, margin double, playoff int"),
            spark.createDataFrame(teams, "team string, conference string, division string"))


def test_refined_sets_equal_the_plain_chain(spark):
    from duelframe.operators import records

    games, teams = _seasons(spark)
    table, pairs = standings.criteria(records.pair_table(games, ["sim_id"]), teams, ["sim_id"])
    met = {}
    for p in pairs.collect():
        met.setdefault((p.sim_id, p.team), {})[p.rival] = (p.wins, p.games)
    groups = {}
    for r in table.collect():
        m = met.get((r.sim_id, r.team), {})
        groups.setdefault((r.sim_id, r.conference), {}).setdefault(r.wins, []).append(
            {**r.asDict(), "h2h": {o: w for o, (w, _) in m.items()}, "games": {o: g for o, (_, g) in m.items()}})
    expected, sizes = {}, set()
    for (sim, conference), by_wins in groups.items():
        order = []
        for wins in sorted(by_wins, reverse=True):
            sizes.add(len(by_wins[wins]))
            order += standings.order_tied(by_wins[wins])
        expected |= {(sim, conference, t): k for k, t in enumerate(order, 1)}
    assert {2, 3, 4} <= sizes
    got = {(r.sim_id, r.conference, r.team): r.seed for r in standings.standings(games, teams).collect()}
    assert got == expected


def test_scenario_tables_are_never_broadcast(spark, sf_dir, capsys):
    """Their rows are made per scenario, so that the driver would have to hold far more than the files' sizes say."""
    from duelframe.catalog import playoff_queries
    from duelframe.operators import playoffs

    finals = spark.createDataFrame([(1, 10, 20), (2, 20, 10)], "sim_id bigint, host bigint, guest bigint")
    stats = spark.createDataFrame([(1, 10, 5, 0.0), (1, 20, 6, 0.0), (2, 20, 4, 1.0), (2, 10, 4, 2.0)],
                                  "sim_id bigint, team bigint, wins int, net_points double")
    pairs = spark.createDataFrame([(2, 20, 10, 2, 1), (2, 10, 20, 1, 2)], "sim_id bigint, team bigint, rival bigint, wins int, losses int")
    out = playoffs.finals_hosts(finals, stats, pairs)
    assert {r.sim_id: (r.host, r.guest) for r in out.collect()} == {1: (20, 10), 2: (20, 10)}
    capsys.readouterr()
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out
    playoff_queries.scenario_stats(spark, sf_dir)[1].explain()
    assert "BroadcastHashJoin [sim_id" not in capsys.readouterr().out
