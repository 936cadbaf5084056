"""Blocked scans and exact percentiles against plain computations, with a hot key."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from duelframe.functions.stats import exact_percentiles, histogram, value_buckets
from duelframe.operators.scan import blocked_scan, first_per_key


def _skewed(n=3000, seed=5):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.3, np.nan, rng.integers(-9, 9, n))
    return pd.DataFrame({"k": key, "day": rng.integers(0, 12, n), "id": np.arange(n), "v": value})


def test_blocked_scan_matches_pandas(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    out = blocked_scan(df, ["k"], "day", ["id"], position="pos", sums_before={"s": F.col("v")},
                       last_known={"seen": F.col("v")}, last_before={"before": F.col("v")}).toPandas()
    out = out.sort_values(["k", "day", "id"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "day", "id"]).reset_index(drop=True)
    g = want.groupby("k")
    assert (out["pos"] == g.cumcount() + 1).all()
    filled = want["v"].fillna(0)
    assert np.allclose(out["s"], filled.groupby(want["k"]).cumsum() - filled)
    seen = g["v"].ffill()
    assert np.allclose(out["seen"].astype(float), seen, equal_nan=True)
    assert np.allclose(out["before"].astype(float), seen.groupby(want["k"]).shift(1), equal_nan=True)


def test_exact_percentiles(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.where(rng.random(4000) < 0.5, 0, rng.integers(1, 30, 4000)), "x": rng.normal(0, 100, 4000).round(1)})
    pdf.loc[pdf.k == 3, "x"] = 7.0
    out = exact_percentiles(spark.createDataFrame(pdf), ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.93}, buckets=16).toPandas().set_index("k")
    for k, x in pdf.groupby("k")["x"]:
        assert np.allclose(out.loc[k, ["a", "b", "c"]].astype(float), np.percentile(x, [10, 50, 93]))
    whole = exact_percentiles(spark.createDataFrame(pdf), [], "x", {"a": 0.37}, buckets=8).first()[0]
    assert np.isclose(whole, np.percentile(pdf.x, 37))


def test_percentiles_with_one_extreme_value(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, 1e12]})
    out = exact_percentiles(spark.createDataFrame(pdf), [], "x", {"a": 0.5, "b": 0.9, "c": 1.0, "d": 0.0}).first()
    assert np.allclose(list(out), np.percentile(pdf.x, [50, 90, 100, 0]))


def test_extreme_values_leave_buckets_even(spark):
    rng = np.random.default_rng(9)
    x = np.unique(np.concatenate([rng.normal(0, 1, 20_000), rng.normal(1e6, 1, 10_000), [1e12, -1e300]]))
    pdf = pd.DataFrame({"k": 0, "v": x, "c": 1})
    small = pd.DataFrame({"k": 1, "v": np.arange(50.0), "c": 2})
    for keys in (["k"], []):
        counts = spark.createDataFrame(pd.concat([pdf, small]) if keys else pdf)
        got = value_buckets(counts, keys, 64).toPandas()
        rows = got[got.v.isin(x) & (got.n == len(x))]
        assert rows.groupby("b").size().max() <= 2 * len(x) / 64 and rows.sort_values("v").b.is_monotonic_increasing
        assert len(got) == counts.count() and (got[got.n == 100].b == 0).all()
    out = exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.25, "b": 0.6667, "c": 0.99995}, buckets=64).first()
    assert np.allclose([out.a, out.b, out.c], np.percentile(x, [25, 66.67, 99.995]))


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert [tuple(r) for r in histogram(df, "x", 10).collect()] == [(0, 4)]


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 5)], "k int, v int")
    assert sorted(tuple(r) for r in first_per_key(df, ["k"], [F.col("v")]).collect()) == [(1, 1), (2, 5)]


def test_a_day_with_all_games_is_many_blocks(spark):
    from duelframe.operators.history import game_position
    from duelframe.operators.scan import IDS_PER_BLOCK, day_block

    df = spark.range(60_000).select(F.col("id").alias("game_id"), F.lit(2000).alias("year"), F.lit("2000-01-01").cast("date").alias("date"))
    cells = df.groupBy(day_block(df).alias("b")).count().collect()
    assert max(r["count"] for r in cells) == IDS_PER_BLOCK and len(cells) == 6
    assert game_position(df).where("game_number <> game_id + 1").count() == 0


def test_possessions_do_not_depend_on_the_block_size(spark, sf_dir):
    from duelframe.catalog.event_queries import log
    from duelframe.operators.events import possession_counter

    small, default = (possession_counter(log(spark, sf_dir), **size) for size in ({"block_actions": 20}, {}))
    assert small.exceptAll(default).count() == 0 and small.count() == default.count()


def test_season_edges_leave_the_games_where_they_are(spark, capsys):
    """Joined by sorting, all games of a season would be read by one task."""
    from duelframe.operators import history

    games = spark.createDataFrame([(1, 2000, 3.0, 1.0, 0.0), (2, 2001, -2.0, 0.0, 0.0)],
                                  "game_id int, year int, margin double, team_rating double, opponent_rating double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        for known in (games.select("year", games["margin"].alias("hca")), games.limit(0).select("year", games["margin"].alias("hca"))):
            history.with_home_edge(games, known).explain()
            text = capsys.readouterr().out
            assert "BroadcastHashJoin [year" in text and "SortMergeJoin" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
