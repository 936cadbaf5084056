"""Headline queries, timed once each after a warm-up.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "team_records", "standings_by_wins", "side_history_features", "model_features", "bias_prior", "bias_posterior",
    "season_em_ratings", "point_in_time_ratings", "schedule_adjusted_efficiencies", "safe_lead_detection",
    "season_report", "scenario_season_records", "standings_with_tiebreaks", "bracket_outcomes", "kalman_bias_pass",
    "smoothed_residual_spread", "predictive_ratings", "round_odds",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from duelframe.catalog import QUERIES
    from duelframe.session import build_session

    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up: JIT, file metadata and Python workers
    for name in ("team_records", "season_em_ratings"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
