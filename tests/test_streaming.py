"""Streaming twins against the batch jobs."""

from pyspark.sql import functions as F

from duelframe.catalog.event_queries import log
from duelframe.operators import events
from duelframe.streaming import ingest, safe_lead


def test_ingest_keeps_newest_and_is_idempotent(spark, tmp_path):
    schema = "game_id string, date date, team string, opponent string, completed boolean, margin double"
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    one = spark.createDataFrame([("1", "BKN", "ATL", False, None), ("2", "CHA", "BOS", True, 4.0)],
                                "game_id string, team string, opponent string, completed boolean, margin double")
    one = one.withColumn("date", F.to_date(F.lit("2024-01-01"))).select("game_id", "date", "team", "opponent", "completed", "margin")
    one.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    ingest.start_ingest(stream(), out, ckpt).awaitTermination()
    two = one.filter("game_id = '1'").withColumns({"completed": F.lit(True), "margin": F.lit(7.0)})
    two.coalesce(1).write.mode("append").parquet(src)
    ingest.start_ingest(stream(), out, ckpt).awaitTermination()
    ingest.append_batch(two.withColumn("team", F.lit("BRK")), 1, out)  # replay of the second batch
    got = sorted((r.game_id, r.team, r.completed, r.margin) for r in ingest.current_games(spark, out).collect())
    assert got == [("1", "BRK", True, 7.0), ("2", "CHO", True, 4.0)]


def test_live_safe_leads_match_batch(spark, sf_dir, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ck")
    actions = log(spark, sf_dir).select("game", "action_number", "period", "clock", "action_type", "team_id", "score_home", "score_away").cache()
    cut = 30
    actions.filter(F.col("action_number") <= cut).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda: (safe_lead.live_safe_leads(stream, expire_ms=None).writeStream.option("checkpointLocation", ckpt).format("parquet")
                   .option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination())
    run()
    actions.filter(F.col("action_number") > cut).coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r.game: (r.cutoff_action_number, r.cutoff_period, r.cutoff_clock, r.possessions_before_cutoff, r.lead)
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.game: (r.cutoff_action_number, r.cutoff_period, r.cutoff_clock, r.possessions_before_cutoff, r.final_score_diff)
            for r in events.safe_leads(actions).filter("safe_lead").collect()}
    assert got == want and got
