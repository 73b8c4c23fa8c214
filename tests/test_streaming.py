from pyspark.sql import functions as F

from skirmish.streaming import events as E


def test_windows_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"2026-01-0{1 + i // 4} 00:30:00", "kill", 1.0) for i in range(8)], "event_id long, t string, event_type string, value double")
    rows = rows.select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = E.window_counts(E.read_events(spark, str(tmp_path / "in"), rows.schema))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["events"] for r in spark.table("counts").collect()) == [4, 4]
    once = E.first_seen(E.read_events(spark, str(tmp_path / "in"), rows.schema), ["event_id"])
    q = once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 5
