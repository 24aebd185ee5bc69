"""A stream gives what the batch gives, once its watermark has passed."""

from pyspark.sql import functions as F

from quillframe.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    made = windows.tumbling(stream, "ts", "1 day", ["event_type"], [F.count("*").alias("n")], late="1 day")
    windows.run_once(made, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = windows.tumbling(events, "ts", "1 day", ["event_type"], [F.count("*").alias("n")])
    want = {(r.start, r.event_type): r.n for r in batch.collect()}
    assert got
    assert all(want[k] == n for k, n in got.items())


def test_state_over_a_stream(spark, tmp_path):
    from quillframe.streaming import state

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("ts").repartition(4)
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.event_type] = (r.n, round(r.total, 4))

    run = state.running_totals(stream, "event_type", "value").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination()
    want = {r.event_type: (r.n, round(r.total, 4)) for r in state.running_totals(events, "event_type", "value").collect()}
    assert seen == want


def test_late_rows_are_dropped_and_others_counted(spark, tmp_path):
    """A row counts as late against the watermark with which the batch before ended."""
    import time
    from datetime import datetime

    schema = "ts timestamp, k string"
    at = lambda *hm: datetime(2024, 1, 1, *hm)
    for k, rows in enumerate([[(at(1, 0), "a"), (at(5, 0), "a")], [(at(4, 50), "a")], [(at(1, 10), "late"), (at(9, 0), "a")], [(at(9, 1), "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = windows.tumbling(stream, "ts", "1 hour", ["k"], [F.count("*").alias("n")], late="30 minutes")
    windows.run_once(made, str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.start, r.k): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(at(1), "a"): 1, (at(4), "a"): 1, (at(5), "a"): 1}


def test_streams_join_within_a_time(spark, tmp_path):
    from quillframe.streaming import joins

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    views = events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    clicks = events.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("other_ts"))
    for name, d in (("views", views), ("clicks", clicks)):
        d.coalesce(1).write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(d.schema).parquet(str(tmp_path / name)) for name, d in (("views", views), ("clicks", clicks))]
    pairs = joins.within(*streams, ["user_id"], "ts", "other_ts", "2 days", "1 hour", late="1 day").select("event_id", "other")
    windows.run_once(pairs, str(tmp_path / "out"), str(tmp_path / "check"))
    want = joins.within(views, clicks, ["user_id"], "ts", "other_ts", "2 days", "1 hour").select("event_id", "other")
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(want.collect()) != []


def test_sources_of_streams(spark):
    from quillframe.streaming import joins

    assert joins.rate(spark, 5).isStreaming
