"""Streams from files, run until all that is there is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from colvane.streaming.events import KeyedSink, timer, tumbling


def test_keyed_sink_and_windows(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "src")
    e.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)
    sink = KeyedSink(spark, str(tmp_path / "table"), ["user_id"], ["event_id"])
    last = []
    q = timer(stream, 0, lambda df, k: (sink(df, k), last.append(k)), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = {(r["user_id"], r["event_id"]) for r in spark.read.parquet(sink.version(max(last))).collect()}
    # of all rows of a user the last one stays, whatever batch it came in
    want = e.groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()
    assert got == {(r["user_id"], r["event_id"]) for r in want}
    windows = tumbling(stream, "ts", "1 hour", "event_type", late="1 hour")
    q = windows.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from w").first()["n"] == e.count()
